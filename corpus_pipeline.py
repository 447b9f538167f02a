"""From raw documents to tokens: quality, near-duplicates, contamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on every row that the one before kept and returns a DataFrame; ``run`` writes
what each stage returns to the shared folder and reads it again for the next, so that a lost executor costs one stage at most.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitflow.llm import bpe, decontam, minhash, pii, quality
from orbitflow.llm.common import Scratch, bounded
from orbitflow.llm.queries import RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least similarity of near-duplicates in hundredths.
NEAR = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; null texts and metadata have features of their own, so each row is judged, and without labels all stay."""
    bounded(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id. Rows of one doc_id and text are one document, with the source and language of any of them."""
    bounded(spark)
    kept = minhash.classes(docs, least=NEAR).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    some = docs.select(*COLUMNS)
    return some.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(some.where("doc_id IS NULL"))


def untainted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and blank texts hold none and stay, as do all without items."""
    bounded(spark)
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts stay null, and every row stays."""
    bounded(spark)
    found = pii.find(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("spans")))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them; a null text is the empty text."""
    bounded(spark)
    import public_tokenizers

    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path(RANKS))
    return bpe.digests(docs.select("doc_id", "text"), vocabulary, ids=True).drop("text")


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", untainted), ("personal_data", private), ("byte_bpe", tokens)]
#: SQL expresses neither the trained classifier nor the tokenizer; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage's operators and the stage before have in the shared folder goes once the stage is written."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = Scratch.mark()
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        Scratch.release(mark)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
