"""Licence scanning by diagonal voting, in DataFrame functions only.

Words of the templates (phrases, short statements, whole licence texts) and of every text are cut into rolling k-grams (k = 2, the length of the shortest phrase). An
equi-join of gram hashes (and the grams themselves, so that a collision of hashes cannot vote) gives a vote for each
(text position, template position) pair; votes with the same difference lie on one diagonal. Neighbouring diagonals of a
template, which an inserted or lost word tears apart, are merged; a merged run is verified by the share of the template's
grams that it holds. Phrases are matched if one diagonal holds all their grams without a gap, that is, if the words stand
there one after another. In statements and licence texts grams of two very common words do not vote, as they would stand on every diagonal.

The templates are a fixed list and are broadcast (some thousand rows). Texts are read once; what is shuffled is one
row for each document and hits, which are few. A text's grams are never gathered again.

Defined results: a null text is the empty text (no words); each row gives one row, also when rows or doc_ids repeat or
doc_id is null; extra columns are ignored. A run that holds exactly ``ENOUGH`` of a template counts; the score is that of the best run, 0 without any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitflow.llm.license_texts import STATEMENTS, TEXTS

K = 2
#: Diagonals at most this far apart are neighbours, if their votes are near in the text as well.
SLACK = 3
NEAR = 12
#: Share of a notice's grams that verifies it.
ENOUGH = 0.75
# Phrases of the contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Words of which two in a row do not vote for statements and licence texts.
COMMON = frozenset("a an and any are as at be by for from in is it may no not of on or that the this to under with you your".split())
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates(spark: SparkSession) -> DataFrame:
    """template, label, phrase (whether it is one of the contract's), tpos, size (grams that vote) and gram."""
    rows = []
    for i, (words, label, phrase) in enumerate([*((p, x, True) for p, x in PHRASES.items()), *((p, x, False) for p, x in STATEMENTS + TEXTS)]):
        w = words.split()
        own = [j for j in range(len(w) - K + 1) if phrase or not COMMON.issuperset(w[j : j + K])]
        rows += [(i, label, phrase, j, len(own), " ".join(w[j : j + K])) for j in own]
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, tpos int, size int, tgram string")


def _votes(df: DataFrame, text: str) -> DataFrame:
    """Row 0 of each document holds its number of words; further rows are votes (pos is the word's place from 1)."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(low, SEPARATORS, -1), lambda w: w != "")
    docs = df.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words.alias("w"))
    places = F.when(F.size("w") >= K, F.sequence(F.lit(0), F.size("w") - K)).otherwise(F.array().cast("array<int>"))
    w = F.col("w")
    grams = F.transform(places, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(K)]))
    lines = docs.select("row_id", "doc_id", F.posexplode(F.concat(F.array(F.size("w").cast("string")), grams)).alias("pos", "gram"))
    hashed = lines.withColumn("h", F.xxhash64("gram"))
    known = F.broadcast(templates(df.sparkSession).withColumn("th", F.xxhash64("tgram")))
    joined = hashed.join(known, (F.col("h") == F.col("th")) & (F.col("gram") == F.col("tgram")) & (F.col("pos") > 0), "left")
    return joined.where("pos = 0 OR template IS NOT NULL").select("row_id", "doc_id", "pos", F.when(F.col("pos") == 0, F.col("gram")).alias("gram"), "template", "label", "phrase", "tpos", "size")


def spans(votes: DataFrame) -> DataFrame:
    """Verified spans of ``_votes``, and each document's row (template null). One shuffle, by document."""
    # A place of the template starts once on a diagonal, so a diagonal's votes are at most the template's grams.
    diag = votes.repartition("row_id").withColumn("diagonal", F.col("pos") - 1 - F.col("tpos"))
    by_diag = diag.groupBy("row_id", "doc_id", "template", "label", "phrase", "size", "diagonal").agg(
        F.count("*").alias("votes"), F.min(F.col("pos") - 1).alias("lo"), F.max(F.col("pos") - 1).alias("hi"), F.max("gram").alias("gram")
    )
    order = Window.partitionBy("row_id", "template").orderBy("diagonal")
    near = ~F.col("phrase") & (F.col("diagonal") - F.lag("diagonal").over(order) <= SLACK) & (F.col("lo") - F.lag("hi").over(order) <= NEAR)
    torn = by_diag.withColumn("new", F.when(near, 0).otherwise(1))
    runs = torn.withColumn("run", F.sum("new").over(order)).groupBy("row_id", "doc_id", "template", "label", "phrase", "size", "run")
    merged = runs.agg(F.sum("votes").alias("votes"), F.min("lo").cast("long").alias("start"), F.max("gram").cast("long").alias("n_words"))
    score = F.when(F.col("template").isNotNull(), F.least(F.lit(1.0), F.col("votes") / F.col("size")))
    enough = F.when(F.col("phrase"), F.col("votes") == F.col("size")).otherwise(score >= ENOUGH)
    return merged.withColumn("score", score).where(F.col("template").isNull() | enough).drop("run", "votes", "size")


def report(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    start, label = F.when(F.col("phrase"), F.col("start")), F.when(F.col("phrase"), F.col("label"))
    full = spans(_votes(df, text)).groupBy("row_id", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count(start).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    return full.drop("row_id").na.fill({"score": 0.0})
