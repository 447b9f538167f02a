"""Registered queries and the pipeline against SQL and plain versions."""

import hashlib
import os
import struct

import duckdb
import pytest
from conftest import rows_of
from fixtures import awkward, frame, plain_near

import __spark_entry__ as entry
import corpus_pipeline
from orbitflow.llm import bpe, decontam, pii, quality, queries

P = pytest.importorskip("public_tokenizers")
DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(df):
    df = df[sorted(df.columns)]
    known = df.astype(object).where(df.notna(), None)
    return sorted(repr(tuple(int(x) if isinstance(x, float) else x for x in r)) for r in known.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = entry.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(want.columns) == names
    assert plain(got.toPandas()) == plain(want)


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_quality", "op5_pii", "op6_decontamination", "op7_licenses", "op8_byte_bpe", "op10_language"])
def test_query_gives_a_row_for_each_document(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    n, docs = got.count(), spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert n == docs if name != "op6_decontamination" else n > 0


def test_pipeline_equals_its_stages_in_plain_python(spark, sf_dir):
    """Each stage on what the one before kept, decided row by row from the operators' own answers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).where("kept").collect()}
    rows = [r for r in docs.select(*DOCS).collect() if r.doc_id in good]
    alone = {i for i, _, _, keep in plain_near([(r.doc_id, r.text) for r in rows], corpus_pipeline.NEAR) if keep}
    rows = [r for r in rows if r.doc_id in alone]
    index = decontam.Index([(r.item_id, r.text) for r in bench])
    rows = [r for r in rows if not index.hits([r.text or ""])]
    clean = pii.find(spark.createDataFrame(rows, docs.select(*DOCS).schema)).select("doc_id", pii.redacted(corpus_pipeline.F.col("text"), corpus_pipeline.F.col("spans")).alias("t")).collect()
    with open(P.path(queries.RANKS), "rb") as f:
        import tiktoken

        library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    want = {}
    for r in clean:
        ids = library.encode_ordinary(r.t or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.t or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_take_awkward_rows(spark, sf_dir):
    rows = [(None, None), (None, "no id"), (None, "no id"), (1, None), (1, None), (2, ""), (3, "mail a@b.cc now"), (4, "mail a@b.cc now"), (2**60 + 1, "big"), (5, spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text)]
    docs = frame(spark, rows)
    kept = corpus_pipeline.distinct(spark, docs, sf_dir)
    assert kept.columns == DOCS and rows_of(kept.select("doc_id"))[:2] == [(1,), (2**60 + 1,)] and kept.where("doc_id IS NULL").count() == 3 and kept.where("doc_id = 4").count() == 0
    clean = corpus_pipeline.untainted(spark, docs, sf_dir)
    assert clean.columns == DOCS and clean.where("doc_id = 5").count() == 0 and clean.count() == 9
    private = corpus_pipeline.private(spark, docs, sf_dir)
    assert private.columns == DOCS and private.where("text = 'mail <email> now' AND n_chars = 16").count() == 2 and private.where("doc_id = 1 AND text IS NULL").count() == 2
    assert corpus_pipeline.good(spark, docs, sf_dir).columns == DOCS
    assert corpus_pipeline.tokens(spark, docs, sf_dir).count() == 10
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_without_labels_or_benchmark(spark, tmp_path):
    """Nothing to learn from and nothing to look for: near-duplicates alone decide, also for very long texts, ties, repeated rows and rows without id."""
    rows = awkward()
    frame(spark, rows).select(*DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {i for i, _, _, keep in plain_near(rows, 80) if keep and i is not None}
    want = [i for i, _ in {r for r in rows if r[0] in kept}] + [i for i, _ in rows if i is None]
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline_leaves_one_table(spark, tmp_path):
    """Of all that stages and operators write, only what the last stage reads stays in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:").replace("//", "/")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    frame(spark, awkward()[:20]).select(*DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    (left,) = set(os.listdir(base)) - before
    assert left.startswith("pipeline-") and [d for d in os.listdir(f"{base}/{left}") if not d.startswith(".")] == ["004-personal_data"]
    assert got.count() > 0
