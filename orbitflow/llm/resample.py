"""Importance resampling towards a target: documents are drawn by how much likelier their words are under the target than under the corpus.

*Position table.* Words become rows (document, position, word); ``lead()`` within a document puts the following words beside each, which gives every run of
one to ``ORDERS`` words; a run's CRC-32 names one of ``BUCKETS`` buckets. Texts are dealt out by row before they become words, so that the windows
need no shuffle of words, and a document's buckets leave as one row. Gains are a table of ``BUCKETS`` rows and the only thing that is broadcast.

*Draw.* The rows of highest score, Gumbel noise included, are a sample without replacement in proportion to the weights' exponentials. Their ranks come from slices of
the order by score and id: a row's rank is its number within the slice plus the rows of the slices before it. No task sorts all.

Defined results: null and empty texts have no features, weight 0 and are not drawn. Each row is a document of its own, repeated or not. A null doc_id is hashed as the empty
string and comes last among ties; equal rows draw in any order. An empty target or corpus counts 0 everywhere. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitflow.llm.common import Scratch, parts

BUCKETS, ORDERS = 10_000, 3
#: Bits of a bucket's number from 1, or of 0 for none, in a packed place.
BITS = BUCKETS.bit_length()
#: Words that a document needs to be drawn, and hundredths of such documents that are.
LEAST, SHARE = 20, 5
SEED = 42
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, letters and whatever is not ASCII; only A-Z become lower case."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def features(texts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_words and ``places``: for each word the buckets of the runs that begin with it, packed into a long (``unpacked``); a row for each row that has words.

    The number of a row only holds its words together within this job: it is made at the scan, before anything is shuffled, so a task that runs again gives
    the same. Words come to the aggregate in their order, which needs no hash table where the session replaces it (``_sorted``).
    """
    spark = texts.sparkSession
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), *keep, "text").where("text IS NOT NULL").repartition(parts(spark), "_row")
    places = rows.select("_row", *keep, F.posexplode(words(F.col("text"))).alias("_at", "_w0"))
    order = Window.partitionBy("_row").orderBy("_at")
    places = places.withColumns({f"_w{k}": F.lead("_w0", k).over(order) for k in range(1, ORDERS)})
    packed, own = F.lit(0).cast("long"), F.col("_w0")
    for k in range(ORDERS):
        own = own if k == 0 else F.concat(own, F.lit(" "), F.col(f"_w{k}"))  # null beyond the last word
        packed = packed + F.shiftleft(F.coalesce(F.crc32(own) % BUCKETS + 1, F.lit(0).cast("long")), BITS * k)
    return places.select("_row", *keep, packed.alias("_packed")).groupBy("_row").agg(*[F.first(c).alias(c) for c in keep], F.count("*").alias("n_words"), F.collect_list("_packed").alias("places")).drop("_row")


def unpacked(found: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``bucket``, a row for each feature."""
    runs = F.explode(F.array(*[F.shiftright("_packed", BITS * k).bitwiseAND((1 << BITS) - 1) - 1 for k in range(ORDERS)])).alias("bucket")
    return found.select(*keep, F.explode("places").alias("_packed")).select(*keep, runs).where("bucket >= 0")


@contextmanager
def _sorted(spark: SparkSession) -> Iterator[None]:
    """Aggregates over rows that come sorted by their keys take them as they come, within the block."""
    name = "spark.sql.execution.replaceHashWithSortAgg"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _counted(found: DataFrame, name: str) -> DataFrame:
    return unpacked(found).groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) for every bucket, from ``features`` of both sides."""
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    counts = every.join(_counted(corpus, "s"), "bucket", "left").join(_counted(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    all_of = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (t + 1) * (F.col("all_s").cast("double") + BUCKETS) / ((s + 1) * (F.col("all_t").cast("double") + BUCKETS))
    return counts.crossJoin(F.broadcast(all_of)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # one row beside each bucket


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def _ranked(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """``scored`` (score, doc_id) with ``rank`` by falling score; slices are written once, as their edges are sampled."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    slices = scratch.keep(scored.repartitionByRange(parts(scored.sparkSession), *order).withColumn("_slice", F.spark_partition_id()), "order")
    sizes = slices.groupBy("_slice").agg(F.count("*").alias("_n"))  # one row a shuffle partition
    before = sizes.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = slices.join(F.broadcast(before), "_slice").withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_slice").orderBy(*order)))
    return placed.withColumn("rank", F.when(F.col("rank") <= F.floor(F.col("_all") * SHARE / 100), F.col("rank"))).drop("_slice", "_before", "_all")


def resample(documents: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``documents``; ``target`` has a column text."""
    spark = documents.sparkSession
    scratch = Scratch(spark, f"resample-{uuid.uuid4().hex[:8]}")
    with _sorted(spark):
        found = scratch.keep(features(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id"]), "features")
    table = gains(found, features(target.select("text"), []))
    runs = unpacked(found.withColumn("_row", F.monotonically_increasing_id()), "_row", "doc_id", "n_words")
    weighed = runs.join(F.broadcast(table), "bucket").groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("*").alias("n_features"), F.sum("gain").alias("weight"))
    blank = documents.where(F.size(words(F.coalesce("text", F.lit("")))) == 0).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight")])
    scored = weighed.drop("_row").unionByName(blank).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    scored = scratch.keep(scored, "scored")
    scratch.drop(found)
    drawn = _ranked(scored.where(F.col("n_words") >= LEAST), scratch).unionByName(scored.where(F.col("n_words") < LEAST).withColumn("rank", F.lit(None).cast("long")))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
