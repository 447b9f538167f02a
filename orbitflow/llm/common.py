"""Helpers that the operators share: tables in the cluster's shared folder, text batches."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Code points that are handled at once where Python works on texts; bounds a task's arrays.
CHUNK = 1 << 18
#: Rows of a batch whose values are Python objects at once.
ROWS = 500
#: Rows of an Arrow batch: ten times fewer than Spark's default, as rows are whole texts.
BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a folder of our own if driver and executors are one process (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orbitflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Hold the memory that batches of texts take in executors and their Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


class Scratch:
    """Tables written into the shared folder, which survive the loss of executors and cut lineage.

    A result that was not written yet still reads them, so operators leave their tables. A caller that has written its result takes a ``mark`` before
    and gives it to ``release`` after: what operators of this thread made in between is deleted.
    """

    _own = threading.local()

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self._made().append(self)

    @classmethod
    def _made(cls) -> list[Scratch]:
        if not hasattr(cls._own, "made"):
            cls._own.made = []
        return cls._own.made

    @classmethod
    def mark(cls) -> int:
        return len(cls._made())

    @classmethod
    def release(cls, mark: int) -> None:
        """Delete the tables of all scratches made since ``mark``."""
        for s in cls._made()[mark:]:
            s.delete(s.root)
        del cls._made()[mark:]

    def keep(self, df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and read it back."""
        return self.read(df, self.write(df, name, partition_by))

    def write(self, df: DataFrame, name: str = "t", partition_by: str | None = None) -> str:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return path

    def read(self, like: DataFrame, path: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that nothing reads any more."""
        for name in {f[: f.index("/", f.index(self.root.rsplit("/", 1)[-1]) + len(self.root.rsplit("/", 1)[-1]) + 1)] for f in df.inputFiles()}:
            self.delete(name)

    def delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(texts: Iterable[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts with about ``most`` code points; nulls become empty texts. Yields first index and texts."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


#: Bits of the filter of ``maybe_in``.
FILTER_BITS = 1 << 23


def maybe_in(df: DataFrame, keys: DataFrame, column: str, key: str | None = None, keep_all: bool = False, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in ``keys`` (never leaving out one that is), or all with a flag ``maybe``.

    One bit a hash, in ``bits / 63`` rows at most, is all that is broadcast, however many keys there are; with very
    many keys more rows than needed pass, and the join that follows stays exact.
    """
    def bit(c):
        return F.pmod(F.xxhash64(c), F.lit(bits))

    words = keys.select(bit(F.col(key or column)).alias("b")).groupBy((F.col("b") / 63).cast("int").alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 63).cast("int"))).alias("_mask"))
    own = df.withColumn("_bit", bit(F.col(column)))
    own = own.withColumn("_word", (F.col("_bit") / 63).cast("int"))
    found = F.coalesce(F.call_function("shiftrightunsigned", F.col("_mask"), (F.col("_bit") % 63).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    joined = own.join(F.broadcast(words), "_word", "left").withColumn("maybe", found).drop("_word", "_mask", "_bit")
    return joined if keep_all else joined.where("maybe").drop("maybe")


#: Rows of a key from which on ``join_to_keys`` deals them out, and to how many places at least.
HOT, SALTS = 2000, 64


def join_to_keys(rows: DataFrame, keys: DataFrame, key: str, members: str, spread: str) -> DataFrame:
    """``rows`` left-joined with ``keys``, which has one row a key and in ``members`` the number of its rows.

    Rows without a key move nowhere. Rows of a key with more than HOT of them are dealt by a hash of ``spread``, to copies of the key's one row. Both
    sides ask the same filter whether a key is hot, so a false alarm costs copies and loses nothing.
    """
    hot, salts = keys.where(F.col(members) > HOT).select(key), max(SALTS, parts(rows.sparkSession))
    left = maybe_in(rows.where(F.col(key).isNotNull()), hot, key, keep_all=True)
    right = maybe_in(keys, hot, key, keep_all=True)
    left = left.withColumn("_salt", F.when(F.col("maybe"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("maybe")
    right = right.withColumn("_salt", F.explode(F.when(F.col("maybe"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("maybe")
    joined = left.join(right.drop(members), [key, "_salt"], "left").drop("_salt")
    return joined.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, ROWS at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def with_columns(df: DataFrame, needs: list[str], fields: list[T.StructField], make: Callable[[], Callable], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``fields`` appended, made from the columns ``needs``; columns of df with such names, and those in ``drop``, go.

    ``make()`` gives, once a task, a function from lists of values to one list for each field. Other columns stay Arrow data: integers beside nulls never
    turn into floating-point numbers.
    """
    made = T.StructType(fields)
    taken = {f.name for f in fields}
    source = df.select(*[c for c in df.columns if c not in taken or c in needs])
    kept = [f for f in source.schema.fields if f.name not in taken and f.name not in drop]
    types = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in pieces(batches):
            new = work(*(batch.column(c).to_pylist() for c in needs))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(v, t.type) for v, t in zip(new, types))], names=[*(f.name for f in kept), *types.names])

    return source.mapInArrow(run, T.StructType([*kept, *fields]))
