"""An offset index of recordings, by which many tasks read one file.

Records have no marks, so a place in the middle of a file is no boundary by itself. A task that is given a range of bytes takes the offset in it from which
lengths lead through most records, one after the other, past the range's end. That may be a wrong one: each range therefore tells where it began and where it ended up, and a
range that didn't begin where the one before it ended is read again from there. The first range begins behind the magic, so by induction all are right. What
is left is a table of ranges with their numbers and times of arrival, which a reader prunes by the filters that Spark pushes down.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from orbitflow import schemas
from orbitflow.sources.rawlog import FAMILY, MAGIC, MOST, RECORD, Damaged, listed, located

#: Bytes of a range; a task reads one or several neighbouring ones.
EVERY = 8 << 20
#: Bytes that a task reads, unless a single range is larger.
SPLIT = 64 << 20
#: Bytes beyond a range through which lengths lead too before an offset counts as a boundary, and seconds between neighbours there. Both only guide the search.
AHEAD, LEAP = 1 << 16, 3600.0
RANGES = "path string, size long, piece long, begin long, end long, datagrams long, bytes long, first_time double, last_time double, truncated boolean, version int"
INDEX = f"{RANGES}, seq long"


def _evidence(data: bytes, base: int, at: int) -> int:
    """Whole records that lengths lead through from ``at`` to the end of what was read; 0 if a length is impossible or times of arrival leap."""
    n, before = 0, None
    while at + RECORD.size <= base + len(data):
        time, length = RECORD.unpack_from(data, at - base)
        if length > MOST or (before is not None and not 0 <= time - before <= LEAP):
            return 0
        at, before = at + RECORD.size + length, time
        n += at <= base + len(data)
    return n


def _chain(data: bytes, base: int, at: int, to: int, size: int) -> tuple | None:
    """(end, records, payload bytes, least and greatest time, cut off) of the chain from ``at`` to the first boundary from ``to`` on; None if a length is impossible."""
    n = total = 0
    lo, hi = float("inf"), float("-inf")
    while at < to:
        if at + RECORD.size > size:
            return size, n, total, lo, hi, True
        time, length = RECORD.unpack_from(data, at - base)
        if length > MOST:
            return None
        if at + RECORD.size + length > size:
            return size, n, total, lo, hi, True
        lo, hi, n, total, at = min(lo, time), max(hi, time), n + 1, total + length, at + RECORD.size + length
    return at, n, total, lo, hi, False


def _candidates(data: bytes, base: int, to: int) -> list[int]:
    """Offsets of the range whose next bytes look like the head of a record: a possible length, and a time that is neither 0 nor too small for a normal number nor infinite."""
    raw = np.frombuffer(data, np.uint8)
    n = min(to - base, len(raw) - RECORD.size + 1, MOST + RECORD.size)
    if n <= 0:
        return []
    high = raw[10 : 10 + n].astype(np.int64) | (raw[11 : 11 + n].astype(np.int64) << 8)  # the length's upper half
    exponent = (raw[7 : 7 + n] & 0x7F).astype(np.int64) << 4 | (raw[6 : 6 + n] >> 4)
    return (np.flatnonzero((high <= MOST >> 16) & (exponent != 0x7FF) & (exponent != 0)) + base).tolist()


def _range(path: str, piece: int, every: int, size: int, begin: int | None) -> tuple:
    """A row of RANGES; where no record begins in the range, begin and end are null."""
    store, inside = located(path)
    lo, to = piece * every, min((piece + 1) * every, size)
    known = begin is not None or piece == 0
    with store.open_input_file(inside) as f:
        version = None
        if piece == 0:
            magic = f.read(len(MAGIC))
            if magic[:FAMILY] != MAGIC[:FAMILY]:
                raise Damaged("not a recording")
            version = magic[-1] if len(magic) == len(MAGIC) else None
            begin = len(MAGIC)
        lo = begin if known else lo
        if lo >= to:
            return path, size, piece, None if piece else min(begin, size), None if piece else min(begin, size), 0, 0, None, None, False, version
        f.seek(lo)
        data = f.read(min(to + RECORD.size + (0 if known else AHEAD), size) - lo)
    if known:
        at, found = lo, _chain(data, lo, lo, to, size)
        if found is None:
            raise Damaged(f"a record of impossible length after byte {lo}")
    else:
        n, at = max(((_evidence(data, lo, p), -p) for p in _candidates(data, lo, to)), default=(0, 0))
        at, found = -at, _chain(data, lo, -at, to, size) if n else None
    if found is None:
        return path, size, piece, None, None, 0, 0, None, None, False, version
    end, n, total, first, last, cut = found
    return path, size, piece, at, end, n, total, first if n else None, last if n else None, cut, version


def _mended(path: str, size: int, every: int, piece: int, begin: int, later: dict[int, int | None]) -> Iterator[tuple]:
    """Ranges read again from a known begin, up to where the next one is right already."""
    while True:
        row = _range(path, piece, every, size, begin)
        yield row
        begin, piece = begin if row[4] is None else row[4], piece + 1
        if piece not in later or later[piece] == begin or (later[piece] is None and begin >= min((piece + 1) * every, size)):
            return


def _ranges(rows: DataFrame, every: int) -> DataFrame:
    """RANGES of (path, size, piece, begin, later); begin is null where it has to be found."""

    def run(batches):
        for b in batches:
            made: list = []
            for path, size, piece, begin, later in zip(*(b.column(c).to_pylist() for c in ("path", "size", "piece", "begin", "later"))):
                made += [_range(path, piece, every, size, None)] if begin is None else _mended(path, size, every, piece, begin, {x["piece"]: x["begin"] for x in later})
            cols = list(zip(*made)) if made else [[]] * 11
            types = (*(pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), *(pa.float64(), pa.float64(), pa.bool_(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split(" ")[0] for f in RANGES.split(", ")])

    return rows.mapInArrow(run, RANGES)


def build_index(spark: SparkSession, glob: str, path: str, every: int = EVERY) -> DataFrame:
    """Index the recordings that match into the table ``path``; INDEX is returned. Work and tasks follow the bytes, however few the files.

    A cut-off last record is told by ``truncated``. A length that is impossible on the chain from the file's beginning raises ``Damaged``.
    """
    if every <= RECORD.size + len(MAGIC):
        raise ValueError("a range must be longer than a head")
    files = spark.createDataFrame([(p, n) for p, n in listed(spark, glob, sizes=True)], "path string, size long")
    pieces = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / every) - 1).cast("long"))).alias("piece"))
    tasks = max(1, sum(-(-n // every) for _, n in listed(spark, glob, sizes=True)))
    none = F.lit(None)
    todo = pieces.withColumns({"begin": none.cast("long"), "later": none.cast("array<struct<piece:bigint,begin:bigint>>")}).repartition(min(tasks, 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "piece")
    order = Window.partitionBy("path").orderBy("piece")
    done, k = None, 0
    while True:
        found = _ranges(todo, every)
        if done is not None:
            found = found.withColumn("_new", F.lit(1)).unionByName(done.withColumn("_new", F.lit(0)))
            found = found.groupBy("path", "piece").agg(F.max_by(F.struct(*done.columns), "_new").alias("r")).select("r.*")
        where = f"{path.rstrip('/')}/try={k}"
        found.write.mode("overwrite").parquet(where)
        done, k = spark.read.schema(RANGES).parquet(where), k + 1
        # Where a range has to begin: where the last range before it that has records ended.
        due = done.withColumn("due", F.last("end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        free = F.col("begin").isNull() & (F.col("due") >= F.least((F.col("piece") + 1) * every, F.col("size")))
        wrong = due.where((F.col("piece") > 0) & ~(F.coalesce(F.col("begin") == F.col("due"), F.lit(False)) | free))
        first = wrong.groupBy("path", "size").agg(F.min("piece").alias("piece"), F.min_by("due", "piece").alias("begin"))  # later ones may be right once this one is
        if not first.take(1):
            break
        rest = done.select("path", F.col("piece").alias("p"), F.col("begin").alias("b")).join(first.select("path", "piece"), "path").where("p > piece")
        later = rest.groupBy("path").agg(F.collect_list(F.struct(F.col("p").alias("piece"), F.col("b").alias("begin"))).alias("later"))  # a row a range, of one file
        todo = first.join(later, "path", "left").select("path", "size", "piece", "begin", F.coalesce("later", F.array().cast("array<struct<piece:bigint,begin:bigint>>")).alias("later"))
    known = done.where("begin IS NOT NULL")
    numbered = known.withColumn("seq", F.sum("datagrams").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("datagrams"))
    numbered.write.mode("overwrite").parquet(f"{path.rstrip('/')}/ranges")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/ranges")


class _Ranges(InputPartition):
    def __init__(self, path: str, begin: int, end: int, seq: int):
        self.path, self.begin, self.end, self.seq = path, begin, end, seq


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.index, self.split = options["index"].rstrip("/"), int(options.get("split", SPLIT))
        self.names: set[str] | None = None
        self.tests: list = []

    def pushFilters(self, filters):
        """recording_id and recv_time choose ranges; Spark tests the rows again."""
        for f in filters:
            if f.attribute == ("recording_id",) and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif f.attribute == ("recv_time",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.tests.append(f)
            yield f

    def _may_hold(self, first: float | None, last: float | None) -> bool:
        if first is None or last is None:
            return False
        checks = {EqualTo: lambda v: first <= v <= last, GreaterThan: lambda v: last > v, GreaterThanOrEqual: lambda v: last >= v, LessThan: lambda v: first < v, LessThanOrEqual: lambda v: first <= v}
        return all(checks[type(f)](f.value) for f in self.tests)

    def partitions(self):
        store, inside = located(f"{self.index}/ranges")
        table = pq.read_table(inside, filesystem=store, columns=["path", "begin", "end", "datagrams", "first_time", "last_time", "seq"]).sort_by([("path", "ascending"), ("begin", "ascending")])
        out: list[_Ranges] = []
        for path, begin, end, n, first, last, seq in zip(*(c.to_pylist() for c in table.columns)):
            if not n or (self.names is not None and PurePosixPath(path).name not in self.names) or not self._may_hold(first, last):
                continue
            if out and out[-1].path == path and out[-1].end == begin and end - out[-1].begin <= self.split:
                out[-1].end = end
            else:
                out.append(_Ranges(path, begin, end, seq))
        return out or [_Ranges("", 0, 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from batches(partition.path, partition.begin, partition.end, partition.seq)


def batches(path: str, begin: int, end: int, seq: int) -> Iterator[pa.RecordBatch]:
    """The datagrams of neighbouring ranges, the first of which has number ``seq``."""
    store, inside = located(path)
    name, at, rest = PurePosixPath(path).name, begin, b""
    with store.open_input_file(inside) as f:
        f.seek(at)
        while at < end:
            data = rest + f.read(min(EVERY, end - at))
            at += len(data) - len(rest)
            place, times, payloads = 0, [], []
            while place + RECORD.size <= len(data):
                time, length = RECORD.unpack_from(data, place)
                if place + RECORD.size + length > len(data):
                    break
                times.append(time)
                payloads.append(data[place + RECORD.size : place + RECORD.size + length])
                place += RECORD.size + length
            rest = data[place:]
            for lo in range(0, len(times), 4096):
                some = times[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(range(seq, seq + len(some)), pa.int64()), pa.array(some, pa.float64()), pa.array(payloads[lo : lo + 4096], pa.binary())], names=["recording_id", "seq", "recv_time", "payload"])
                seq += len(some)


class Indexed(DataSource):
    """``format("rawlog_indexed")``: options ``index`` (a table of ``build_index``) and ``split`` (bytes of a task)."""

    @classmethod
    def name(cls):
        return "rawlog_indexed"

    def schema(self):
        return schemas.DATAGRAMS

    def reader(self, schema):
        return _Reader(self.options)


def read(spark: SparkSession, index: str, split: int = SPLIT) -> DataFrame:
    """The rows of ``rawlog.read`` for the recordings of an index, by ranges: filters on recording_id and recv_time leave out ranges before any byte is read."""
    spark.dataSource.register(Indexed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("rawlog_indexed").option("index", index).option("split", split).load()


def status(index: DataFrame) -> DataFrame:
    """``rawlog.STATUS`` of indexed recordings, without reading them again."""
    name = F.element_at(F.split("path", "/"), -1)
    return index.groupBy(name.alias("recording_id")).agg(F.sum("datagrams").alias("datagrams"), F.sum("bytes").alias("bytes"), F.max("truncated").alias("truncated"), F.max("version").alias("version"))
