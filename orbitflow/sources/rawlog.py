"""Recordings: a magic, then records of arrival time, length and one datagram.

``read`` is a Spark data source with one partition a file. Files are read as streams in the task, a record at a time, from any store that Spark's reader lists.
Large files are read by many tasks once ``sources.offsets`` has indexed them. Datagrams at scale belong into Parquet; ``to_parquet`` writes them there once.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from orbitflow import schemas

# The file format, little-endian; the magic's last byte is its version.
MAGIC = b"L1RAW\x00\x00\x01"
FAMILY = 5
RECORD = struct.Struct("<dI")
MOST = 1 << 20
STATUS = "recording_id string, datagrams long, bytes long, truncated boolean, version int"


class Damaged(ValueError):
    """Not a recording, or a record of impossible length."""


def records(f) -> Iterator[tuple[float, bytes]]:
    """Whole records of an open file; a partial one at the end stops the iteration with ``truncated`` as the generator's value."""
    head = f.read(len(MAGIC))
    if head[:FAMILY] != MAGIC[:FAMILY]:
        raise Damaged("not a recording")
    while True:
        line = f.read(RECORD.size)
        if not line:
            return False
        if len(line) < RECORD.size:
            return True
        at, size = RECORD.unpack(line)
        if size > MOST:
            raise Damaged(f"a record of {size} bytes")
        data = f.read(size)
        if len(data) < size:
            return True
        yield at, data


def scan(f) -> tuple[list[tuple[float, bytes]], bool]:
    """All records of a (small) file, and whether its end is cut off."""
    out, it = [], records(f)
    while True:
        try:
            out.append(next(it))
        except StopIteration as end:
            return out, bool(end.value)


def write_records(f, rows) -> tuple[int, int]:
    """Magic and records; returns how many datagrams, and their bytes."""
    f.write(MAGIC)
    n = size = 0
    for at, data in rows:
        f.write(RECORD.pack(at, len(data)) + data)
        n, size = n + 1, size + len(data)
    return n, size


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def located(path: str):
    """(store, path inside it) of a path or URI."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _open(path: str):
    store, inside = located(path)
    return store.open_input_stream(inside)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["files"].split("\n") if p]

    def partitions(self):
        return [_File(p) for p in self.paths] or [_File("")]

    def read(self, partition):
        import pyarrow as pa

        if not partition.path:
            return
        name, rows, seq = PurePosixPath(partition.path).name, [], 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows)), pa.array(range(seq - len(rows), seq), pa.int64()), pa.array([t for t, _ in rows], pa.float64()), pa.array([d for _, d in rows], pa.binary())],
                names=["recording_id", "seq", "recv_time", "payload"],
            )

        with _open(partition.path) as f:
            for row in records(f):
                rows.append(row)
                seq += 1
                if len(rows) == 4096:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class RawLog(DataSource):
    """``format("rawlog")``: option ``files``, one path a line."""

    @classmethod
    def name(cls):
        return "rawlog"

    def schema(self):
        return schemas.DATAGRAMS

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """One file a recording and task; rows must come grouped and ordered (``write`` sees to it).

    A task writes under names of its own; only when all are done does ``commit`` move the files of the attempts that counted to their places. Failed and
    speculative attempts leave nothing, nor does a job that is aborted.
    """

    def __init__(self, options: dict):
        self.folder, self.job = options["path"], uuid.uuid4().hex

    def _store(self):
        store, inside = located(self.folder)
        return store, inside.rstrip("/"), f"{inside.rstrip('/')}/_temporary-{self.job}"

    def write(self, rows):
        store, inside, temp = self._store()
        own = f"{temp}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        out, now, files = None, None, []
        for r in rows:
            if r.recording_id != now:
                if out is not None:
                    out.close()
                now = r.recording_id
                files.append((f"{own}/{now}", f"{inside}/{now}"))
                out = store.open_output_stream(files[-1][0])
                out.write(MAGIC)
            out.write(RECORD.pack(r.recv_time, len(r.payload)) + bytes(r.payload))
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages):
        store, _, temp = self._store()
        for m in messages:
            for made, to in m.files if m is not None else []:
                store.move(made, to)
        self._clear(store, temp)

    def abort(self, messages):
        store, _, temp = self._store()
        self._clear(store, temp)

    @staticmethod
    def _clear(store, temp: str) -> None:
        from pyarrow.fs import FileType

        if store.get_file_info(temp).type == FileType.Directory:
            store.delete_dir(temp)


def listed(spark: SparkSession, glob: str, sizes: bool = False) -> list:
    """Paths that match, as Spark's file system sees them, or (path, bytes)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    files = sorted((s.getPath().toString(), s.getLen()) for s in found if not s.isDirectory())
    return files if sizes else [p for p, _ in files]


def read(spark: SparkSession, glob: str) -> DataFrame:
    """``schemas.DATAGRAMS`` of the recordings; the file's name is the recording_id. A file that is no recording fails the query."""
    spark.dataSource.register(RawLog)
    return spark.read.format("rawlog").option("files", "\n".join(listed(spark, glob))).load()


def write(datagrams: DataFrame, folder: str) -> None:
    """One file for each recording."""
    datagrams.sparkSession.dataSource.register(RawLog)
    rows = datagrams.select("recording_id", "seq", "recv_time", "payload").repartition("recording_id").sortWithinPartitions("recording_id", "seq")
    rows.write.format("rawlog").mode("append").option("path", folder).save()


def status(spark: SparkSession, glob: str) -> DataFrame:
    """``STATUS`` of each file: a cut-off end is told, not raised; files are streamed, their content is not kept."""
    paths = spark.createDataFrame([(p,) for p in listed(spark, glob)], "path string")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                with _open(p) as f:
                    version = f.read(len(MAGIC))[-1:]
                with _open(p) as f:
                    n, size, it = 0, 0, records(f)
                    while True:
                        try:
                            size, n = size + len(next(it)[1]), n + 1
                        except StopIteration as end:
                            rows.append((PurePosixPath(p).name, n, size, bool(end.value), version[0] if version else None))
                            break
            yield pd.DataFrame(rows, columns=["recording_id", "datagrams", "bytes", "truncated", "version"])

    return paths.repartition(max(1, min(len(paths.take(1000)), 1000))).mapInPandas(run, STATUS)


def to_parquet(datagrams: DataFrame, path: str) -> None:
    """The table that everything at scale reads: partitioned by recording, ordered by arrival."""
    datagrams.repartition("recording_id").sortWithinPartitions("recording_id", "seq").write.mode("overwrite").partitionBy("recording_id").parquet(path)


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DATAGRAMS).parquet(path)


def in_window(datagrams: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Datagrams that arrived in [lo, hi); the filter reaches the Parquet scan."""
    out = datagrams
    if lo is not None:
        out = out.where(F.col("recv_time") >= lo)
    return out if hi is None else out.where(F.col("recv_time") < hi)
