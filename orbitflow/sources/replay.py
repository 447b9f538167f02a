"""Recordings as a stream, at the pace at which they were made.

An offset is a number of recorded seconds since each recording's first datagram. What is due by the clock is admitted; a micro-batch holds the datagrams between two
offsets, read by the ranges of an index (``offsets.build_index``) in many tasks. The clock starts when the stream is first asked and is written down beside the index or
where ``state`` says, so that a query that stops and starts again goes on where time has got to: what was due meanwhile comes at once.
"""

from __future__ import annotations

import json
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from orbitflow import schemas
from orbitflow.sources import offsets
from orbitflow.sources.rawlog import located


class _Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int, seq: int, after: float, upto: float):
        self.path, self.begin, self.end, self.seq, self.after, self.upto = path, begin, end, seq, after, upto


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.index, self.pace = options["index"].rstrip("/"), float(options.get("pace", 1.0))
        self.state, self.split = options.get("state", f"{self.index}/_clock"), int(options.get("split", offsets.SPLIT))
        self.known: list[tuple] | None = None
        self.clock: float | None = None

    def _ranges(self) -> list[tuple]:
        """(path, begin, end, seq, first, last): times since the recording's first datagram."""
        if self.known is None:
            store, inside = located(f"{self.index}/ranges")
            t = pq.read_table(inside, filesystem=store, columns=["path", "begin", "end", "seq", "datagrams", "first_time", "last_time"]).sort_by([("path", "ascending"), ("begin", "ascending")])
            rows = [r for r in zip(*(c.to_pylist() for c in t.columns)) if r[4]]
            start: dict[str, float] = {}
            for r in rows:
                start[r[0]] = min(start.get(r[0], r[5]), r[5])
            self.known = [(*r[:4], r[5] - start[r[0]], r[6] - start[r[0]], start[r[0]]) for r in rows]
        return self.known

    def _started(self) -> float:
        """When the clock was first asked: the one that is written down."""
        if self.clock is None:
            from pyarrow.fs import FileType

            store, inside = located(f"{self.state}/started.json")
            if store.get_file_info(inside).type == FileType.NotFound:
                store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(inside) as f:
                    f.write(json.dumps({"started": time.time()}).encode())
            with store.open_input_stream(inside) as f:
                self.clock = json.loads(f.read())["started"]
        return self.clock

    def initialOffset(self) -> dict:
        return {"seconds": -1.0}

    def latestOffset(self) -> dict:
        last = max((r[5] for r in self._ranges()), default=-1.0)
        if self.pace <= 0:
            return {"seconds": last}
        started = self._started()
        return {"seconds": min(last, max(-1.0, self.pace * (time.time() - started)))}

    def partitions(self, start: dict, end: dict):
        after, upto, out = start["seconds"], end["seconds"], []
        for path, begin, stop, seq, first, last, zero in self._ranges():
            if last <= after or first > upto:
                continue
            if out and out[-1].path == path and out[-1].end == begin and stop - out[-1].begin <= self.split:
                out[-1].end = stop
            else:
                out.append(_Part(path, begin, stop, seq, after + zero, upto + zero))
        return out

    def read(self, partition):
        for batch in offsets.batches(partition.path, partition.begin, partition.end, partition.seq):
            t = batch.column("recv_time").to_numpy()
            due = (t > partition.after) & (t <= partition.upto)
            if due.any():
                yield batch if due.all() else batch.filter(pa.array(due))

    def commit(self, end: dict) -> None:
        pass


class Replay(DataSource):
    """``format("rawlog_replay")``: options ``index``, ``pace`` (recorded seconds a second; 0: all at once), ``state`` and ``split``."""

    @classmethod
    def name(cls):
        return "rawlog_replay"

    def schema(self):
        return schemas.DATAGRAMS

    def streamReader(self, schema):
        return _Stream(self.options)


def stream(spark: SparkSession, index: str, pace: float = 1.0, state: str | None = None, split: int = offsets.SPLIT) -> DataFrame:
    """A stream of the datagrams of indexed recordings, all of which begin together. ``state`` is a folder for this replay's clock."""
    spark.dataSource.register(Replay)
    reader = spark.readStream.format("rawlog_replay").option("index", index).option("pace", pace).option("split", split)
    return (reader.option("state", state) if state else reader).load()
