"""Live frames, poses and maps under Structured Streaming.

State is keyed by recording (a sensor) and bounded: waiting scans, the open frame, the inertial window, the local map. There is no watermark,
as late scans must count: they re-anchor the open frame instead of being dropped. State and offsets go to the checkpoint, so a query resumes
where it was. The state store must be RocksDB (``configure``).
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql import types as T

from orbitflow import schemas
from orbitflow.config import IMU_WINDOW, MAP_VOXEL, Config, Registration
from orbitflow.functions.codec import unpack
from orbitflow.operators.fold import PARITY_FRAMES, Assembler, _fields
from orbitflow.operators.mapping import map_step
from orbitflow.operators.odometry import _Register
from orbitflow.operators.results import KEYS
from orbitflow.streaming.status import ARRIVALS, told, watched


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _PerRecording(StatefulProcessor):
    """A pickled object for each key; what is in a micro-batch is sorted by seq before it is taken.

    What is open when a recording ends leaves with a datagram that has no payload (the end mark), or after ``idle`` seconds without any.
    """

    columns: list[str] = []
    #: The column that tells how far a result reaches.
    end = "t_end"
    idle: float | None = None

    def fresh(self, key: tuple):
        raise NotImplementedError

    def take(self, state, pdf: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def finish(self, state) -> list[tuple]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blob = handle.getValueState("state", T.StructType([T.StructField("data", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle))
        ended = pdf["payload"].isna()
        yield from self._stored(key, lambda state: self.take(state, pdf[~ended]) + (self.finish(state) if ended.any() else []))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._stored(key, self.finish)

    def _stored(self, key, work: Callable) -> Iterator[pd.DataFrame]:
        state = pickle.loads(self.blob.get()[0]) if self.blob.exists() else self.fresh(key)
        made = work(state)
        self.blob.update((pickle.dumps(state, pickle.HIGHEST_PROTOCOL),))
        if made:
            yield pd.DataFrame(made, columns=self.columns)

    def close(self) -> None:
        pass


class _Sensor:
    def __init__(self, key: tuple, config: Config, imu_window: int, register: bool):
        self.key, self.n, self.window = key[0], 0, deque(maxlen=imu_window)
        self.assembler = Assembler(config.frame_duration, rotate=config.rotate_with_imu)
        self.register = _Register(key, config, Registration(), None, False, 0) if register else None

    def frames(self, pdf: pd.DataFrame) -> list:
        scans = []
        for data in pdf["payload"]:
            message = unpack(data)
            if message is not None:
                (self.window if message[0] == "imu" else scans).append(message)
        return self.assembler.take(scans, self.window)


class Frames(_PerRecording):
    columns = [f.strip().split(" ")[0] for f in _fields(PARITY_FRAMES)]

    def __init__(self, config: Config, imu_window: int, idle: float | None = None):
        self.config, self.imu_window, self.idle = config, imu_window, idle

    def fresh(self, key):
        return _Sensor(key, self.config, self.imu_window, False)

    def take(self, state, pdf):
        return self.rows(state, state.frames(pdf))

    def finish(self, state):
        return self.rows(state, state.assembler.close())

    def rows(self, state, frames):
        rows = []
        for f in frames:
            points = [dict(zip(("x", "y", "z", "t_norm"), (*p, t))) for p, t in zip(f.points.tolist(), f.times.tolist())]
            rows.append((state.key, state.n, f.t_start, f.t_end, f.span, f.n_scans, len(points), points))
            state.n += 1
        return rows


class Poses(Frames):
    end = "stamp"
    columns = [f.strip().split(" ")[0] for f in _fields(schemas.POSES)]

    def fresh(self, key):
        return _Sensor(key, self.config, self.imu_window, True)

    def rows(self, state, frames):
        rows = []
        for f in frames:
            rows += state.register.frame(state.n, f.points, f.times, f.t_end, f.span)
            state.n += 1
        return rows


def _stateful(datagrams: DataFrame, processor: _PerRecording, schema: str) -> DataFrame:
    configure(datagrams.sparkSession)
    made = watched(datagrams).groupBy("recording_id").transformWithStateInPandas(processor, schema, "Append", "None" if processor.idle is None else "ProcessingTime")
    return told(made, processor.end)


def live_frames(datagrams: DataFrame, config: Config | None = None, imu_window: int = IMU_WINDOW, idle: float | None = None) -> DataFrame:
    """Frames of a stream of datagrams; a micro-batch is what the consumer sees at once. The last frame leaves with an end mark, or after ``idle`` silent seconds."""
    return _stateful(datagrams, Frames(config or Config(), imu_window, idle), PARITY_FRAMES)


def live_poses(datagrams: DataFrame, config: Config | None = None, imu_window: int = IMU_WINDOW, idle: float | None = None) -> DataFrame:
    """Poses of a stream of datagrams."""
    return _stateful(datagrams, Poses(config or Config(), imu_window, idle), schemas.POSES)


class MapSink:
    """``foreachBatch`` writer of an incremental map: of each batch the points whose voxels the table lacks. ``clear`` empties the map.

    Files are partitioned by cell, a cube of space, and batch. A batch reads only the cells that it reaches, so its cost follows the batch and not the map. A batch that is run again after a
    failure replaces its own partitions, so nothing is doubled.
    """

    SCHEMA = f"{schemas.CLOUD}, key bigint, cell bigint, batch bigint"

    def __init__(self, path: str, voxel: float = MAP_VOXEL, max_points: int | None = None):
        self.path, self.voxel, self.max_points = path.rstrip("/"), voxel, max_points

    def _fs(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def stored(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The map's table (of batches before ``before``), with key, cell and batch."""
        store, path = self._fs(spark)
        if not store.exists(path):
            return spark.createDataFrame([], self.SCHEMA)
        df = spark.read.schema(self.SCHEMA).parquet(self.path)
        return df if before is None else df.where(F.col("batch") < before)

    def points(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The map so far (of batches before ``before``)."""
        return self.stored(spark, before).drop("key", "cell")

    def __call__(self, cloud: DataFrame, batch: int) -> None:
        spark = cloud.sparkSession
        seen = self.stored(spark, batch)
        new = map_step(seen, cloud, self.voxel, "ord", KEYS)
        if self.max_points is not None:
            full = seen.groupBy(*KEYS).count().where(F.col("count") >= self.max_points).select(*KEYS)
            new = new.join(full, KEYS, "left_anti")
        out = new.withColumn("batch", F.lit(batch).cast("long")).repartition("cell")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell", "batch").parquet(self.path)

    def clear(self, spark: SparkSession) -> None:
        store, path = self._fs(spark)
        store.delete(path, True)


class Running:
    """A started query as a context: stopped at the end, whatever happens; stopping twice does no harm.

    A query that was running before is borrowed: it is used and left running, as it belongs to somebody else. One that was not, given as another ``Running``, is started here and
    stopped here.
    """

    def __init__(self, start: Callable[[], StreamingQuery] | StreamingQuery | Running):
        if isinstance(start, Running):
            start = start.query if start.is_running else start.start
        self.borrowed = None if callable(start) else start
        self.start, self.query = start, None

    def __enter__(self) -> Running:
        if self.query is not None and self.query.isActive:
            raise RuntimeError("already running")
        if self.borrowed is not None and not self.borrowed.isActive:
            raise RuntimeError("a borrowed query must be running")
        self.query = self.borrowed or self.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    @property
    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive

    def stop(self) -> None:
        if self.is_running and self.borrowed is None:
            self.query.stop()

    def step(self) -> bool:
        """Work through what has arrived by now; False once the query has stopped."""
        if self.is_running:
            self.query.processAllAvailable()
        return self.is_running

    def wait_until_ready(self, timeout: float = 5.0) -> bool:
        """Whether at least one scan and one sample arrived within ``timeout`` seconds; any row counts in a query without ``status.watched``."""
        import time

        ends = time.monotonic() + timeout
        while time.monotonic() < ends:
            progress = [] if self.query is None else self.query.recentProgress
            seen = [p.observedMetrics[ARRIVALS] for p in progress if ARRIVALS in p.observedMetrics]
            if any(m.scans for m in seen) and any(m.samples for m in seen) or not seen and any(p.numInputRows for p in progress):
                return True
            time.sleep(0.02)
        return False


def on_frame(df: DataFrame, callback: Callable[[DataFrame, int], None], interval: str = "1 second", checkpoint: str | None = None) -> Running:
    """Call ``callback(batch, number)`` at most once an interval."""

    def start() -> StreamingQuery:
        writer = df.writeStream.foreachBatch(callback).trigger(processingTime=interval)
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()

    return Running(start)
