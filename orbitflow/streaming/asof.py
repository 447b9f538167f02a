"""Nearest-in-time alignment of two streams, with state that event time bounds.

As in the batch join, time is cut into buckets some tolerances wide and a sample near an edge goes to both sides, so that a bucket decides alone. State is keyed by
recording and bucket: scans and samples of a recording spread over tasks, a row is appended to a list and never rewritten, and a bucket's list is read once, when the watermark has
passed all that can match in it, and is gone then. Rows later than ``lateness`` are dropped by the watermark; all others count, in whatever order they come,
so the result is that of ``align.nearest_asof``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from orbitflow.config import MAX_TIME_GAP
from orbitflow.functions import codec
from orbitflow.streaming.live import configure

#: Tolerances in a bucket's width; a scan leaves at most so much event time, and the lateness, after its stamp. At least 4, so that a sample is in two buckets at most.
WIDTH = 8
ALIGNED = "recording_id string, seq long, stamp double, payload binary, imu_seq long, x double, y double, z double, w double, gap double"
_QUAT = ["x", "y", "z", "w"]
_ROW = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("stamp", T.DoubleType()), T.StructField("seq", T.LongType()), T.StructField("payload", T.BinaryType()), *(T.StructField(c, T.DoubleType()) for c in _QUAT)])


def nearest(scans: np.ndarray, stamps: np.ndarray, tolerance: float) -> np.ndarray:
    """Index of the sample for each scan, -1 for none; ``stamps`` ascend, those of one stamp in their order of arrival. Of two equally near the earlier."""
    if not len(stamps):
        return np.full(len(scans), -1)
    after = np.searchsorted(stamps, scans, "left")
    before = after - 1
    back = np.where(before >= 0, scans - stamps[np.maximum(before, 0)], np.inf)
    ahead = np.where(after < len(stamps), stamps[np.minimum(after, len(stamps) - 1)] - scans, np.inf)
    return np.where(np.minimum(back, ahead) <= tolerance, np.where(back <= ahead, before, after), -1)


class _Bucket(StatefulProcessor):
    """Key: recording and bucket. Rows wait in a list until the bucket's timer."""

    def __init__(self, tolerance: float, width: float):
        self.tolerance, self.width = tolerance, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", _ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.rows.exists():
            self.handle.registerTimer(math.ceil(((key[1] + 1) * self.width + self.tolerance) * 1000) + 1)
        for pdf in rows:
            some = pdf[_ROW.names].astype(object)
            self.rows.appendList(list(some.where(some.notna(), None).itertuples(index=False, name=None)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.rows.get()), columns=_ROW.names)
        self.rows.clear()
        scans, samples = held[held["side"] == 0].reset_index(drop=True), held[held["side"] == 1].sort_values(["stamp", "seq"]).reset_index(drop=True)
        if len(scans):
            stamps = samples["stamp"].to_numpy(float)
            at = nearest(scans["stamp"].to_numpy(float), stamps, self.tolerance)
            found = samples.reindex(at)  # -1 is no label: nulls
            out = pd.DataFrame({"recording_id": key[0], "seq": scans["seq"], "stamp": scans["stamp"], "payload": scans["payload"]})
            out["imu_seq"] = found["seq"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for c in _QUAT:
                out[c] = found[c].to_numpy(float)
            out["gap"] = np.where(at >= 0, np.abs(scans["stamp"].to_numpy(float) - found["stamp"].to_numpy(float)), np.nan)
            yield out.astype({"imu_seq": "Int64", "seq": "int64"})

    def close(self) -> None:
        pass


def stream_asof(scans: DataFrame, samples: DataFrame, tolerance: float = MAX_TIME_GAP, lateness: str = "2 seconds", width: int = WIDTH) -> DataFrame:
    """``ALIGNED``: each of ``scans`` (recording_id, seq, stamp, payload) with the nearest of ``samples`` (recording_id, seq, stamp, q), nulls where none is near enough.

    Both may be streams. Scans without a stamp leave at once, unmatched. What no later row's event time has passed stays in state, so a stream's last
    bucket leaves with the first row beyond it.
    """
    if tolerance <= 0:
        raise ValueError("tolerance must be > 0")
    if width < 4:
        raise ValueError("a bucket must be at least 4 tolerances wide")
    configure(scans.sparkSession)
    wide, known = width * tolerance, F.col("stamp").isNotNull() & ~F.isnan("stamp")
    reach = tolerance * 1.001 + F.abs(F.col("stamp")) * 4e-16
    none = [F.lit(None).cast("double").alias(c) for c in _QUAT]
    mine = scans.where(known).select("recording_id", F.floor(F.col("stamp") / wide).alias("bucket"), F.lit(0).alias("side"), "stamp", "seq", "payload", *none)
    edges = F.array_distinct(F.array(F.floor((F.col("stamp") - reach) / wide), F.floor((F.col("stamp") + reach) / wide)))
    near = samples.where(known).select("recording_id", F.explode(edges).alias("bucket"), F.lit(1).alias("side"), "stamp", "seq", F.lit(None).cast("binary").alias("payload"), *[F.col(f"q.{c}").cast("double").alias(c) for c in _QUAT])
    both = mine.unionByName(near).withColumn("at", F.timestamp_micros(F.round(F.col("stamp") * 1e6).cast("long"))).withWatermark("at", lateness)
    met = both.groupBy("recording_id", "bucket").transformWithStateInPandas(_Bucket(tolerance, wide), ALIGNED, "Append", "EventTime")
    blank = scans.where(~known).select("recording_id", "seq", "stamp", "payload", F.lit(None).cast("long").alias("imu_seq"), *none, F.lit(None).cast("double").alias("gap"))
    nan = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in (*_QUAT, "gap")]
    return met.select("recording_id", "seq", "stamp", "payload", "imu_seq", *nan).unionByName(blank)


def live_aligned(datagrams: DataFrame, tolerance: float = MAX_TIME_GAP, lateness: str = "2 seconds", width: int = WIDTH) -> DataFrame:
    """``ALIGNED`` of a stream of datagrams; a scan keeps its packet, which ``codec.decode`` reads again."""
    kept = codec.decode(datagrams.select("recording_id", "seq", F.col("payload").alias("packet"), "payload"))
    scans = kept.where("scan IS NOT NULL").select("recording_id", "seq", F.col("scan.stamp").alias("stamp"), F.col("packet").alias("payload"))
    samples = kept.where("imu IS NOT NULL").select("recording_id", "seq", F.col("imu.stamp").alias("stamp"), F.col("imu.q").alias("q"))
    return stream_asof(scans, samples, tolerance, lateness, width)
