"""The rolling window of turned scans: the newest by stamp, whatever their order of arrival."""

from __future__ import annotations

from bisect import insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitflow.config import IMU_WINDOW, MAX_TIME_GAP, PERIOD
from orbitflow.functions.codec import unpack
from orbitflow.operators.buffers import KEYS, checked
from orbitflow.operators.fold import Batcher, datagram_fold, rotated


def window_scans(ingested: DataFrame, max_scans: int = 100, keys: list[str] = KEYS) -> DataFrame:
    """The newest ``max_scans`` of each recording by (stamp, seq); late scans older than a full window fall out."""
    w = Window.partitionBy(*keys).orderBy(F.desc("stamp"), F.desc("seq"))
    return ingested.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= checked(max_scans)).drop("_rn")


def points(window: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Their points with ``pos``; oldest scan first is the order of (stamp, seq, pos)."""
    return window.select(*keys, "stamp", "seq", F.posexplode("pts").alias("pos", "p")).select(*keys, "stamp", "seq", "pos", "p.x", "p.y", "p.z")


def centroid_and_nearest(window_points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Centroid, nearest range, and mean and deviation of the distance from the vertical axis."""
    r, radius = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyz"), F.lit(0.0))), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return window_points.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in "xyz"], F.min(r).alias("nearest"), F.avg(radius).alias("radius_mean"), F.stddev_pop(radius).alias("radius_std"), F.count("*").alias("n_points"))


def rate(ingested: DataFrame, rate_window: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    """Points in each tumbling ``rate_window`` of arrival time (recv_time), as a rate."""
    if rate_window <= 0:
        raise ValueError("rate_window must be > 0")
    slot = F.floor(F.col("recv_time") / rate_window).alias("slot")
    return ingested.groupBy(*keys, slot).agg((F.sum(F.size("pts")) / rate_window).alias("points_per_second"))


class Accumulator:
    """The rolling window as a consumer fills it, batch by batch: scans wait while they are newer than every sample by more than the tolerance,
    the oldest waiting one is counted out when the queue is full, and the window keeps the newest by (stamp, arrival)."""

    def __init__(self, max_scans: int = 100, tolerance: float = MAX_TIME_GAP, pending: int | None = None, drop_zero_returns: bool = True):
        if tolerance <= 0:
            raise ValueError("max_time_gap must be > 0")
        self.most, self.tolerance, self.drop = checked(max_scans), tolerance, drop_zero_returns
        self.queue = checked(max_scans if pending is None else pending)
        self.waiting: list[tuple] = []
        self.window: list[tuple] = []  # (stamp, arrival, points)
        self.counts = dict.fromkeys(("scans_accumulated", "scans_unmatched", "points_accumulated"), 0)

    def take(self, scans, samples) -> int:
        """Scans taken into the window from a batch and the visible inertial samples."""
        self.waiting += scans
        over = max(0, len(self.waiting) - self.queue)
        self.counts["scans_unmatched"] += over
        self.waiting = self.waiting[over:]
        known = sorted(samples, key=lambda m: m[1])
        if not self.waiting or not known:
            return 0
        t, s = np.array([m[1] for m in known]), np.array([m[1] for m in self.waiting])
        held = s > t[-1] + self.tolerance
        after = np.minimum(np.searchsorted(t, s), len(t) - 1)
        before = np.maximum(np.searchsorted(t, s) - 1, 0)
        nearest = np.where(np.abs(s - t[before]) <= np.abs(t[after] - s), before, after)
        good = ~held & (np.abs(t[nearest] - s) <= self.tolerance)
        self.counts["scans_unmatched"] += int((~held & ~good).sum())
        taken = 0
        for i in np.flatnonzero(good).tolist():
            p = self.waiting[i][3]
            xyz = np.stack([p[c] for c in "xyz"], 1).astype(np.float64) if len(p) else np.zeros((0, 3))
            xyz = xyz[(xyz != 0).any(1)] if self.drop else xyz
            if len(xyz):
                insort(self.window, (self.waiting[i][1], self.counts["scans_accumulated"], rotated(xyz, known[nearest[i]][3][:4])), key=lambda e: e[:2])
                del self.window[: max(0, len(self.window) - self.most)]
                self.counts["scans_accumulated"] += 1
                self.counts["points_accumulated"] += len(xyz)
                taken += 1
        self.waiting = [self.waiting[i] for i in np.flatnonzero(held).tolist()]
        return taken

    def points(self) -> np.ndarray:
        """(n, 3), oldest scan first."""
        return np.concatenate([e[2] for e in self.window]) if self.window else np.zeros((0, 3))

    def reset(self) -> None:
        """Empties window and queue; counters go on."""
        self.waiting, self.window = [], []


WINDOW = "recording_id string, stamp double, pos long, x double, y double, z double"


class _Window:
    def __init__(self, key: tuple, max_scans: int, tolerance: float, period: float, imu_window: int, in_parts: bool):
        self.key, self.window = key[0], Accumulator(max_scans, tolerance)
        self.batcher = Batcher(period, imu_window, self.window.queue if in_parts else None)

    def take(self, pdf) -> list[tuple]:
        for at, data in zip(pdf["recv_time"].tolist(), pdf["payload"]):
            if (message := unpack(data)) is not None and (batch := self.batcher.take(at, message)) is not None:
                self.window.take(batch[1], batch[2])
        return []

    def close(self) -> list[tuple]:
        if (batch := self.batcher.close()) is not None:
            self.window.take(batch[1], batch[2])
        return [(self.key, stamp, i, *p) for stamp, _, xyz in self.window.window for i, p in enumerate(xyz.tolist())]


def replay_window(datagrams: DataFrame, max_scans: int = 100, tolerance: float = MAX_TIME_GAP, period: float = PERIOD, imu_window: int = IMU_WINDOW, in_parts: bool = False, by_time: bool = False) -> DataFrame:
    """Points of the rolling window at the end of each recording, as a consumer would hold them; ``in_parts`` batches do not overflow its queue."""
    return datagram_fold(datagrams, ["recording_id"], lambda k: _Window(k, max_scans, tolerance, period, imu_window, in_parts), WINDOW, by_time)
