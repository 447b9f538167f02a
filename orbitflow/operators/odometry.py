"""Poses and map points from frames.

Registration is sequential within a recording, so frames are sorted by Spark and stream through a task one at a time; recordings and
configurations run side by side. A task holds one local map (pruned by range) and one frame.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitflow import schemas
from orbitflow.config import IMU_WINDOW, MAP_VOXEL, PERIOD, Config, Registration
from orbitflow.functions import geometry as G
from orbitflow.functions.codec import unpack
from orbitflow.operators.fold import Assembler, Batcher, datagram_fold, ordered_fold
from orbitflow.operators.mapping import voxel_downsample
from orbitflow.operators.registration import Odometry, first_in_voxel, move


class _Register:
    """Rows of poses (``cloud`` false) or of world points (true) from a recording's frames."""

    def __init__(self, key: tuple, config: Config, fixed: Registration, map_deskew: bool | None, cloud: bool, voxel: float):
        self.key, self.cloud, self.voxel = key[0], cloud, voxel
        self.odometry, self.ord = Odometry(config, fixed, map_deskew), 0

    def frame(self, frame_id: int, xyz: np.ndarray, times: np.ndarray, t_end: float, span: float) -> list[tuple]:
        began = time.perf_counter()
        before = self.odometry.pose
        pose = self.odometry.register(xyz, times)
        took = time.perf_counter() - began
        if not self.cloud:
            delta = np.linalg.inv(before) @ pose
            return [(self.key, frame_id, t_end, *pose[:3, 3].tolist(), pose.ravel().tolist(), delta.ravel().tolist(), self.odometry.threshold, span, len(xyz), took)]
        world = first_in_voxel(move(self.odometry.last_map_cloud, pose), self.voxel)
        rows = [(self.key, frame_id, self.ord + i, *p) for i, p in enumerate(world.tolist())]
        self.ord += len(world)
        return rows


class _FromFrames(_Register):
    def take(self, pdf: pd.DataFrame) -> list[tuple]:
        rows = []
        for f in pdf.itertuples():
            p = np.array([(q["x"], q["y"], q["z"], q["t_norm"]) for q in f.points], float).reshape(-1, 4)
            rows += self.frame(int(f.frame_id), p[:, :3], p[:, 3], f.t_end, f.t_end - f.t_start)
        return rows

    def close(self) -> list[tuple]:
        return []


class _FromDatagrams(_Register):
    """The whole of a replay in one pass: batches, alignment, frames, registration. Nothing but its result is ever stored."""

    def __init__(self, key, config, fixed, map_deskew, cloud, voxel, period, imu_window, in_parts, options):
        super().__init__(key, config, fixed, map_deskew, cloud, voxel)
        self.assembler, self.n = Assembler(config.frame_duration, rotate=config.rotate_with_imu, **options), 0
        self.batcher = Batcher(period, imu_window, self.assembler.most if in_parts else None)

    def _rows(self, frames: list) -> list[tuple]:
        rows = []
        for f in frames:
            rows += self.frame(self.n, f.points, f.times, f.t_end, f.span)
            self.n += 1
        return rows

    def take(self, pdf: pd.DataFrame) -> list[tuple]:
        rows = []
        for at, data in zip(pdf["recv_time"].tolist(), pdf["payload"]):
            if (message := unpack(data)) is not None and (batch := self.batcher.take(at, message)) is not None:
                rows += self._rows(self.assembler.take(batch[1], batch[2]))
        return rows

    def close(self) -> list[tuple]:
        batch = self.batcher.close()
        rows = self._rows(self.assembler.take(batch[1], batch[2])) if batch is not None else []
        return rows + self._rows(self.assembler.close())


def register(frames: DataFrame, config: Config | None = None, fixed: Registration | None = None) -> DataFrame:
    """``schemas.POSES`` from ``frames(recording_id, frame_id, t_start, t_end, points)``; sparse frames must be left out before."""
    c, r = config or Config(), fixed or Registration()
    rows = frames.select("recording_id", "frame_id", "t_start", "t_end", "points")
    return ordered_fold(rows, ["recording_id"], ["frame_id"], lambda k: _FromFrames(k, c, r, None, False, 0), schemas.POSES)


def replay(datagrams: DataFrame, config: Config | None = None, period: float = PERIOD, imu_window: int = IMU_WINDOW, assembling: dict | None = None, in_parts: bool = False, by_time: bool = False, **changes) -> DataFrame:
    """``schemas.POSES`` of recordings; ``assembling`` are options of ``Assembler``; ``in_parts`` batches do not overflow; an unknown config name is a TypeError before anything is read."""
    c = (config or Config()).with_(**changes)
    return datagram_fold(datagrams, ["recording_id"], lambda k: _FromDatagrams(k, c, Registration(), None, False, 0, period, imu_window, in_parts, assembling or {}), schemas.POSES, by_time)


def accumulate_map(datagrams: DataFrame, map_voxel: float = MAP_VOXEL, map_deskew: bool = True, config: Config | None = None, period: float = PERIOD, imu_window: int = IMU_WINDOW, assembling: dict | None = None, in_parts: bool = False, by_time: bool = False, **changes) -> DataFrame:
    """World points of recordings, the first seen in each voxel; a negative voxel keeps all.

    A frame is thinned where it is registered, frames are thinned against each other by an aggregation: first-seen within a frame, then the
    first frame, is first-seen over all.
    """
    if not map_voxel:
        raise RuntimeError("a map needs a voxel size; a negative one keeps every point")
    c = (config or Config()).with_(**changes)
    cloud = datagram_fold(datagrams, ["recording_id"], lambda k: _FromDatagrams(k, c, Registration(), map_deskew, True, map_voxel, period, imu_window, in_parts, assembling or {}), schemas.CLOUD, by_time)
    return voxel_downsample(cloud, map_voxel, keys=["recording_id"])


def sweep(datagrams: DataFrame, configs: dict[str, Config], period: float = PERIOD, assembling: dict | None = None, in_parts: bool = False, by_time: bool = False) -> DataFrame:
    """Poses of every recording under every configuration (a small table of them); recording and configuration make the key."""
    names = F.array(*[F.lit(n) for n in configs])
    keyed = datagrams.withColumn("config", F.explode(names))
    fixed = Registration()

    def start(key: tuple):
        return _Keyed(key, _FromDatagrams((key[0],), configs[key[1]], fixed, None, False, 0, period, IMU_WINDOW, in_parts, assembling or {}))

    return datagram_fold(keyed, ["recording_id", "config"], start, "config string, " + schemas.POSES, by_time)


class _Keyed:
    def __init__(self, key: tuple, inner: _FromDatagrams):
        self.name, self.inner = key[1], inner

    def take(self, pdf: pd.DataFrame) -> list[tuple]:
        return [(self.name, *row) for row in self.inner.take(pdf)]

    def close(self) -> list[tuple]:
        return [(self.name, *row) for row in self.inner.close()]


def place(cloud: DataFrame, poses: DataFrame) -> DataFrame:
    """Sensor points ``cloud(recording_id, frame_id, ord, x, y, z)`` in the world of ``poses``."""
    p = poses.select("recording_id", "frame_id", "pose")
    moved = cloud.join(p, ["recording_id", "frame_id"]).withColumn("_w", G.transform(F.struct("x", "y", "z"), F.col("pose")))
    return moved.select("recording_id", "frame_id", "ord", "_w.*")
