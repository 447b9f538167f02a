"""Disjoint event-time frames that begin with data, not with the clock.

A frame starts at a scan and takes all scans less than ``duration`` later; the next one starts at the next scan. That is a chain
of jumps, so it looks sequential; but every jump out of a stretch of time begins with one of its few last frames, and where the
next stretch is entered decides the rest. Recordings are therefore cut into slices of many frames: each slice works out,
for every scan that could be its first start, where the chain through it ends; a fold over these few rows for each slice picks the
real entries; the slices then number their frames. A long recording is as parallel as many short ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitflow.config import MAX_TIME_GAP, MIN_POINTS
from orbitflow.functions import geometry as G
from orbitflow.operators.align import align

#: Frames in a slice.
SLICE = 4096


def jumps(stamps: np.ndarray, duration: float) -> np.ndarray:
    """For each of the sorted stamps the index of the first one at least ``duration`` later (exactly as ``later - stamp >= duration`` says)."""
    at = np.searchsorted(stamps, stamps + duration)
    while (early := (at < len(stamps)) & (np.take(stamps, at, mode="clip") - stamps < duration)).any():
        at = at + early
    while (late := (at > 0) & (np.take(stamps, at - 1, mode="clip") - stamps >= duration)).any():
        at = at - late
    return at


def chain_starts(stamps: np.ndarray, duration: float, first: int = 0) -> list[int]:
    """Indexes of the frame starts from ``first`` on."""
    to, out, i = jumps(stamps, duration).tolist(), [], first
    while i < len(to):
        out.append(i)
        i = to[i]
    return out


def _candidates(duration: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(pdf["stamp"].to_numpy())
        to = jumps(t, duration)
        last, frames = np.arange(len(t)), np.ones(len(t), np.int64)
        for i in range(len(t) - 1, -1, -1):
            if to[i] < len(t):
                last[i], frames[i] = last[to[i]], frames[to[i]] + 1
        heads = min(len(t), int(to[0]) + 1)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "slice": pdf["slice"].iloc[0], "head": t[:heads], "last": t[last[:heads]], "frames": frames[:heads]})

    return run


def _entries(duration: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, t0, number = [], np.nan, -1
        for part, own in pdf.sort_values(["slice", "head"]).groupby("slice", sort=True):
            heads = own["head"].to_numpy()
            later = np.flatnonzero(heads - t0 >= duration) if number >= 0 else np.zeros(1, np.int64)
            entry = float(heads[later[0]]) if len(later) else np.nan
            rows.append((pdf["recording_id"].iloc[0], part, t0, number, entry))
            if len(later):
                t0, number = float(own["last"].iloc[later[0]]), number + int(own["frames"].iloc[later[0]])
        return pd.DataFrame(rows, columns=["recording_id", "slice", "carried", "carried_id", "entry"])

    return run


def _numbered(duration: float):
    def run(stamps: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if stamps.empty:
            return pd.DataFrame({"recording_id": [], "stamp": [], "frame_t0": [], "frame_id": []})
        t, e = np.unique(stamps["stamp"].to_numpy()), entries.iloc[0]
        starts = chain_starts(t, duration, int(np.searchsorted(t, e["entry"]))) if e["entry"] == e["entry"] else []
        place = np.searchsorted(starts, np.arange(len(t)), side="right")
        t0 = np.r_[e["carried"], t[starts]][place]
        return pd.DataFrame({"recording_id": stamps["recording_id"].iloc[0], "stamp": t, "frame_t0": t0, "frame_id": e["carried_id"] + place})

    return run


def greedy_frames(scans: DataFrame, duration: float, frames_in_slice: int = SLICE) -> DataFrame:
    """``scans(recording_id, stamp, ...)`` with frame_t0 and frame_id (from 0 in each recording). Null or NaN stamps go."""
    if duration <= 0:
        raise ValueError("frame_duration must be > 0")
    known = scans.where(F.col("stamp").isNotNull() & ~F.isnan("stamp") & F.col("recording_id").isNotNull())
    stamps = known.select("recording_id", F.floor(F.col("stamp") / (duration * frames_in_slice)).alias("slice"), "stamp")
    # One exchange of bare stamps serves both passes over the slices.
    heads = stamps.groupBy("recording_id", "slice").applyInPandas(_candidates(duration), "recording_id string, slice long, head double, last double, frames long")
    entries = heads.groupBy("recording_id").applyInPandas(_entries(duration), "recording_id string, slice long, carried double, carried_id long, entry double")
    keys = ["recording_id", "slice"]
    numbered = stamps.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(_numbered(duration), "recording_id string, stamp double, frame_t0 double, frame_id long")
    return known.join(numbered, ["recording_id", "stamp"])


def starts_native(scans: DataFrame, duration: float) -> DataFrame:
    """recording_id and the array of its frame starts, by one fold in SQL; for recordings of a few thousand frames, as the array is copied as it grows."""
    from_last = lambda acc: F.element_at(acc, -1)
    fold = F.aggregate(
        F.array_sort(F.collect_list("stamp")),
        F.array().cast("array<double>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - from_last(acc) >= duration), F.concat(acc, F.array(t))).otherwise(acc),
    )
    return scans.groupBy("recording_id").agg(fold.alias("starts"))


def live(scans: DataFrame) -> DataFrame:
    """Scans that have any point that is not a zero return."""
    return scans.where(F.exists("points", lambda p: G.not_zero(p["x"].cast("double"), p["y"].cast("double"), p["z"].cast("double"))))


def ingest(aligned: DataFrame, drop_zero_returns: bool = True, rotate: bool = True, only_live: bool = False) -> DataFrame:
    """Matched scans with ``pts``: rotated double points and their absolute times. Scans without points left vanish; where the caller knows that
    there are none (``only_live``), stamps can be had without reading points."""
    raw = F.filter("points", lambda p: G.not_zero(p["x"].cast("double"), p["y"].cast("double"), p["z"].cast("double"))) if drop_zero_returns else F.col("points")
    widened = F.transform(raw, lambda p: F.struct(*[p[c].cast("double").alias(c) for c in "xyz"], (F.col("stamp") + p["time"].cast("double")).alias("t")))
    kept = aligned.where("state = 'matched'").withColumn("_raw", widened)
    if not only_live:
        kept = kept.where(F.size("_raw") > 0)
    if not rotate:
        return kept.withColumnRenamed("_raw", "pts")
    unit = kept.withColumn("_u", G.normalize_quaternion(F.col("q")))
    turned = F.transform("_raw", lambda p: G.rotate(p, F.col("_u"), normalize=False).withField("t", p["t"]))
    return unit.withColumn("pts", turned).drop("_raw", "_u")


def t_norm(t: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi - lo > 1e-9, (t - lo) / (hi - lo)).otherwise(F.lit(1.0))


def build(framed: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Frames of framed scans with ``pts``: one aggregation, whose largest value is one frame's points. ``sparse`` marks those with too few."""
    per = framed.groupBy("recording_id", "frame_id").agg(
        F.first("frame_t0").alias("frame_t0"),
        F.min(F.array_min(F.transform("pts", lambda p: p["t"]))).alias("t_start"),
        F.max(F.array_max(F.transform("pts", lambda p: p["t"]))).alias("t_end"),
        F.count("*").cast("int").alias("n_scans"),
        F.sum(F.size("pts")).cast("long").alias("n_points"),
        F.array_sort(F.collect_list(F.struct("stamp", "seq", "pts"))).alias("_scans"),
    )
    flat = F.flatten(F.transform("_scans", lambda s: s["pts"]))
    points = F.transform(flat, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), t_norm(p["t"], F.col("t_start"), F.col("t_end")).alias("t_norm")))
    return per.select("recording_id", "frame_id", "frame_t0", "t_start", "t_end", (F.col("t_end") - F.col("t_start")).alias("span"), "n_scans", "n_points", points.alias("points"), (F.col("n_points") < min_points).alias("sparse"))


def assemble(aligned: DataFrame, duration: float, min_points: int = MIN_POINTS, rotate: bool = True) -> DataFrame:
    """Aligned scans to frames, sparse ones marked."""
    return build(greedy_frames(ingest(aligned, rotate=rotate), duration), min_points)


def frames(scans: DataFrame, imu: DataFrame | None, duration: float, tolerance: float = MAX_TIME_GAP, min_points: int = MIN_POINTS, rotate: bool = True) -> DataFrame:
    """Both streams to frames, sparse ones marked. Empty scans go before alignment, so that the pass that numbers frames moves stamps only."""
    return build(greedy_frames(ingest(align(live(scans), imu, tolerance, rotate), rotate=rotate, only_live=True), duration), min_points)


def frame_stats(frames: DataFrame) -> DataFrame:
    """Counters by recording."""
    return frames.groupBy("recording_id").agg(
        F.count(F.when(~F.col("sparse"), 1)).alias("frames_emitted"),
        F.count(F.when(F.col("sparse"), 1)).alias("frames_too_sparse"),
        F.sum("n_scans").cast("long").alias("scans_ingested"),
        F.sum("n_points").alias("points_ingested"),
    )
