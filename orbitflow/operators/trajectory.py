"""Trajectory metrics: window functions and aggregates over poses, which are few (one a frame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitflow.config import Config
from orbitflow.functions import geometry as G
from orbitflow.operators.sliced import ROWS, by_number, neighbours, numbered, quantiles

KEYS = ["recording_id"]
STILL = 0.15
# Characters of the speed profile.
RAMP = " .:!#"


def _distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def _xyz() -> list[Column]:
    return [F.col(c) for c in "xyz"]


def scaled(poses: DataFrame, scale: float) -> DataFrame:
    """Positions by a factor; rotations stay."""
    return poses.withColumns({c: F.col(c) * scale for c in "xyz"})


def steps(poses: DataFrame, frame_duration: float = Config.frame_duration, keys: list[str] = KEYS) -> DataFrame:
    """``poses`` with step (m), speed (m/s, by the configured duration) and second, the norm of the second difference; null at the ends."""
    known = neighbours(poses, keys, ["frame_id"], by_number("frame_id"), ["x", "y", "z"], ahead=True)
    back, ahead = [F.col(f"_prev.{c}") for c in "xyz"], [F.col(f"_next.{c}") for c in "xyz"]
    step = _distance(_xyz(), back)
    second = _distance([a + b for a, b in zip(ahead, back)], [2 * c for c in _xyz()])
    return known.withColumns({"step": step, "speed": step / frame_duration, "second": second}).drop("_prev", "_next")


def rotations(poses: DataFrame) -> DataFrame:
    """``poses`` with rotation_deg of their delta (16 numbers, row-major)."""
    trace = sum((F.get("delta", F.lit(i)) for i in (0, 5, 10)), F.lit(0.0))
    return poses.withColumn("rotation_deg", G.rotation_deg(trace))


def path_metrics(poses: DataFrame, frame_duration: float = Config.frame_duration, keys: list[str] = KEYS) -> DataFrame:
    """One row a recording: frames, path_length, net_displacement, jitter_mm (0 under three poses), loop_pct."""
    at = F.struct(*_xyz())
    each = steps(poses, frame_duration, keys)
    per = each.groupBy(*keys).agg(
        F.count("*").alias("frames"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"),
        F.min_by(at, "frame_id").alias("_a"),
        F.max_by(at, "frame_id").alias("_b"),
    )
    per = per.join(quantiles(each, keys, "second", {"_second": 0.5}), keys, "left").withColumn("_second", F.coalesce("_second", F.lit(0.0)))
    net = _distance([F.col(f"_b.{c}") for c in "xyz"], [F.col(f"_a.{c}") for c in "xyz"])
    # 2.45 is the gain of a second difference on white noise, 0.89 the median of its norm.
    out = per.select(*keys, "frames", "path_length", net.alias("net_displacement"), (F.col("_second") / 2.45 / 0.89 * 1000).alias("jitter_mm"))
    return out.withColumn("loop_pct", 100 * F.col("net_displacement") / F.greatest("path_length", F.lit(1e-9)))


def clipping(poses: DataFrame, frame_duration: float = Config.frame_duration, still: float = STILL, keys: list[str] = KEYS) -> DataFrame:
    """Frames at rest before and after the movement, and whether either end is cut off. Nothing moving: zeros and no flags."""
    s = steps(poses, frame_duration, keys).where("step IS NOT NULL")
    moving = F.when(F.col("speed") > still, F.col("_i") - 1)
    per = numbered(s, keys, ["frame_id"], by_number("frame_id")).groupBy(*keys).agg(F.min(moving).alias("_first"), F.max(moving).alias("_last"), F.count("*").alias("_n"))
    head, tail = F.col("_first"), F.col("_n") - 1 - F.col("_last")
    return per.select(*keys, F.coalesce(head, F.lit(0)).cast("long").alias("head"), F.coalesce(tail, F.lit(0)).cast("long").alias("tail"), F.coalesce(head == 0, F.lit(False)).alias("start_clipped"), F.coalesce(tail == 0, F.lit(False)).alias("end_clipped"))


def cost(poses: DataFrame, frame_duration: float = Config.frame_duration, keys: list[str] = KEYS) -> DataFrame:
    """ms_per_frame and budget_pct, the share of the frame's period that registration took."""
    ms = 1000 * F.sum("seconds") / F.greatest(F.count("*"), F.lit(1))
    return poses.groupBy(*keys).agg(ms.alias("ms_per_frame"), (ms / (10 * frame_duration)).alias("budget_pct"))


def details(poses: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Sizes, spans (population deviation), heights, thresholds and the 95th percentile of rotation."""
    r = rotations(poses)
    per = r.groupBy(*keys).agg(
        F.avg("size").alias("size_mean"), F.min("size").alias("size_min"), F.max("size").alias("size_max"),
        F.avg("span").alias("span_mean"), F.stddev_pop("span").alias("span_std"),
        F.min("z").alias("z_min"), F.max("z").alias("z_max"),
        F.min_by("threshold", "frame_id").alias("threshold_first"), F.max_by("threshold", "frame_id").alias("threshold_last"),
        F.min("threshold").alias("threshold_min"), F.max("threshold").alias("threshold_max"),
    )
    return per.join(quantiles(r, keys, "rotation_deg", {"rotation_p95": 0.95}), keys, "left")


def verdicts(poses: DataFrame, meta: DataFrame, frame_duration: float = Config.frame_duration, keys: list[str] = KEYS) -> DataFrame:
    """Errors against the truth by the recording's kind, and warnings as an array."""
    m = path_metrics(poses, frame_duration, keys).join(clipping(poses, frame_duration, keys=keys), keys, "left").join(details(poses, keys), keys).join(cost(poses, frame_duration, keys), keys).join(meta, keys, "left")
    net, truth = F.col("net_displacement"), F.col("truth_m")
    missing = F.lit(str(round(1000 * STILL * frame_duration)))
    warnings = F.array_compact(F.array(
        F.when(F.col("start_clipped"), F.concat(F.lit("CLIPPED at START: up to "), missing, F.lit(" mm missing"))),
        F.when(F.col("end_clipped"), F.concat(F.lit("CLIPPED at END: up to "), missing, F.lit(" mm missing"))),
        F.when(F.col("budget_pct") > 100, "slower than the sensor"),
        F.when(F.col("span_std") > 0.01, "frame spans vary"),
    ))
    return m.withColumns({
        "loop_error_pct": F.when(F.col("kind") == "loop", F.col("loop_pct")),
        "drift_mm": F.when(F.col("kind") == "stationary", 1000 * net),
        "scale_error_pct": F.when((F.col("kind") == "line") & (truth != 0), 100 * (net - truth) / truth),
        "warnings": warnings,
    })


def sparkline(poses: DataFrame, frame_duration: float = Config.frame_duration, keys: list[str] = KEYS) -> DataFrame:
    """The speed profile, one character a step."""
    s = steps(poses, frame_duration, keys).where("speed IS NOT NULL")
    per = s.groupBy(*keys).agg(F.max("speed").alias("_top"), F.array_sort(F.collect_list(F.struct("frame_id", "speed"))).alias("_s"))
    level = lambda x: F.least(F.lit(4), F.floor(5 * x["speed"] / F.greatest(F.col("_top"), F.lit(1e-9))).cast("int"))
    return per.select(*keys, F.array_join(F.transform("_s", lambda x: F.substring(F.lit(RAMP), level(x) + 1, F.lit(1))), "").alias("profile"))


#: Frames that the mean cost is taken over.
LAST = 10


def live_lag(progress: DataFrame, frame_duration: float = Config.frame_duration, keys: list[str] = KEYS, rows: int = ROWS) -> DataFrame:
    """``progress(frame_id, newest_stamp, t_end, reg_ms)`` with lag, behind (over three frames) and the mean of the last ten times.

    Frames are numbered and fall into pieces of ``rows``; a piece also gets the nine frames before it.
    """
    lag = F.col("newest_stamp") - F.col("t_end")
    piece = lambda ahead: F.floor((F.col("_i") - 1 + ahead) / rows)
    ranked = numbered(progress, keys, ["frame_id"], by_number("frame_id", rows)).withColumn("_own", piece(0))
    spread = ranked.withColumn("_piece", F.explode(F.sequence(piece(0), piece(LAST - 1))))
    mean = F.avg("reg_ms").over(Window.partitionBy(*keys, "_piece").orderBy("_i").rowsBetween(1 - LAST, 0))
    out = spread.withColumns({"lag": lag, "behind": lag > 3 * frame_duration, "reg_ms_10": mean})
    return out.where("_own = _piece").drop("_i", "_own", "_piece")
