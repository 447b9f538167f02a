"""Nearest-in-time join under a tolerance.

Only samples within the tolerance can match, so time is cut into buckets many tolerances wide, and a sample near an edge is
copied into the neighbouring bucket. A bucket then decides alone: the join is one shuffle by (recording, bucket) and two running
windows, however long one recording is, with no pair ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitflow.config import MAX_TIME_GAP, Config

#: Tolerances in a bucket's width; at least 4, so that a sample is in two buckets at most.
WIDTH = 256


def nearest_asof(left: DataFrame, right: DataFrame, tolerance: float = MAX_TIME_GAP, by: str = "recording_id", stamp: str = "stamp", order: str = "seq") -> DataFrame:
    """``left`` with ``match`` (a struct of the other columns of the nearest row of ``right``) and ``gap``; null where none is near enough.

    The tolerance is inclusive; of two equally near samples the earlier wins. Among samples with one stamp the last to arrive
    (by ``order``) stands for those before, the first to arrive for those at or after the left row's stamp. Null or NaN stamps match nothing.
    """
    if tolerance <= 0:
        raise ValueError("tolerance must be > 0")
    width = WIDTH * tolerance
    known = F.col(stamp).isNotNull() & ~F.isnan(stamp)

    def bucket(at: Column) -> Column:
        return F.floor(at / width)

    reach = tolerance * 1.001 + F.abs(F.col(stamp)) * 4e-16
    rest = [c for c in right.columns if c != by]
    near = right.where(known).select(
        by,
        F.explode(F.array_distinct(F.array(bucket(F.col(stamp) - reach), bucket(F.col(stamp) + reach)))).alias("_bucket"),
        F.col(stamp).alias("_at"),
        F.lit(1).alias("_side"),
        F.col(order).alias("_order"),
        F.struct(*rest).alias("_sample"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"),
    )
    mine = left.select(
        by,
        F.when(known, bucket(F.col(stamp))).alias("_bucket"),
        F.col(stamp).alias("_at"),
        F.lit(0).alias("_side"),
        F.col(order).alias("_order"),
        F.lit(None).cast(near.schema["_sample"].dataType).alias("_sample"),
        F.struct(*left.columns).alias("_row"),
    )
    both = mine.unionByName(near)
    place = Window.partitionBy(by, "_bucket")
    before = place.orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, -1)
    after = place.orderBy(F.desc("_at"), F.desc("_side"), F.desc("_order")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_l", F.last("_sample", ignorenulls=True).over(before)).withColumn("_r", F.last("_sample", ignorenulls=True).over(after)).where("_side = 0")
    back, ahead = F.col("_at") - F.col(f"_l.{stamp}"), F.col(f"_r.{stamp}") - F.col("_at")
    earlier = F.col("_l").isNotNull() & (F.col("_r").isNull() | (back <= ahead))
    gap = F.when(earlier, back).otherwise(ahead)
    chosen = F.when(earlier, F.col("_l")).otherwise(F.col("_r"))
    good = known_gap(gap, tolerance) & F.col("_bucket").isNotNull()
    return seen.select("_row.*", F.when(good, chosen).alias("match"), F.when(good, gap).alias("gap"))


def known_gap(gap: Column, tolerance: float) -> Column:
    return F.coalesce(gap <= tolerance, F.lit(False))


def align(scans: DataFrame, imu: DataFrame, tolerance: float = MAX_TIME_GAP, rotate_with_imu: bool = Config.rotate_with_imu) -> DataFrame:
    """``scans`` with q, imu_seq, gap and ``state``: matched, pending (newer than the recording's every sample) or unmatched.

    Without rotation the inertial stream is not read at all and every scan is matched with the identity.
    """
    if not rotate_with_imu:
        identity = F.struct(*[F.lit(v).alias(c) for c, v in zip("xyzw", (0.0, 0.0, 0.0, 1.0))])
        return scans.select("*", identity.alias("q"), F.lit(None).cast("long").alias("imu_seq"), F.lit(None).cast("double").alias("gap"), F.lit("matched").alias("state"))
    newest = imu.groupBy("recording_id").agg(F.max("stamp").alias("_newest"))
    met = nearest_asof(scans, imu.select("recording_id", "seq", "stamp", "q"), tolerance).join(newest, "recording_id", "left")
    state = F.when(F.col("match").isNotNull(), "matched").when(F.col("_newest").isNull() | (F.col("stamp") > F.col("_newest")), "pending").otherwise("unmatched")
    return met.select(*scans.columns, F.col("match.q").alias("q"), F.col("match.seq").alias("imu_seq"), "gap", state.alias("state"))


def alignment_counts(aligned: DataFrame) -> DataFrame:
    """Matched, pending and unmatched scans by recording."""
    return aligned.groupBy("recording_id").agg(*[F.count(F.when(F.col("state") == s, 1)).alias(f"scans_{s}") for s in ("matched", "pending", "unmatched")])
