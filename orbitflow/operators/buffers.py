"""Bounded histories as queries: the newest rows of a stream, by arrival.

``newest`` is an aggregation with a bounded buffer for each key where Spark allows it, not a sort of the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["recording_id"]


def checked(n: int, maxlen: int | None = None) -> int:
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("n must be an int")
    if n < 1:
        raise ValueError("n must be >= 1")
    if maxlen is not None and n > maxlen:
        raise ValueError(f"n is larger than the buffer ({maxlen})")
    return n


def latest(df: DataFrame, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """The newest row of each key; combines before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("_r")).select("_r.*")


def latest_n(df: DataFrame, n: int, maxlen: int | None = None, allow_partial: bool = True, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """The newest ``n`` rows of each key with ``rank`` from 1, oldest first. Without ``allow_partial`` keys with fewer rows raise when read.

    The rank filter is pushed below the shuffle (a limit for each key and task), so a key with very many rows sends ``n`` from a task.
    """
    n = checked(n, maxlen)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    held = top.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    if not allow_partial:
        held = held.where(F.when(F.col("_n") < n, F.raise_error(F.lit("the buffer holds fewer rows")).cast("boolean")).otherwise(True))
    return held.withColumn("rank", (F.col("_n") - F.col("_rn") + 1).cast("long")).drop("_rn", "_n")


def counters(df: DataFrame, maxlen: int, keys: list[str] = KEYS) -> DataFrame:
    """received, held and dropped of a buffer that nobody drains."""
    n = F.count("*")
    return df.groupBy(*keys).agg(n.alias("received"), F.least(n, F.lit(maxlen)).alias("held"), F.greatest(n - maxlen, F.lit(0)).cast("long").alias("dropped"))


def stream_stats(messages: DataFrame, scan_maxlen: int = 360, imu_maxlen: int = 500, keys: list[str] = KEYS) -> DataFrame:
    """Counters of a stream of decoded messages by status and kind."""
    count = lambda test: F.count(F.when(test, 1))
    scans, imu = count(F.col("scan").isNotNull()), count(F.col("imu").isNotNull())
    return messages.groupBy(*keys).agg(
        scans.alias("scans_received"), imu.alias("imu_received"), F.greatest(scans - scan_maxlen, F.lit(0)).cast("long").alias("scans_dropped"), F.greatest(imu - imu_maxlen, F.lit(0)).cast("long").alias("imu_dropped"),
        F.least(scans, F.lit(scan_maxlen)).alias("scans_held"), F.least(imu, F.lit(imu_maxlen)).alias("imu_held"), count(F.col("msg_type").isNull()).alias("unparsed"),
    )


def snapshot(df: DataFrame, maxlen: int, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """What the buffer holds, oldest first by ``rank``; nothing is consumed."""
    return latest_n(df, maxlen, keys=keys, order=order)


# A consumer's state is a table of offsets (keys, ``upto``: the order of the newest row that it has seen). Rows and offsets are tables, so what one consumer takes leaves
# others alone, and a step that is run again after a failure hands over the same rows.


def unread(df: DataFrame, offsets: DataFrame | None, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Rows beyond a consumer's offsets; all for keys without one."""
    if offsets is None:
        return df
    return df.join(offsets.select(*keys, "upto"), keys, "left").where(F.col("upto").isNull() | (F.col(order) > F.col("upto"))).drop("upto")


def advanced(df: DataFrame, offsets: DataFrame | None, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """The offsets after everything in ``df`` was seen."""
    now = df.groupBy(*keys).agg(F.max(order).alias("upto"))
    return now if offsets is None else now.unionByName(offsets.select(*keys, "upto")).groupBy(*keys).agg(F.max("upto").alias("upto"))


def drain(df: DataFrame, offsets: DataFrame | None, maxlen: int, keys: list[str] = KEYS, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(rows, offsets): each row is handed over once, oldest first by ``rank``, unless more than ``maxlen`` came in between, when the oldest are lost."""
    return latest_n(unread(df, offsets, keys, order), maxlen, keys=keys, order=order), advanced(df, offsets, keys, order)


def newest_unseen(df: DataFrame, offsets: DataFrame | None, keys: list[str] = KEYS, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(rows, offsets): the newest row of each key with any that the consumer has not seen; the others in between count as seen."""
    return latest(unread(df, offsets, keys, order), keys, order), advanced(df, offsets, keys, order)


def cleared(df: DataFrame, offsets: DataFrame, maxlen: int, keys: list[str] = KEYS, order: str = "seq") -> DataFrame:
    """Counters of a buffer that was emptied at ``offsets``: received goes on counting, held starts afresh, rows lost to a full buffer stay counted."""
    late = F.col("upto").isNull() | (F.col(order) > F.col("upto"))
    marked = df.join(offsets.select(*keys, "upto"), keys, "left")
    before, after = F.count(F.when(~late, 1)), F.count(F.when(late, 1))
    return marked.groupBy(*keys).agg((before + after).alias("received"), F.least(after, F.lit(maxlen)).alias("held"), (F.greatest(before - maxlen, F.lit(0)) + F.greatest(after - maxlen, F.lit(0))).cast("long").alias("dropped"))
