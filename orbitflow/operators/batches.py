"""Micro-batches of a recording, from arrival times alone.

A batch closes with the first message that comes ``period`` or more after the one that opened it, and that message also opens the next one. Such a message is later
than all before it, so on the running maximum of arrival times (clocks may step back) the openings are a chain of frames: ``framing`` finds it in
parallel slices. Nothing is decoded; a message's kind is in its first bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitflow.config import IMU_WINDOW, PERIOD
from orbitflow.functions.codec import HEADER, IMU_PAYLOAD, IMU_TYPE, SCAN_HEAD, SCAN_TYPE
from orbitflow.operators.framing import greedy_frames
from orbitflow.operators.sliced import by_number, neighbours, running_max

KEYS = ["recording_id"]


def kind_of(payload: Column) -> Column:
    """imu or scan where a datagram can be decoded, else null."""
    starts = lambda number: F.hex(F.substring(payload, 1, 4)) == number.to_bytes(4, "little").hex().upper()
    size = F.octet_length(payload) - HEADER.size
    return F.when(starts(IMU_TYPE) & (size >= IMU_PAYLOAD.size), "imu").when(starts(SCAN_TYPE) & (size >= SCAN_HEAD.size), "scan")


def micro_batches(datagrams: DataFrame, period: float = PERIOD, imu_window: int = IMU_WINDOW) -> DataFrame:
    """recording_id, batch_id, n_scans, imu_window (samples visible at its end), first_seq, last_seq: what a consumer would have seen at once.

    The last batch may hold no message, only the window; it is there if the window holds any. Rows without arrival time or recording go.
    """
    messages = datagrams.select(*KEYS, "seq", "recv_time", kind_of(F.col("payload")).alias("kind")).where("kind IS NOT NULL AND recv_time IS NOT NULL")
    ordered = running_max(messages, KEYS, ["seq"], by_number("seq"), F.col("recv_time"), "stamp")
    framed = greedy_frames(ordered.drop("recv_time"), period)
    seen = neighbours(framed.select(*KEYS, "seq", "kind", "frame_id"), KEYS, ["seq"], by_number("seq"), ["frame_id"])
    closing = F.coalesce(F.col("_prev.frame_id") != F.col("frame_id"), F.lit(False))
    placed = seen.withColumn("batch_id", F.col("frame_id") - closing.cast("long"))
    imu = F.count(F.when(F.col("kind") == "imu", 1))
    own = placed.groupBy(*KEYS, "batch_id").agg(F.count(F.when(F.col("kind") == "scan", 1)).alias("n_scans"), imu.alias("n_imu"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    whole = placed.groupBy(*KEYS).agg(F.max("frame_id").alias("batch_id"), F.max("batch_id").alias("_b"), imu.alias("_imu"), F.max("seq").alias("last_seq")).where("batch_id > _b AND _imu > 0")
    empty = whole.select(*KEYS, "batch_id", F.lit(0).cast("long").alias("n_scans"), F.lit(0).cast("long").alias("n_imu"), F.lit(None).cast("long").alias("first_seq"), "last_seq")
    upto = F.sum("n_imu").over(Window.partitionBy(*KEYS).orderBy("batch_id"))  # one row a batch
    return own.unionByName(empty).select(*KEYS, "batch_id", "n_scans", F.least(upto, F.lit(imu_window)).cast("long").alias("imu_window"), "first_seq", "last_seq")
