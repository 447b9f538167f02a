"""The rolling window as it was after every arrival, not only at the end: what was taken in, what fell out, and when.

The window keeps the newest scans by (stamp, arrival). An arrival that ``max_scans`` earlier ones exceed is counted as taken in and falls out at once; any
other falls out when the last of ``max_scans`` newer ones arrives. Arrivals are cut into slices. What lies in the window when a slice begins are the newest of all slices
before it: the newest of each slice are ranked, those of 64 slices merge into a group, groups are folded in their order, and each slice gets its beginning from its group and
the slices before it there. Then slices run side by side, each with a heap of ``max_scans``. A recording of any length takes as many tasks as it has slices.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitflow.operators.buffers import KEYS, checked
from orbitflow.operators.sliced import by_number

#: Arrivals of a slice, and slices of a group.
SLICE, GROUP = 4096, 64
_ROWS = "recording_id string, slot long, stamp double, seq long"


def _newest(rows: DataFrame, slot: Column, most: int) -> DataFrame:
    """The newest rows of each slot."""
    at = rows.withColumn("slot", slot)
    w = Window.partitionBy("recording_id", "slot").orderBy(F.desc("stamp"), F.desc("seq"))
    return at.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def _before(tops: DataFrame, within: list[str], most: int) -> DataFrame:
    """For every slot the newest rows of the slots before it in the same group; rows of slot -1 come before all and get none themselves."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        rows = sorted(zip(*(table[c].to_pylist() for c in ("slot", "stamp", "seq"))))
        name, out, kept, i = table["recording_id"][0].as_py() if rows else None, [], [], 0
        while i < len(rows):
            slot = rows[i][0]
            if slot >= 0:
                out += [(name, slot, *k) for k in kept]
            while i < len(rows) and rows[i][0] == slot:
                heapq.heappush(kept, rows[i][1:])
                if len(kept) > most:
                    heapq.heappop(kept)
                i += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.float64(), pa.int64()))], names=["recording_id", "slot", "stamp", "seq"])

    def one(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(fold(iter(table.to_batches())))

    return tops.groupBy(*within).applyInArrow(one, _ROWS)


def evictions(ingested: DataFrame, max_scans: int = 100, size: int = SLICE, group: int = GROUP) -> DataFrame:
    """recording_id, seq, evicted_at: the arrival (seq) at which each scan fell out of the window; scans still in it have no row.

    ``ingested`` has recording_id, seq (order of arrival) and stamp, a row a scan. Rows without stamp or seq never enter. Equal stamps fall out in their order of arrival.
    """
    most = checked(max_scans)
    rows = ingested.where("recording_id IS NOT NULL AND stamp IS NOT NULL AND NOT isnan(stamp) AND seq IS NOT NULL").select("recording_id", F.col("stamp").cast("double").alias("stamp"), F.col("seq").cast("long").alias("seq"))
    tops = _newest(rows, by_number("seq", size), most)
    part = F.floor(F.col("slot") / group)
    groups = _before(_newest(tops.drop("slot"), F.floor(by_number("seq", size) / group), most), ["recording_id"], most)
    inner = tops.withColumn("part", part).unionByName(groups.select("recording_id", F.lit(-1).cast("long").alias("slot"), "stamp", "seq", F.col("slot").alias("part")))
    begins = _before(inner, ["recording_id", "part"], most)

    def replay(table: pa.Table) -> pa.Table:
        arrivals = sorted(zip(*(table[c].to_pylist() for c in ("old", "seq", "stamp"))), key=lambda r: (not r[0], r[1]))
        held = [(stamp, seq) for old, seq, stamp in arrivals if old]
        heapq.heapify(held)
        out = []
        for old, seq, stamp in arrivals:
            if not old:
                heapq.heappush(held, (stamp, seq))
                if len(held) > most:
                    out.append((heapq.heappop(held)[1], seq))
        name = table["recording_id"][0].as_py()
        return pa.table({"recording_id": pa.array([name] * len(out), pa.string()), "seq": pa.array([a for a, _ in out], pa.int64()), "evicted_at": pa.array([b for _, b in out], pa.int64())})

    both = rows.withColumn("slot", by_number("seq", size)).withColumn("old", F.lit(False)).unionByName(begins.withColumn("old", F.lit(True)))
    return both.groupBy("recording_id", "slot").applyInArrow(replay, "recording_id string, seq long, evicted_at long")


def window_log(ingested: DataFrame, batch: Column, max_scans: int = 100, size: int = SLICE, group: int = GROUP) -> DataFrame:
    """recording_id, batch, n_accumulated, n_evicted, n_late (fell out as they came), oldest_evicted and newest_evicted by stamp; a row for each ``batch`` of arrivals.

    ``batch`` tells a row's batch from its seq alone.
    """
    rows = ingested.where("recording_id IS NOT NULL AND stamp IS NOT NULL AND NOT isnan(stamp) AND seq IS NOT NULL").select(*KEYS, "seq", "stamp")
    came = rows.select(*KEYS, batch.alias("batch"), F.lit(1).alias("came"), F.lit(None).cast("long").alias("late"), F.lit(None).cast("double").alias("gone"))
    out = evictions(rows, max_scans, size, group).join(rows, [*KEYS, "seq"])
    went = out.select(*KEYS, F.col("evicted_at"), (F.col("seq") == F.col("evicted_at")).cast("long").alias("late"), F.col("stamp").alias("gone")).withColumnRenamed("evicted_at", "seq")
    went = went.select(*KEYS, batch.alias("batch"), F.lit(None).cast("int").alias("came"), "late", "gone")
    zero = F.lit(0).cast("long")
    return came.unionByName(went).groupBy(*KEYS, "batch").agg(F.count("came").alias("n_accumulated"), F.count("gone").alias("n_evicted"), F.coalesce(F.sum("late"), zero).alias("n_late"), F.min("gone").alias("oldest_evicted"), F.max("gone").alias("newest_evicted"))
