"""Connected components by alternating large-star and small-star steps.

Only edges are moved, minima are pre-aggregated before the shuffle and joined back (so a node of very many neighbours is
an ordinary skewed join, not one task's list), and every round is a table in the shared folder. Rounds are logarithmic
in the longest path; the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitflow.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable. Self-loops and repeats do no harm."""
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = scratch.keep(moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "stars")
        scratch.drop(now)
        now, sign = step, step.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
