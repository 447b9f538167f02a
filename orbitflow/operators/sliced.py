"""Order within a recording without one task a recording.

A window over a whole recording sorts it in one task. Here its rows fall into slices by a value that grows with their order; windows run within
slices, and what crosses an edge (the neighbour beyond it, the number of rows before it, a running sum) comes from one row a slice, joined back. Results
equal those of the single window, whatever the slices. Exact quantiles work likewise: counts between cut points say which
values are needed, and only those are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds, or rows by number, in a slice.
SECONDS, ROWS = 3600.0, 1 << 18
#: Cut points between which ``quantiles`` counts.
CUTS = 200


def by_stamp(seconds: float = SECONDS) -> Column:
    return F.floor(F.col("stamp") / seconds)


def by_number(column: str = "seq", rows: int = ROWS) -> Column:
    return F.floor(F.col(column) / rows)


def _back(df: DataFrame, per_slice: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``per_slice``, which has one row for each key and slice; null keys are keys."""
    own = [*keys, "_slice"]
    renamed = per_slice.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(own)], *[c for c in per_slice.columns if c not in own])
    same = F.lit(True)
    for i, k in enumerate(own):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(renamed, same, "left").drop(*[f"_k{i}" for i in range(len(own))])


def neighbours(df: DataFrame, keys: list[str], order: list[str], slice_: Column, columns: list[str], ahead: bool = False) -> DataFrame:
    """``df`` with struct ``_prev`` (and ``_next``) of ``columns`` of the row before (after) in ``order``; null at the ends."""
    at, row = F.struct(*order), F.struct(*columns)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    cut = df.withColumn("_slice", slice_)
    ends = cut.groupBy(*keys, "_slice").agg(F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_slice")
    beyond = ends.select(*keys, "_slice", F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"))
    out = _back(cut.withColumns({"_prev": F.lag(row).over(w), "_next": F.lead(row).over(w)} if ahead else {"_prev": F.lag(row).over(w)}), beyond, keys)
    out = out.withColumn("_prev", F.coalesce("_prev", "_before"))
    if ahead:
        out = out.withColumn("_next", F.coalesce("_next", "_after"))
    return out.drop("_slice", "_before", "_after")


def running_sum(df: DataFrame, keys: list[str], order: list[str], slice_: Column, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to and with each row."""
    cut = df.withColumn("_slice", slice_).withColumn("_v", value)
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = cut.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_slice", F.sum("_s").over(over).alias("_carried"))
    out = _back(cut.withColumn(name, inside), before, keys)
    return out.withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0).cast(cut.schema["_v"].dataType))).drop("_slice", "_v", "_carried")


def running_max(df: DataFrame, keys: list[str], order: list[str], slice_: Column, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the greatest ``value`` up to and with each row; nulls do not count."""
    cut = df.withColumn("_slice", slice_).withColumn("_v", value)
    inside = F.max("_v").over(Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    tops = cut.groupBy(*keys, "_slice").agg(F.max("_v").alias("_s"))
    over = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    out = _back(cut.withColumn(name, inside), tops.select(*keys, "_slice", F.max("_s").over(over).alias("_carried")), keys)
    return out.withColumn(name, F.greatest(name, "_carried")).drop("_slice", "_v", "_carried")


def numbered(df: DataFrame, keys: list[str], order: list[str], slice_: Column, name: str = "_i") -> DataFrame:
    """``df`` with ``name``, each row's number in ``order`` from 1."""
    return running_sum(df, keys, order, slice_, F.lit(1).cast("long"), name)


def quantiles(df: DataFrame, keys: list[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of the non-null, non-NaN values of ``column``: one row a key that has any, a column for each of ``wanted``.

    Sketched cut points bound each value's place; counts between them (combined before the shuffle) tell in which gaps the two values lie that
    a quantile falls between, and only the distinct values of those gaps are counted and sorted. No buffer holds a key's values.
    """
    own = keys or ["_all"]
    known = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    v = known.select(*([F.lit(0).alias("_all")] if not keys else keys), F.col(column).cast("double").alias("_x"))
    cuts = v.groupBy(*own).agg(F.percentile_approx("_x", [k / CUTS for k in range(1, CUTS)], 2000).alias("_cuts"))

    def keyed(some: DataFrame, other: DataFrame) -> DataFrame:
        renamed = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(own)], *[c for c in other.columns if c not in own])
        same = F.lit(True)
        for i, k in enumerate(own):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return some.join(renamed, same).drop(*[f"_k{i}" for i in range(len(own))])

    # How many cut points are less, by halving: cut points ascend, and beyond them there is null.
    placed, half = keyed(v, cuts).withColumn("_gap", F.lit(0)), 1 << (CUTS - 1).bit_length() - 1
    while half:
        placed = placed.withColumn("_gap", F.col("_gap") + F.when(F.get("_cuts", F.col("_gap") + (half - 1)) < F.col("_x"), half).otherwise(0))
        half //= 2
    placed = placed.select(*own, "_x", "_gap")
    counts = placed.groupBy(*own, "_gap").agg(F.count("*").alias("_n"))
    to = F.sum("_n").over(Window.partitionBy(*own).orderBy("_gap"))
    spans = counts.select(*own, "_gap", (to - F.col("_n")).alias("_from"), to.alias("_to"), F.sum("_n").over(Window.partitionBy(*own)).alias("_total"))
    ranks = [f(q * (F.col("_total") - 1)).cast("long") for q in wanted.values() for f in (F.floor, F.ceil)]
    needed = spans.where(F.exists(F.array(*ranks), lambda r: (r >= F.col("_from")) & (r < F.col("_to"))))
    held = needed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(own)], F.col("_gap").alias("_g"), "_from", "_total")
    same = F.col("_gap") == F.col("_g")
    for i, k in enumerate(own):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    values = placed.join(held, same).groupBy(*own, "_gap", "_from", "_total", "_x").agg(F.count("*").alias("_n"))
    upto = F.col("_from") + F.sum("_n").over(Window.partitionBy(*own, "_gap").orderBy("_x"))
    lines = values.select(*own, "_x", "_total", (upto - F.col("_n")).alias("_lo"), upto.alias("_hi"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col("_x")))

    aggs = [x.alias(f"_{i}") for i, x in enumerate(at(r) for r in ranks)]
    got = lines.groupBy(*own).agg(F.first("_total").alias("_total"), *aggs)
    out = []
    for i, (name, q) in enumerate(wanted.items()):
        place = q * (F.col("_total") - 1)
        low, high = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        out.append((low + (place - F.floor(place)) * (high - low)).alias(name))
    return got.select(*keys, *out)
