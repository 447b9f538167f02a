"""Maps: voxels, extents, planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitflow.functions import geometry as G
from orbitflow.operators.sliced import quantiles

AXES = ("x", "y", "z")


def voxel_keys(voxel: float) -> list[Column]:
    return [F.floor(F.col(c) / voxel).alias(f"k{c}") for c in AXES]


def voxel_downsample(cloud: DataFrame, voxel: float, keys: list[str] | None = None, order: str = "ord") -> DataFrame:
    """The first point (by ``order``) of each voxel; a voxel size that is not positive changes nothing.

    Aggregates before the shuffle, so a voxel with very many points sends one row from each task. NaN points have no voxel and go.
    """
    if voxel is None or voxel <= 0:
        return cloud
    keys = keys or []
    known = cloud.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    kept = known.groupBy(*keys, *voxel_keys(voxel)).agg(F.min_by(F.struct(*[F.col(c) for c in cloud.columns]), F.col(order)).alias("_p"))
    return kept.select("_p.*")


def voxel_new(seen: DataFrame, cloud: DataFrame, voxel: float, keys: list[str] | None = None, order: str = "ord", max_points: int | None = None) -> DataFrame:
    """What an incremental map takes from ``cloud``: the first point of each voxel that ``seen`` lacks; nothing once ``seen`` has ``max_points``."""
    keys = keys or []
    names = [f"k{c}" for c in AXES]
    fresh = voxel_downsample(cloud, voxel, keys, order).select("*", *voxel_keys(voxel))
    old = seen.select(*keys, *voxel_keys(voxel)).distinct()
    out = fresh.join(old, [*keys, *names], "left_anti").drop(*names)
    if max_points is None:
        return out
    if not keys:
        room = seen.agg((F.count("*") < max_points).alias("_room"))
        return out.join(F.broadcast(room), F.lit(True)).where("_room").drop("_room")  # one row
    full = seen.groupBy(*keys).count().where(F.col("count") >= max_points).select(*keys)
    return out.join(full, keys, "left_anti")


#: Bits of a voxel number on an axis, and of those the low ones that a cell of the map's files spans.
AXIS_BITS, CELL_BITS = 21, 8
# Masks that spread 21 bits to every third place, and the shifts before them.
SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


def voxel_key(voxel: float) -> Column:
    """The voxel of x, y, z as one long in Morton order: 21 bits an axis, so that voxels near each other have near keys and ``cell_of`` is a shift.

    Null for NaN points. A voxel more than 2^20 voxels from the origin raises.
    """
    out = F.lit(0).cast("long")
    for place, c in enumerate(AXES):
        n = F.floor(F.col(c) / voxel).cast("long") + (1 << AXIS_BITS - 1)
        bad = F.raise_error(F.concat(F.lit("outside of the map: "), F.col(c).cast("string"))).cast("long")
        bits = F.when(F.isnan(c) | F.col(c).isNull(), F.lit(None)).when(n.between(0, (1 << AXIS_BITS) - 1), n).otherwise(bad)
        for shift, mask in SPREAD:
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(bits, place))
    return out


def cell_of(key: Column) -> Column:
    """The cube of 2^CELL_BITS voxels a side that a key lies in."""
    return F.shiftright(key, 3 * CELL_BITS)


def map_step(seen: DataFrame, cloud: DataFrame, voxel: float, order: str = "ord", keys: list[str] | None = None) -> DataFrame:
    """What an incremental map takes from ``cloud``, with ``key`` and ``cell``: the first point of each voxel that ``seen`` (with key and cell) lacks.

    Of ``seen`` only the cells that the cloud reaches are read, where it is a table partitioned by cell: they reach its scan as a dynamic filter. There are as many
    as cubes in the sensors' range, few beside the points.
    """
    own = keys or []
    known = cloud.withColumn("key", voxel_key(voxel)).where("key IS NOT NULL")
    fresh = known.groupBy(*own, "key").agg(F.min_by(F.struct(*[F.col(c) for c in cloud.columns]), F.col(order)).alias("_p")).select("_p.*", "key", cell_of(F.col("key")).alias("cell"))
    cells = known.select(cell_of(F.col("key")).alias("cell")).where("cell >= 0").distinct()  # of a micro-batch
    near = seen.join(F.broadcast(cells), "cell", "left_semi").select(*own, "key")
    return fresh.join(near, [*own, "key"], "left_anti")


def extent(cloud: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, and least and largest coordinate of each axis."""
    aggs = [F.count("*").alias("n_points")]
    for c in AXES:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return cloud.groupBy(*(keys or [])).agg(*aggs)


def z_limits(cloud: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """2nd and 98th percentile of the height, interpolated."""
    return quantiles(cloud, keys or [], "z", {"z_lo": 0.02, "z_hi": 0.98})


def plane_inliers(cloud: DataFrame, normal: tuple, offset: float, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """How many points lie within ``threshold`` of a given plane."""
    n = F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(AXES, normal)])
    near = F.abs(G.plane_distance(F.struct(*AXES), n, F.lit(float(offset)))) <= threshold
    return cloud.groupBy(*(keys or [])).agg(F.count(F.when(near, 1)).alias("n_inliers"), F.count("*").alias("n_points"))


def smallest_axis(moments: np.ndarray) -> tuple[np.ndarray, float]:
    """(normal, offset) of the least-squares plane of n, sums and sums of products (n, x, y, z, xx, xy, xz, yy, yz, zz)."""
    n, s, m = moments[0], moments[1:4], moments[4:]
    mean = s / n
    second = np.array([[m[0], m[1], m[2]], [m[1], m[3], m[4]], [m[2], m[4], m[5]]]) / n
    normal = np.linalg.eigh(second - np.outer(mean, mean))[1][:, 0]
    return normal, float(-normal @ mean)


PRODUCTS = ("xx", "xy", "xz", "yy", "yz", "zz")


#: Keys whose candidate planes are broadcast (a few kB each); with more of them they are joined to the points.
MODELS = 1000


def _votes(points: DataFrame, models: list, own: list[str], threshold: float) -> DataFrame:
    """Partial votes (own, _i, n): each batch of points is multiplied with its key's planes."""
    planes = {tuple(r[k] for k in own): ([m["_i"] for m in r["models"]], np.array([[m["nx"], m["ny"], m["nz"], m["d"]] for m in r["models"]], float).reshape(-1, 4)) for r in models}
    shared = points.sparkSession.sparkContext.broadcast(planes)

    def run(batches):
        for pdf in batches:
            for key, some in pdf.groupby(own, sort=False):
                numbers, plane = shared.value.get(key if isinstance(key, tuple) else (key,), ([], None))
                if not numbers:
                    continue
                xyz = some[list(AXES)].to_numpy(float)
                n = sum((np.abs(xyz[lo : lo + 4096] @ plane[:, :3].T + plane[:, 3]) <= threshold).sum(0) for lo in range(0, len(xyz), 4096))
                yield pd.DataFrame({**{k: [v] * len(numbers) for k, v in zip(own, key)}, "_i": numbers, "n": n}).query("n > 0")

    types = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in own)
    return points.select(*own, *AXES).mapInPandas(run, f"{types}, _i int, n long")


def fit_plane(cloud: DataFrame, threshold: float = 0.05, iterations: int = 200, seed: int = 0, keys: list[str] | None = None, order: str = "ord") -> DataFrame:
    """One plane for each key by random sampling: the triple with most points within ``threshold``, refitted on those.

    No points are gathered: triples come from a sample of 3 * ``iterations`` of a key, the candidate planes are sent to the points (up to ``MODELS`` keys, else joined to them) and their
    votes counted before the shuffle, and the refit needs ten sums. Keys with under 3 points give no row; where every triple lies on a
    line, all points are fitted. Points with null coordinates go.
    """
    if iterations < 1:
        raise ValueError("iterations must be >= 1")
    own = keys or ["_all"]
    points = cloud.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    points = points.select(*[F.lit(0).alias("_all")] * (not keys), *own * bool(keys), *[F.col(c).cast("double").alias(c) for c in AXES], F.col(order).alias("_o"))
    # A uniform sample: of the points that fall into a bucket the one of least hash. Triples are drawn from it; any order of rows gives the same.
    bucket = F.pmod(F.xxhash64("_o", F.lit(seed)), F.lit(3 * iterations)).alias("_b")
    reps = points.groupBy(*own, bucket).agg(F.min_by(F.struct(*AXES), F.xxhash64(F.lit(seed), "_o")).alias("p"))
    per = reps.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("_b", "p"))).alias("s"))  # 3 * iterations entries at most

    def model(i: Column) -> Column:
        p = [F.get("s", F.pmod(F.xxhash64(i, F.lit(k), F.lit(seed)), F.size("s")).cast("int"))["p"] for k in range(3)]
        a, b = [{c: p[k][c] - p[0][c] for c in AXES} for k in (1, 2)]
        cross = F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))
        return F.struct(i.alias("_i"), cross.alias("c"), p[0].alias("p"))

    def unit(m: Column) -> Column:
        n = {c: m["c"][c] / G.norm(m["c"]) for c in AXES}
        return F.struct(m["_i"].alias("_i"), *[n[c].alias(f"n{c}") for c in AXES], (-(n["x"] * m["p"]["x"] + n["y"] * m["p"]["y"] + n["z"] * m["p"]["z"])).alias("d"))

    def off(m: Column) -> Column:
        return F.abs(m["nx"] * F.col("x") + m["ny"] * F.col("y") + m["nz"] * F.col("z") + m["d"])

    drawn = per.select(*own, F.transform(F.sequence(F.lit(0), F.lit(iterations - 1)), model).alias("m"))
    models = drawn.select(*own, F.transform(F.filter("m", lambda m: G.norm(m["c"]) >= G.TINY), unit).alias("models"))
    few = models.limit(MODELS + 1).collect()
    if len(few) <= MODELS:
        votes = _votes(points, few, own, threshold)
    else:
        hits = F.transform(F.filter("models", lambda m: off(m) <= threshold), lambda m: m["_i"])
        votes = points.join(models, own).select(*own, F.explode(hits).alias("_i"))
        votes = votes.withColumn("n", F.lit(1).cast("long"))
    votes = votes.groupBy(*own, "_i").agg(F.sum("n").alias("n"))
    most = votes.groupBy(*own).agg(F.max(F.struct("n", (-F.col("_i")).alias("i"))).alias("top"))
    best = most.join(models, own).select(*own, F.col("top.n").alias("n"), F.get(F.filter("models", lambda m: m["_i"] == -F.col("top.i")), F.lit(0)).alias("m"))
    total = points.groupBy(*own).agg(F.count("*").alias("n_points")).where("n_points >= 3")
    chosen = total.join(best, own, "left").select(*own, "n_points", F.when(F.col("n") >= 3, F.col("m")).alias("m"))
    near = F.col("m").isNull() | (off(F.col("m")) <= threshold)
    inliers = points.join(chosen, own).where(near)
    # Sums are taken around a point of the plane, or the squares of far coordinates would swallow the noise.
    around = {c: F.col(c) - F.coalesce(-F.col("m.d") * F.col(f"m.n{c}"), F.lit(0.0)) for c in AXES}
    sums = [F.sum(around[c]).alias(f"s{c}") for c in AXES] + [F.sum(around[p[0]] * around[p[1]]).alias(f"s{p}") for p in PRODUCTS]
    moments = inliers.groupBy(*own).agg(F.count("*").alias("n_inliers"), F.first("n_points").alias("n_points"), F.first("m").alias("m"), *sums)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                m = r["m"]
                center = np.zeros(3) if m is None else -m["d"] * np.array([m["nx"], m["ny"], m["nz"]])
                normal, offset = smallest_axis(np.array([r["n_inliers"], *(r[f"s{c}"] for c in (*AXES, *PRODUCTS))], float))
                rows.append((*(r[k] for k in own), *normal.tolist(), offset - float(normal @ center), r["n_inliers"], r["n_points"], m))
            yield pd.DataFrame(rows, columns=[*own, "nx", "ny", "nz", "offset", "n_inliers", "n_points", "m"])

    model_type = moments.schema["m"].dataType.simpleString()
    key_types = ", ".join(f"{k} {moments.schema[k].dataType.simpleString()}" for k in own)
    solved = moments.select(*own, "n_inliers", "n_points", "m", *[f"s{c}" for c in (*AXES, *PRODUCTS)]).mapInPandas(solve, f"{key_types}, nx double, ny double, nz double, offset double, n_inliers long, n_points long, m {model_type}")
    d = F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("offset")
    left = points.join(solved, own).where(near)
    groups = [*own, "nx", "ny", "nz", "offset", "n_inliers", "n_points"]
    done = left.groupBy(*groups).agg(F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("max_abs"))
    return done.select(*(keys or []), F.array("nx", "ny", "nz").alias("normal"), "offset", "rms", "max_abs", "n_inliers", "n_points", (F.col("n_inliers") / F.col("n_points")).alias("inlier_fraction"), F.abs("offset").alias("distance_from_origin"))


def in_boxes(cloud: DataFrame, boxes: dict[str, tuple[tuple, tuple]]) -> DataFrame:
    """A row for each point and box that it lies in, as ``box``; boxes are few and given by hand."""
    hits = F.array_compact(F.array(*[F.when(G.in_box(*map(F.col, AXES), lo, hi), F.lit(name)) for name, (lo, hi) in boxes.items()]))
    return cloud.withColumn("box", F.explode(hits))


def plane_report(planes: DataFrame, expected_angle: float | None = None, expected_distance: float | None = None, order: str = "box") -> DataFrame:
    """Tilt, angle to the next plane, range bias and warnings for each plane of a small table."""
    from pyspark.sql import Window

    def v(c: Column) -> Column:
        return F.struct(*[F.get(c, F.lit(i)).alias(a) for i, a in enumerate(AXES)])

    w = Window.partitionBy(*[c for c in ("recording_id",) if c in planes.columns]).orderBy(order)
    up = F.struct(*[F.lit(x).alias(a) for a, x in zip(AXES, (0.0, 0.0, 1.0))])
    tilt = G.plane_angle_deg(v(F.col("normal")), up)
    angle = G.plane_angle_deg(v(F.col("normal")), v(F.lead("normal").over(w)))
    out = planes.select("*", F.least(tilt, 90 - tilt).alias("level_error_deg"), F.when(tilt < 45, "off horizontal").otherwise("wall").alias("surface"), angle.alias("angle_to_next_deg"))
    if expected_angle is not None:
        out = out.withColumn("angle_error_deg", F.col("angle_to_next_deg") - expected_angle)
    if expected_distance is not None:
        out = out.withColumn("range_bias_pct", 100 * (F.col("distance_from_origin") - expected_distance) / expected_distance)
    return out.withColumn("few_inliers", F.col("inlier_fraction") < 0.8)
