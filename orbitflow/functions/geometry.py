"""Geometry as column expressions: everything stays in whole-stage code generation, no Python runs on rows.

Quaternions are structs x, y, z, w (scalar last), vectors structs x, y, z; arithmetic is double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Five stops of a perceptual colour map.
VIRIDIS = [(0.267, 0.005, 0.329), (0.230, 0.322, 0.546), (0.128, 0.567, 0.551), (0.369, 0.789, 0.383), (0.993, 0.906, 0.144)]
TINY = 1e-12


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def quat(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x, y, z, w), "xyzw")])


def norm(v: Column) -> Column:
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def normalize_quaternion(q: Column) -> Column:
    """q / |q|; the identity where the norm is below 1e-12."""
    n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"])
    return F.when(n < TINY, quat(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(quat(*[q[c] / n for c in "xyzw"]))


def quaternion_wxyz(q: Column) -> Column:
    return F.struct(*[q[c].alias(c) for c in "wxyz"])


def quaternion_to_matrix(q: Column) -> Column:
    """Row-major array of 9; normalises first."""
    u = normalize_quaternion(q)
    x, y, z, w = (u[c] for c in "xyzw")
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def rotate(p: Column, q: Column, normalize: bool = True) -> Column:
    """p turned by q; one cross product twice instead of a matrix."""
    u = normalize_quaternion(q) if normalize else q
    tx = 2 * (u["y"] * p["z"] - u["z"] * p["y"])
    ty = 2 * (u["z"] * p["x"] - u["x"] * p["z"])
    tz = 2 * (u["x"] * p["y"] - u["y"] * p["x"])
    return vec(
        p["x"] + u["w"] * tx + (u["y"] * tz - u["z"] * ty),
        p["y"] + u["w"] * ty + (u["z"] * tx - u["x"] * tz),
        p["z"] + u["w"] * tz + (u["x"] * ty - u["y"] * tx),
    )


def transform(p: Column, pose: Column) -> Column:
    """p moved by a 4x4 row-major pose."""
    return vec(*[pose[4 * r] * p["x"] + pose[4 * r + 1] * p["y"] + pose[4 * r + 2] * p["z"] + pose[4 * r + 3] for r in range(3)])


def azimuth_deg(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def yaw(q: Column) -> Column:
    """Heading in radians; q is taken as it is."""
    return F.atan2(2 * (q["w"] * q["z"] + q["x"] * q["y"]), 1 - 2 * (q["y"] * q["y"] + q["z"] * q["z"]))


def rotation_deg(trace: Column) -> Column:
    """Angle of a rotation matrix from its trace."""
    cos = (trace - 1) / 2
    return F.when(cos.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def in_box(x: Column, y: Column, z: Column, lo: tuple, hi: tuple) -> Column:
    """Inside an axis-aligned box, faces included."""
    test = F.lit(True)
    for c, a, b in zip((x, y, z), lo, hi):
        test = test & c.between(float(a), float(b))
    return test


def not_zero(x: Column, y: Column, z: Column) -> Column:
    """Any coordinate differs from 0 (NaN does)."""
    return (x != 0) | (y != 0) | (z != 0)


def plane_distance(p: Column, normal: Column, offset: Column) -> Column:
    return dot(p, normal) + offset


def plane_angle_deg(a: Column, b: Column) -> Column:
    """Angle between two planes by their normals, in 0..90."""
    cos = F.abs(dot(a, b) / (norm(a) * norm(b)))
    return F.when(cos.isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), cos))))


def height_color(z: Column, lo: float, hi: float) -> Column:
    """Struct r, g, b of 0..255 by height, rounded half to even."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (z - float(lo)) / max(float(hi) - float(lo), 1e-6))) * (len(VIRIDIS) - 1)
    at = F.least(F.floor(t), F.lit(len(VIRIDIS) - 2))

    def channel(c: int) -> Column:
        out = F.lit(None).cast("double")
        for i in range(len(VIRIDIS) - 1):
            a, b = VIRIDIS[i][c], VIRIDIS[i + 1][c]
            out = F.when(at == i, a + (t - i) * (b - a)).otherwise(out)
        return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), out * 255)), 0).cast("int")

    return F.struct(*[channel(i).alias(n) for i, n in enumerate("rgb")])
