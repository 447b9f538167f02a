import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitflow.functions import geometry as G
from orbitflow.operators import registration as R
from orbitflow.operators.fold import rotated


def matrix(q):
    """Independent: by the quaternion's outer product."""
    x, y, z, w = q / np.linalg.norm(q)
    v = np.array([x, y, z])
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * k


def test_rotation_agrees_with_matrices(spark):
    rng = np.random.default_rng(3)
    q, p = rng.normal(size=(200, 4)), rng.normal(size=(200, 3))
    df = spark.createDataFrame([(i, *map(float, [*a, *b])) for i, (a, b) in enumerate(zip(q, p))], "i int, qx double, qy double, qz double, qw double, x double, y double, z double")
    quat = G.quat(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    got = df.select("i", G.rotate(F.struct("x", "y", "z"), quat).alias("r"), G.quaternion_to_matrix(quat).alias("m"), G.quaternion_wxyz(quat).alias("s")).orderBy("i").collect()
    for row, a, b in zip(got, q, p):
        assert np.allclose(tuple(row.r), matrix(a) @ b) and np.allclose(np.array(row.m).reshape(3, 3), matrix(a)) and row.s[0] == a[3]
        assert np.allclose(rotated(b[None], a)[0], matrix(a) @ b)


def test_degenerate_quaternion_is_identity(spark):
    zero = G.quat(*[F.lit(0.0)] * 4)
    row = spark.range(1).select(G.normalize_quaternion(zero).alias("q"), G.rotate(G.vec(F.lit(1), F.lit(2), F.lit(3)), zero).alias("p")).first()
    assert tuple(row.q) == (0, 0, 0, 1) and tuple(row.p) == (1, 2, 3)


def test_angles_boxes_colours(spark):
    a, b = G.vec(F.lit(1), F.lit(0), F.lit(0)), G.vec(F.lit(-1), F.lit(0), F.lit(0))
    row = spark.range(1).select(
        G.plane_angle_deg(a, b).alias("folded"), G.plane_angle_deg(a, G.vec(F.lit(1), F.lit(1), F.lit(0))).alias("half"), G.azimuth_deg(F.lit(0.0), F.lit(1.0)).alias("az"),
        G.in_box(F.lit(1.0), F.lit(0.0), F.lit(0.0), (1, 0, 0), (1, 0, 0)).alias("edge"), G.not_zero(F.lit(0.0), F.lit(float("nan")), F.lit(0.0)).alias("nan"), G.rotation_deg(F.lit(-1.5)).alias("clipped"),
        G.height_color(F.lit(-5.0), 0, 1).alias("low"), G.height_color(F.lit(5.0), 0, 1).alias("high"), G.height_color(F.lit(0.5), 0, 1).alias("mid"),
    ).first()
    assert row.folded == 0 and math.isclose(row.half, 45) and row.az == 90 and row.edge and row.nan and math.isclose(row.clipped, 180)
    assert tuple(row.low) == tuple(int(np.round(255 * v)) for v in G.VIRIDIS[0]) and tuple(row.high) == tuple(int(np.round(255 * v)) for v in G.VIRIDIS[-1]) and tuple(row.mid) == tuple(int(np.round(255 * v)) for v in G.VIRIDIS[2])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=3, max_size=3))
def test_exponential_and_logarithm_are_inverse(w):
    w = np.array(w)
    if np.linalg.norm(w) > 3.0:
        w = w / np.linalg.norm(w) * 3.0
    r = R.exp_so3(w[None])[0]
    assert np.allclose(r @ r.T, np.eye(3), atol=1e-9) and np.allclose(R.log_so3(r), w, atol=1e-6)


def test_logarithm_near_a_half_turn():
    for w in ([math.pi, 0, 0], [0, math.pi - 1e-6, 0], [2.0, 2.0, 1.0]):
        w = np.array(w) * (math.pi - 1e-6) / np.linalg.norm(w)
        assert np.allclose(R.exp_so3(R.log_so3(R.exp_so3(w[None])[0])[None])[0], R.exp_so3(w[None])[0], atol=1e-5)


@pytest.mark.parametrize("voxel", [0, -1, None])
def test_voxel_sizes_that_change_nothing(voxel):
    p = np.random.default_rng(0).normal(size=(20, 3))
    assert len(R.first_in_voxel(p, voxel)) == 20
