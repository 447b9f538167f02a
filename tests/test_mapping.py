import numpy as np
import pytest
from conftest import rows_of

from orbitflow.operators import mapping

CLOUD = "ord long, x double, y double, z double"


def cloud(spark, p):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], CLOUD)


def wall(n=4000, noise=0.005, seed=0):
    rng = np.random.default_rng(seed)
    return np.column_stack([3 + rng.normal(0, noise, n), rng.uniform(-2, 2, n), rng.uniform(-1, 1, n)])


def test_voxels_keep_the_first_original_point(spark):
    p = [(0.01, 0, 0), (0.02, 0, 0), (-0.01, 0, 0), (0.11, 0, 0), (float("nan"), 0, 0)]
    got = mapping.voxel_downsample(cloud(spark, p), 0.05)
    assert [r[:2] for r in rows_of(got)] == [(0, 0.01), (2, -0.01), (3, 0.11)]
    assert mapping.voxel_downsample(cloud(spark, p), 0).count() == 5 and mapping.voxel_downsample(cloud(spark, []), 0.1).count() == 0


def test_incremental_map_takes_only_new_voxels(spark):
    old, new = cloud(spark, [(0, 0, 0)]), cloud(spark, [(0.01, 0, 0), (1, 0, 0), (1.01, 0, 0)])
    assert [r[1] for r in rows_of(mapping.voxel_new(old, new, 0.05))] == [1.0]
    assert mapping.voxel_new(old, new, 0.05, max_points=1).count() == 0


def test_plane_recovers_noise_and_ignores_clutter(spark):
    p = wall(20_000, 0.02)
    row = mapping.fit_plane(cloud(spark, p), 0.2).first()
    assert 0.018 < row.rms < 0.022 and abs(abs(row.normal[0]) - 1) < 1e-3 and abs(row.distance_from_origin - 3) < 0.01 and row.n_inliers == 20_000
    rng = np.random.default_rng(5)
    mixed = np.concatenate([wall(), rng.uniform([0, -2, -1], [2.8, 2, 1], (800, 3))])
    row = mapping.fit_plane(cloud(spark, mixed), 0.05).first()
    assert abs(row.n_inliers - 4000) <= 200 and row.n_points == 4800 and row.max_abs <= 0.06


def test_plane_edges(spark):
    assert mapping.fit_plane(cloud(spark, [(0, 0, 0), (1, 0, 0)])).count() == 0
    line = mapping.fit_plane(cloud(spark, [(i, 0, 0) for i in range(5)])).first()
    assert line.n_inliers == 5 and line.rms < 1e-9
    keyed = cloud(spark, wall(500)).selectExpr("CASE WHEN ord % 2 = 0 THEN 'a' ELSE 'b' END AS k", "*")
    assert mapping.fit_plane(keyed, keys=["k"]).count() == 2
    with pytest.raises(ValueError):
        mapping.fit_plane(keyed, iterations=0)


def test_tilt_angles_and_reports(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(-3, 3, 3000), rng.uniform(-3, 3, 3000)
    ceiling = np.column_stack([x, y, 2.4 + np.tan(np.radians(1.5)) * x])
    both = np.concatenate([wall(), ceiling])
    boxes = {"a wall": ((2.8, -3, -2), (3.2, 3, 1.5)), "ceiling": ((-4, -4, 2), (4, 4, 3))}
    planes = mapping.fit_plane(mapping.in_boxes(cloud(spark, both), boxes), 0.03, keys=["box"])
    got = {r.box: r for r in mapping.plane_report(planes, 90, 3.0).collect()}
    assert abs(got["ceiling"].level_error_deg - 1.5) < 0.05 and got["ceiling"].surface == "off horizontal" and got["a wall"].surface == "wall"
    assert abs(got["a wall"].angle_to_next_deg - 88.5) < 0.2 and got["ceiling"].angle_to_next_deg is None and abs(got["a wall"].range_bias_pct) < 0.2 and not got["a wall"].few_inliers


def test_extent_and_limits(spark):
    c = cloud(spark, [(i, -i, i / 100) for i in range(101)])
    row, z = mapping.extent(c).first(), mapping.z_limits(c).first()
    assert (row.n_points, row.x_min, row.x_max, row.y_min) == (101, 0, 100, -100) and np.allclose(tuple(z), (0.02, 0.98))
