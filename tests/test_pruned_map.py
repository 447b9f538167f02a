"""Packed voxel keys, and a map of which a batch reads only what it reaches."""

import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from orbitflow import schemas
from orbitflow.operators import mapping
from orbitflow.streaming.live import MapSink


def morton(p, voxel):
    out = 0
    for place, v in enumerate(p):
        n = int(np.floor(v / voxel)) + (1 << 20)
        for bit in range(21):
            out |= (n >> bit & 1) << (3 * bit + place)
    return out


def test_keys_interleave_the_axes(spark):
    rng = np.random.default_rng(5)
    points = [(i, *map(float, p)) for i, p in enumerate(np.r_[rng.normal(0, 50, (200, 3)), [[0, 0, 0], [-0.1, 0.1, 0.1], [104857.5, -104857.6, 0]]])]
    df = spark.createDataFrame(points, "ord long, x double, y double, z double")
    got = {r.ord: r.k for r in df.select("ord", mapping.voxel_key(0.1).alias("k")).collect()}
    assert all(got[i] == morton(p, 0.1) for i, *p in points) and min(got.values()) >= 0
    cells = df.select(mapping.cell_of(mapping.voxel_key(0.1)).alias("c")).where("abs(x) < 25 AND abs(y) < 25 AND abs(z) < 25").distinct().count()
    assert cells <= 8
    nan = spark.createDataFrame([(0, float("nan"), 0.0, 0.0), (1, None, 0.0, 0.0)], "ord long, x double, y double, z double")
    assert nan.where(mapping.voxel_key(0.1).isNotNull()).count() == 0
    with pytest.raises(Exception, match="outside of the map"):
        spark.createDataFrame([(0, 1e6, 0.0, 0.0)], "ord long, x double, y double, z double").select(mapping.voxel_key(0.1)).collect()


def batches(spark, n=6):
    """Clouds along a corridor, with points of two recordings; neighbouring ones overlap."""
    rng = random.Random(9)
    for b in range(n):
        rows = [(rng.choice("ab"), b, 1000 * b + i, 40.0 * b + rng.random() * 60, rng.random() * 2, rng.random()) for i in range(400)]
        yield b, spark.createDataFrame([*rows, ("a", b, 1000 * b + 999, float("nan"), 0.0, 0.0)], schemas.CLOUD)


def test_map_equals_one_downsample_and_reads_what_it_reaches(spark, tmp_path):
    sink, all_of = MapSink(f"{tmp_path}/map", 0.5), None
    for b, cloud in batches(spark):
        sink(cloud, b)
        if b == 3:
            sink(cloud, b)
        all_of = cloud if all_of is None else all_of.unionByName(cloud)
    want = mapping.voxel_downsample(all_of, 0.5, ["recording_id"])
    assert rows_of(sink.points(spark).drop("batch")) == rows_of(want)
    b, cloud = list(batches(spark))[5]
    step = mapping.map_step(sink.stored(spark, 6), cloud, 0.5, "ord", ["recording_id"])
    assert step.count() == 0
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    cells = [r.cell for r in cloud.select(mapping.cell_of(mapping.voxel_key(0.5)).alias("cell")).where("cell IS NOT NULL").distinct().collect()]
    every = sink.stored(spark).select("cell").distinct().count()
    read = sink.stored(spark).where(F.col("cell").isin(cells)).select(F.col("_metadata.file_path")).distinct().count()
    assert len(cells) < every and read < len(sink.stored(spark).inputFiles())


def test_a_full_map_takes_nothing_more(spark, tmp_path):
    sink = MapSink(f"{tmp_path}/map", 0.5, max_points=3)
    for b, cloud in batches(spark, 2):
        sink(cloud, b)
    assert sink.points(spark).where("batch = 1").count() == 0 and sink.points(spark).where("batch = 0").count() > 3
