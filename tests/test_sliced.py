"""Slices change nothing: against single windows and numpy."""

import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from orbitflow.operators import buffers, health, sliced


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for name, n in (("a", 300), ("b", 1), ("c", 40), (None, 5)):
        for i in range(n):
            out.append((name, i, rng.choice([rng.uniform(0, 40), 7.0]), rng.choice([None, rng.gauss(0, 3), float("nan"), 1.0]), rng.randrange(9)))
    return spark.createDataFrame(out, "recording_id string, seq long, stamp double, x double, v long").cache()


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_neighbours_numbers_and_sums(rows, width):
    w = Window.partitionBy("recording_id").orderBy("stamp", "seq")
    want = rows.select("recording_id", "seq", F.lag("v").over(w).alias("b"), F.lead("v").over(w).alias("a"), F.row_number().over(w).cast("long").alias("i"), F.sum("v").over(w).alias("s"))
    cut = sliced.by_stamp(width)
    keys, order = ["recording_id"], ["stamp", "seq"]
    got = sliced.neighbours(rows, keys, order, cut, ["v"], ahead=True).select(*rows.columns, F.col("_prev.v").alias("b"), F.col("_next.v").alias("a"))
    got = sliced.running_sum(sliced.numbered(got, keys, order, cut, "i"), keys, order, cut, F.col("v"), "s")
    assert rows_of(got.select(*want.columns)) == rows_of(want)


@pytest.mark.parametrize("cuts", [2, 7, 200])
def test_quantiles_are_exact(rows, monkeypatch, cuts):
    monkeypatch.setattr(sliced, "CUTS", cuts)
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    got = {r.recording_id: r for r in sliced.quantiles(rows, ["recording_id"], "x", wanted).collect()}
    per = {}
    for r in rows.collect():
        if r.x is not None and r.x == r.x:
            per.setdefault(r.recording_id, []).append(r.x)
    assert set(got) == set(per)
    for k, v in per.items():
        for name, q in wanted.items():
            assert np.isclose(got[k][name], np.quantile(v, q)), (k, name)
    every = sliced.quantiles(rows, [], "x", {"mid": 0.5}).collect()
    assert len(every) == 1 and np.isclose(every[0].mid, np.median(sum(per.values(), [])))
    assert sliced.quantiles(rows.limit(0), ["recording_id"], "x", wanted).count() == 0


def test_yaw_and_highpass_do_not_depend_on_slices(spark):
    rng = np.random.default_rng(2)
    half = np.cumsum(rng.normal(0.2, 0.3, 200)) / 2
    rows = [("r", i, i / 250, (0.0, 0.0, float(np.sin(h)), float(np.cos(h))), float(rng.normal())) for i, h in enumerate(half)]
    df = spark.createDataFrame(rows, "recording_id string, seq long, stamp double, q struct<x:double,y:double,z:double,w:double>, g double")
    yaw = lambda n: np.array([r.yaw_deg for r in health.yaw_unwrap(df, rows=n).orderBy("seq").collect()])
    assert np.allclose(yaw(7), yaw(1 << 18)) and np.allclose(yaw(7), np.degrees(np.unwrap(2 * half) - 2 * half[0] + np.arctan2(np.sin(2 * half[0]), np.cos(2 * half[0]))))
    rest = lambda n: {r.seq: r.g_hp for r in health.highpass(df, 11, ["g"], rows=n).collect()}
    g = np.array([r[-1] for r in rows])
    want = {i: g[i] - g[i - 5 : i + 6].mean() for i in range(11, 189)}
    for n in (11, 60, 1 << 18):
        got = rest(n)
        assert set(got) == set(want) and np.allclose([got[i] for i in want], list(want.values()))


def test_a_consumer_gets_each_row_once(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 3)], "recording_id string, seq long")
    first, at = buffers.drain(df.where("seq < 4"), None, 3)
    assert rows_of(first.select("recording_id", "seq", "rank")) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 3, 1)]
    then, at = buffers.drain(df, at, 100)
    assert rows_of(then.select("recording_id", "seq")) == [("a", i) for i in range(4, 10)]
    none, at = buffers.drain(df, at, 100)
    assert none.count() == 0 and rows_of(at) == [("a", 9), ("b", 3)]
    newest, seen = buffers.newest_unseen(df, spark.createDataFrame([("a", 5)], "recording_id string, upto long"))
    assert rows_of(newest) == [("a", 9), ("b", 3)] and rows_of(seen) == [("a", 9), ("b", 3)]
    counts = buffers.cleared(df, spark.createDataFrame([("a", 6)], "recording_id string, upto long"), 2)
    assert rows_of(counts) == [("a", 10, 2, 6), ("b", 1, 1, 0)]
    assert buffers.snapshot(df, 2).count() == 3


def test_quantiles_place_values_by_halving(spark):
    """Each row is placed among the cut points by a handful of compiled comparisons, not by one interpreted call a cut point."""
    rng = np.random.default_rng(3)
    values = {"a": rng.integers(0, 5, 3000).astype(float), "b": np.r_[rng.normal(size=2001), [np.inf, -np.inf, -0.0, 0.0]], "c": np.array([7.0]), "d": np.arange(199.0)}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, x double")
    got = sliced.quantiles(df, ["k"], "x", {"lo": 0.01, "mid": 0.5, "hi": 0.99})
    assert "filter(_cuts" not in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.collect():
        assert np.allclose(tuple(r)[1:], np.quantile(values[r.k], [0.01, 0.5, 0.99]))
    assert got.count() == 4
