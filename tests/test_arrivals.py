"""The window after every arrival, against a sorted list."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from orbitflow.operators import arrivals


def plain(rows, most):
    """(recording, seq, evicted_at) by keeping the window sorted."""
    out = []
    for name in {r[0] for r in rows}:
        window = []
        for _, seq, stamp in sorted(r for r in rows if r[0] == name):
            window = sorted([*window, (stamp, seq)])
            if len(window) > most:
                out.append((name, window.pop(0)[1], seq))
    return sorted(out)


def drive(n=700, late=30, seed=4):
    rng = random.Random(seed)
    return [(r, i, float(rng.choice([i, i, i, max(0, i - rng.randint(0, late)), max(0, i - 300)]))) for r in ("a", "b") for i in range(n)]


@pytest.mark.parametrize("most,size,group", [(1, 16, 2), (7, 16, 4), (40, 16, 4), (25, 1 << 12, 64)])
def test_slices_give_what_a_sorted_list_gives(spark, most, size, group):
    rows = drive()
    df = spark.createDataFrame(rows, "recording_id string, seq long, stamp double")
    assert sorted(map(tuple, arrivals.evictions(df, most, size, group).collect())) == plain(rows, most)


def test_log_counts_late_arrivals(spark):
    rows = [("a", 0, 5.0), ("a", 1, 6.0), ("a", 2, 1.0), ("a", 3, 7.0), ("a", 4, 5.5), ("a", 5, None), ("a", 6, float("nan")), ("a", None, 2.0), (None, 7, 1.0)]
    df = spark.createDataFrame(rows, "recording_id string, seq long, stamp double")
    got = arrivals.window_log(df, F.floor(F.col("seq") / 2), 2, 2)
    assert rows_of(got) == [("a", 0, 2, 0, 0, None, None), ("a", 1, 2, 2, 1, 1.0, 5.0), ("a", 2, 1, 1, 1, 5.5, 5.5)]
    assert arrivals.window_log(df.limit(0), F.col("seq"), 2).count() == 0
    with pytest.raises(ValueError):
        arrivals.evictions(df, 0)
