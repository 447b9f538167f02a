"""The streaming join against the batch join, on orderly and on late data."""

import os
import random

import numpy as np
import pytest
from conftest import ramp, rows_of

from orbitflow.functions import codec
from orbitflow.functions.codec import pack_imu_bytes, pack_scan_bytes
from orbitflow.operators import align
from orbitflow.streaming import asof

DATAGRAM = "recording_id string, seq long, payload binary"


def packets(late: bool, n=240, seed=3):
    """(recording, seq, packet) in order of arrival; late ones come up to 1.2 s after their stamp."""
    rng = random.Random(seed)
    made = []
    for r in ("a", "b"):
        for i in range(n):
            t = 100.0 + i * 0.02 + rng.choice([0, 0, 0.004]) + (1.0 if i > n // 2 else 0)  # a gap in the middle
            data = pack_scan_bytes(t, i, ramp(2, 1)) if rng.random() < 0.4 else pack_imu_bytes(round(t, 2), i, (0, 0, rng.random(), 1))
            made.append((t + (rng.random() * 1.2 if late else 0), r, data))
    made.sort(key=lambda x: x[0])
    return [(r, i, data) for i, (_, r, data) in enumerate(made)] + [(r, 10_000 + k, pack_imu_bytes(1e4, 0, (0, 0, 0, 1))) for k, r in enumerate("ab")]


def streamed(spark, tmp_path, rows, files, tolerance, lateness):
    folder = tmp_path / "in"
    step = -(-len(rows) // files)
    for k in range(files):
        some = spark.createDataFrame(rows[k * step : (k + 1) * step], DATAGRAM).coalesce(1)
        some.write.parquet(f"{folder}/part={k}")
    names = sorted(folder.rglob("*.parquet"), key=lambda p: int(p.parent.name.split("=")[1]))
    for k, name in enumerate(names):
        os.utime(name, (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema(DATAGRAM).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    out = asof.live_aligned(stream, tolerance, lateness)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    return q, spark.read.schema(asof.ALIGNED).parquet(f"{tmp_path}/out")


@pytest.mark.parametrize("late", [False, True])
def test_equals_the_batch_join(spark, tmp_path, late):
    rows, tolerance = packets(late), 0.05
    q, got = streamed(spark, tmp_path, rows, 6, tolerance, "3 seconds")
    messages = codec.decode(spark.createDataFrame(rows, DATAGRAM))
    scans = codec.scans(messages).select("recording_id", "seq", "stamp")
    want = align.nearest_asof(scans, codec.imu_samples(messages).select("recording_id", "seq", "stamp", "q"), tolerance)
    names = "recording_id", "seq", "stamp", "imu_seq", "gap"
    assert rows_of(got.select(*names)) == rows_of(want.select("recording_id", "seq", "stamp", want["match.seq"].alias("imu_seq"), "gap"))
    assert rows_of(got.where("imu_seq IS NOT NULL").select("seq", "z")) == rows_of(want.where("match IS NOT NULL").select("seq", want["match.q.z"].alias("z")))
    assert 0 < got.where("imu_seq IS NULL").count() < got.count()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert left[-1] <= 8 < max(left)  # only the far end mark's buckets are left


def test_nearest_breaks_ties_towards_the_past():
    at = asof.nearest(np.array([1.0, 1.05, 2.0, 5.0]), np.array([0.9, 1.1, 1.1, 2.0, 2.0]), 0.1 + 1e-12)
    assert at.tolist() == [0, 1, 3, -1] and asof.nearest(np.array([1.0]), np.zeros(0), 1.0).tolist() == [-1]


def test_arguments_are_checked(spark):
    df = spark.createDataFrame([], "recording_id string, seq long, stamp double, payload binary, q struct<x:double,y:double,z:double,w:double>")
    for bad in ({"tolerance": 0.0}, {"width": 2}):
        with pytest.raises(ValueError):
            asof.stream_asof(df, df, **bad)
