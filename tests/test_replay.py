"""Recordings as a paced stream."""

import time

from conftest import rows_of
from test_offsets import recording

from orbitflow import schemas
from orbitflow.sources import offsets, rawlog, replay


def run(df, path, until, timeout=40):
    """Append to ``path`` until ``until(rows)``; number of rows then."""
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(processingTime="200 milliseconds").start()
    ends = time.monotonic() + timeout
    try:
        while time.monotonic() < ends and q.isActive:
            time.sleep(0.2)
            n = sum(p.numInputRows for p in q.recentProgress)
            if until(n):
                break
        assert q.exception() is None
    finally:
        q.stop()
    return n


def test_pace_zero_gives_all_rows(spark, tmp_path):
    recording(tmp_path / "a.rec", 200)
    recording(tmp_path / "b.rec", 90, cut=5, seed=2)
    offsets.build_index(spark, f"{tmp_path}/*.rec", f"{tmp_path}/index", 2000)
    run(replay.stream(spark, f"{tmp_path}/index", 0, split=4000), tmp_path, lambda n: n >= 289)
    got = spark.read.schema(schemas.DATAGRAMS).parquet(f"{tmp_path}/out")
    assert rows_of(got) == rows_of(rawlog.read(spark, f"{tmp_path}/*.rec"))


def test_a_paced_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = recording(tmp_path / "a.rec", 300)  # 30 recorded seconds
    offsets.build_index(spark, f"{tmp_path}/*.rec", f"{tmp_path}/index", 2000)
    stream = lambda: replay.stream(spark, f"{tmp_path}/index", 3.0, f"{tmp_path}/clock")
    began = time.time()
    run(stream(), tmp_path, lambda n: 0 < n)
    first = spark.read.schema(schemas.DATAGRAMS).parquet(f"{tmp_path}/out").count()
    assert 0 < first < 300 and first <= 3.0 * 10 * (time.time() - began) + 1
    run(stream(), tmp_path, lambda n: first + n >= 300)
    got = spark.read.schema(schemas.DATAGRAMS).parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert [(r.seq, r.recv_time, bytes(r.payload)) for r in got] == [(i, *r) for i, r in enumerate(rows)]


def test_offsets_admit_what_is_due(spark, tmp_path):
    recording(tmp_path / "a.rec", 100)
    offsets.build_index(spark, f"{tmp_path}/*.rec", f"{tmp_path}/index", 1000)
    s = replay._Stream({"index": f"{tmp_path}/index", "pace": "1.0", "state": f"{tmp_path}/clock", "split": "1000"})
    assert s.initialOffset() == {"seconds": -1.0} and 0 <= s.latestOffset()["seconds"] < 5
    parts = s.partitions({"seconds": 2.0}, {"seconds": 3.0})
    seqs = [x for p in parts for b in s.read(p) for x in b.column("seq").to_pylist()]
    assert seqs == list(range(21, 31)) and len(parts) < len(s.partitions(s.initialOffset(), {"seconds": 100.0}))
    assert s.partitions({"seconds": 3.0}, {"seconds": 3.0}) == [] or all(not list(s.read(p)) for p in s.partitions({"seconds": 3.0}, {"seconds": 3.0}))
