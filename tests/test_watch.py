"""Observed metrics of running queries: readiness, counters, lag."""

from conftest import ramp

from orbitflow import schemas
from orbitflow.functions.codec import pack_imu_bytes, pack_scan_bytes
from orbitflow.streaming.live import Running, live_frames
from orbitflow.streaming.status import Watch


def datagrams(lo, hi, kinds=("imu", "scan")):
    out = []
    for i in range(lo, hi):
        t = 100 + i * 0.005
        both = {"imu": (2 * i, pack_imu_bytes(t, i, (0, 0, 0, 1))), "scan": (2 * i + 1, pack_scan_bytes(t, i, ramp(60, 1)))}
        out += [("r", both[k][0], t, both[k][1]) for k in kinds]
    return out


class Row:
    def __init__(self, **values):
        self.__dict__.update(values)


def test_ready_needs_both_kinds_and_lag_counts(spark, tmp_path):
    folder, lines = f"{tmp_path}/in", []
    put = lambda rows: spark.createDataFrame(rows, schemas.DATAGRAMS).coalesce(1).write.mode("append").parquet(folder)
    put(datagrams(0, 5, ("imu",)))
    watch = Watch(say=lines.append)
    spark.streams.addListener(watch)
    frames = live_frames(spark.readStream.schema(schemas.DATAGRAMS).parquet(folder))
    start = lambda: frames.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        with Running(start) as r:
            r.step()
            assert not r.wait_until_ready(0.2) and not watch.ready and not watch.wait_until_ready(0.1)
            put([*datagrams(5, 160), ("r", 5000, 101.0, b"what is this"), ("r", 5001, 101.0, None)])
            r.step()
            assert r.wait_until_ready(20) and watch.wait_until_ready(20)
            other = Running(r)  # borrows what runs
            with other:
                assert other.is_running
            assert r.is_running
    finally:
        spark.streams.removeListener(watch)
    assert (watch.scans, watch.samples, watch.dropped) == (155, 160, 1)
    assert abs(watch.newest_scan - 100.795) < 1e-9 and watch.rows == spark.read.parquet(f"{tmp_path}/out").count() > 0
    assert lines and "155 scans (latest 100.795)" in lines[-1] and "1 dropped" in lines[-1]


def test_a_running_that_was_not_started_is_started_and_stopped(spark, tmp_path):
    rate = spark.readStream.format("rate").load()
    held = Running(lambda: rate.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").start())
    with Running(held) as r:
        assert r.is_running
        query = r.query
    assert not query.isActive and not held.is_running


def test_behind_is_told_beyond_three_frames():
    w = Watch(frame_duration=0.2)
    assert not w.behind and w.lag is None
    w.take({"arrivals": Row(scans=3, samples=0, dropped=0, newest_scan=10.0, newest_sample=None)})
    w.take({"results": Row(rows=1, newest_end=9.45)})
    assert not w.ready and abs(w.lag - 0.55) < 1e-9 and not w.behind and "lag 550 ms" in w.line() and "BEHIND" not in w.line()
    w.take({"arrivals": Row(scans=1, samples=2, dropped=1, newest_scan=10.1, newest_sample=10.0), "results": Row(rows=0, newest_end=None)})
    assert w.ready and w.behind and w.line().endswith("lag 650 ms BEHIND") and "1 dropped, 1 results" in w.line()
