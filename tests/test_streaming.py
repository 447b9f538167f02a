import time

import numpy as np
from conftest import ramp, rows_of
from test_sources import free_port, send, some

from orbitflow import schemas
from orbitflow.config import Config
from orbitflow.functions.codec import pack_imu_bytes, pack_scan_bytes
from orbitflow.operators import fold
from orbitflow.sources.udp import UdpStream
from orbitflow.streaming.live import MapSink, Running, live_frames, live_poses, on_frame
from orbitflow.streaming.status import StatusLine


def rows(lo, hi):
    out = []
    for i in range(lo, hi):
        t = 100 + i * 0.005
        out += [("r", 2 * i, t, pack_imu_bytes(t, i, (0, 0, 0, 1))), ("r", 2 * i + 1, t, pack_scan_bytes(t, i, ramp(60, 1)))]
    return out


def drain(df, check, name, mode="append"):
    q = df.writeStream.format("parquet").option("path", f"{check}/{name}").option("checkpointLocation", f"{check}/{name}-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)


def test_frames_survive_a_restart(spark, tmp_path):
    """Two runs over growing files give what one fold over everything gives."""
    stream = lambda: spark.readStream.schema(schemas.DATAGRAMS).parquet(f"{tmp_path}/in")
    spark.createDataFrame(rows(0, 70), schemas.DATAGRAMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    drain(live_frames(stream()), tmp_path, "frames")
    first = spark.read.parquet(f"{tmp_path}/frames").count()
    spark.createDataFrame(rows(70, 150), schemas.DATAGRAMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    drain(live_frames(stream()), tmp_path, "frames")
    got = spark.read.parquet(f"{tmp_path}/frames")
    want = fold.replay_frames(spark.createDataFrame(rows(0, 150), schemas.DATAGRAMS), Config())
    assert 0 < first < got.count() and rows_of(got.select("frame_id", "n_scans", "t_end")) == rows_of(want.select("frame_id", "n_scans", "t_end"))[: got.count()]
    drain(live_poses(stream()), tmp_path, "poses")
    assert spark.read.parquet(f"{tmp_path}/poses").count() == got.count()


def test_map_sink_is_idempotent(spark, tmp_path):
    sink = MapSink(f"{tmp_path}/map", 0.1)
    cloud = lambda xs: spark.createDataFrame([("r", 0, i, float(x), 0.0, 0.0) for i, x in enumerate(xs)], schemas.CLOUD)
    sink(cloud([0.01, 0.02, 0.5]), 0)
    sink(cloud([0.03, 0.9]), 1)
    sink(cloud([0.03, 0.9]), 1)
    assert sorted(np.round([r.x for r in sink.points(spark).collect()], 3)) == [0.01, 0.5, 0.9]
    sink.clear(spark)
    assert sink.points(spark).count() == 0


def test_lifecycle_callbacks_and_socket(spark, tmp_path):
    spark.dataSource.register(UdpStream)
    port, seen, said = free_port(), [], []
    df = spark.readStream.format("udp").option("port", port).option("ip", "127.0.0.1").load()
    listener = StatusLine(0.0, said.append)
    spark.streams.addListener(listener)
    running = on_frame(df, lambda batch, n: seen.append(batch.count()), "200 milliseconds", f"{tmp_path}/state")
    with running as r:
        assert r.is_running
        ends = time.monotonic() + 60
        while sum(seen) < 6 and time.monotonic() < ends:
            send(port, some(6))
            time.sleep(0.3)
        assert r.wait_until_ready(20)
    running.stop()
    spark.streams.removeListener(listener)
    assert not running.is_running and sum(seen) >= 6
    assert not Running(lambda: None).is_running


def test_the_last_frame_leaves_with_an_end_mark_or_in_silence(spark, tmp_path):
    stream = lambda name: spark.readStream.schema(schemas.DATAGRAMS).parquet(f"{tmp_path}/{name}")
    want = rows_of(fold.replay_frames(spark.createDataFrame(rows(0, 60), schemas.DATAGRAMS), Config()).select("frame_id", "n_scans"))
    spark.createDataFrame(rows(0, 60) + [("r", 999, 200.0, None)], schemas.DATAGRAMS).coalesce(1).write.parquet(f"{tmp_path}/marked")
    drain(live_frames(stream("marked")), tmp_path, "ended")
    assert rows_of(spark.read.parquet(f"{tmp_path}/ended").select("frame_id", "n_scans")) == want
    spark.createDataFrame(rows(0, 60), schemas.DATAGRAMS).coalesce(1).write.parquet(f"{tmp_path}/silent")
    got = []
    with on_frame(live_frames(stream("silent"), idle=0.5), lambda df, n: got.extend(df.select("frame_id", "n_scans").collect()), "200 milliseconds", f"{tmp_path}/silent-state") as running:
        ends = time.monotonic() + 60
        while len(got) < len(want) and time.monotonic() < ends:
            time.sleep(0.1)
        with Running(running.query) as borrowed:  # used, then left to its owner
            assert borrowed.is_running
        assert running.is_running
    assert sorted(map(tuple, got)) == want and not running.is_running
