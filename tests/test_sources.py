import io
import json
import os
import shutil
import socket
import threading
import time

import numpy as np
import pytest
from conftest import ramp, rows_of

from orbitflow import schemas
from orbitflow.functions import codec
from orbitflow.functions.codec import pack_imu_bytes, pack_scan_bytes
from orbitflow.sources import rawlog, tables, udp
from orbitflow.sources.udp import Buffered


def some(n=6):
    return [(100.0 + i, pack_imu_bytes(i, i, (0, 0, 0, 1)) if i % 2 else pack_scan_bytes(i, i, ramp(5, 1))) for i in range(n)]


def raw(rows):
    f = io.BytesIO()
    rawlog.write_records(f, rows)
    return f.getvalue()


def test_files_roundtrip_and_damage():
    data = raw(some())
    assert rawlog.scan(io.BytesIO(data)) == (some(), False)
    assert rawlog.scan(io.BytesIO(data[:-3])) == (some()[:-1], True) and rawlog.scan(io.BytesIO(data + b"ab")) == (some(), True)
    with pytest.raises(rawlog.Damaged):
        rawlog.scan(io.BytesIO(b"WRONG" + data[5:]))
    with pytest.raises(rawlog.Damaged):
        rawlog.scan(io.BytesIO(data[:8] + rawlog.RECORD.pack(0.0, 1 << 31)))
    other = bytearray(data)
    other[7] = 9
    assert len(rawlog.scan(io.BytesIO(bytes(other)))[0]) == 6


def test_spark_reads_and_writes_recordings(spark, tmp_path):
    (tmp_path / "a.rec").write_bytes(raw(some()))
    (tmp_path / "b.rec").write_bytes(raw(some(3))[:-3])
    df = rawlog.read(spark, f"{tmp_path}/*.rec")
    assert df.groupBy("recording_id").count().count() == 2 and df.count() == 8
    assert df.schema.simpleString() == spark.createDataFrame([], schemas.DATAGRAMS).schema.simpleString()
    assert codec.decode(df).where("status = 'ok'").count() == 8
    assert rows_of(rawlog.status(spark, f"{tmp_path}/*.rec").select("recording_id", "datagrams", "truncated", "version")) == [("a.rec", 6, False, 1), ("b.rec", 2, True, 1)]
    rawlog.write(df, f"{tmp_path}/out")
    assert (tmp_path / "out" / "a.rec").read_bytes() == raw(some())
    rawlog.to_parquet(df, f"{tmp_path}/table")
    back = rawlog.from_parquet(spark, f"{tmp_path}/table")
    assert rows_of(back.select("recording_id", "seq", "recv_time", "payload")) == rows_of(df) and rawlog.in_window(back, 101.0, 103.0).where("recording_id = 'a.rec'").count() == 2
    assert rawlog.read(spark, f"{tmp_path}/*.none").count() == 0


def free_port():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def send(port, rows, gap=0.005):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for _, data in rows:
            s.sendto(data, ("127.0.0.1", port))
            time.sleep(gap)


def test_receiver(tmp_path):
    port = free_port()
    with pytest.raises(ValueError):
        udp.Receiver(buffer_size=100)
    r = udp.Receiver(port, "127.0.0.1", 0.5)
    with pytest.raises(RuntimeError):
        r.datagram()
    with r:
        with pytest.raises(RuntimeError):
            r.open()
        send(port, [*some(2), (0, b"junk")])
        assert r.receive_once()["msg_type"] == 102 and r.receive_once()["msg_type"] == 101 and r.receive_once() is None and r.receive_once() is None
    r.close()
    threading.Timer(0.2, send, (port, some())).start()
    assert udp.capture(f"{tmp_path}/live.rec", 1.0, port=port, ip="127.0.0.1", timeout=0.1)[0] == 6
    with open(f"{tmp_path}/live.rec", "rb") as f:
        assert [d for _, d in rawlog.scan(f)[0]] == [d for _, d in some()]


def test_sidecars(spark, tmp_path):
    tables.write_sidecar(f"{tmp_path}/a.rec", {"kind": "loop", "truth_m": 2.5, "unknown": 1, "config": {"voxel_size": "0.1"}})
    (tmp_path / "b.rec.json").write_text("{broken")
    got = {r.recording_id: r for r in tables.read_sidecars(spark, f"{tmp_path}/*.json").collect()}
    assert got["a.rec"].kind == "loop" and got["a.rec"].config == {"voxel_size": "0.1"} and not got["a.rec"].broken and got["b.rec"].broken and got["b.rec"].kind is None
    assert json.dumps(tables.provenance()) and tables.provenance()["python"]


def test_result_tables_grow(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert tables.read_results(spark, path) is None
    tables.append_results(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    got = tables.append_results(spark.createDataFrame([(2, 0.5)], "a int, c double"), path)
    assert got.columns == ["a", "b", "c"] and rows_of(got) == [("1", "x", None), ("2", None, "0.5")]


def test_clouds_and_trajectories(spark, tmp_path):
    p = np.random.default_rng(0).normal(size=(50, 3)).astype(np.float32).astype(float)
    c = spark.createDataFrame([(i, *r) for i, r in enumerate(p.tolist())], "ord long, x double, y double, z double")
    assert tables.write_ply(c, f"{tmp_path}/c.ply", -1, 1) == 50
    assert np.array_equal(np.array([r[2:] for r in sorted(map(tuple, tables.read_ply(spark, f"{tmp_path}/c.ply").collect()), key=lambda r: r[1])]), p)
    for kind in ("deskew", "raw"):
        tables.write_ply(c, f"{tmp_path}/run_map_{kind}.ply", -1, 1)
    clouds, track = tables.load_saved(spark, f"{tmp_path}/run")
    assert clouds.count() == 100 and track.count() == 0
    (tmp_path / "bad.ply").write_bytes(b"ply\nformat ascii 1.0\nend_header\n")
    with pytest.raises(Exception, match="not a cloud"):
        tables.read_ply(spark, f"{tmp_path}/bad.ply").collect()
    t = c.withColumnRenamed("ord", "frame_id")
    assert tables.write_trajectory(t, f"{tmp_path}/t.npy") == 50
    assert rows_of(tables.read_trajectory(spark, f"{tmp_path}/t.npy")) == rows_of(t) and tables.read_trajectory(spark, f"{tmp_path}/none.npy").count() == 0


def test_an_exchange_of_result_tables_can_be_cut_short_anywhere(spark, tmp_path):
    path = f"{tmp_path}/results"
    tables.append_results(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    os.rename(path, f"{path}.old")  # the old table stood aside, the new one never came
    assert tables.read_results(spark, path).count() == 1
    shutil.copytree(path, f"{path}.old")  # the new one came, the old one was not deleted
    shutil.copytree(path, f"{path}.new")  # and another was being written
    assert tables.append_results(spark.createDataFrame([(2, "y")], "a int, b string"), path).count() == 2
    assert sorted(os.listdir(tmp_path)) == ["results"]


def test_recordings_appear_when_the_job_is_done(spark, tmp_path):
    out = f"{tmp_path}/out"
    options = {"path": out}
    rows = spark.createDataFrame([("a", 0, 1.0, b"x"), ("a", 1, 2.0, b"yz"), ("b", 0, 1.0, b"")], schemas.DATAGRAMS).collect()
    writer = rawlog._Writer(options)
    first, again = writer.write(iter(rows)), writer.write(iter(rows))  # the second is a speculative copy that does not count
    assert [x for x in os.listdir(out) if not x.startswith("_")] == []
    writer.commit([first])
    assert sorted(os.listdir(out)) == ["a", "b"] and rawlog.read(spark, f"{out}/*").count() == 3
    other = rawlog._Writer(options)
    other.abort([other.write(iter(rows[:1]))])
    assert sorted(os.listdir(out)) == ["a", "b"] and again.files


def test_a_port_is_drained_into_two_histories():
    port = free_port()
    with Buffered(scan_maxlen=2, imu_maxlen=5, port=port, ip="127.0.0.1", timeout=0.1) as b:
        threading.Timer(0.3, lambda: send(port, [(0, x) for x in [pack_scan_bytes(float(i), i, ramp(4, 1)) for i in range(3)] + [pack_imu_bytes(9.0, 7, (0, 0, 0, 1)), b"no"]])).start()
        assert b.wait_for_new("scan", 5)[0] == "scan"
        ends = time.monotonic() + 5
        while b.stats()["unparsed"] == 0 and time.monotonic() < ends:
            time.sleep(0.02)
        assert b.stats() == {"scan_received": 3, "imu_received": 1, "scan_dropped": 1, "imu_dropped": 0, "unparsed": 1, "scan_held": 2, "imu_held": 1}
        assert b.latest("imu")[2] == 7 and [m[2] for m in b.held("scan")] == [1, 2] and [m[2] for m in b.drain("scan")] == [1, 2]
        assert b.latest("scan") is None and b.wait_for_new("imu", 0.05) is None and b.stats()["scan_received"] == 3
