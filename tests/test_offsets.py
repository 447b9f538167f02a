"""Recordings that many tasks read, by an index of offsets."""

import random
import struct

import numpy as np
import pytest
from conftest import ramp, rows_of

from orbitflow.functions.codec import pack_imu_bytes, pack_scan_bytes
from orbitflow.sources import offsets, rawlog


def recording(path, n, cut=0, seed=1, padded=False):
    rng = random.Random(seed)
    rows = [(50.0 + i / 10, pack_imu_bytes(i, i, (0, 0, 0, 1)) if rng.random() < 0.7 else pack_scan_bytes(i, i, ramp(rng.randint(1, 20), 1), pad_to_max=padded)) for i in range(n)]
    with open(path, "wb") as f:
        rawlog.write_records(f, rows)
    if cut:
        path.write_bytes(path.read_bytes()[:-cut])
    return rows


@pytest.mark.parametrize("every", [64, 1000, 1 << 20])
def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, every):
    recording(tmp_path / "a.rec", 300)
    recording(tmp_path / "b.rec", 120, cut=5, seed=2, padded=True)
    (tmp_path / "c.rec").write_bytes(rawlog.MAGIC)
    (tmp_path / "d.rec").write_bytes(rawlog.MAGIC + b"abc")
    index = offsets.build_index(spark, f"{tmp_path}/*.rec", f"{tmp_path}/index", every)
    got = offsets.read(spark, f"{tmp_path}/index", split=max(every, 5000))
    assert rows_of(got) == rows_of(rawlog.read(spark, f"{tmp_path}/*.rec"))
    assert rows_of(offsets.status(index)) == rows_of(rawlog.status(spark, f"{tmp_path}/*.rec"))
    if every <= 4096:
        assert got.where("recording_id = 'a.rec'").rdd.getNumPartitions() > 4


def test_filters_reach_the_reader(spark, tmp_path):
    recording(tmp_path / "a.rec", 600)
    recording(tmp_path / "b.rec", 600, seed=3)
    offsets.build_index(spark, f"{tmp_path}/*.rec", f"{tmp_path}/index", 2000)
    df = offsets.read(spark, f"{tmp_path}/index", split=2000)
    every = df.rdd.getNumPartitions()
    some = df.where("recording_id = 'b.rec' AND recv_time >= 60 AND recv_time < 62")
    assert some.count() == 20 and some.rdd.getNumPartitions() <= 3 < 20 < every
    assert rows_of(some.select("seq")) == [(i,) for i in range(100, 120)]
    assert df.where("recv_time < 0").count() == 0 and df.where("recording_id IN ('a.rec', 'z.rec') AND recv_time = 55.0").count() == 1


def test_a_false_chain_is_found_out(spark, tmp_path):
    """Payloads that look like records lead astray wherever a range begins inside them; the ranges' ends do not."""
    fake = b"".join(rawlog.RECORD.pack(1.0, 20) + struct.pack("<20B", *range(20)) for _ in range(200))
    rows = [(10.0 + i, fake if i % 3 else b"\0" * 500) for i in range(12)]
    with open(tmp_path / "x.rec", "wb") as f:
        rawlog.write_records(f, rows)
    index = offsets.build_index(spark, f"{tmp_path}/x.rec", f"{tmp_path}/index", 900)
    got = sorted(offsets.read(spark, f"{tmp_path}/index", split=900).collect(), key=lambda r: r.seq)
    assert [(r.seq, r.recv_time, bytes(r.payload)) for r in got] == [(i, *r) for i, r in enumerate(rows)]
    assert index.agg({"datagrams": "sum"}).first()[0] == 12


def test_damage_is_told(spark, tmp_path):
    (tmp_path / "x.rec").write_bytes(b"WRONG" + bytes(100))
    with pytest.raises(Exception, match="not a recording"):
        offsets.build_index(spark, f"{tmp_path}/x.rec", f"{tmp_path}/index")
    rows = recording(tmp_path / "y.rec", 50)
    data = bytearray((tmp_path / "y.rec").read_bytes())
    at = len(rawlog.MAGIC) + sum(rawlog.RECORD.size + len(p) for _, p in rows[:30])
    data[at + 8 : at + 12] = struct.pack("<I", 1 << 31)
    (tmp_path / "y.rec").write_bytes(bytes(data))
    for every in (200, 1 << 20):
        with pytest.raises(Exception, match="impossible length"):
            offsets.build_index(spark, f"{tmp_path}/y.rec", f"{tmp_path}/index2", every)
    with pytest.raises(ValueError):
        offsets.build_index(spark, f"{tmp_path}/y.rec", f"{tmp_path}/index2", 8)


def test_heads_are_told_from_noise():
    noise = np.random.default_rng(1).integers(0, 256, 20000, np.uint8).tobytes()
    assert len(offsets._candidates(noise, 0, 20000)) < 20
    assert offsets.build_index is not None and offsets._candidates(b"", 0, 10) == []
