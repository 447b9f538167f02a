import numpy as np
import pytest
from conftest import ramp, rows_of
from pyspark.sql import functions as F

from orbitflow.functions import codec
from orbitflow.functions.codec import HEADER, IMU_TYPE, SCAN_TYPE, pack_imu_bytes, pack_scan_bytes, parse, status_of


def test_sizes():
    assert len(pack_imu_bytes(1.0, 1, (0, 0, 0, 1))) == 64
    assert len(pack_scan_bytes(1.0, 1, ramp(5))) == 2904
    assert len(pack_scan_bytes(1.0, 1, ramp(5), pad_to_max=False)) == 8 + 16 + 5 * 24
    assert codec.POINT.itemsize == 24


def test_imu_roundtrip():
    got = parse(pack_imu_bytes(12.5, 2**32 - 1, (0.5, -0.5, 0.5, 0.5), (1, 2, 3), (4, 5, 6)))
    assert got["msg_type"] == IMU_TYPE and got["imu"]["id"] == 2**32 - 1 and got["imu"]["stamp"] == 12.5
    assert got["imu"]["q"] == {"x": 0.5, "y": -0.5, "z": 0.5, "w": 0.5} and got["imu"]["accel"] == {"x": 4, "y": 5, "z": 6} and got["scan"] is None


@pytest.mark.parametrize("n", [0, 1, 6, 120])
def test_scan_roundtrip_ignores_padding(n):
    data = bytearray(pack_scan_bytes(3.0, 7, ramp(n)))
    if n < 120:
        data[-24:] = b"\xab" * 24
    got = parse(bytes(data))["scan"]
    assert got["valid_points_num"] == n == len(got["points"])
    assert [p["x"] for p in got["points"]] == list(range(n)) and [p["ring"] for p in got["points"]] == [i % 4 for i in range(n)]


def test_truncated_and_lying_scans():
    assert len(parse(pack_scan_bytes(1.0, 1, ramp(120))[: 8 + 16 + 24 * 9 + 7])["scan"]["points"]) == 9
    lying = bytearray(pack_scan_bytes(1.0, 1, ramp(3), pad_to_max=False))
    lying[20:24] = (5000).to_bytes(4, "little")
    got = parse(bytes(lying))["scan"]
    assert got["valid_points_num"] == 3


@pytest.mark.parametrize("data, status", [(b"", "undersized"), (b"ab", "undersized"), (None, "undersized"), (HEADER.pack(999, 0), "unknown"), (HEADER.pack(0, 0), "unknown"), (pack_imu_bytes(1, 1, (0, 0, 0, 1))[:20], "malformed"), (HEADER.pack(SCAN_TYPE, 16), "malformed"), (pack_imu_bytes(1, 1, (0, 0, 0, 1))[:60], "short_declared")])
def test_bad_datagrams_never_raise(data, status):
    assert status_of(data) == status
    if status != "short_declared" and data is not None:
        assert parse(data) is None and codec.unpack(data) is None


def test_packing_checks_its_arguments():
    with pytest.raises(ValueError):
        pack_scan_bytes(0.0, 0, ramp(121))
    with pytest.raises(ValueError):
        pack_scan_bytes(0.0, 0, ramp(4).reshape(2, 2))


def test_decode_keeps_every_row_and_splits(spark):
    rows = [("a", 0, 0.1, pack_scan_bytes(1.0, 5, ramp(6))), ("a", 1, 0.2, b"x"), ("a", 2, 0.3, None), ("a", 3, 0.4, pack_imu_bytes(1.1, 6, (0, 0, 0, 1)))]
    from orbitflow import schemas

    m = codec.decode(spark.createDataFrame(rows, schemas.DATAGRAMS)).cache()
    assert rows_of(m.select("seq", "status", "msg_type")) == [(0, "ok", 102), (1, "undersized", None), (2, "undersized", None), (3, "ok", 101)]
    s = codec.scans(m)
    assert s.count() == 1 and codec.imu_samples(m).count() == 1
    got = s.select(codec.xyz("points", True).alias("p"), codec.point("points", 9).alias("none"), codec.point("points", 2).alias("two"), codec.xyz_intensity("points").alias("i")).first()
    assert len(got.p) == 5 and got.none is None and got.two.y == 4 and got.i[1].intensity == 10
    assert np.isclose(got.p[0].x, 1.0)
    assert codec.decode(spark.createDataFrame([], schemas.DATAGRAMS)).count() == 0


def test_slim_datagrams_unpack_alike(spark):
    import struct

    full = codec.pack_scan_bytes(5.0, 7, ramp(3))
    odd = [full, codec.pack_scan_bytes(5.0, 7, ramp(120)), codec.pack_scan_bytes(5.0, 7, ramp(0)), full[:90], full[:22], full[:3], b"", None, codec.pack_imu_bytes(1.0, 2, (0.0, 0.0, 0.0, 1.0)), b"\xe7\x03\0\0" + full[4:]]
    odd += [full[:20] + struct.pack("<I", n) + full[24:] for n in (121, 200, 256, 259, 1 << 31)]
    rows = spark.createDataFrame(list(enumerate(odd)), "i long, payload binary").select("payload", codec.slim(F.col("payload")).alias("slim")).collect()
    assert len(rows) == len(odd) and len(bytes(next(r.slim for r in rows if r.payload == full))) == 24 + 3 * 24
    for r in rows:
        a, b = (codec.unpack(None if x is None else bytes(x)) for x in r)
        assert repr(a) == repr(b) and (a is None or a[0] == "imu" or a[3].tobytes() == b[3].tobytes())
