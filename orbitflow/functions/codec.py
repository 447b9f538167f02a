"""The sensor's wire format.

A datagram is a header (message type, payload size), then an inertial sample or a scan of up to 120 points. SQL cannot turn bytes
into floats, so decoding is the one step that is an Arrow UDF: a batch of payloads is a buffer that numpy views as records, and the
points of a whole batch leave as one nested Arrow column, never as Python objects.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitflow import schemas
from orbitflow.config import MAX_POINTS

# The wire format, little-endian.
IMU_TYPE, SCAN_TYPE = 101, 102
HEADER = struct.Struct("<II")
IMU_PAYLOAD = struct.Struct("<dI4f3f3f")
SCAN_HEAD = struct.Struct("<dII")
IMU_PADDED = 56
#: Datagrams that a task decodes at once.
ROWS = 1000
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4"), ("time", "<f4"), ("ring", "<u4")])

_FIELDS = ("x", "y", "z", "intensity", "time", "ring")
_POINT_TYPE = pa.struct([(n, pa.float32()) for n in _FIELDS[:-1]] + [("ring", pa.int64())])
_VEC = pa.struct([(n, pa.float64()) for n in "xyz"])
_QUAT = pa.struct([(n, pa.float64()) for n in "xyzw"])
_SCAN_TYPE = pa.struct([("stamp", pa.float64()), ("id", pa.int64()), ("valid_points_num", pa.int32()), ("points", pa.list_(_POINT_TYPE))])
_IMU_TYPE = pa.struct([("stamp", pa.float64()), ("id", pa.int64()), ("q", _QUAT), ("gyro", _VEC), ("accel", _VEC)])


def status_of(data: bytes | None) -> str:
    """ok, short_declared (decoded, but the header promises more bytes), undersized, unknown or malformed."""
    if data is None or len(data) < HEADER.size:
        return "undersized"
    kind, size = HEADER.unpack_from(data)
    need = {IMU_TYPE: IMU_PAYLOAD.size, SCAN_TYPE: SCAN_HEAD.size}.get(kind)
    if need is None:
        return "unknown"
    if len(data) - HEADER.size < need:
        return "malformed"
    return "short_declared" if size > len(data) - HEADER.size else "ok"


def decode_batch(payloads: list[bytes | None]) -> pa.StructArray:
    """One ``schemas.MESSAGE`` for each payload; scan and imu are null where the payload is not one."""
    n = len(payloads)
    status = [status_of(p) for p in payloads]
    kind = np.array([HEADER.unpack_from(p)[0] if s in ("ok", "short_declared") else 0 for p, s in zip(payloads, status)], np.int64)
    heads = np.zeros(n, np.dtype([("stamp", "<f8"), ("id", "<u4"), ("n", "<u4")]))
    counts, bodies = np.zeros(n, np.int64), []
    for i in np.flatnonzero(kind == SCAN_TYPE).tolist():
        heads[i] = SCAN_HEAD.unpack_from(payloads[i], HEADER.size)
        at = HEADER.size + SCAN_HEAD.size
        counts[i] = min(int(heads["n"][i]), MAX_POINTS, (len(payloads[i]) - at) // POINT.itemsize)
        bodies.append(payloads[i][at : at + int(counts[i]) * POINT.itemsize])
    points = np.frombuffer(b"".join(bodies), POINT)
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[f]).astype(np.int64 if f == "ring" else np.float32)) for f in _FIELDS], fields=list(_POINT_TYPE))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), flat)
    scan = pa.StructArray.from_arrays([pa.array(heads["stamp"]), pa.array(heads["id"].astype(np.int64)), pa.array(counts.astype(np.int32)), lists], fields=list(_SCAN_TYPE), mask=pa.array(kind != SCAN_TYPE))
    rows = np.zeros(n, np.dtype([("stamp", "<f8"), ("id", "<u4"), ("v", "<f4", 10)]))
    for i in np.flatnonzero(kind == IMU_TYPE).tolist():
        stamp, number, *v = IMU_PAYLOAD.unpack_from(payloads[i], HEADER.size)
        rows[i] = (stamp, number, v)
    v = rows["v"].astype(np.float64)

    def part(lo: int, hi: int, kind_: pa.StructType) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v[:, j])) for j in range(lo, hi)], fields=list(kind_))

    imu = pa.StructArray.from_arrays([pa.array(rows["stamp"]), pa.array(rows["id"].astype(np.int64)), part(0, 4, _QUAT), part(4, 7, _VEC), part(7, 10, _VEC)], fields=list(_IMU_TYPE), mask=pa.array(kind != IMU_TYPE))
    return pa.StructArray.from_arrays([pa.array(np.where(kind > 0, kind, 0).astype(np.int32), mask=kind == 0), pa.array(status), scan, imu], names=["msg_type", "status", "scan", "imu"])


def parse(data: bytes) -> dict | None:
    """One datagram as a dict, or None; for tests and single packets."""
    row = decode_batch([data])[0].as_py()
    return row if row["msg_type"] else None


def decode(datagrams: DataFrame) -> DataFrame:
    """``datagrams`` with msg_type, status, scan and imu instead of payload. Nothing raises; bad packets keep their status."""
    kept = datagrams.drop("msg_type", "status", "scan", "imu")
    names = [c for c in kept.columns if c != "payload"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                made = decode_batch(some.column("payload").to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), *made.flatten()], names=[*names, "msg_type", "status", "scan", "imu"])

    fields = [f for f in kept.schema.fields if f.name != "payload"]
    made = T._parse_datatype_string(f"msg_type int, status string, scan {schemas.SCAN}, imu {schemas.IMU}").fields
    return kept.mapInArrow(run, T.StructType([*fields, *made]))


def scans(messages: DataFrame) -> DataFrame:
    return messages.where("scan IS NOT NULL").select("recording_id", "seq", "scan.*")


def imu_samples(messages: DataFrame) -> DataFrame:
    return messages.where("imu IS NOT NULL").select("recording_id", "seq", "imu.*")


def pack_imu_bytes(stamp: float, number: int, q, gyro=(0.0, 0.0, 0.0), accel=(0.0, 0.0, 0.0)) -> bytes:
    body = IMU_PAYLOAD.pack(stamp, number, *q, *gyro, *accel).ljust(IMU_PADDED, b"\0")
    return HEADER.pack(IMU_TYPE, len(body)) + body


def pack_scan_bytes(stamp: float, number: int, points: np.ndarray, pad_to_max: bool = True) -> bytes:
    points = np.asarray(points, POINT)
    if points.ndim != 1:
        raise ValueError("points must be one-dimensional")
    if len(points) > MAX_POINTS:
        raise ValueError(f"a scan holds {MAX_POINTS} points at most")
    body = SCAN_HEAD.pack(stamp, number, len(points)) + points.tobytes()
    if pad_to_max:
        body = body.ljust(SCAN_HEAD.size + MAX_POINTS * POINT.itemsize, b"\0")
    return HEADER.pack(SCAN_TYPE, len(body)) + body


def _numbers(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


@F.arrow_udf(T.BinaryType())
def pack_imu(imu: pa.Array) -> pa.Array:
    """A struct like ``schemas.IMU`` as a datagram."""
    values = zip(*(_numbers(imu.field(v).field(c)) for v, axes in (("q", "xyzw"), ("gyro", "xyz"), ("accel", "xyz")) for c in axes))
    return pa.array([pack_imu_bytes(s, i, v[:4], v[4:7], v[7:]) for s, i, v in zip(_numbers(imu.field("stamp")), _numbers(imu.field("id")), values)], pa.binary())


@F.arrow_udf(T.BinaryType())
def pack_scan(scan: pa.Array) -> pa.Array:
    """A struct like ``schemas.SCAN`` as a full-size datagram; the points of a batch are one array of records."""
    lists = scan.field("points")
    flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
    points = np.zeros(len(flat), POINT)
    for c in _FIELDS:
        points[c] = flat.field(c).to_numpy(zero_copy_only=False)
    return pa.array([pack_scan_bytes(s, i, points[a:b]) for s, i, a, b in zip(_numbers(scan.field("stamp")), _numbers(scan.field("id")), ends, ends[1:])], pa.binary())


def slim(payload: Column) -> Column:
    """A datagram without the padding behind its points, nothing that ``unpack`` reads; for rows that are shuffled and sorted."""
    head, at = HEADER.size + SCAN_HEAD.size, HEADER.size + SCAN_HEAD.size - 3  # the number of points is the head's last four bytes
    scan = F.hex(F.substring(payload, 1, 4)) == SCAN_TYPE.to_bytes(4, "little").hex().upper()
    few = F.hex(F.substring(payload, at + 1, 3)) == "000000"
    n = F.least(F.conv(F.hex(F.substring(payload, at, 1)), 16, 10).cast("int"), F.lit(MAX_POINTS))
    return F.when(scan & few, F.substring(payload, F.lit(1), head + n * POINT.itemsize)).otherwise(payload)


# Scan accessors


def xyz(points: Column, drop_zero_returns: bool = False) -> Column:
    """array<struct x, y, z> in double, without zero returns if asked."""
    kept = F.filter(points, lambda p: (p["x"] != 0) | (p["y"] != 0) | (p["z"] != 0)) if drop_zero_returns else points
    return F.transform(kept, lambda p: F.struct(*[p[c].cast("double").alias(c) for c in "xyz"]))


def xyz_intensity(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(*[p[c].alias(c) for c in ("x", "y", "z", "intensity")]))


def point(points: Column, i: int) -> Column:
    """The i-th point from 0, null if there is none."""
    return F.get(points, F.lit(i))


def unpack(data: bytes | None) -> tuple | None:
    """('imu', stamp, id, ten floats) or ('scan', stamp, id, points) for tasks that fold over datagrams; None for anything else."""
    if status_of(data) not in ("ok", "short_declared"):
        return None
    if HEADER.unpack_from(data)[0] == IMU_TYPE:
        stamp, number, *v = IMU_PAYLOAD.unpack_from(data, HEADER.size)
        return "imu", stamp, number, np.array(v)
    stamp, number, n = SCAN_HEAD.unpack_from(data, HEADER.size)
    at = HEADER.size + SCAN_HEAD.size
    return "scan", stamp, number, np.frombuffer(data, POINT, min(n, MAX_POINTS, (len(data) - at) // POINT.itemsize), at)
