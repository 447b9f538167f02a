"""Schemas of every table, as DDL. Stamps are double seconds; unsigned 32-bit numbers are bigint."""

from __future__ import annotations

POINT = "struct<x:float,y:float,z:float,intensity:float,time:float,ring:bigint>"
VEC3 = "struct<x:double,y:double,z:double>"
QUAT = "struct<x:double,y:double,z:double,w:double>"
SCAN = f"struct<stamp:double,id:bigint,valid_points_num:int,points:array<{POINT}>>"
IMU = f"struct<stamp:double,id:bigint,q:{QUAT},gyro:{VEC3},accel:{VEC3}>"
MESSAGE = f"struct<msg_type:int,status:string,scan:{SCAN},imu:{IMU}>"

DATAGRAMS = "recording_id string, seq bigint, recv_time double, payload binary"
SCANS = f"recording_id string, seq bigint, stamp double, id bigint, valid_points_num int, points array<{POINT}>"
IMU_SAMPLES = f"recording_id string, seq bigint, stamp double, id bigint, q {QUAT}, gyro {VEC3}, accel {VEC3}"
FRAME_POINT = "struct<x:double,y:double,z:double,t_norm:double>"
FRAMES = f"recording_id string, frame_id bigint, t_start double, t_end double, n_scans int, points array<{FRAME_POINT}>"
POSES = "recording_id string, frame_id bigint, stamp double, x double, y double, z double, pose array<double>, delta array<double>, threshold double, span double, size bigint, seconds double"
CLOUD = "recording_id string, frame_id bigint, ord bigint, x double, y double, z double"
META = (
    "kind string, truth_m double, truth_method string, speed_mps double, environment string, notes string, recorded_at string, "
    "duration_s double, datagrams bigint, bytes_written bigint, port int, config map<string,string>, provenance map<string,string>"
)
