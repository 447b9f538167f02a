import argparse

import pytest
from test_align_frames import recording
from test_sources import raw

from orbitflow import cli, schemas
from orbitflow.plans import reports


def test_reports_run_over_recordings(spark):
    df = spark.createDataFrame(recording(150), schemas.DATAGRAMS)
    assert reports.frames_report(df).count() >= 3
    parts = reports.precheck(df)
    assert {k: v.count() >= 0 for k, v in parts.items()} and parts["streams"].first().packets == 150 and parts["kind"].first().kind == "stationary"
    view = reports.latest_view(df)
    assert view["stats"].first().scans_received == 150 and view["scan"].first().id == 149 and view["cloud"].count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.rec").write_bytes(raw([(t, p) for _, _, t, p in recording(120)]))
    args = cli.parser().parse_args(["odometry", "x", "--voxel-size", "0.3", "--no-deskew", "--tag", "a=b"])
    c = cli.config_from(args)
    assert c.voxel_size == 0.3 and not c.deskew and c.max_range == 25.0
    assert cli.box("w=0,0,0,1,1,1") == ("w", ((0, 0, 0), (1, 1, 1)))
    with pytest.raises(argparse.ArgumentTypeError):
        cli.box("w=1")
    assert cli.main(["monitor", f"{tmp_path}/*.rec"]) == 0 and "a.rec" in capsys.readouterr().out
