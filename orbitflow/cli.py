"""Command line: capture, odometry, precheck, map, monitor."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from orbitflow.config import MAP_VOXEL, PERIOD, Config


def config_from(args: argparse.Namespace) -> Config:
    return Config().with_(**{f.name: getattr(args, f.name) for f in fields(Config) if getattr(args, f.name, None) is not None})


def add_config(parser: argparse.ArgumentParser) -> None:
    for f in fields(Config):
        flag = f"--{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        else:
            parser.add_argument(flag, type=float, default=None)


def box(text: str) -> tuple[str, tuple[tuple, tuple]]:
    """NAME=x0,y0,z0,x1,y1,z1"""
    name, _, numbers = text.partition("=")
    v = [float(x) for x in numbers.split(",")]
    if len(v) != 6:
        raise argparse.ArgumentTypeError(f"not NAME and six numbers: {text!r}")
    return name, (tuple(v[:3]), tuple(v[3:]))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orbitflow", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    c = sub.add_parser("capture")
    c.add_argument("path")
    c.add_argument("--duration", type=float, default=60.0)
    c.add_argument("--port", type=int, default=None)
    c.add_argument("--kind", default=None)
    c.add_argument("--truth-m", type=float, default=None)
    c.add_argument("--notes", default=None)
    for name in ("odometry", "precheck", "map", "monitor"):
        s = sub.add_parser(name)
        s.add_argument("recordings", help="glob of recordings")
        add_config(s)
        s.add_argument("--sidecars", default=None, help="glob of sidecars")
        if name == "odometry":
            s.add_argument("--results", default=None, help="result table to append to")
            s.add_argument("--tag", action="append", default=[], help="KEY=VALUE, an extra result column")
            s.add_argument("--scale", type=float, default=1.0)
        if name == "map":
            s.add_argument("--map-voxel", type=float, default=MAP_VOXEL)
            s.add_argument("--plane", type=box, action="append", default=[])
    return p


def capture(args: argparse.Namespace) -> int:
    from orbitflow.sources import tables, udp

    if args.kind in ("line", "loop") and args.truth_m is None:
        print(f"a {args.kind} without --truth-m cannot be scored", file=sys.stderr)
    port = args.port or udp.PORT
    n, size = udp.capture(args.path, args.duration, port=port)
    if not n:
        print("nothing arrived", file=sys.stderr)
        return 1
    tables.write_sidecar(args.path, {"kind": args.kind, "truth_m": args.truth_m, "notes": args.notes, "duration_s": args.duration, "datagrams": n, "bytes_written": size, "port": port, "config": {k: str(v) for k, v in Config().as_dict().items()}, "provenance": tables.provenance()})
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.what == "capture":
        return capture(args)
    from pyspark.sql import SparkSession

    from orbitflow.operators.results import tags
    from orbitflow.plans import reports
    from orbitflow.sources import rawlog, resultlog, tables

    config, extra = config_from(args), tags(getattr(args, "tag", []))
    spark = SparkSession.builder.appName(f"orbitflow {args.what}").getOrCreate()
    data = rawlog.read(spark, args.recordings)
    meta = tables.read_sidecars(spark, args.sidecars) if args.sidecars else None
    if args.what == "odometry":
        _, row = reports.odometry_report(data, meta, config, args.scale, **extra)
        if args.results:
            resultlog.append(row, args.results)
        (resultlog.read(spark, args.results) if args.results else row).show(100, False)
    elif args.what == "precheck":
        for name, df in reports.precheck(data, meta, config).items():
            print(name)
            df.show(50, False)
    elif args.what == "map":
        for df in reports.map_quality(data, dict(args.plane), args.map_voxel, config):
            df.show(50, False)
    else:
        for name, df in reports.latest_view(data).items():
            print(name, f"(period {PERIOD} s)")
            df.show(20, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
