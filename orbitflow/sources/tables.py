"""Sidecars (JSON), result tables (CSV), point clouds (PLY), trajectories, provenance."""

from __future__ import annotations

import getpass
import platform
import socket
import subprocess
import sys
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitflow import schemas
from orbitflow.functions.geometry import height_color
from orbitflow.operators.results import widen
from orbitflow.sources.clouds import PLY_HEADER, VERTEX, read_ply


def read_sidecars(spark: SparkSession, glob: str) -> DataFrame:
    """``schemas.META`` with recording_id (the recording's file name). Unknown keys are left out; broken JSON gives a row with ``broken`` true."""
    df = spark.read.schema(schemas.META + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(glob)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    return df.select(F.url_decode(name).alias("recording_id"), "*").withColumn("broken", F.col("_bad").isNotNull()).drop("_bad")


def write_sidecar(recording: str, meta: dict) -> Path:
    """``<recording>.json`` beside a recording."""
    import json

    path = Path(f"{recording}.json")
    path.write_text(json.dumps(meta, indent=2) + "\n")
    return path


def provenance() -> dict[str, str | None]:
    """Where and with what something was made; what cannot be found out is None."""

    def tried(f):
        try:
            return f()
        except Exception:
            return None

    import pyspark

    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    return {
        "host": tried(socket.gethostname), "user": tried(getpass.getuser), "platform": tried(platform.platform), "python": sys.version.split()[0],
        "spark": pyspark.__version__, "numpy": np.__version__, "commit": tried(lambda: git("rev-parse", "HEAD")),
        "dirty": tried(lambda: str(bool(git("status", "--porcelain"))).lower()), "recorded_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
    }


def _place(spark: SparkSession, path: str):
    """(store, table, the old table while a new one takes its place)."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path.rstrip("/"))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at, jvm.Path(f"{path.rstrip('/')}.old")


def _recover(spark: SparkSession, path: str) -> bool:
    """Undo or finish an exchange of tables that was cut short; whether there is a table."""
    store, at, old = _place(spark, path)
    if not store.exists(at) and store.exists(old):
        store.rename(old, at)
    elif store.exists(old):
        store.delete(old, True)
    return store.exists(at)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """All columns as text, or None if there is no table yet; the first row names the columns."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path) if _recover(spark, path) else None


def append_results(rows: DataFrame, path: str) -> DataFrame:
    """Append to a result table, widening it: the new table is written beside the old one, which steps aside for it and goes last.

    Wherever this is cut short, the next reader finds the old table or the new one, whole. One writer at a time; for tables that grow long or have several, see ``resultlog``.
    """
    spark = rows.sparkSession
    table = widen(read_results(spark, path), rows)
    temp = f"{path.rstrip('/')}.new"
    table.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(temp)
    store, at, old = _place(spark, path)
    if store.exists(at):
        store.rename(at, old)
    store.rename(spark._jvm.org.apache.hadoop.fs.Path(temp), at)
    store.delete(old, True)
    return read_results(spark, path)


def write_ply(cloud: DataFrame, path: str, lo: float, hi: float, order: str = "ord") -> int:
    """A coloured cloud as one local file, streamed partition by partition; for export to viewers, so of a size that one file makes sense for."""
    rows = cloud.select("x", "y", "z", height_color(F.col("z"), lo, hi).alias("c"), order).orderBy(order)
    n = rows.count()
    with open(path, "wb") as f:
        f.write(PLY_HEADER.format(n=n).encode())
        held = []
        for r in rows.toLocalIterator():
            held.append((r.x, r.y, r.z, r.c.r, r.c.g, r.c.b))
            if len(held) == 65536:
                f.write(np.array(held, VERTEX).tobytes())
                held = []
        f.write(np.array(held, VERTEX).tobytes())
    return n


def write_trajectory(poses: DataFrame, path: str) -> int:
    """Positions of one recording as a .npy file of (frames, 3)."""
    rows = np.array([(r.x, r.y, r.z) for r in poses.select("frame_id", "x", "y", "z").orderBy("frame_id").toLocalIterator()], float).reshape(-1, 3)
    np.save(path, rows)
    return len(rows)


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """frame_id, x, y, z; no rows if the file is missing."""
    xyz = np.load(path) if Path(path).exists() else np.zeros((0, 3))
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "frame_id long, x double, y double, z double")


def load_saved(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(clouds, trajectory) saved under a prefix: ``<prefix>_map_deskew.ply`` and ``<prefix>_map_raw.ply`` with ``cloud`` deskew or raw, and
    ``<prefix>_traj.npy``. What is not there has no rows."""
    clouds = [read_ply(spark, f"{prefix}_map_{kind}.ply").drop("path").withColumn("cloud", F.lit(kind)) for kind in ("deskew", "raw")]
    return clouds[0].unionByName(clouds[1]), read_trajectory(spark, f"{prefix}_traj.npy")
