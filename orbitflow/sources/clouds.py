"""Point clouds of one binary file each, read by ranges of vertices.

A header tells the number of vertices, and a vertex has a fixed size, so the place of every vertex is known without reading any before it: a file of any length is as many
partitions as it has ranges, and a task holds a batch of vertices.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orbitflow.sources.rawlog import listed, located

# The only PLY layout that is written and read.
PLY_HEADER = "ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
COLUMNS = "path string, ord long, x double, y double, z double"
#: Vertices of a partition, and of a batch.
SPLIT, BATCH = 1 << 22, 1 << 16


def header(path: str) -> tuple[int, int]:
    """(vertices, byte of the first) of a file; files of another layout, or shorter than they say, are refused."""
    store, inside = located(path)
    with store.open_input_file(inside) as f:
        start, size = f.read(len(PLY_HEADER) + 24), f.size()
    m = re.search(rb"element vertex (\d+)\n", start)
    head = PLY_HEADER.format(n=int(m.group(1))).encode() if m else b"?"
    if not start.startswith(head):
        raise ValueError(f"{path}: not a cloud of ours")
    if size < len(head) + int(m.group(1)) * VERTEX.itemsize:
        raise ValueError(f"{path}: not a cloud of ours, as it ends early")
    return int(m.group(1)), len(head)


class _Vertices(InputPartition):
    def __init__(self, path: str, first: int, last: int, start: int):
        self.path, self.first, self.last, self.start = path, first, last, start


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.split = [p for p in options["files"].split("\n") if p], int(options["split"])

    def partitions(self):
        out = []
        for path in self.paths:
            n, start = header(path)
            out += [_Vertices(path, lo, min(lo + self.split, n), start) for lo in range(0, n, self.split)]
        return out or [_Vertices("", 0, 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        store, inside = located(partition.path)
        with store.open_input_file(inside) as f:
            f.seek(partition.start + partition.first * VERTEX.itemsize)
            for lo in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - lo)
                v = np.frombuffer(f.read(n * VERTEX.itemsize), VERTEX)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.arange(lo, lo + n)), *(pa.array(v[c].astype(np.float64)) for c in "xyz")], names=["path", "ord", "x", "y", "z"])


class Clouds(DataSource):
    """``format("cloud_ply")``: options ``files``, one path a line, and ``split``, vertices of a partition."""

    @classmethod
    def name(cls):
        return "cloud_ply"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return _Reader(self.options)


def read_ply(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """path, ord, x, y, z of the files that match; ord counts a file's vertices. No file, no rows."""
    spark.dataSource.register(Clouds)
    return spark.read.format("cloud_ply").option("files", "\n".join(listed(spark, path))).option("split", split).load()
