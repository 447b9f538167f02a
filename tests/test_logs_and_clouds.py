"""Result logs with several writers, and clouds read by ranges."""

import os
import threading

import numpy as np
import pytest
from conftest import rows_of

from orbitflow.sources import clouds, resultlog, tables


def test_result_log_grows_by_parts(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert resultlog.read(spark, path) is None
    assert resultlog.append(spark.createDataFrame([(1, "x")], "a int, b string"), path) == 0
    first = {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}
    assert resultlog.append(spark.createDataFrame([(2, 0.5)], "a int, `c.d` double"), path) == 1
    assert resultlog.append(spark.createDataFrame([(None, "y, \"z\"\nw")], "`c.d` double, b string"), path) == 2
    got = resultlog.read(spark, path)
    assert got.columns == ["a", "b", "c.d"]
    assert rows_of(got) == [("1", "x", None), ("2", None, "0.5"), (None, "y, \"z\"\nw", None)]
    assert rows_of(resultlog.read(spark, path, 0)) == [("1", "x")]
    again = {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}
    assert all(again[f] == t for f, t in first.items())  # nothing was rewritten


def test_two_writers_at_once_both_stay(spark, tmp_path):
    path, errors = f"{tmp_path}/log", []

    def write(k):
        try:
            for i in range(2):
                resultlog.append(spark.createDataFrame([(k, i, str(k))], f"k int, i int, c{k} string"), path)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = resultlog.read(spark, path)
    assert not errors and rows_of(got.select("k", "i")) == [(str(k), str(i)) for k in range(3) for i in range(2)]
    assert sorted(got.columns) == ["c0", "c1", "c2", "i", "k"] and [m["version"] for m in resultlog.manifests(spark, path)] == list(range(6))


def test_a_taken_version_is_not_overwritten(spark, tmp_path):
    name = f"{tmp_path}/log/_log/000000000000.json"
    assert resultlog._put_if_absent(spark, name, "one") and not resultlog._put_if_absent(spark, name, "two")
    assert open(name).read() == "one" and os.listdir(f"{tmp_path}/log/_log") == ["000000000000.json"]


def test_uncommitted_parts_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/log"
    row = spark.createDataFrame([(1,)], "a int")
    resultlog.append(row, path)
    row.write.csv(f"{path}/part-left")
    assert resultlog.read(spark, path).count() == 1 and resultlog.vacuum(spark, path) == ["part-left"] and resultlog.read(spark, path).count() == 1


def test_one_cloud_is_many_partitions(spark, tmp_path):
    rng = np.random.default_rng(1)
    for name, n in (("a", 1000), ("b", 7), ("c", 0)):
        v = np.zeros(n, clouds.VERTEX)
        for c in "xyz":
            v[c] = rng.normal(size=n)
        (tmp_path / f"{name}.ply").write_bytes(clouds.PLY_HEADER.format(n=n).encode() + v.tobytes())
    whole, split = clouds.read_ply(spark, f"{tmp_path}/*.ply"), clouds.read_ply(spark, f"{tmp_path}/*.ply", 128)
    assert rows_of(split) == rows_of(whole) and whole.count() == 1007
    assert split.rdd.getNumPartitions() == 9 and whole.rdd.getNumPartitions() == 2
    data = np.frombuffer((tmp_path / "a.ply").read_bytes()[-1000 * clouds.VERTEX.itemsize :], clouds.VERTEX)
    got = split.where("path LIKE '%a.ply'").orderBy("ord").toPandas()
    assert got["ord"].tolist() == list(range(1000)) and np.array_equal(got["y"].to_numpy(), data["y"].astype(float))
    (tmp_path / "a.ply").write_bytes((tmp_path / "a.ply").read_bytes()[:-1])
    with pytest.raises(Exception, match="ends early"):
        clouds.read_ply(spark, f"{tmp_path}/a.ply").collect()


def test_saved_maps_load_whatever_is_there(spark, tmp_path):
    c = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(5)], "ord long, x double, y double, z double")
    tables.write_ply(c, f"{tmp_path}/run_map_raw.ply", 0, 1)
    cloud, track = tables.load_saved(spark, f"{tmp_path}/run")
    assert cloud.groupBy("cloud").count().collect() == [("raw", 5)] and track.count() == 0
    assert tables.load_saved(spark, f"{tmp_path}/none")[0].count() == 0
