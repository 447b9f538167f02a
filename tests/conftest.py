import os
import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(base / "warehouse")).config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def ramp(n: int, start: int = 0) -> np.ndarray:
    """Points x = i + start, y = 2 i, z = 3 i; the first is a zero return if start is 0."""
    from orbitflow.functions.codec import POINT

    i = np.arange(n)
    p = np.zeros(n, POINT)
    p["x"], p["y"], p["z"], p["intensity"], p["time"], p["ring"] = i + start, 2 * i, 3 * i, 10, np.linspace(0, 0.005, n), i % 4
    return p


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)
