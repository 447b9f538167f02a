"""Every query of the catalogue against its SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from orbitflow.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)

    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and np.isnan(x):
            return None
        x = x.item() if isinstance(x, np.generic) else x
        return float(x) if isinstance(x, int) and not isinstance(x, bool) else x  # pandas has floats where an integer column has nulls

    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "n_points" in df.columns


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
