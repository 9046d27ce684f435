"""Every registered query against its SQL on the small tables, as the driver compares them."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quern.plans import registry

SF = os.environ.get("QUERN_TEST_SF", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def comparable(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (np.isscalar(v) or v is pd.NaT or v is pd.NA) and pd.isna(v):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):  # numbers as numbers: 120.0 is 120
            return f"{v:.6f}" if v != int(v) else str(int(v))
        return str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name not in registry.oracle_sql():
        assert len(got) >= 0
        return
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numeric = [c for c in want.columns if want[c].dtype.kind in "iuf" and got[c].dtype.kind in "iuf"]
    for c in numeric:
        if want[c].dtype.kind == "f" or got[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert comparable(got) == comparable(want)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(registry.queries()) <= set(__spark_entry__.queries())
