"""Every query with SQL equals that SQL on the small tables: names, types, rows and values."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from basketry.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = ordered(QUERIES[name](spark, SF).toPandas()), ordered(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert got[c].dtype.kind == want[c].dtype.kind, c
        if got[c].dtype.kind in "iuf":
            a, b = got[c].to_numpy(float), want[c].to_numpy(float)
            assert ((a == b) | (np.isnan(a) & np.isnan(b))).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_names_and_contract(spark):
    assert set(SQL) <= set(QUERIES)
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 1


def test_queries_leave_out_only_models_and_searches():
    without = set(REGISTRY) - set(SQL)
    assert all(n.split("_")[0] in {"k06", "m12", "p01", "p02", "p03", "p06", "p07", "p08", "p10", "p11", "p12", "p13"} for n in without)
