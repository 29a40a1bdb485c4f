from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from basketry.config import LedgerSpec  # noqa: E402
from basketry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "basketry-tests", "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = LedgerSpec(n_periods=24, items=(1, 2, 3, 4, 5), legit=(2, 3, 5), amount="amt", channels=("a",), limit="lim")


@pytest.fixture(scope="session")
def spec() -> LedgerSpec:
    return SMALL


@pytest.fixture(scope="session")
def make_ledger(spark):
    """Rows (chid, dt, tag[, amt[, cnt]]) as a ledger."""

    def build(rows):
        full = [(r[0], r[1], r[2], float(r[3]) if len(r) > 3 else 10.0, r[4] if len(r) > 4 else 1) for r in rows]
        return spark.createDataFrame(full, "chid long, dt int, tag int, amt double, txn_cnt long")

    return build


@pytest.fixture(scope="session")
def make_clients(spark):
    return lambda ids: spark.createDataFrame([(i,) for i in ids], "chid long")


def rows_by(df, *keys):
    """Collected rows as a dict by key columns."""
    out = {}
    for r in df.collect():
        key = tuple(r[k] for k in keys)
        out[key[0] if len(key) == 1 else key] = r
    return out
