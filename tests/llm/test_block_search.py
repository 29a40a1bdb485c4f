"""Nearest vectors by int8 tiles against products of all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from basketry.llm import block_search as bs

SF = "/root/testdata/sf0.001"


def plain(rows, asks, k):
    """rows (id, vector); lists of (query, rank, id, score)."""
    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and fit(v)]
    out = []
    for q in {i for i, _ in rows if asks(i)}:
        for x in {v.tobytes(): v for i, v in rows if i == q}.values():
            found = []
            for i, v in rows:
                if i != q and len(v) == len(x):
                    score = 0.0
                    for a, b in zip(x.tolist(), v.tolist(), strict=True):
                        score += a * b
                    found.append((-score, i))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_query_equals_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = rows_of(entry.queries()["op12_block_search"](spark, SF))
    assert got == plain(rows, lambda i: i % 20 == 0, 20) and got


@pytest.mark.parametrize("width", [1, 7, 1500])
def test_bounds_hold(width):
    rng = np.random.default_rng(width)
    x = rng.standard_normal((40, width)) * np.exp(rng.normal(0, 3, (40, 1)))
    y = rng.standard_normal((60, width)) ** 3
    (a, s, near, off), (b, t, _, off_b) = bs.codes(x), bs.codes(y)
    assert a.dtype == np.int8 and (np.abs(a.astype(int)).max(axis=1) == 127).all()
    whole = a.astype(np.int64) @ b.astype(np.int64).T
    assert (bs.code_products(a, b) == whole).all()
    apart = np.abs(x @ y.T - whole * (s[:, None] * t))
    assert (apart <= off[:, None] * np.linalg.norm(y, axis=1) + near[:, None] * off_b).all()


def test_few_pairs_are_computed_again():
    rng = np.random.default_rng(5)
    x, ids = rng.standard_normal((6000, 64)).astype(np.float32).astype(float), np.arange(6000)
    own = ids[:50]
    found, computed = bs.nearest_in_tile(x[:50], own, x, ids, 20)
    scores = x[:50] @ x.T
    scores[own, own] = -np.inf
    assert [[-v for _, v in f] for f in found] == np.argsort(-scores, axis=1)[:, :20].tolist()
    assert computed < 0.05 * 50 * 6000


@pytest.mark.parametrize("cells,merged", [(1 << 20, 64), (64, 2), (640, 3)])
def test_strips_change_nothing(spark, monkeypatch, cells, merged):
    monkeypatch.setattr(bs, "MERGED", merged)
    rng = np.random.default_rng(2)
    # few values, so many equal scores; a third of all rows are one row
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(150)] + [(300, [1.0, 2.0, 0.0, 1.0])] * 75
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(bs.nearest_vectors(df, F.col("vec_id") % 10 == 0, k=5, strip_cells=cells))
    assert got == plain(rows, lambda i: i % 10 == 0, 5)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, -0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
        (None, [5.0, 5.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [3.0, 0.0, 1.0]), (20, [1.0, 0.0, 1.0]), (40, [9.0]),
        (0, [2.0, 1.0]), (9, [-1.0, -1.0]), (10, [2.0, 1.0]),
    ]
    schema = "vec_id long, embedding array<double>, key long, copies long, asks string, width int, score string, rank int"
    df = spark.createDataFrame([(*r, 1, 2, "a", 3, "s", 4) for r in rows], schema)
    asks = F.col("vec_id") % 20 == 0
    got = rows_of(bs.nearest_vectors(df, asks, k=3))
    assert got == plain(rows, lambda i: i % 20 == 0, 3)
    assert {r[0] for r in got} == {0, 20} and [r[2] for r in got if r[0] == 20] == [8]
    assert bs.nearest_vectors(df.where("vec_id > 99"), asks).collect() == []
    assert bs.nearest_vectors(df.where("vec_id = 9"), asks).collect() == []
    huge = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e200, 1.0]), (2, [1.0, 1.0]), (3, [1e200, -1e200])], "vec_id long, embedding array<double>")
    found = bs.nearest_vectors(huge, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 2, 3] and found[0]["score"] == inf
    with pytest.raises(ValueError):
        bs.nearest_vectors(df, asks, vector="other")
