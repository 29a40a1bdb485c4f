"""Whitening by exact characteristic polynomials against plain versions."""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest

from basketry.llm import whitening as wh
from basketry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def whole(vectors):
    return np.floor(64 * np.array(vectors, np.float64)).astype(np.int64).astype(object) + 1_000_000


def plain(x):
    """(n, deviations, components, eigenvalues, trace) with exact sums and a float decomposition."""
    n = len(x)
    s = x.sum(axis=0)
    scatter = n * (x.T @ x) - np.outer(s, s)
    values, vectors = np.linalg.eigh(scatter.astype(float))
    return n, [int(((n * r - s) ** 2).sum()) for r in x], vectors[:, ::-1], values[::-1] / n**2, int(scatter.diagonal().sum()) / n**2


def check(rows, ids, vectors, most=32):
    x = whole(vectors)
    n, deviation, components, e, trace = plain(x)
    rank = int((e > 1e-9 * e[0]).sum())
    want = min(most, rank)
    assert len(rows) == len(ids) * want
    centred = ((n * x - x.sum(axis=0)) / n).astype(float)
    at = {i: k for k, i in enumerate(ids)}
    got = np.zeros((len(ids), want))
    for r in rows:
        k, c = at[r["vec_id"]], r["component"] - 1
        got[k, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[k] == int(r["deviation_exact"])
        assert abs(r["explained"] - e[c] / trace) <= 1e-6 * e[c] / trace
        assert r["identity_error"] <= 1e-4
    assert np.abs(np.cov(got.T, bias=True).reshape(want, want) - np.eye(want)).max() < 1e-8
    for c in range(want):
        near = np.abs(e[:rank] - e[c]) > 1e-6 * e[0]
        near[c] = True
        if near.all():  # an eigenvalue of its own has one vector, up to its sign
            ref = centred @ components[:, c] / np.sqrt(e[c])
            assert min(np.abs(got[:, c] - ref).max(), np.abs(got[:, c] + ref).max()) < 1e-6


def test_query_equals_plain_version(spark):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = QUERIES["op13_whitening"](spark, SF).collect()
    check(rows, list(table), list(table.values()))


@pytest.mark.parametrize("most", [1 << 8, 1 << 22, 1 << 45])
def test_sums_are_exact(most):
    x = np.random.default_rng(most).integers(-most, most, (40, 6))
    big = x.astype(object)
    assert (wh.gram(x) == big.T @ big).all() and (wh.column_sums(x) == big.sum(axis=0)).all()


def determinant(m):
    m, out = [[Fraction(int(v)) for v in row] for row in m], Fraction(1)
    for k in range(len(m)):
        pivot = next((r for r in range(k, len(m)) if m[r][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            m[k], m[pivot], out = m[pivot], m[k], -out
        out *= m[k][k]
        for r in range(k + 1, len(m)):
            f = m[r][k] / m[k][k]
            m[r] = [a - f * b for a, b in zip(m[r], m[k], strict=True)]
    return out


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_polynomial_is_exact(spark, d):
    a = np.random.default_rng(d).integers(-10**6, 10**6, (d + 3, d)).astype(object)
    m = a.T @ a
    e = wh.characteristic_polynomial(spark, m)
    assert e[0] == 1 and e[1] == m.diagonal().sum() and e[d] == determinant(m)
    for x in (-3, 10**12):
        assert sum((-1) ** k * v * x ** (d - k) for k, v in enumerate(e)) == determinant(np.eye(d, dtype=int).astype(object) * x - m)


def test_polynomial_of_a_reduced_matrix(spark):
    # blocks and zero columns take every turn of the reduction
    m = np.zeros((6, 6), object)
    m[:2, :2], m[3:5, 3:5] = [[2, 1], [1, 2]], [[5, 0], [0, 5]]
    m[0, 5] = m[5, 0] = 1
    m[5, 5] = 3
    e = wh.characteristic_polynomial(spark, m)
    ref = np.poly(m.astype(float))
    assert [(-1) ** k * v for k, v in enumerate(e)] == [round(v) for v in ref]


def test_roots_with_multiplicity():
    # (x - 7)^2 (x - 3) x, and (x^2 - 4 x + 1): 2 +- sqrt 3
    roots = wh.Roots([1, 17, 91, 147, 0])
    assert roots.rank == 3
    assert [roots.group(k) for k in (1, 2, 3)] == [(1, 2), (1, 2), (3, 3)]
    assert [Fraction(*(lambda a, b: (a, 1 << b))(*roots.root(k))) for k in (1, 2, 3)] == [7, 7, 3]
    roots = wh.Roots([1, 4, 1])
    with localcontext() as context:
        context.prec = 80
        for k, sign in ((1, 1), (2, -1)):
            a, bits = roots.root(k)
            exact = 2 + sign * Decimal(3).sqrt()
            assert abs(Decimal(a) / (1 << bits) / exact - 1) < Decimal(2) ** -195


def test_close_roots_have_their_own_vectors():
    # eigenvalues 10^12 and 10^12 + 2 differ in the twelfth digit only
    m = np.array([[10**12 + 1, 1], [1, 10**12 + 1]], object)
    roots = wh.Roots([1, 2 * (10**12 + 1), (10**12 + 1) ** 2 - 1])
    with localcontext() as context:
        context.prec = wh.DIGITS
        for k, other in ((1, 1), (2, -1)):
            assert roots.group(k) == (k, k)
            a, bits = roots.root(k)
            (v,) = wh.null_vectors(m, Decimal(a + 1) / (1 << bits), 1)
            assert abs(float(v[0]) - other * float(v[1])) < 1e-15


def test_equal_eigenvalues_and_constant_columns(spark):
    rows = [(0, [1.0, 0.0, 0.0, 5.0]), (1, [0.0, 1.0, 0.0, 5.0]), (2, [0.0, 0.0, 1.0, 5.0])]
    rows += [(i + 3, [-v[0], -v[1], -v[2], 5.0]) for i, v in rows]
    out = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(out, [r[0] for r in rows], [r[1] for r in rows])
    assert {r["component"] for r in out} == {1, 2, 3}


def test_cases(spark):
    nan = float("nan")
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(30)] + [(None, [0.0, 0.0, 0.0])]
    bad = [(100, None), (101, []), (102, [nan, 1.0, 2.0]), (103, [None, 1.0, 2.0]), (104, [1.0, float("-inf"), 0.0])]
    alone = [(200, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, n long, component string, width int, part int"
    df = spark.createDataFrame([(*r, 1, "c", 2, 3) for r in good + bad + alone], schema)
    rows = wh.whiten(df).collect()
    check(rows, [r[0] for r in good], [r[1] for r in good])
    assert wh.whiten(df.where("vec_id = 999")).collect() == []
    assert wh.whiten(df.where("vec_id = 200")).collect() == []  # one row has no variance
    # repeated rows count; a width of its own is a list of its own
    pairs = [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 1.5])]
    rows = wh.whiten(spark.createDataFrame(pairs + [(r[0] + 10, r[1]) for r in good[:9]], "vec_id long, embedding array<double>")).collect()
    assert sorted({(r["n"], r["component"]) for r in rows}) == [(3, 1), (9, 1), (9, 2), (9, 3)]
    with pytest.raises(ValueError):
        wh.whiten(df, vector="other")


def test_values_beyond_a_long(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [3e10, 4.0]), (3, [0.0, 0.0])]
    out = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 8 and all(np.isfinite(r["whitened"]) for r in out)
    assert out[0]["deviation"] is None and all(r["identity_error"] < 1e-4 for r in out)
