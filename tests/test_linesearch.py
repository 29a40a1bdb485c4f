"""Exact line search of blend weights against brute force."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import linesearch as ls
from basketry.operators.metrics import DISCOUNTS, client_ndcg
from basketry.operators.ranking import rank_by_probability
from basketry.operators.stacking import blend, blend_search

MODELS = [("a", 1), ("b", 2), ("c", 3)]
N, T = 40, 10


@pytest.fixture(scope="module")
def world(spark, make_ledger, spec):
    rng = np.random.default_rng(12)
    ledger = make_ledger([(c, T, int(i), float(rng.integers(1, 400))) for c in range(N) for i in spec.items if rng.random() < 0.6])
    rows = [(m, v, c, int(i), float(rng.integers(0, 30))) for m, v in MODELS for c in range(N + 3) for i in spec.legit]
    store = spark.createDataFrame(rows, "model string, version int, chid long, tag int, prob double")
    return store, ledger


def units_at(probs, amounts, ideal, weights):
    total = []
    for p, a, top in zip(probs, amounts, ideal, strict=True):
        order = sorted(range(len(a)), key=lambda j: (-sum(w * x for w, x in zip(weights, p[j], strict=True)), -j))
        gain = sum(a[j] / d for j, d in zip(order, DISCOUNTS, strict=False))
        total.append(int(np.floor(gain / top * ls.UNITS + 0.5)))
    return total


def test_changes_give_the_value_everywhere():
    rng = np.random.default_rng(3)
    probs = rng.integers(0, 12, (25, 6, 3)).astype(float)
    amounts, ideal = rng.integers(0, 90, (25, 6)).astype(float), rng.integers(100, 200, 25).astype(float)
    weights = [0.2, 0.5, 0.7]
    direction, at, change = ls.client_changes(probs, amounts, ideal, weights)
    assert change[direction == -1].tolist() == units_at(probs, amounts, ideal, weights)
    for d in range(3):
        for x in rng.random(40):
            moved = [x if i == d else w for i, w in enumerate(weights)]
            own = (direction == d) & (at < x)
            assert change[own].sum() == sum(units_at(probs, amounts, ideal, moved))


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_sweep_finds_the_first_best_interval(spark, monkeypatch, bins):
    monkeypatch.setattr(ls, "BINS", bins)
    rng = np.random.default_rng(bins)
    rows = [(d, float(a), int(c)) for d in (0, 1) for a, c in zip(rng.integers(0, 50, 200) / 50, rng.integers(-5, 6, 200))]
    rows += [(0, 0.0, 3), (1, 0.0, 4)]
    got = {r["direction"]: r for r in ls.sweep(spark.createDataFrame(rows, "direction int, at double, change long")).collect()}
    for d in (0, 1):
        marks = sorted({a for e, a, _ in rows if e == d})
        totals = [sum(c for e, a, c in rows if e == d and a <= m) for m in marks]
        best = int(np.argmax(totals))
        want = (totals[best], marks[best], marks[best + 1] if best + 1 < len(marks) else 1.0)
        assert (got[d]["total"], got[d]["low"], got[d]["high"]) == want


def test_never_worse_than_a_grid(spark, spec, world):
    store, ledger = world
    grid = [list(w) for w in product((0.0, 0.25, 0.5, 0.75, 1.0), repeat=3) if any(w)]
    scored = blend_search(store, ledger, spec, T, MODELS, grid).orderBy(F.col("ndcg").desc(), "candidate").first()
    starts = [None, grid[scored["candidate"]]]
    found = [ls.blend_line_search(store, ledger, spec, T, MODELS, s).collect() for s in starts]
    assert max(rows[0]["ndcg"] for rows in found) >= scored["ndcg"] - 1e-8
    for rows in found:
        weights = {(r["model"], r["version"]): r["weight"] for r in rows}
        assert set(weights) == set(MODELS) and all(0 <= w <= 1 for w in weights.values())
        ranked = rank_by_probability(blend(store, weights), spec)
        per_client = client_ndcg(ranked, ledger, spec, T)
        assert per_client.agg(F.avg("ndcg")).first()[0] == pytest.approx(rows[0]["ndcg"], abs=1e-8)
        assert per_client.count() == rows[0]["n_clients"]
    equal = blend_search(store, ledger, spec, T, MODELS, [[1 / 3] * 3]).first()["ndcg"]
    assert found[0][0]["ndcg"] >= equal - 1e-8


def test_nobody_to_score(spec, world):
    store, ledger = world
    rows = ls.blend_line_search(store.filter("chid < 0"), ledger, spec, T, MODELS).collect()
    assert [(r["weight"], r["n_clients"], r["ndcg"]) for r in rows] == [(1 / 3, 0, None)] * 3
