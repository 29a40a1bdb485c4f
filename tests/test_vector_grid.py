"""The grid of vector parameters in one pass, against one call per point."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketry.config import Decay
from basketry.operators import neighbors as nei
from basketry.operators.decayed import decayed_purchases
from basketry.operators.metrics import client_ndcg, mean_ndcg
from basketry.operators.ranking import rank_by_vector
from basketry.plans import training as tr
from basketry.queries.base import SPEC, T_END, Tables
from tests.conftest import rows_by

SF = "/root/testdata/sf0.001"
DECAYS = (Decay(12, 3, 0.5, 0.9), Decay(12, 3, 1.0, 1.0))


@pytest.fixture(scope="module")
def src(spark):
    t = Tables(spark, SF)
    return tr.Sources(t.ledger, t.profile, t.clients, SPEC)


def test_blends_equal_single_calls(src):
    own = decayed_purchases(src.ledger, src.clients, SPEC, T_END, {"v0": DECAYS[0], "v1": DECAYS[1]}, "all").cache()
    points = [
        nei.GridPoint(0, 40, 3, 0.7, "cos"),
        nei.GridPoint(1, 40, 3, 0.2, "ed"),
        nei.GridPoint(1, 15, 5, 0.2, "ed"),
        nei.GridPoint(0, 15, None, 0.5, "cos"),
        nei.GridPoint(0, 40, 3, 0.1, "cos"),
    ]
    got = rows_by(nei.grid_blend(own, src.clients, SPEC, ["v0", "v1"], points, n_pools=2), "point", "chid", "tag")
    assert len(got) == len(points) * own.count()
    for i, p in enumerate(points):
        value = f"v{p.vector}"
        single = nei.neighbor_blend(own, src.clients, SPEC, value, p.n_candidates, p.k, p.alpha, p.measure, 2).collect()
        assert single and all(got[i, r["chid"], r["tag"]]["value"] == pytest.approx(r[value], abs=1e-12) for r in single)


def test_scores_equal_single_searches(src):
    grid = [tr.VectorParams(d, a, m, 5, n) for d in DECAYS for a, m, n in ((0.9, "cos", 30), (0.4, "ed", 12))]
    found = tr.search_vectors(src, T_END, grid, 2)
    more = [tr.VectorParams(p.decay, p.alpha / k, p.measure, k, p.n_candidates) for p in grid for k in (2, 3, 7)]
    plans = [tr.search_vectors(src, T_END, g, 2)._jdf.queryExecution().executedPlan().toString() for g in (grid, more)]
    # the ledger is read as often and the pools are met once, whatever the number of points
    assert plans[0].count("FileScan") == plans[1].count("FileScan")
    assert all(p.count("FlatMapCoGroupsInArrow") == 1 for p in plans)
    got = rows_by(found, "decay_g", "alpha")
    for p in grid:
        own = decayed_purchases(src.ledger, src.clients, SPEC, T_END, {"v": p.decay}, "all")
        vectors = nei.neighbor_blend(own, src.clients, SPEC, "v", p.n_candidates, p.k, p.alpha, p.measure, 2)
        ranking = rank_by_vector(vectors, src.ledger, src.clients, SPEC, "v", 1, T_END + 1)
        want = mean_ndcg(client_ndcg(ranking, src.ledger, SPEC, T_END + SPEC.horizon)).first()
        row = got[p.decay.decay_g, p.alpha]
        assert row["n_clients"] == want["n_clients"] and row["ndcg"] == pytest.approx(want["ndcg"], abs=1e-9)


def test_points_that_cannot_share_pools(src):
    own = src.clients.select("chid", F.lit(2).alias("tag"), F.lit(1.0).alias("v"))
    with pytest.raises(ValueError, match="candidates"):
        nei.grid_blend(own, src.clients, SPEC, ["v"], [nei.GridPoint(0, 3, 5, 0.5, "cos")])
    far = [nei.GridPoint(0, n, 5, 0.5, "cos") for n in (100, 50_000)]
    with pytest.raises(ValueError, match="pools"):
        nei.grid_blend(own, src.clients, SPEC, ["v"], far)
