"""Hand-worked cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from basketry.config import ORDERS, Decay
from basketry.functions.moments import row_stat
from basketry.operators import behavior as beh
from basketry.operators import decayed as dec
from basketry.operators import metrics as met
from basketry.operators import ranking as rnk
from basketry.operators import raw
from basketry.operators import weights as wts
from basketry.operators.groupstats import group_stats
from basketry.queries.base import Tables
from tests.conftest import rows_by

PSEUDO = 797.165663


@pytest.fixture(scope="module")
def three_months(make_ledger):
    return make_ledger([(7, 2, 2), (7, 3, 2), (7, 6, 2), (7, 4, 3)])


def test_behavior_of_three_months(three_months, make_clients, spec):
    names = ["gap_since_first", "gap_since_last", "avg_gap", "st_tgl", "made_ratio", "purch_t_end"]
    got = rows_by(beh.behavior(three_months, make_clients([7]), spec, 6, names), "tag")
    r = got[2]
    assert (r.gap_since_first, r.gap_since_last, r.avg_gap) == (4, 0, 1.0)
    assert (r.n00, r.n01, r.n10, r.n11) == (1, 2, 1, 1)
    assert (r.made_ratio, r.purch_t_end) == (0.5, 1)
    never = got[5]
    assert (never.gap_since_first, never.gap_since_last, never.avg_gap) == (100, 100, 100.0)
    assert (never.n00, never.n01, never.n10, never.n11) == (5, 0, 0, 0)
    assert got[3].avg_gap == 100.0  # bought once


def test_decay_weights():
    d = Decay(6, 3, 0.5, 0.9)
    assert d.periods(6) == (2, 6)
    assert [round(w, 12) for w in reversed(d.weights(6))] == [0.45, 0.5, 0.81, 0.9, 1.0]
    full = Decay(12, 3, 0.5, 0.9)
    assert full.periods(23) == (13, 23)
    assert sum(full.weights(23)) == pytest.approx(4.98)


def test_decayed_purchases_and_features(three_months, make_clients, spec):
    d = Decay(6, 3, 0.5, 0.9)
    got = rows_by(dec.decayed_purchases(three_months, make_clients([7]), spec, 6, {"v": d}), "tag")
    assert got[2].v == pytest.approx(1.95)
    assert got[5].v == 0.0
    d12 = {"a": ("amt", Decay(), PSEUDO)}
    got = rows_by(dec.decayed_features(three_months, make_clients([7]), spec, 23, d12), "tag")
    assert got[5].a == pytest.approx(PSEUDO * 4.98)


def test_group_stats(spark):
    df = spark.createDataFrame(
        [("x", 1.0), ("x", 2.0), ("x", 5.0), ("y", 7.0), ("z", 3.0), ("z", None), (None, 9.0)], "k string, v double"
    )
    stats = ["std", "quantile_0.25", "nanquantile_0.25", "median", "mean"]
    got = rows_by(group_stats(df, ["k"], ["v"], stats), "k")
    assert set(got) == {"x", "y", "z"}
    assert got["x"].v_std == pytest.approx(2.0816659994661326)
    assert got["y"].v_std is None
    assert (got["x"].v_quantile_0_25, got["y"].v_quantile_0_25) == (1.5, 7.0)
    assert got["z"].v_quantile_0_25 is None and got["z"].v_nanquantile_0_25 == 3.0
    assert (got["x"].v_median, got["y"].v_median) == (2.0, 7.0)


def test_row_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 9.0, 4.0), (3.0,) * 5], "a double, b double, c double, d double, e double")
    cols = list("abcde")
    got = df.select(*[row_stat(cols, s).alias(s) for s in ("mean", "median", "std", "skew", "kurt")]).collect()
    assert got[0].skew == pytest.approx(0.93345096, abs=1e-8)
    assert got[0].kurt == pytest.approx(0.76203635, abs=1e-8)
    assert (got[0]["mean"], got[0]["median"]) == (4.2, 4.0)
    assert (got[1].skew, got[1].kurt, got[1]["std"]) == (0.0, 0.0, 0.0)


def test_weights_scale_and_exp(spark):
    labels = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 2, 0), (2, 3, 1)], "chid long, tag int, label int")
    cells = spark.createDataFrame([(1, 2, 100.0), (1, 3, 40.0), (2, 2, 20.0), (2, 3, 300.0)], "chid long, tag int, weight double")
    got = rows_by(wts.label_weights(labels, cells), "chid", "tag")
    assert got[1, 2].weight == pytest.approx(math.e)
    assert got[1, 3].weight == pytest.approx(math.exp(0.4))
    assert got[2, 2].weight == pytest.approx(math.exp(1 / 15))


def test_probability_ties_go_to_higher_label(spark, spec):
    rows = [(1, i, i, p) for i, p in enumerate([0.2, 0.5, 0.5, 0.1, 0.5])]
    df = spark.createDataFrame(rows, "chid long, tag int, label int, prob double")
    r = rnk.rank_by_probability(df, spec).first()
    assert (r.top1, r.top2, r.top3) == (4, 2, 1)


def test_weighted_rating(spark):
    rows = []
    for tag, (n, mean) in enumerate([(10, 100), (5, 300), (1, 500), (4, 50), (20, 80)], 1):
        rows += [(i, 1, tag, float(mean)) for i in range(n)]
    df = spark.createDataFrame(rows, "chid long, dt int, tag int, amt double")
    got = rnk.weighted_ratings(df, "amt").collect()
    assert [(r.tag, round(r.rating, 9)) for r in got] == [(5, 127.25)]


def test_vector_ranking_rounds_half_to_even(spark, make_clients, make_ledger, spec):
    # mean items per period 1.5 -> k = 2; 2.5 -> k = 2; 0.5 cannot occur on active periods, no history -> k = 0
    ledger = make_ledger(
        [(1, 1, 2, 5), (1, 2, 2, 5), (1, 2, 3, 50)]
        + [(2, 1, t, 10 * t) for t in (1, 2)]
        + [(2, 2, t, 10 * t) for t in (1, 2, 3)]
    )
    clients = make_clients([1, 2, 3])
    vec = dec.decayed_purchases(ledger, clients, spec, 4, {"v": Decay(5, 1, 1.0, 1.0)}, "all")
    got = rows_by(rnk.rank_by_vector(vec, ledger, clients, spec, "v", 1, 5), "chid")
    assert (got[1].top1, got[1].top2, got[1].top3) == (3, 2, 5)  # best two reordered by amount
    assert (got[3].top1, got[3].top2, got[3].top3) == (5, 3, 2)  # all zero: higher item first


def test_ndcg_values(spark, make_ledger, spec):
    ledger = make_ledger([(1, 9, 2, 100), (1, 9, 3, 50), (1, 9, 5, 20), (2, 9, 2, 30), (3, 9, 1, 40), (4, 9, 2, 0)])
    ranking = spark.createDataFrame(
        [(1, 3, 2, 4), (2, 2, 2, 2), (2, 2, 2, 2), (3, 2, 3, 5), (4, 2, 3, 5)], "chid long, top1 int, top2 int, top3 int"
    )
    got = rows_by(met.client_ndcg(ranking, ledger, spec, 9), "chid")
    assert set(got) == {1, 2}  # 3 bought nothing legit, 4 for nothing
    assert got[1].ndcg == pytest.approx(0.7989811489633001)
    assert got[2].ndcg == pytest.approx(2.1309297535714573)
    once = rows_by(met.client_ndcg(ranking, ledger, spec, 9, distinct=True), "chid")
    assert once[2].ndcg == pytest.approx(1.0)


def test_label_auc(spark):
    rows = [(0.9, 1)] * 3 + [(0.1, 1)] + [(0.2, 0)] * 4 + [(0.8, 0)] * 2 + [(0.5, 0)] * 0
    df = spark.createDataFrame(rows, "s double, y int")
    counts = met.confusion(df, "s", "y", 0.5)
    r = counts.first()
    assert (r.tp, r.fn, r.tn, r.fp) == (3, 1, 4, 2)
    assert met.binary_scores(counts).first().auc == pytest.approx(0.7083333, abs=1e-7)


def test_threshold_is_strict_and_empty_scores_are_zero(spark):
    df = spark.createDataFrame([(0.5, 1)], "s double, y int")
    r = met.binary_scores(met.confusion(df, "s", "y", 0.5)).first()
    assert (r.precision, r.recall, r.f1, r.acc) == (0.0, 0.0, 0.0, 0.0)


def test_amount_per_count(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 0.0, 0), (1, 1, 2, 0.0, 2), (1, 1, 3, 500.0, 1), (1, 1, 4, 2000.0, 2)],
        "chid long, dt int, tag int, amt double, cnt long",
    )
    got = rows_by(raw.amount_per_count(df, {"x": ("amt", "cnt")}, 1025.89962), "tag")
    assert [got[t].x_apc_state for t in (1, 2, 3, 4)] == [0, 2, 1, 3]
    assert got[1].x_apc is None
    assert [got[t].x_apc for t in (2, 3, 4)] == [512.94981, 500.0, 1000.0]


def test_baseline_on_the_given_tables(spark):
    """Measured once with two other engines."""
    t = Tables(spark, "/root/testdata/sf0.01")
    popular = t.past.filter(F.col("tag").isin(*ORDERS.legit))
    top = t.spark.range(1).select(rnk.popular_items(popular).alias("p")).first().p
    assert list(top) == [2, 19, 17]
    s = met.zero_summary(met.client_ndcg(t.ranking_a, t.ledger, ORDERS, 24)).first()
    assert (s.n_clients, s.n_zero) == (380, 176)
    assert s.ndcg == pytest.approx(0.269371204463368, abs=1e-12)


def test_ledger_totals(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    r = t.ledger.agg(F.count("*").alias("n"), F.sum("amt_cents").alias("c"), F.sum("txn_cnt").alias("k"), F.sum("cents_a").alias("a")).first()
    assert (r.n, r.c, r.k, r.a) == (53846, 318325627163, 60000, 106140089767)
    assert t.profile.count() == 12496
