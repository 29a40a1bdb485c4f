"""Empty, single-row and out-of-range inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketry.config import CARDS, ORDERS, Decay, LedgerSpec, trailing
from basketry.operators import behavior as beh
from basketry.operators import decayed as dec
from basketry.operators import descriptive as des
from basketry.operators import filters as flt
from basketry.operators import groupstats as grp
from basketry.operators import labels as lab
from basketry.operators import metrics as met
from basketry.operators import neighbors as nei
from basketry.operators import panel as pan
from basketry.operators import ranking as rnk
from basketry.operators import raw
from basketry.operators import weights as wts


@pytest.fixture(scope="module", params=["empty", "one_row"])
def ledger(request, make_ledger):
    one = make_ledger([(1, 20, 2, 0.0)])
    return one if request.param == "one_row" else one.filter("chid < 0")


@pytest.fixture(scope="module")
def profile(ledger):
    return ledger.select("chid", "dt", F.lit(3).alias("g"), F.lit(7).cast("long").alias("lim"))


def test_features_survive(ledger, make_clients, spec):
    clients = make_clients([1, 2])
    assert beh.behavior(ledger, clients, spec, 20, ["avg_gap", "st_tgl"]).count() == 6
    assert beh.items_per_period(ledger, clients, spec, 20).count() == 2
    assert beh.old_gaps(ledger, clients, spec).filter("old_gap <> 24.0").count() == 0
    assert dec.decayed_purchases(ledger, clients, spec, 20, {"v": Decay()}).count() == 6
    got = dec.decayed_features(ledger, clients, spec, 20, {"v": ("amt", Decay(), 5.0)})
    assert got.select("v").distinct().count() == 1  # a zero amount counts as empty
    assert pan.purchase_map(ledger, clients, spec, 20).count() == 2 * 5 * 20
    assert pan.feature_map(ledger, clients, spec, "amt", 5.0, (1, 20)).filter("value <> 5.0").count() == 0
    assert raw.flat_vector(ledger, clients, spec, "amt", 20, (2, 0)).count() == 2
    assert raw.lag_table(ledger, spec, ["amt"], 20, 3).count() == ledger.count()


def test_tables_survive(ledger, profile, make_clients, spec):
    clients = make_clients([1, 2])
    assert des.count_map(ledger, spec).count() == 24 * 5
    des.amount_quartiles(ledger, "amt").collect()
    des.first_period(ledger, clients, spec).collect()
    des.log_histogram(ledger, "amt", 4).collect()
    des.code_shares(ledger, clients.withColumn("grp", F.lit("x")), "tag").collect()
    des.amount_heatmap(ledger, spec, "amt").collect()
    grp.group_stats(ledger, ["tag"], ["amt"], ["std", "median", "quantile_0.1"]).collect()
    raw.limit_stats(profile, clients, "lim").collect()
    raw.filled_limit(profile, "lim", 24).collect()
    assert raw.client_attributes(profile, ["g"], 20, clients).count() == 2


def test_rankings_and_metrics_survive(ledger, make_clients, spec):
    clients = make_clients([1, 2])
    ranking = rnk.rank_by_amount(ledger, clients, spec)
    assert ranking.count() == 2
    assert met.client_ndcg(ranking, ledger, spec, 20).count() == 0  # nothing bought for money
    assert met.mean_ndcg(met.client_ndcg(ranking, ledger, spec, 20)).first().ndcg is None
    met.zero_summary(met.client_ndcg(ranking, ledger, spec, 20)).collect()
    rnk.rank_by_rating(ledger, clients, spec).collect()
    vec = dec.decayed_purchases(ledger, clients, spec, 20, {"v": Decay()}, "all")
    assert rnk.rank_by_vector(vec, ledger, clients, spec, "v", 1, 21).count() == 2
    assert nei.neighbor_blend(vec, clients, spec, "v", 3, 2, 0.5, "cos", 2).count() == 10
    labels = lab.label_rows(ledger, spec, 19)
    wts.label_weights(labels, wts.active_weights(ledger, spec, 19, "amt")).collect()
    wts.class_weights(labels).collect()
    met.gap_cdf(beh.behavior(ledger, clients, spec, 20, ["avg_gap"])).collect()


def test_windows_before_the_first_period_are_rejected():
    with pytest.raises(ValueError):
        Decay(12).periods(5)
    with pytest.raises(ValueError):
        Decay(3, 6).periods(20)
    with pytest.raises(ValueError):
        trailing(5, 6)
    with pytest.raises(ValueError):
        trailing(5, 2, 2)


@pytest.mark.parametrize("which", ["legit", True, [99]])
def test_item_sets_are_validated(which):
    with pytest.raises(ValueError):
        ORDERS.item_set(which)


def test_item_sets():
    assert len(CARDS.item_set("leg")) == 16 and len(CARDS.item_set("illeg")) == 33
    assert ORDERS.label_map[19] == 7
    with pytest.raises(ValueError):
        LedgerSpec(n_periods=0, items=(1,), legit=(1,), amount="a")


def test_long_ledgers(make_ledger):
    long = LedgerSpec(n_periods=80, items=(1, 2), legit=(1,), amount="amt")
    assert long.n_periods == 80
    (row,) = beh.history(make_ledger([(1, 70, 2), (1, 3, 2)]), 70).collect()
    assert (row.first_dt, row.last_dt, row.months0, row.months1) == (3, 70, 1 << 2, 1 << (70 - 62 - 1))
    with pytest.raises(ValueError):
        beh.history(make_ledger([(1, 70, 2)]), 0)


def test_rankings_of_a_repeated_client_do_not_depend_on_order(spark, make_ledger, spec):
    rows = [(1, 2, 3, 5), (1, 5, 3, 2)]
    got = set()
    for order in (rows, rows[::-1]):
        ranking = spark.createDataFrame(order, "chid long, top1 int, top2 int, top3 int").coalesce(1)
        got.add(met.client_ndcg(ranking, make_ledger([(1, 4, 5, 100.0)]), spec, 4).first().ndcg)
    assert len(got) == 1


def test_limit_carries_the_last_known_value(spark):
    profile = spark.createDataFrame([(1, 1, None), (1, 2, 100), (1, 3, None), (2, 2, None)], "chid long, dt int, lim long")
    got = {(r.chid, r.dt): r.lim for r in raw.filled_limit(profile, "lim", 4).collect()}
    assert got == {(1, 1): 0, (1, 2): 100, (1, 3): 100, (1, 4): 100, **{(2, t): 0 for t in (1, 2, 3, 4)}}


def test_many_labels_and_high_tags(spark):
    hot = lab.multi_hot(spark.createDataFrame([(1, 0), (1, 99), (1, 99)], "chid long, label int"), 100).first().hot
    assert [i for i, x in enumerate(hot) if x] == [0, 99]
    pairs = spark.createDataFrame([(1, 65), (2, 1)], "chid long, tag int")
    folds = [r.fold for r in lab.row_folds(pairs, 1 << 30, by_client=False).orderBy("chid").collect()]
    assert folds[0] != folds[1]


def test_parameters_are_validated(make_ledger, spec):
    ledger = make_ledger([(1, 1, 2)])
    with pytest.raises(ValueError):
        nei.neighbor_blend(ledger, ledger, spec, "amt", 5, 6)
    with pytest.raises(ValueError):
        nei.neighbor_blend(ledger, ledger, spec, "amt", 5, 2, measure="dot")
    with pytest.raises(ValueError):
        wts.label_weights(ledger, ledger, scale_method="sum")
    with pytest.raises(ValueError):
        wts.item_imputation(ledger.select("tag", F.col("amt").alias("weight")), "mode")
    with pytest.raises(ValueError):
        beh.behavior_feature("gap", ledger, ledger, spec, 3)


def test_mean_fill_of_an_empty_column(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None)], "chid long, a double, b double")
    got = {r.chid: (r.a, r.b) for r in flt.mean_fill(df, ["a", "b"]).collect()}
    assert got == {1: (None, 2.0), 2: (None, 2.0)}


def test_recode_presets(spark):
    df = spark.createDataFrame([(99, 35, -1), (4, 38, 1), (5, 40, 0)], "poscd int, cuorg int, gender_code int")
    got = [tuple(r) for r in flt.recode(df).collect()]
    assert got == [(11, 10, 0), (4, 33, 2), (5, 34, 1)]
