"""Closed forms and distributed forms against brute force on small random data."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.config import Decay
from basketry.functions.hashing import key_fraction, key_hash
from basketry.functions.moments import exact_sum
from basketry.functions.quantiles import exact_quantiles
from basketry.operators import behavior as beh
from basketry.operators import decayed as dec
from basketry.operators import filters as flt
from basketry.operators import labels as lab
from basketry.operators import metrics as met
from basketry.operators import neighbors as nei
from basketry.operators import panel as pan
from basketry.operators import raw
from basketry.operators import stacking as stk
from basketry.plans import dataset as ds
from tests.conftest import SMALL, rows_by

N_CLIENTS, T = 30, 20


@pytest.fixture(scope="module")
def bought():
    rng = np.random.default_rng(5)
    return rng.random((N_CLIENTS, T, 5)) < 0.3, rng.integers(0, 500, (N_CLIENTS, T, 5)).astype(float)


@pytest.fixture(scope="module")
def ledger(bought, make_ledger):
    mask, amount = bought
    return make_ledger([(int(c), int(d) + 1, int(i) + 1, amount[c, d, i]) for c, d, i in zip(*np.nonzero(mask))])


@pytest.fixture(scope="module")
def clients(make_clients):
    return make_clients(range(N_CLIENTS))


def test_toggles_ratio_and_gaps(ledger, clients, spec, bought):
    mask = bought[0].astype(int)
    got = rows_by(beh.behavior(ledger, clients, spec, T, ["gap_since_first", "gap_since_last", "avg_gap", "st_tgl", "made_ratio"], "all"), "chid", "tag")
    assert len(got) == N_CLIENTS * 5
    for (c, tag), r in got.items():
        v = mask[c, :, tag - 1]
        when = np.nonzero(v)[0] + 1
        pairs = list(zip(v[:-1], v[1:]))
        assert [r.n00, r.n01, r.n10, r.n11] == [pairs.count(x) for x in ((0, 0), (0, 1), (1, 0), (1, 1))]
        assert r.n00 + r.n01 + r.n10 + r.n11 == T - 1
        assert r.made_ratio == pytest.approx(v.sum() / T) and 0 <= r.made_ratio <= 1
        assert r.gap_since_first == (T - when.min() if len(when) else 100)
        assert r.gap_since_last == (T - when.max() if len(when) else 100)
        assert r.gap_since_first >= r.gap_since_last
        assert r.avg_gap == pytest.approx(np.mean(np.diff(when) - 1) if len(when) > 1 else 100)


def test_purchase_map_is_the_mask(ledger, clients, spec, bought):
    got = rows_by(pan.purchase_map(ledger, clients, spec, T), "chid", "tag", "dt")
    assert len(got) == N_CLIENTS * 5 * T
    assert all(r.bought == bought[0][c, d - 1, i - 1] for (c, i, d), r in got.items())


@pytest.mark.parametrize("decay", [Decay(12, 3, 0.5, 0.9), Decay(7, 6, 0.8, 0.6), Decay(10, 2, 0.7, 1.0), Decay(20, 1, 0.6, 0.9, True)])
def test_decay_closed_forms(ledger, clients, spec, bought, decay):
    """Grouped from the end: weight by group and by position in the group, dense and with imputed cells."""
    mask, amount = bought
    first, last = decay.periods(T)
    months = list(range(first, last + 1))
    groups = [months[max(0, e - decay.gp_size) : e] for e in range(len(months), 0, -decay.gp_size)]
    weight = {m: decay.decay_g**g * decay.decay_b**b for g, ms in enumerate(groups) for b, m in enumerate(reversed(ms))}
    counts = rows_by(dec.decayed_purchases(ledger, clients, spec, T, {"v": decay}, "all"), "chid", "tag")
    values = rows_by(dec.decayed_features(ledger, clients, spec, T, {"v": ("amt", decay, 7.5)}, "all"), "chid", "tag")
    for c in range(N_CLIENTS):
        for i in range(5):
            cells = [(weight[m], mask[c, m - 1, i], amount[c, m - 1, i]) for m in months]
            assert counts[c, i + 1].v == pytest.approx(sum(w * b for w, b, _ in cells))
            assert values[c, i + 1].v == pytest.approx(sum(w * (a if b and a else 7.5) for w, b, a in cells))


def test_unit_decay_counts_months(ledger, clients, spec, bought):
    got = rows_by(dec.decayed_purchases(ledger, clients, spec, T, {"v": Decay(11, 3, 1.0, 1.0)}, "all"), "chid", "tag")
    assert all(r.v == bought[0][c, 10:, i - 1].sum() for (c, i), r in got.items())


@pytest.mark.parametrize("measure", ["cos", "ed"])
@pytest.mark.parametrize("k", [4, None])
@pytest.mark.parametrize("normalize", [False, True])
def test_neighbors_by_brute_force(ledger, clients, spec, measure, k, normalize):
    vectors = dec.decayed_purchases(ledger, clients, spec, T, {"v": Decay(12, 3, 1.0, 1.0)}, "all")
    dense = np.zeros((N_CLIENTS, 5))
    for r in vectors.collect():
        dense[r.chid, r.tag - 1] = r.v
    dense[3] = 0  # a client without purchases in the window
    vectors = vectors.withColumn("v", F.when(F.col("chid") == 3, 0.0).otherwise(F.col("v")))
    pools = {r.chid: r.p for r in clients.select("chid", nei.pool_of(3).alias("p")).collect()}
    members = {}
    for r in nei.candidate_pools(clients, 3, 7).collect():
        members.setdefault(r.pool, []).append(r.chid)
    assert all(len(m) <= 7 and all(pools[c] == p for c in m) for p, m in members.items())
    got = rows_by(nei.neighbor_blend(vectors, clients, spec, "v", 7, k, 0.6, measure, 3, normalize), "chid", "tag")

    def unit(v):
        return v / v.max() if v.max() > 0 else np.zeros_like(v)

    for c in range(N_CLIENTS):
        own = dense[c]
        options = [m for m in sorted(members[pools[c]]) if m != c]
        if k is not None:
            def distance(m):
                if measure == "ed":
                    return float(((dense[m] - own) ** 2).sum())
                norm = np.linalg.norm(dense[m]) * np.linalg.norm(own)
                return -round(float(dense[m] @ own) / norm, 12) if norm else np.inf
            options = sorted(options, key=lambda m: (distance(m), m))[:k]
        shape = unit if normalize else (lambda v: v)
        mean = np.mean([shape(dense[m]) for m in options], axis=0) if options else np.zeros(5)
        want = 0.6 * shape(own) + 0.4 * mean
        assert [got[c, i].v for i in range(1, 6)] == pytest.approx(list(want))


def test_attribute_neighbors_by_brute_force(spark, ledger, clients, spec):
    vectors = dec.decayed_purchases(ledger, clients, spec, T, {"v": Decay(12, 3, 1.0, 1.0)}, "all")
    dense = np.zeros((N_CLIENTS, 5))
    for r in vectors.collect():
        dense[r.chid, r.tag - 1] = r.v
    attrs = clients.withColumn("g", F.col("chid") % 3).withColumn("h", F.col("chid") % 2)
    pools = {r.chid: r.p for r in clients.select("chid", nei.pool_of(2).alias("p")).collect()}
    members = {r.chid for r in nei.candidate_pools(clients, 2, 9).collect()}
    got = rows_by(nei.attribute_blend(vectors, attrs, ["g", "h"], spec, "v", 9, 0.6, 2), "chid", "tag")

    def unit(v):
        return v / v.max() if v.max() > 0 else np.zeros_like(v)

    for c in range(N_CLIENTS):
        same = [m for m in members if m != c and pools[m] == pools[c] and m % 6 == c % 6]
        mean = np.mean([unit(dense[m]) for m in same], axis=0) if same else np.zeros(5)
        want = 0.6 * unit(dense[c]) + 0.4 * mean
        assert [got[c, i].v for i in range(1, 6)] == pytest.approx(list(want))


@pytest.mark.parametrize(
    "kind,accuracy",
    [(k, 60) for k in ("cents", "doubles", "negative", "one_value", "outlier", "close", "ties")] + [("cents", 400), ("ties", 20_000)],
)
def test_exact_quantiles(spark, kind, accuracy):
    rng = np.random.default_rng(3)
    values = {
        "cents": rng.integers(1, 10**7, 4000).astype(float),
        "doubles": rng.random(4001),
        "negative": rng.normal(0, 50, 3000),
        "one_value": np.full(3000, 12.5),
        "close": 7.0 + rng.random(4000) * 1e-9,
        "ties": np.where(rng.random(4000) < 0.8, 3.25, rng.random(4000)),
        "outlier": np.append(rng.integers(0, 40, 3000), 1e15),
    }[kind]
    # one group holds most rows
    keys = np.where(rng.random(len(values)) < 0.8, "hot", "cold")
    df = spark.createDataFrame([(str(k), float(v)) for k, v in zip(keys, values)] + [("hot", None), (None, 1.0)], "k string, v double")
    probs = {"lo": 0.0, "a": 0.1, "m": 0.5, "b": 0.93, "hi": 1.0}
    got = rows_by(exact_quantiles(df.repartition(6), ["k"], "v", probs, accuracy=accuracy), "k")
    assert set(got) == {"hot", "cold"}
    for k, r in got.items():
        want = np.quantile(values[keys == k], list(probs.values()))
        assert [r[p] for p in probs] == pytest.approx(list(want), rel=1e-12)
    total = exact_quantiles(df.filter("k IS NOT NULL"), [], "v", {"m": 0.5}, accuracy=accuracy).first()
    assert total.m == pytest.approx(np.quantile(values, 0.5))


def test_quantiles_of_many_columns_with_other_aggregates(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), float(a), None if b < 0.1 else float(b), int(c)) for k, a, b, c in zip(rng.integers(0, 3, 900), rng.normal(size=900), rng.random(900), rng.integers(0, 9, 900))]
    rows += [(7, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c int")
    extra = [F.count("*").alias("n"), F.stddev_samp("c").alias("sd"), (F.count("*") > F.count("b")).alias("gap")]
    got = rows_by(exact_quantiles(df, ["k"], ["a", "b", "c"], {"q1": 0.25, "q9": 0.9}, extra, accuracy=50), "k")
    assert set(got) == {0, 1, 2, 7}
    for k in (0, 1, 2):
        own = [r for r in rows if r[0] == k]
        for at, name in ((1, "a"), (2, "b"), (3, "c")):
            want = np.quantile([r[at] for r in own if r[at] is not None], [0.25, 0.9])
            assert [got[k][f"{name}_q1"], got[k][f"{name}_q9"]] == pytest.approx(list(want), rel=1e-12)
        assert (got[k].n, got[k].gap) == (len(own), True) and got[k].sd == pytest.approx(np.std([r[3] for r in own], ddof=1))
    assert got[7].a_q1 is None and got[7].b_q9 is None and got[7].n == 1
    assert exact_quantiles(df.filter("k > 9"), ["k"], "a", {"m": 0.5}).collect() == []
    assert exact_quantiles(df.filter("k > 9"), [], "a", {"m": 0.5}).collect() == []


def test_hash_is_spread_and_repeatable(spark):
    ids = spark.range(20000)
    a = ids.select(key_hash(F.col("id"), 3).alias("h"))
    assert a.agg(F.bit_xor("h")).first() == ids.repartition(7).select(key_hash(F.col("id"), 3).alias("h")).agg(F.bit_xor("h")).first()
    share = ids.filter(key_fraction(F.col("id"), 9) < 0.3).count() / 20000
    assert 0.28 < share < 0.32


def test_sample_and_folds_keep_clients_together(ledger):
    picked = flt.sample_rows(ledger, 0.5, 4)
    kept = {r.chid for r in picked.select("chid").distinct().collect()}
    assert picked.count() == ledger.filter(F.col("chid").isin(*kept)).count()
    folds = lab.row_folds(ledger.select("chid", "tag"), 4)
    assert folds.select("chid", "fold").distinct().groupBy("chid").count().filter("count > 1").count() == 0
    with pytest.raises(ValueError):
        lab.row_folds(ledger, 1)


def test_blend_identities(spark):
    store = spark.createDataFrame(
        [("m", v, c, t, (v * 7 + c * 3 + t) % 10 / 10) for v in (1, 2) for c in range(5) for t in (2, 3, 5)],
        "model string, version int, chid long, tag int, prob double",
    )
    one = rows_by(stk.blend(store, {("m", 1): 1.0}), "chid", "tag")
    assert all(one[r.chid, r.tag].prob == r.prob for r in store.filter("version = 1").collect())
    equal = rows_by(stk.blend(store, [("m", 1), ("m", 2)]), "chid", "tag")
    seeds = rows_by(stk.seed_average(store.withColumnRenamed("version", "seed")), "chid", "tag")
    assert all(equal[k].prob == pytest.approx(seeds[k].prob) for k in equal)


def test_ndcg_is_at_most_one_for_distinct_rankings(spark, ledger, spec):
    rng = np.random.default_rng(1)
    rows = [(c, *[int(x) for x in rng.permutation([2, 3, 5])]) for c in range(N_CLIENTS)]
    ranking = spark.createDataFrame(rows, "chid long, top1 int, top2 int, top3 int")
    scored = met.client_ndcg(ranking, ledger, spec, T).collect()
    assert scored and all(0 <= r.ndcg <= 1 + 1e-12 for r in scored)


def test_blend_search_equals_one_blend_at_a_time(spark, ledger, spec):
    from basketry.operators.ranking import rank_by_probability

    rng = np.random.default_rng(2)
    models = [("m", 1), ("m", 2)]
    rows = [("m", v, c, t, float(rng.integers(0, 5))) for v in (1, 2) for c in range(N_CLIENTS) for t in (2, 3, 5)]
    store = spark.createDataFrame(rows, "model string, version int, chid long, tag int, prob double")
    candidates = [[1.0, 0.0], [0.5, 0.5], [0.25, 0.75]]
    got = rows_by(stk.blend_search(store, ledger, spec, T, models, candidates), "candidate")
    for i, w in enumerate(candidates):
        mixed = stk.blend(store, dict(zip(models, w)))
        one = met.mean_ndcg(met.client_ndcg(rank_by_probability(mixed, spec), ledger, spec, T)).first()
        assert (got[i].n_clients, got[i].ndcg) == (one.n_clients, pytest.approx(one.ndcg))


def test_filled_limit(spark):
    profile = spark.createDataFrame([(1, 3, 50), (1, 5, 70), (2, 1, 9)], "chid long, dt int, lim long")
    got = rows_by(raw.filled_limit(profile, "lim", 6), "chid", "dt")
    assert [got[1, d].lim for d in range(1, 7)] == [0, 0, 50, 50, 70, 70]
    assert [got[2, d].lim for d in range(1, 7)] == [9] * 6


def test_temporal_folds():
    folds = lab.temporal_folds(3, 24)
    assert [(f.t_end_train, f.t_end_valid) for f in folds] == [(20, 21), (21, 22), (22, 23)]
    assert lab.temporal_folds(1, 24, train_override=5, valid_override=9)[0].t_end_valid == 9


def test_neighbours_do_not_depend_on_slices(spark, spec, monkeypatch):
    """Pools are dealt to slices of bounded size, and what a client is blended with stays the same."""
    rows = [(c, t, float((c * 37 + t * 11) % 23)) for c in range(240) for t in spec.items]
    vectors, clients = spark.createDataFrame(rows, "chid long, tag int, v double"), spark.range(240).selectExpr("id chid")

    def got(**how):
        out = nei.neighbor_blend(vectors, clients, spec, "v", 12, 3, 0.6, "cos", **how).collect()
        return {(r["chid"], r["tag"]): round(r["v"], 9) for r in out}

    whole, one_pool = got(n_pools=2), got(n_pools=1)
    assert got() == one_pool
    monkeypatch.setattr(nei, "POOL_CLIENTS", 20)
    assert got(n_pools=2) == whole
    assert got(n_pools=nei.pool_count(240, 12)) == got() != one_pool
    dealt = clients.withColumn("slices", nei.slice_count(clients, 2)).select(nei.pool_of(2).alias("p"), nei.slice_of(F.col("slices")).alias("s"))
    sizes = [r["count"] for r in dealt.groupBy("p", "s").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 40


@pytest.mark.parametrize("t_end", [61, 62, 63, 65, 124, 125, 130])
def test_ledgers_of_many_periods(make_ledger, make_clients, t_end):
    """Bought periods fill several words; toggles are counted across their borders."""
    spec = replace(SMALL, n_periods=130)
    rng = np.random.default_rng(t_end)
    bought = rng.random((6, 130)) < np.array([0.5, 0.05, 0.95, 0.5, 1.0, 0.02])[:, None]
    bought[3, 60:66] = bought[3, 122:127] = True
    bought[5, :] = False
    rows = [(int(c), int(d) + 1, 2) for c, d in zip(*np.nonzero(bought))]
    led, cli = make_ledger(rows), make_clients(range(6))
    names = ["gap_since_first", "gap_since_last", "avg_gap", "st_tgl", "made_ratio", "purch_t_end"]
    got = {r.chid: r for r in beh.behavior(led, cli, spec, t_end, names).collect() if r.tag == 2}
    maps = rows_by(pan.purchase_map(led, cli, spec, t_end, [2]), "chid", "dt")
    cfg = ds.DatasetConfig(t_end, behavior={"st_tgl": "leg", "made_ratio": "leg"}, labels=False)
    wide = rows_by(ds.build_features(led, led, cli, spec, cfg), "chid")
    for c in range(6):
        b = bought[c, :t_end]
        assert [maps[c, d + 1].bought for d in range(t_end)] == b.astype(int).tolist()
        pairs = list(zip(b[:-1], b[1:]))
        want = [sum(1 for p in pairs if p == (x, y)) for x in (False, True) for y in (False, True)]
        assert [got[c].n00, got[c].n01, got[c].n10, got[c].n11] == want
        assert [wide[c][f"{n}_tag2"] for n in beh.TOGGLES] == want
        assert got[c].made_ratio == pytest.approx(b.mean()) == wide[c].made_ratio_tag2
        periods = np.flatnonzero(b) + 1
        if len(periods):
            assert (got[c].gap_since_first, got[c].gap_since_last) == (t_end - periods[0], t_end - periods[-1])
        if len(periods) > 1:
            assert got[c].avg_gap == pytest.approx(np.mean(np.diff(periods) - 1))


@pytest.mark.parametrize(
    "values",
    [[0.1] * 7 + [1e15, -1e15, 0.3], [1e-9, 3e-9, 5e-9], [1e300, 2.0], [float("nan"), 1.0], [None, 2.5], [None, None]],
    ids=["cancelling", "tiny", "huge", "nan", "null", "nothing"],
)
def test_sums_do_not_depend_on_the_order(spark, values):
    frames = [spark.createDataFrame([(v,) for v in vs], "v double").repartition(n) for vs in (values, values[::-1]) for n in (1, 3)]
    got = [df.agg(exact_sum(F.col("v")).alias("s")).first().s for df in frames]
    known = [v for v in values if v is not None]
    if not known:
        assert got == [None] * 4
    elif values[0] == 0.1:
        assert got == [1.0] * 4
    else:
        assert got == pytest.approx([float(np.sum(known))] * 4, rel=1e-12, nan_ok=True)
