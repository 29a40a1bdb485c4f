"""Dataset assembly and trained models.  Trained models have no SQL side; tests check their properties."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.config import PSEUDO_ZERO, Decay
from basketry.operators import labels as lab
from basketry.operators import models as ml
from basketry.operators import stacking as stk
from basketry.operators.metrics import client_ndcg
from basketry.operators.ranking import rank_by_probability
from basketry.plans import dataset as ds
from basketry.plans.blocks import BlockStore
from basketry.plans import lifecycle as lc
from basketry.plans import training as tr
from basketry.session import scratch_path, written
from basketry.queries.base import MODELS, SPEC, T_END, TARGET, Tables, query, rounded

PSEUDO = PSEUDO_ZERO
TRAIN_END = T_END - 1


def sources(t: Tables, blocks: BlockStore | None = None) -> tr.Sources:
    return tr.Sources(t.priced, t.profile, t.clients, SPEC, blocks)


def block_store(t: Tables) -> BlockStore:
    """Blocks of the ledger with the amount in whole units."""
    return BlockStore(t.spark, f"{t.state}/priced", t.bucket_count)


CONFIG = ds.DatasetConfig(
    T_END,
    purchases={"freq": ds.PurchaseVector()},
    features={"amt": ds.FeatureVector("amt", imputed=PSEUDO), "cnt": ds.FeatureVector("txn_cnt")},
    behavior={"gap_since_last": "leg", "st_tgl": "leg", "made_ratio": "leg"},
    attributes=("nation", "region", "prio"),
    group_stats=(ds.GroupStat(("nation",), ("amt",), (6, 0), "leg", ("nanmean", "nanquantile_0.75")),),
    drop_cold_start=True,
)

_P13_PURCHASE = "sum(pow(0.5, (23 - dt) // 3) * pow(0.9, (23 - dt) % 3)) FILTER (dt >= 13)"
_P13_CELLS = {
    "freq": ("round(coalesce(max(freq) FILTER (tag = {x}), 0), 4)"),
    "amt": ("round(coalesce(max(amt_vec) FILTER (tag = {x}), " + str(PSEUDO) + " * 4.98), 4)"),
    "cnt": ("round(coalesce(max(cnt_vec) FILTER (tag = {x}), 0), 4)"),
    "gap_since_last": "CAST(coalesce(max(gap) FILTER (tag = {x}), 100) AS INTEGER)",
    "n00": "CAST(coalesce(max(22 - n01 - n10 - n11) FILTER (tag = {x}), 22) AS INTEGER)",
    "n01": "CAST(coalesce(max(n01) FILTER (tag = {x}), 0) AS INTEGER)",
    "n10": "CAST(coalesce(max(n10) FILTER (tag = {x}), 0) AS INTEGER)",
    "n11": "CAST(coalesce(max(n11) FILTER (tag = {x}), 0) AS INTEGER)",
    "made_ratio": "round(coalesce(max(ratio) FILTER (tag = {x}), 0), 4)",
}
_P13_SQL = ", ".join(sql.format(x=x) + f" AS {name}_tag{x}" for name, sql in _P13_CELLS.items() for x in SPEC.legit)


_P13_DATASET = f"""WITH st AS (SELECT *, lag(dt) OVER w AS prev, lead(dt) OVER w AS nxt FROM past WINDOW w AS (PARTITION BY chid, tag ORDER BY dt)),
        per AS (SELECT chid, tag, coalesce({_P13_PURCHASE}, 0) AS freq,
                  {PSEUDO} * 4.98 + coalesce(sum((amt_cents / CAST(100 AS DOUBLE) - {PSEUDO}) * pow(0.5, (23 - dt) // 3) * pow(0.9, (23 - dt) % 3)) FILTER (dt >= 13 AND amt_cents <> 0), 0) AS amt_vec,
                  coalesce(sum(txn_cnt * pow(0.5, (23 - dt) // 3) * pow(0.9, (23 - dt) % 3)) FILTER (dt >= 13), 0) AS cnt_vec,
                  23 - max(dt) AS gap, count(*) / CAST(23 AS DOUBLE) AS ratio,
                  count(*) FILTER (nxt = dt + 1) AS n11, count(*) FILTER (dt < 23 AND (nxt IS NULL OR nxt > dt + 1)) AS n10,
                  count(*) FILTER (dt > 1 AND (prev IS NULL OR prev < dt - 1)) AS n01
                FROM st GROUP BY 1, 2),
        f AS (SELECT chid, {_P13_SQL} FROM clients LEFT JOIN per USING (chid) GROUP BY chid),
        latest AS (SELECT chid, nation, region, prio FROM (SELECT *, row_number() OVER (PARTITION BY chid ORDER BY dt DESC) AS rn FROM profile WHERE dt <= 23) WHERE rn = 1),
        gs AS (SELECT nation, avg(amt) AS g1, quantile_cont(amt, 0.75) AS g2 FROM wide WHERE dt BETWEEN 18 AND 23 AND tag IN (SELECT tag FROM leg) GROUP BY nation)
        SELECT f.*, latest.nation AS nation, latest.region AS region, latest.prio AS prio, round(g1, 4) AS g0_amt_nanmean, round(g2, 4) AS g0_amt_nanquantile_0_75, label
        FROM target_labels JOIN warm USING (chid) JOIN f USING (chid) JOIN latest USING (chid) JOIN gs ON gs.nation = latest.nation"""


@query("p13_dataset", _P13_DATASET)
def dataset(t: Tables) -> DataFrame:
    """The whole training set of one fold as one plan."""
    return rounded(ds.build_dataset(t.priced, t.profile, t.clients, SPEC, CONFIG), 4)


@query("p13_block_dataset", _P13_DATASET)
def block_dataset(t: Tables) -> DataFrame:
    """The same training set joined from blocks that are written once per state of the sources."""
    return rounded(ds.build_dataset(t.priced, t.profile, t.clients, SPEC, CONFIG, blocks=block_store(t)), 4)


@query("p13_all_blocks")
def all_blocks(t: Tables) -> DataFrame:
    """Every kind of feature block at once, with neighbours, variants and per-attribute statistics."""
    near = {"n_candidates": 100, "k": 10, "alpha": 0.9, "n_pools": 2}
    cfg = ds.DatasetConfig(
        T_END,
        raw={"txn_cnt": ((2, 0), "leg")},
        purchases={"freq": ds.PurchaseVector(), "near": ds.PurchaseVector(neighbors=near)},
        features={
            "amt": ds.FeatureVector("amt", imputed=PSEUDO),
            "amt6": ds.FeatureVector("amt", Decay(6), PSEUDO),
            "amt18": ds.FeatureVector("amt", Decay(18), PSEUDO),
            "amtn": ds.FeatureVector("amt", imputed=PSEUDO, neighbors={**near, "k": None}),
        },
        variant_stats={"amt+amt6+amt18": ("mean", "std", "skew")},
        behavior={n: "leg" for n in ("gap_since_first", "gap_since_last", "avg_gap", "st_tgl", "made_ratio", "n_shop_tags", "purch_t_end")},
        attributes=("nation", "region"),
        group_stats=(ds.GroupStat("each", ("amt", "txn_cnt"), (6, 0), "leg", ("nanmean", "nanmedian", "nanstd")),),
        labels=False,
    )
    return rounded(ds.build_dataset(t.priced, t.profile, t.clients, SPEC, cfg), 4)


def _base(t_end: int) -> ds.DatasetConfig:
    return ds.model_config(t_end)


def _scored(predictions: DataFrame) -> DataFrame:
    return rounded(predictions.select("chid", "tag", "label", "prob"))


@query("p01_train_models")
def train_models(t: Tables) -> DataFrame:
    """Regression, forest and boosted trees trained on one fold, with the rounds that serve the next period best, and
    scored on it.
    """
    src = sources(t, block_store(t))
    data = tr.weighted_dataset(src, _base(TRAIN_END), "amt")
    valid = tr.weighted_dataset(src, _base(T_END), "amt")
    out = None
    tries = {"lr": {"steps": (2, 4, 8, 16)}, "rf": {"rounds": 12}, "gbt": {"rounds": 4, "depth": 3}}
    for algorithm, params in tries.items():
        fitted = {}
        rounds = ml.best_rounds(ml.validation_curve(data, valid, SPEC, algorithm, fitted=fitted, **params))
        # the curve has trained on the same rows: only a number of rounds it did not train is trained here
        if (model := fitted.get(rounds)) is None:
            size = {"trees" if algorithm == "rf" else "rounds": rounds}
            model = ml.train(data, SPEC, algorithm, weight="weight", **size, **{k: v for k, v in params.items() if k == "depth"})
        ndcg = tr.evaluate(src, tr.predict_clients(src, model, _base(T_END)), TARGET)
        row = ndcg.agg(F.count("*").alias("n_clients"), F.avg("ndcg").alias("ndcg")).select(
            F.lit(algorithm).alias("algorithm"), F.lit(rounds).alias("rounds"), "n_clients", "ndcg"
        )
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("p02_predictions")
def predictions(t: Tables) -> DataFrame:
    """Long probabilities of all clients for the validation period."""
    src = sources(t)
    model = tr.train_model(src, _base(TRAIN_END), "amt")
    return _scored(tr.predict_clients(src, model, _base(T_END)))


@query("p03_production_ranking")
def production(t: Tables) -> DataFrame:
    """Ranking of every client for the period after the last complete one."""
    src = sources(t)
    model = tr.train_model(src, _base(T_END), "amt")
    return rank_by_probability(tr.predict_clients(src, model, _base(T_END + 1)), SPEC)


@query("p06_out_of_fold")
def out_of_fold(t: Tables) -> DataFrame:
    """Stacker: out-of-fold probabilities over three client folds, weighted, with cross-validated rounds."""
    oof, _ = lc.train_stacker(sources(t), t.predictions, MODELS, T_END, "amt", folds=3, seeds=(), steps=(2, 4, 8))
    return _scored(oof)


@query("p07_refit_average")
def refit_average(t: Tables) -> DataFrame:
    """Stacker refitted with every seed on all rows, predictions averaged; rounds by cross-validation, scaled up."""
    src, store = sources(t), t.predictions
    _, refits = lc.train_stacker(src, store, MODELS, T_END, "amt", folds=5, algorithm="rf", rounds=8, depth=4)
    return rounded(lc.predict_stacker(src, refits, store, MODELS))


@query("p10_feature_importance")
def feature_importance(t: Tables) -> DataFrame:
    src = sources(t)
    model = tr.train_model(src, _base(TRAIN_END), "amt", "rf", trees=10)
    return rounded(ml.importance_table(model, t.ledger))


@query("p11_multi_label")
def multi_label(t: Tables) -> DataFrame:
    """One regression per label on the multi-hot target, trained on out-of-fold predictions, for all clients."""
    src = sources(t)
    rows = lc.stacker_rows(src, t.predictions, MODELS, T_END, "amt")
    features = ml.feature_columns(rows)
    # a client counts by the mean weight of its labels
    clients = rows.groupBy("chid").agg(*[F.first(f).alias(f) for f in features], F.avg("weight").alias("weight"))
    hot = lab.multi_hot(lab.label_rows(t.ledger, SPEC, T_END), len(SPEC.legit))
    models = ml.train_multi_label(clients.join(hot, "chid"), SPEC, features, rounds=10, weight="weight")
    unseen = stk.meta_dataset(t.predictions.filter(F.col("split") == "unseen"), SPEC, MODELS)
    return _scored(ml.predict_multi_label(models, unseen, SPEC))


@query("p12_sweep")
def sweep(t: Tables) -> DataFrame:
    """Feature sets x all algorithms, scored on the next period; every block is built once."""
    sets = {
        "vectors": replace(_base(TRAIN_END), behavior={}),
        "behavior": replace(_base(TRAIN_END), purchases={}, features={}),
    }
    algorithms = {"lr": {"rounds": 10}, "rf": {"trees": 10}, "gbt": {"rounds": 3, "depth": 3}}
    return rounded(tr.sweep(sources(t, block_store(t)), sets, algorithms, "amt"))


@query("m12_reevaluation")
def reevaluation(t: Tables) -> DataFrame:
    """Two models, stored and loaded again, scored on the complete client set, client by client."""
    src, root = sources(t), scratch_path(t.spark, "models")
    for name, cold in (("all_clients", False), ("warm_clients", True)):
        model = tr.train_model(src, replace(_base(TRAIN_END), drop_cold_start=cold), "amt")
        ml.save_model(model, root, name, 1, TRAIN_END)
    models = {name: ml.load_model(root, name, 1, TRAIN_END) for name in ("all_clients", "warm_clients")}
    return rounded(tr.reevaluate(src, models, _base(T_END)))


@query("p01_temporal_folds")
def temporal_cv(t: Tables) -> DataFrame:
    """One model per temporal fold, scored on the fold's validation period."""
    folds = lab.temporal_folds(2, TARGET)
    return rounded(lc.cross_validate(sources(t), _base, folds, "amt", rounds=10))


@query("p08_stacker_and_blend")
def stacker_and_blend(t: Tables) -> DataFrame:
    """Base predictions to a stacker, its predictions into the store, and a blend of both ranked."""
    src, models = sources(t), MODELS
    store = written(t.predictions, "store")
    oof, refits = lc.train_stacker(src, store, models, T_END, "amt", folds=2, steps=(2, 4, 8))
    unseen = lc.predict_stacker(src, refits, store, models)
    stacked = lc.store_rows(oof, "meta", 1, "oof").unionByName(lc.store_rows(unseen, "meta", 1, "unseen"))
    ranking, _ = lc.blend_and_score(src, store.unionByName(stacked), [*models, ("meta", 1)], TARGET)
    return ranking
