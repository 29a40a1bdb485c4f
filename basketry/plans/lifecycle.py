"""From folds to blends: base models, stackers and blends over one prediction store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import models as ml
from basketry.operators import stacking as stk
from basketry.operators.labels import TemporalFold, label_rows, row_folds
from basketry.operators.metrics import client_ndcg, mean_ndcg
from basketry.operators.ranking import rank_by_probability
from basketry.operators.weights import active_weights, label_weights
from basketry.plans.dataset import DatasetConfig
from basketry.plans.training import Sources, evaluate, predict_clients, train_model
from basketry.session import written

STORE_COLUMNS = ("model", "version", "split", "chid", "tag", "prob")


def store_rows(predictions: DataFrame, model: str, version: int, split: str) -> DataFrame:
    """Predictions in the shape of the prediction store."""
    keyed = predictions.select(
        F.lit(model).alias("model"), F.lit(version).alias("version"), F.lit(split).alias("split"), "chid", "tag", "prob"
    )
    return keyed.select(*STORE_COLUMNS)


def cross_validate(
    src: Sources,
    config: Callable[[int], DatasetConfig],
    folds: Sequence[TemporalFold],
    amount: str,
    algorithm: str = "lr",
    **params,
) -> DataFrame:
    """One base model per temporal fold, scored on the fold's validation period; one row per fold."""
    parts = []
    for f in folds:
        model = train_model(src, config(f.t_end_train), amount, algorithm, **params)
        valid = predict_clients(src, model, config(f.t_end_valid))
        score = mean_ndcg(evaluate(src, valid, f.t_end_valid + src.spec.horizon))
        parts.append(
            score.select(
                F.lit(f.fold).alias("fold"), F.lit(f.t_end_train).alias("t_end_train"), "n_clients", "ndcg"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stacker_rows(
    src: Sources,
    store: DataFrame,
    models: Sequence[stk.Model],
    t_end: int,
    amount: str,
    folds: int = 5,
    features: DataFrame | None = None,
) -> DataFrame:
    """The base models' out-of-fold predictions with the labels and weights of the target period and a fold by client,
    written once.
    """
    labels = label_rows(src.ledger, src.spec, t_end)
    weights = label_weights(labels, active_weights(src.ledger, src.spec, t_end, amount)).select(
        "chid", "label", F.coalesce("weight", F.lit(1.0)).alias("weight")
    )
    meta = stk.meta_dataset(store.filter(F.col("split") == "oof"), src.spec, models, labels, features)
    return written(row_folds(meta.join(weights, ["chid", "label"]), folds), "stacker")


def train_stacker(
    src: Sources,
    store: DataFrame,
    models: Sequence[stk.Model],
    t_end: int,
    amount: str,
    folds: int = 5,
    algorithm: str = "lr",
    seeds: Sequence[int] = ml.SEEDS,
    features: DataFrame | None = None,
    rounds: int = 20,
    steps: Sequence[int] | None = None,
    **params,
) -> tuple[DataFrame, list[PipelineModel]]:
    """Out-of-fold predictions of a stacker and its refits on all rows, one per seed.

    The rounds, ``rounds`` at most, are those with the least mean loss over the folds; a refit has more rows, and takes
    more rounds in proportion.
    """
    meta = stacker_rows(src, store, models, t_end, amount, folds, features)
    chosen = {} if algorithm != "lr" else {"steps": steps}
    best = ml.cross_validated_rounds(meta, src.spec, folds, algorithm, rounds=rounds, **chosen, **params)
    size = "trees" if algorithm == "rf" else "rounds"

    def fit(rows: DataFrame, n: int, seed: int = ml.SEEDS[0]) -> PipelineModel:
        return ml.train(rows.drop("fold"), src.spec, algorithm, weight="weight", seed=seed, **{size: n}, **params)

    oof = ml.out_of_fold(meta, src.spec, folds, lambda rows: fit(rows, best))
    return oof, [fit(meta, ml.final_rounds(best, folds), s) for s in seeds]


def predict_stacker(
    src: Sources,
    refits: Sequence[PipelineModel],
    store: DataFrame,
    models: Sequence[stk.Model],
    features: DataFrame | None = None,
) -> DataFrame:
    """Mean prediction of the refits on the base models' unseen predictions."""
    meta = stk.meta_dataset(store.filter(F.col("split") == "unseen"), src.spec, models, features=features)
    parts = [ml.predict(m, meta, src.spec).withColumn("seed", F.lit(i)) for i, m in enumerate(refits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stk.seed_average(out)


def blend_and_score(
    src: Sources, store: DataFrame, weights: dict[stk.Model, float] | Sequence[stk.Model], t: int
) -> tuple[DataFrame, DataFrame]:
    """Ranking of the blended unseen predictions, and the mean NDCG of the same blend out of fold at period t."""
    oof = stk.blend(store.filter(F.col("split") == "oof"), weights)
    unseen = stk.blend(store.filter(F.col("split") == "unseen"), weights)
    score = mean_ndcg(client_ndcg(rank_by_probability(oof, src.spec), src.ledger, src.spec, t))
    return rank_by_probability(unseen, src.spec), score
