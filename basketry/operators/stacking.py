"""Meta-datasets, seed averages and blends over the prediction store.

Predictions are long: (model, version, split, chid, tag, prob).  Everything is matched by key, never by row position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.config import TOP_N, LedgerSpec
from basketry.operators.metrics import DISCOUNTS, client_actuals

Model = tuple[str, int]


def model_name(model: Model) -> str:
    return f"{model[0]}{model[1]}"


def is_model(model: Model) -> Column:
    return (F.col("model") == model[0]) & (F.col("version") == model[1])


def prediction_matrix(store: DataFrame, spec: LedgerSpec, models: Sequence[Model]) -> DataFrame:
    """One row per client that every model predicted, one column per model and legit item."""
    width = max(spec.items) + 1
    position = F.lit(None).cast("int")
    for i, m in enumerate(models):
        position = F.when(is_model(m), F.lit(i)).otherwise(position)
    keyed = store.filter(F.col("tag").isin(*spec.legit)).select(
        "chid", (position * width + F.col("tag")).alias("_cell"), "prob"
    )
    cells = {i * width + tag: f"{model_name(m)}_tag{tag}" for i, m in enumerate(models) for tag in spec.legit}
    wide = keyed.na.drop("any", subset=["_cell"]).groupBy("chid").pivot("_cell", list(cells)).agg(F.max("prob"))
    named = wide.selectExpr("chid", *[f"`{key}` AS `{name}`" for key, name in cells.items()])
    for m in models:
        seen = [f"{model_name(m)}_tag{tag}" for tag in spec.legit]
        named = named.filter(F.coalesce(*seen).isNotNull())
    return named


def restack(meta: DataFrame, features: DataFrame) -> DataFrame:
    """Raw features next to predictions; of a client with several feature rows the least one counts."""
    right = features.drop("label", "tag")
    values = [c for c in right.columns if c != "chid"]
    if not values:
        return meta
    right = right.groupBy("chid").agg(F.min(F.struct(*values)).alias("_f")).select("chid", "_f.*")
    return meta.join(right, "chid", "left")


def meta_dataset(
    store: DataFrame,
    spec: LedgerSpec,
    models: Sequence[Model],
    labels: DataFrame | None = None,
    features: DataFrame | None = None,
) -> DataFrame:
    """Predictions of all models side by side, with label rows for out-of-fold data, with raw features on request."""
    meta = prediction_matrix(store, spec, models)
    if features is not None:
        meta = restack(meta, features)
    return meta if labels is None else meta.join(labels.select("chid", "label"), "chid")


def blend(store: DataFrame, weights: dict[Model, float] | Sequence[Model]) -> DataFrame:
    """Weighted sum of probabilities per (chid, tag); equal weights for a plain list.  Weights need not sum to 1."""
    if not isinstance(weights, dict):
        weights = {m: 1.0 / len(weights) for m in weights}
    weight = F.lit(None).cast("double")
    for m, w in weights.items():
        weight = F.when(is_model(m), F.lit(float(w))).otherwise(weight)
    rows = store.withColumn("_w", weight).filter(F.col("_w").isNotNull())
    return rows.groupBy("chid", "tag").agg(F.sum(F.col("_w") * F.col("prob")).alias("prob"))


def seed_average(predictions: DataFrame) -> DataFrame:
    """Mean probability over refits (column ``seed``) per (chid, tag)."""
    return predictions.groupBy("chid", "tag").agg(F.avg("prob").alias("prob"))


def blend_search(
    store: DataFrame,
    ledger: DataFrame,
    spec: LedgerSpec,
    t: int,
    models: Sequence[Model],
    candidates: Sequence[Sequence[float]],
) -> DataFrame:
    """NDCG@3 of every candidate weight vector, in one job.

    Each client becomes one row with its items (at most the legit ones) and all model probabilities.  The candidates
    are opened on that row after the only shuffle, so the data is not multiplied on the network.
    """
    prob = [F.max(F.when(is_model(m), F.col("prob"))).alias(f"p{i}") for i, m in enumerate(models)]
    cells = store.filter(F.col("tag").isin(*spec.legit)).groupBy("chid", "tag").agg(*prob)
    probs = F.array(*[F.coalesce(f"p{i}", F.lit(0.0)) for i in range(len(models))])
    packed = cells.groupBy("chid").agg(F.collect_list(F.struct("tag", probs.alias("p"))).alias("items"))
    actual = client_actuals(ledger, spec, t).filter(F.col("ideal") > 0)
    rows = packed.join(actual, "chid")
    options = F.array(
        *[
            F.struct(F.lit(i).alias("candidate"), F.array(*[F.lit(float(w)) for w in ws]).alias("w"))
            for i, ws in enumerate(candidates)
        ]
    )
    opened = rows.select("items", "amounts", "ideal", F.explode(options).alias("o"))

    def score(item: Column) -> Column:
        parts = [F.get(item["p"], F.lit(i)) * F.get(F.col("o.w"), F.lit(i)) for i in range(len(models))]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        # label order follows item order, so the higher item wins a tie
        return F.struct(total.alias("s"), item["tag"].alias("tag"))

    best = F.slice(F.sort_array(F.transform("items", score), asc=False), 1, TOP_N)
    gains = opened.select("o.candidate", "amounts", "ideal", best.alias("best"))
    gain = F.lit(0.0)
    for i, d in enumerate(DISCOUNTS):
        tag = F.get("best", F.lit(i))["tag"]
        gain = gain + F.coalesce(F.try_element_at("amounts", tag), F.lit(0.0)) / F.lit(d)
    return (
        gains.select("candidate", (gain / F.col("ideal")).alias("ndcg"))
        .groupBy("candidate")
        .agg(F.count("*").alias("n_clients"), F.avg("ndcg").alias("ndcg"))
    )
