"""Sample weights: a client's usual amount on the label item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.config import PSEUDO_ZERO, LedgerSpec
from basketry.functions.quantiles import exact_quantiles

IMPUTATIONS = ("median", "mean", "denoise", "pseudo_zero")


def mean_weights(ledger: DataFrame, t_end: int, amount: str, scale: float = 1.0) -> DataFrame:
    """Mean amount per (client, item) up to t_end."""
    return (
        ledger.filter(F.col("dt") <= t_end)
        .groupBy("chid", "tag")
        .agg((F.avg(amount) / F.lit(scale)).alias("weight"))
    )


def active_weights(ledger: DataFrame, spec: LedgerSpec, t_end: int, amount: str, scale: float = 1.0) -> DataFrame:
    """Mean weights RIGHT JOIN the clients active in the target period; clients without history keep a null row.

    One pass over the ledger: past cells and presence come from one aggregate, and a client's cells, at most one per
    item, from one window.
    """
    target = t_end + spec.horizon
    past, here = F.col("dt") <= t_end, F.col("dt") == target
    cells = (
        ledger.filter(past | here)
        .groupBy("chid", "tag")
        .agg(
            (F.avg(F.when(past, F.col(amount))) / F.lit(scale)).alias("weight"),
            F.max(past).alias("_past"),
            F.max(here).alias("_here"),
        )
    )
    own = Window.partitionBy("chid")
    cells = cells.withColumns(
        {
            "_active": F.max("_here").over(own),
            "_known": F.max("_past").over(own),
            "_first": F.min("tag").over(own) == F.col("tag"),
        }
    )
    kept = cells.filter(F.col("_active") & (F.col("_past") | (~F.col("_known") & F.col("_first"))))
    return kept.select("chid", F.when(F.col("_past"), F.col("tag")).alias("tag"), "weight")


def item_imputation(weights: DataFrame, method: str) -> DataFrame:
    """Per item the value of a missing cell: (tag, fill).  At most one row per item."""
    rows = weights.na.drop("any")
    if method == "mean":
        return rows.groupBy("tag").agg(F.avg("weight").alias("fill"))
    if method in ("median", "denoise"):
        return exact_quantiles(rows, ["tag"], "weight", {"fill": 0.5 if method == "median" else 0.25})
    raise ValueError(f"imputation is one of {IMPUTATIONS}")


def label_weights(
    labels: DataFrame,
    weights: DataFrame,
    imputation: str = "denoise",
    scale_method: str = "max",
) -> DataFrame:
    """Weight of each label row: own mean amount or the item's fill, divided by the client's largest, exponentiated.

    Returns (chid, tag, label, raw, scaled, weight).
    """
    if scale_method != "max":
        raise ValueError("scaling is by max")
    cells = weights.na.drop("any")
    rows = labels.join(cells, ["chid", "tag"], "left")
    if imputation == "pseudo_zero":
        rows = rows.withColumn("fill", F.lit(PSEUDO_ZERO))
    else:
        rows = rows.join(F.broadcast(item_imputation(weights, imputation)), "tag", "left")
    rows = rows.withColumn("raw", F.coalesce("weight", "fill")).drop("weight", "fill")
    top = F.max("raw").over(Window.partitionBy("chid"))
    rows = rows.withColumn("scaled", F.try_divide(F.col("raw"), top))
    return rows.select("chid", "tag", "label", "raw", "scaled", F.exp("scaled").alias("weight"))


def class_weights(labels: DataFrame) -> DataFrame:
    """Balanced class weight n / (k * n_class) per label."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n_class"))
    total = counts.agg((F.sum("n_class") / F.count("*")).alias("t")).scalar()
    return counts.select("label", "n_class", (total / F.col("n_class")).alias("class_weight"))
