"""Labels, eligible clients, temporal and row folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.config import LedgerSpec
from basketry.functions.hashing import key_hash
from basketry.operators.filters import label_index


def bought_at(ledger: DataFrame, spec: LedgerSpec, t: int, legit_only: bool = True) -> DataFrame:
    """Label rows (chid, tag, label) of one period: one row per item bought."""
    rows = ledger.filter(F.col("dt") == t).select("chid", "tag")
    return label_index(rows, spec, legit_only)


def multiclass_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features RIGHT JOIN labels on chid, incomplete rows dropped: a client repeats once per bought item."""
    joined = features.join(labels.select("chid", "label"), "chid", "right")
    return joined.na.drop("any")


def binary_labels(rows: DataFrame, ledger: DataFrame, t: int) -> DataFrame:
    """(chid, tag) rows with ``bought`` 1/0 in period t."""
    hits = ledger.filter(F.col("dt") == t).select("chid", "tag", F.lit(1).alias("_hit"))
    return rows.join(hits, ["chid", "tag"], "left").withColumn("bought", F.coalesce("_hit", F.lit(0))).drop("_hit")


def warm_clients(ledger: DataFrame, spec: LedgerSpec, t_end: int, tolerance: int = 6) -> DataFrame:
    """Clients active in the target period whose first active period is not within the last ``tolerance`` periods.

    Legit items only.  First period and presence come from one aggregate.
    """
    target = t_end + spec.horizon
    rows = ledger.filter(F.col("tag").isin(*spec.legit))
    per_client = rows.groupBy("chid").agg(F.min("dt").alias("first"), F.max(F.col("dt") == target).alias("here"))
    joined_late = F.col("first").between(t_end - tolerance + 1, target)
    return per_client.filter(F.col("here") & ~joined_late).select("chid")


def eligible_clients(
    ledger: DataFrame,
    spec: LedgerSpec,
    t_end: int,
    drop_cold_start: bool = True,
    tolerance: int = 6,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """Clients allowed in the training labels: warm ones, minus a block-list."""
    out = warm_clients(ledger, spec, t_end, tolerance) if drop_cold_start else ledger.select("chid").distinct()
    return out if blocked is None else out.join(blocked.select("chid"), "chid", "left_anti")


def label_rows(
    ledger: DataFrame,
    spec: LedgerSpec,
    t_end: int,
    eligible: DataFrame | None = None,
    legit_only: bool = True,
) -> DataFrame:
    """Multi-class label rows (chid, tag, label) of period t_end + horizon."""
    rows = bought_at(ledger, spec, t_end + spec.horizon, legit_only)
    return rows if eligible is None else rows.join(eligible, "chid", "left_semi")


def multi_hot(labels: DataFrame, n_labels: int) -> DataFrame:
    """One row per client with an array of 0/1 per label, of any number of labels."""
    held = labels.groupBy("chid").agg(F.collect_set("label").alias("_s"))  # at most n_labels values
    hot = F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: F.array_contains("_s", i).cast("int"))
    return held.select("chid", hot.alias("hot"))


@dataclass(frozen=True)
class TemporalFold:
    fold: int
    t_end_train: int
    t_end_valid: int


def temporal_folds(
    n_folds: int, last: int, horizon: int = 1, train_override: int | None = None, valid_override: int | None = None
) -> list[TemporalFold]:
    """Folds that move the training end forward one period at a time; validation follows one period later."""
    if n_folds < 1:
        raise ValueError("at least one fold")
    out = []
    for fold in range(n_folds):
        train = last - n_folds - horizon + fold if train_override is None else train_override
        out.append(TemporalFold(fold, train, train + 1 if valid_override is None else valid_override))
    return out


def fold_table(spark: SparkSession, spec: LedgerSpec, folds: Sequence[TemporalFold]) -> DataFrame:
    """Target periods of the folds: (dt, fold, split, t_end), two rows per fold."""
    rows = [
        (t_end + spec.horizon, f.fold, split, t_end)
        for f in folds
        for split, t_end in (("train", f.t_end_train), ("valid", f.t_end_valid))
    ]
    return spark.createDataFrame(rows, "dt int, fold int, split string, t_end int")


def fold_label_rows(ledger: DataFrame, spec: LedgerSpec, folds: Sequence[TemporalFold] | DataFrame) -> DataFrame:
    """Label rows of all folds at once: each row of a target period is repeated for the folds that use it.

    ``folds`` may be a table as of :func:`fold_table`.  Of a ledger partitioned by period only the periods of the table are
    read: its rows are two per fold, so they are sent to all tasks, and Spark prunes by them at run time.
    """
    table = folds if isinstance(folds, DataFrame) else fold_table(ledger.sparkSession, spec, folds)
    # Spark prunes by a joined table only where that table is filtered itself
    table = table.select("dt", "fold", "split", "t_end").filter("fold >= 0")
    rows = ledger.filter(F.col("tag").isin(*spec.legit)).select("chid", "tag", "dt")
    return rows.join(F.broadcast(table), "dt").select("fold", "split", "t_end", "dt", "chid", "tag")


#: apart from each other for all items below it
ROW_KEY_STEP = 1 << 31


def row_folds(df: DataFrame, k: int, seed: int = 168, by_client: bool = True) -> DataFrame:
    """Shuffled fold number from a key hash.  By client, so no client sits on both sides; by row on request."""
    if k < 2:
        raise ValueError("at least two folds")
    key = F.col("chid") if by_client else F.col("chid") * F.lit(ROW_KEY_STEP) + F.col("tag")
    return df.withColumn("fold", F.pmod(key_hash(key, seed), F.lit(k)).cast("int"))
