"""Top-3 rankings per client.

A client has at most one row per item, so ranking windows partitioned by client are bounded by the item dictionary.
Every order is total: score first, then item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.config import TOP_N, LedgerSpec
from basketry.operators.descriptive import mean_amounts, mean_items_per_period, popularity, total_amounts
from basketry.operators.filters import label_index

TOPS = tuple(f"top{i}" for i in range(1, TOP_N + 1))


def top_items(rows: DataFrame, order: Sequence[Column], value: str = "tag", by: Sequence[str] = ()) -> DataFrame:
    """First three rows per client (and ``by``) in the given order, as (chid, top1, top2, top3)."""
    rank = F.row_number().over(Window.partitionBy("chid", *by).orderBy(*order))
    kept = rows.withColumn("_r", rank).filter(F.col("_r") <= TOP_N)
    return kept.groupBy("chid", *by).agg(
        *[F.max(F.when(F.col("_r") == i, F.col(value))).alias(name) for i, name in enumerate(TOPS, 1)]
    )


def rank_by_probability(predictions: DataFrame, spec: LedgerSpec, prob: str = "prob") -> DataFrame:
    """Top items by probability; ties go to the higher label index."""
    indexed = predictions if "label" in predictions.columns else label_index(predictions, spec)
    return top_items(indexed, [F.col(prob).desc(), F.col("label").desc()])


def popular_items(ledger: DataFrame) -> Column:
    """The three items most clients bought, as one array: a scalar subquery over at most one row per item."""
    ranked = popularity(ledger).agg(F.array_sort(F.collect_list(F.struct((-F.col("n_clients")).alias("n"), "tag"))).alias("a"))
    return ranked.select(F.transform(F.slice("a", 1, TOP_N), lambda s: s["tag"])).scalar()


def rank_by_amount(ledger: DataFrame, clients: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Top items by total amount; short rankings repeat their last item, clients without history get the popular items."""
    legit = ledger.filter(F.col("tag").isin(*spec.legit))
    tops = top_items(total_amounts(legit, spec.amount), [F.col("total").desc(), F.col("tag")])
    top1, top2, top3 = (F.col(c) for c in TOPS)
    # the popular items are found once, not once for every place
    ranked = clients.join(tops, "chid", "left").withColumn("_p", F.when(top1.isNull(), popular_items(legit)))
    none = top1.isNull()
    return ranked.select(
        "chid",
        F.coalesce(top1, F.get("_p", F.lit(0))).alias("top1"),
        F.when(none, F.get("_p", F.lit(1))).otherwise(F.coalesce(top2, top1)).alias("top2"),
        F.when(none, F.get("_p", F.lit(2))).otherwise(F.coalesce(top3, top2, top1)).alias("top3"),
    )


def weighted_ratings(ledger: DataFrame, amount: str, scale: float = 1.0, q: float = 0.8) -> DataFrame:
    """Weighted rating per item ``v/(v+m) * R + m/(m+v) * C`` for the items with v >= m.

    v counts rows, R is the mean amount, m the q-quantile of v, C the mean of R; all over one row per item.
    """
    items = ledger.groupBy("tag").agg(F.count("*").alias("v"), (F.avg(amount) / F.lit(scale)).alias("r"))
    base = items.agg(F.struct(F.percentile("v", F.lit(q)).alias("m"), F.avg("r").alias("c")).alias("b")).scalar()
    m, c, v, r = base.getField("m"), base.getField("c"), F.col("v"), F.col("r")
    return items.filter(v >= m).select("tag", "v", "r", (v / (v + m) * r + m / (m + v) * c).alias("rating"))


def rank_by_rating(ledger: DataFrame, clients: DataFrame, spec: LedgerSpec, scale: float = 1.0) -> DataFrame:
    """The same three best-rated legit items for every client."""
    rated = weighted_ratings(ledger, spec.amount, scale).filter(F.col("tag").isin(*spec.legit))
    ordered = rated.agg(F.array_sort(F.collect_list(F.struct((-F.col("rating")).alias("n"), "tag"))).alias("a"))
    best = ordered.select(F.transform("a", lambda s: s["tag"])).scalar()
    return clients.select("chid", *[F.get(best, F.lit(i)).alias(c) for i, c in enumerate(TOPS)])


def rank_by_vector(
    vectors: DataFrame,
    ledger: DataFrame,
    clients: DataFrame,
    spec: LedgerSpec,
    value: str,
    start: int,
    stop: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rank by a predicted item vector over all items, one ranking per client and ``by``.

    k is the client's mean number of items per active period in [start, stop), rounded half to even.  The k best items
    come first, by mean amount; the others follow by score.  Only legit items are returned.
    """
    k = mean_items_per_period(ledger, clients, start, stop).select("chid", F.bround("mean_items").alias("_k"))
    amounts = mean_amounts(ledger, start, stop, spec.amount)
    score_rank = F.row_number().over(Window.partitionBy("chid", *by).orderBy(F.col(value).desc(), F.col("tag").desc()))
    ranked = vectors.select("chid", *by, "tag", score_rank.alias("_rank"))
    rows = ranked.join(k, "chid").join(amounts, ["chid", "tag"], "left")
    late = F.col("_rank") > F.col("_k")
    amount = F.when(~late, F.coalesce("mean_amt", F.lit(0.0)))
    return top_items(
        rows.filter(F.col("tag").isin(*spec.legit)), [late, amount.desc_nulls_last(), F.col("_rank")], by=by
    )


def truth_amounts(ledger: DataFrame, spec: LedgerSpec, t: int) -> DataFrame:
    """Three largest legit amounts per client in period t: (chid, amt1, amt2, amt3), zero where fewer."""
    rows = ledger.filter((F.col("dt") == t) & F.col("tag").isin(*spec.legit))
    best = F.slice(F.sort_array(F.collect_list(spec.amount), asc=False), 1, TOP_N)
    return (
        rows.groupBy("chid")
        .agg(best.alias("_b"))
        .select(
            "chid", *[F.coalesce(F.get("_b", F.lit(i)), F.lit(0)).alias(f"amt{i + 1}") for i in range(TOP_N)]
        )
    )


def complete_ranking(ranking: DataFrame, targets: DataFrame, fallback: Column) -> DataFrame:
    """Every target client has a row: missing rankings take the fallback items (an array of three)."""
    return targets.join(ranking, "chid", "left").select(
        "chid", *[F.coalesce(F.col(c), F.get(fallback, F.lit(i))).alias(c) for i, c in enumerate(TOPS)]
    )
