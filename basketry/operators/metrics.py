"""Amount-weighted NDCG@3, binary metrics and the analysis tables built on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.config import NEVER, TOP_N, LedgerSpec
from basketry.operators.ranking import TOPS

DISCOUNTS = [log2(r + 1) for r in range(1, TOP_N + 1)]


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _gain(amounts: Sequence[Column]) -> Column:
    return _sum([a / F.lit(d) for a, d in zip(amounts, DISCOUNTS)])


def client_actuals(ledger: DataFrame, spec: LedgerSpec, t: int) -> DataFrame:
    """Per client of period t: its amounts by item, and the ideal gain of its three largest legit amounts.

    One row per client; a map holds at most the item dictionary.
    """
    amount = F.col(spec.amount).cast("double")
    legit = F.when(F.col("tag").isin(*spec.legit), amount)
    packed = (
        ledger.filter(F.col("dt") == t)
        .groupBy("chid")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("tag", amount.alias("a")))).alias("amounts"),
            F.slice(F.sort_array(F.collect_list(legit), asc=False), 1, TOP_N).alias("_best"),
        )
    )
    best = [F.coalesce(F.get("_best", F.lit(i)), F.lit(0.0)) for i in range(TOP_N)]
    return packed.select("chid", "amounts", _gain(best).alias("ideal"))


def client_ndcg(
    ranking: DataFrame,
    ledger: DataFrame,
    spec: LedgerSpec,
    t: int,
    distinct: bool = False,
    keep: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """(chid, ndcg) for clients with a ranking and a legit purchase of non-zero amount in period t.

    A predicted item that was not bought counts 0.  A ranking that repeats an item counts it every time unless
    ``distinct``.  A client with several ranking rows is scored once, by the least of them, or once per ``by``.
    """
    actual = client_actuals(ledger, spec, t).filter(F.col("ideal") > 0)
    gains = []
    for i, name in enumerate(TOPS):
        gain = F.coalesce(F.try_element_at("amounts", F.col(name)), F.lit(0.0))
        if distinct and i:
            seen = reduce(lambda a, b: a | b, [F.col(name) == F.col(p) for p in TOPS[:i]])
            gain = F.when(F.coalesce(seen, F.lit(False)), F.lit(0.0)).otherwise(gain)
        gains.append(gain)
    rankings = ranking.groupBy("chid", *by).agg(F.min(F.struct(*TOPS, *keep)).alias("_r")).select("chid", *by, "_r.*")
    joined = rankings.join(actual, "chid")
    return joined.select("chid", *by, *keep, (_gain(gains) / F.col("ideal")).alias("ndcg"))


def mean_ndcg(per_client: DataFrame) -> DataFrame:
    return per_client.agg(F.count("*").alias("n_clients"), F.avg("ndcg").alias("ndcg"))


def zero_summary(per_client: DataFrame) -> DataFrame:
    """Zero count, mean without zeros, and the mean if all non-zero values were perfect."""
    n, zeros = F.count("*"), F.count_if(F.col("ndcg") == 0)
    return per_client.agg(
        n.alias("n_clients"),
        zeros.alias("n_zero"),
        F.avg("ndcg").alias("ndcg"),
        F.try_divide(F.sum("ndcg"), n - zeros).alias("ndcg_without_zeros"),
        F.try_divide((n - zeros).cast("double"), n).alias("ceiling"),
    )


# Edges of the bands (lo, hi].
BAND_EDGES = (0.0, 0.3, 0.6, 0.7, 1.0)


def band_of(value: Column, edges: Sequence[float] = BAND_EDGES) -> Column:
    """Name of the band (lo, hi]; ``zero`` at the lower edge, ``above`` beyond the last."""
    out = F.lit("above")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        out = F.when(value <= hi, F.lit(f"{lo:g}-{hi:g}")).otherwise(out)
    return F.when(value <= edges[0], F.lit("zero")).otherwise(out)


def ndcg_bands(per_client: DataFrame, edges: Sequence[float] = BAND_EDGES) -> DataFrame:
    """Clients and client share per band."""
    total = per_client.agg(F.count("*").alias("n")).scalar()
    counts = per_client.groupBy(band_of(F.col("ndcg"), edges).alias("band")).agg(F.count("*").alias("n_clients"))
    return counts.withColumn("share", F.col("n_clients") / total)


def performance_groups(per_client: DataFrame) -> DataFrame:
    """(chid, grp): every client's band, and once more ``perfect`` for clients at exactly 1."""
    groups = F.array_compact(F.array(band_of(F.col("ndcg")), F.when(F.col("ndcg") == 1, F.lit("perfect"))))
    return per_client.select("chid", F.explode(groups).alias("grp"))


def compare_models(a: DataFrame, b: DataFrame, ndcg_a: DataFrame, ndcg_b: DataFrame) -> DataFrame:
    """Two models over the clients with non-zero NDCG in both: rankings, hits and the better side.

    One row per case with count, mean and population std of both NDCG values.
    """
    left = a.select("chid", F.struct(*TOPS).alias("ra")).join(
        ndcg_a.select("chid", F.col("ndcg").alias("na")), "chid"
    )
    right = b.select("chid", F.struct(*TOPS).alias("rb")).join(
        ndcg_b.select("chid", F.col("ndcg").alias("nb")), "chid"
    )
    both = left.join(right, "chid").filter((F.col("na") > 0) & (F.col("nb") > 0))
    same = F.col("ra") == F.col("rb")
    case = (
        F.when(same & (F.col("na") == 1), "same_full_hit")
        .when(same, "same_miss")
        .when(F.col("na") == 1, "diff_full_hit_a")
        .when(F.col("nb") == 1, "diff_full_hit_b")
        .when(F.col("na") > F.col("nb"), "diff_better_a")
        .when(F.col("na") < F.col("nb"), "diff_better_b")
        .otherwise("diff_equal")
    )
    return both.groupBy(case.alias("outcome")).agg(
        F.count("*").alias("n_clients"),
        F.avg("na").alias("mean_a"),
        F.stddev_pop("na").alias("std_a"),
        F.avg("nb").alias("mean_b"),
        F.stddev_pop("nb").alias("std_b"),
    )


def client_set_flags(a: DataFrame, b: DataFrame) -> DataFrame:
    """Clients of either set with their membership: both, only_a or only_b."""
    left, right = a.select("chid", F.lit(1).alias("_a")), b.select("chid", F.lit(1).alias("_b"))
    where = (
        F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both")
        .when(F.col("_a").isNotNull(), "only_a")
        .otherwise("only_b")
    )
    return left.join(right, "chid", "full").select("chid", where.alias("member"))


def confusion(rows: DataFrame, score: str, truth: str, threshold: float) -> DataFrame:
    """Counts tp, fp, fn, tn; positive means a score strictly above the threshold."""
    hit, true = F.col(score) > threshold, F.col(truth) == 1
    return rows.agg(
        F.count_if(hit & true).alias("tp"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"),
        F.count_if(~hit & ~true).alias("tn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def binary_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and the AUC of the thresholded labels; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        _ratio(tp + tn, tp + fp + fn + tn).alias("acc"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2).alias("auc"),
    )


def binary_rates(counts: DataFrame) -> DataFrame:
    """Error and hit rates of a confusion matrix."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        _ratio(fp, fp + tn).alias("fpr"),
        _ratio(fn, tp + fn).alias("fnr"),
        _ratio(tn, tn + fp).alias("tnr"),
        _ratio(tn, tn + fn).alias("npv"),
        _ratio(fp, tp + fp).alias("fdr"),
        _ratio(tp, tp + fn).alias("tpr"),
        _ratio(tp, tp + fp).alias("ppv"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("acc"),
    )


def gap_cdf(gaps: DataFrame, gap: str = "avg_gap", last: int = 10) -> DataFrame:
    """Cumulative share of clients per item with a mean gap in [b - 1, b), b = 1..last, then the rest as last + 1.

    Items bought fewer than twice are left out.  At most last + 1 rows per item reach the window.
    """
    rows = gaps.filter(F.col(gap) != NEVER)
    bin_of = F.least(F.floor(F.col(gap)) + 1, F.lit(last + 1)).cast("int")
    counts = rows.groupBy("tag", bin_of.alias("b")).agg(F.count("*").alias("_n"))
    grid = counts.select("tag").distinct().select("tag", F.explode(F.sequence(F.lit(1), F.lit(last + 1))).alias("b"))
    dense = grid.join(counts, ["tag", "b"], "left").na.fill(0)
    upto = Window.partitionBy("tag").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(Window.partitionBy("tag"))
    return dense.select(
        "tag", "b", F.col("_n").alias("n_clients"), (F.sum("_n").over(upto) / total).alias("cdf")
    )


def break_point_weights(cdf: DataFrame, breaks: Sequence[int]) -> DataFrame:
    """Share of clients between break points of the gap CDF: (tag, part, weight), len(breaks) + 1 parts."""
    values = [F.max(F.when(F.col("b") == x, F.col("cdf"))) for x in breaks]
    edges = cdf.groupBy("tag").agg(F.array(F.lit(0.0), *values, F.lit(1.0)).alias("e"))
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(len(breaks))),
        lambda i: F.struct(i.alias("part"), (F.get("e", i + 1) - F.get("e", i)).alias("weight")),
    )
    return edges.select("tag", F.explode(parts).alias("p")).select("tag", "p.part", "p.weight")
