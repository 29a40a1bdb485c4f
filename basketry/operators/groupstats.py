"""Statistics over client groups, joined back to clients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.config import ItemSet, LedgerSpec
from basketry.functions.moments import exact_sum
from basketry.functions.quantiles import exact_quantiles


def _quantile_of(stat: str) -> float | None:
    if stat in ("median", "nanmedian"):
        return 0.5
    if stat.startswith(("quantile_", "nanquantile_")):
        return float(stat.split("_")[-1])
    return None


def _moment(stat: str, feature: str, kind: str) -> Column:
    if stat in ("mean", "nanmean"):
        # whole numbers add up exactly as they are
        return exact_sum(F.col(feature)) / F.count(feature) if kind in ("double", "float") else F.avg(feature)
    if stat in ("std", "nanstd"):
        return F.stddev_samp(feature)
    raise ValueError(f"unknown statistic {stat!r}")


def group_stats(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], stats: Sequence[str]
) -> DataFrame:
    """``stats`` of ``features`` per group, one row per group, columns ``{feature}_{stat}`` with dots as underscores.

    ``std`` is the sample one, quantiles are linear; ``quantile_q`` is null as soon as one value is null, the ``nan``
    forms skip nulls.  Null keys drop out.  Moments come from the pass that also summarises the ranks, so everything
    takes two passes over the rows, and a group with a third of all rows is never held by one task.
    """
    rows = df.na.drop("any", subset=list(keys)).select(*keys, *features)
    kinds = dict(rows.dtypes)
    named = {(f, s): f"{f}_{s}".replace(".", "_") for f in features for s in stats}
    moments = [_moment(s, f, kinds[f]).alias(n) for (f, s), n in named.items() if _quantile_of(s) is None]
    wanted = sorted({_quantile_of(s) for s in stats} - {None})
    if not wanted:
        return rows.groupBy(*keys).agg(*moments) if moments else rows.select(*keys).distinct()
    strict = sorted({f for f, s in named if s.startswith("quantile_")})
    gaps = [(F.count("*") > F.count(f)).alias(f"_gap_{f}") for f in strict]
    probs = {f"q{i}": q for i, q in enumerate(wanted)}
    by_prob = {q: name for name, q in probs.items()}
    out = exact_quantiles(rows, keys, list(features), probs, [*moments, *gaps])

    def column(feature: str, stat: str, name: str) -> Column:
        q = _quantile_of(stat)
        found = F.col(name) if q is None else F.col(f"{feature}_{by_prob[q]}")
        return (F.when(~F.col(f"_gap_{feature}"), found) if stat.startswith("quantile_") else found).alias(name)

    return out.select(*keys, *[column(f, s, n) for (f, s), n in named.items()])


def windowed_group_stats(
    ledger: DataFrame,
    spec: LedgerSpec,
    keys: Sequence[str],
    periods: tuple[int, int],
    which: ItemSet,
    features: Sequence[str],
    stats: Sequence[str],
) -> DataFrame:
    """Group statistics over a period window and an item set of a ledger that carries the attributes."""
    rows = ledger.filter(F.col("dt").between(*periods) & F.col("tag").isin(*spec.item_set(which)))
    return group_stats(rows, keys, features, stats)


def each_attribute_stats(
    df: DataFrame, attributes: Sequence[str], features: Sequence[str], stats: Sequence[str]
) -> DataFrame:
    """Statistics per single attribute, all attributes in one pass: rows (attr, code, statistics)."""
    long = df.select(
        *features,
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("code")) for a in attributes])
        ).alias("_a"),
    ).select("_a.attr", "_a.code", *features)
    return group_stats(long, ["attr", "code"], features, stats)


def join_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group statistics back to rows; Spark sizes the statistics, and splits hot groups if it has to shuffle."""
    return df.join(stats, list(keys), "left")


def join_each_attribute(df: DataFrame, stats: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Statistics of :func:`each_attribute_stats` back to rows, columns prefixed with the attribute."""
    values = [c for c in stats.columns if c not in ("attr", "code")]
    for a in attributes:
        part = stats.filter(F.col("attr") == a).select(
            F.col("code").alias("_code"), *[F.col(v).alias(f"{a}_{v}") for v in values]
        )
        df = df.join(part, F.col(a).cast("string") == F.col("_code"), "left").drop("_code")
    return df
