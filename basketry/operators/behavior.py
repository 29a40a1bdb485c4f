"""Purchase behaviour per client and item, as of one period.

All features come from one aggregate per (client, item): first and last period, and the bought periods as bits of longs,
one long for every 62 periods.  Bits combine with OR, so the aggregate is map-side combined and its size does not depend
on how often a client bought.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.config import NEVER, OLD_GAP_DEFAULT, ItemSet, LedgerSpec
from basketry.functions.bitmaps import count_periods, count_successions, period_bits
from basketry.operators.panel import densify

TOGGLES = ("n00", "n01", "n10", "n11")


def history_columns(t_end: int) -> list[Column]:
    """Aggregates over the rows of a client and item up to t_end: first and last period, and the bought periods."""
    return [F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), *period_bits(t_end)]


def history(ledger: DataFrame, t_end: int) -> DataFrame:
    """(chid, tag, first_dt, last_dt, months0..) of every bought item up to t_end."""
    return ledger.filter(F.col("dt") <= t_end).groupBy("chid", "tag").agg(*history_columns(t_end))


def _toggle_columns(t_end: int) -> dict[str, Column]:
    n, n11 = count_periods(t_end), count_successions(t_end)
    n10 = n - n11 - (F.col("last_dt") == t_end).cast("int")
    n01 = n - n11 - (F.col("first_dt") == 1).cast("int")
    return {"n00": F.lit(t_end - 1) - n10 - n01 - n11, "n01": n01, "n10": n10, "n11": n11}


def feature_columns(t_end: int) -> dict[str, tuple[Column, Column]]:
    """Feature name to (expression over :func:`history`, value of an item that was never bought)."""
    n = count_periods(t_end)
    gap = F.try_divide((F.col("last_dt") - F.col("first_dt")).cast("double"), n - 1) - 1.0
    columns = {
        "gap_since_first": (F.lit(t_end) - F.col("first_dt"), F.lit(NEVER)),
        "gap_since_last": (F.lit(t_end) - F.col("last_dt"), F.lit(NEVER)),
        "avg_gap": (F.coalesce(gap, F.lit(float(NEVER))), F.lit(float(NEVER))),
        "made_ratio": (n / F.lit(float(t_end)), F.lit(0.0)),
        "purch_t_end": ((F.col("last_dt") == t_end).cast("int"), F.lit(0)),
    }
    never = {"n00": t_end - 1, "n01": 0, "n10": 0, "n11": 0}
    for name, expr in _toggle_columns(t_end).items():
        columns[name] = (expr, F.lit(never[name]))
    return columns


def behavior(
    ledger: DataFrame,
    clients: DataFrame,
    spec: LedgerSpec,
    t_end: int,
    features: Sequence[str],
    which: ItemSet = "leg",
) -> DataFrame:
    """Dense (chid, tag, features) for any of the feature names; one pass whatever their number."""
    names = [x for f in features for x in (TOGGLES if f == "st_tgl" else (f,))]
    columns = feature_columns(t_end)
    unknown = set(names) - set(columns)
    if unknown:
        raise ValueError(f"unknown features {sorted(unknown)}")
    sparse = history(ledger, t_end).select("chid", "tag", *[columns[n][0].alias(n) for n in names])
    return densify(sparse, clients, spec, which, {n: columns[n][1] for n in names})


def items_per_period(
    ledger: DataFrame, clients: DataFrame, spec: LedgerSpec, t_end: int, which: ItemSet = "leg", periods: int = 6
) -> DataFrame:
    """Distinct items in each of the last periods, one column per lag (lag 0 is t_end)."""
    first = t_end - periods + 1
    rows = ledger.filter(F.col("dt").between(first, t_end) & F.col("tag").isin(*spec.item_set(which)))
    # the ledger has one row per (dt, chid, tag), so rows are items
    counted = rows.groupBy("chid").agg(
        *[F.count_if(F.col("dt") == t_end - lag).alias(f"n_items_lag{lag}") for lag in range(periods)]
    )
    # only the counts are filled: a filled key would lose its place in the buckets
    return clients.join(counted, "chid", "left").na.fill(0, subset=counted.columns[1:])


def old_gaps(ledger: DataFrame, clients: DataFrame, spec: LedgerSpec, which: ItemSet = "all") -> DataFrame:
    """Older gap vector: mean gap over all periods with a non-zero count, 24.0 with fewer than two of them."""
    counted = ledger.filter(F.col(spec.count) != 0)
    gap = F.try_divide((F.max("dt") - F.min("dt")).cast("double"), F.count("*") - 1) - 1.0
    sparse = counted.groupBy("chid", "tag").agg(F.coalesce(gap, F.lit(OLD_GAP_DEFAULT)).alias("old_gap"))
    return densify(sparse, clients, spec, which, {"old_gap": F.lit(OLD_GAP_DEFAULT)})


# Dispatcher: feature name to a function of (ledger, clients, spec, t_end, which).
Builder = Callable[[DataFrame, DataFrame, LedgerSpec, int, ItemSet], DataFrame]
FEATURES: dict[str, Builder] = {
    name: (lambda led, cli, spec, t, which, _n=name: behavior(led, cli, spec, t, [_n], which))
    for name in ("gap_since_first", "gap_since_last", "avg_gap", "st_tgl", "made_ratio", "purch_t_end")
}
FEATURES["n_shop_tags"] = items_per_period


def behavior_feature(
    name: str, ledger: DataFrame, clients: DataFrame, spec: LedgerSpec, t_end: int, which: ItemSet = "leg"
) -> DataFrame:
    """One feature by name."""
    if name not in FEATURES:
        raise ValueError(f"unknown feature {name!r}: {sorted(FEATURES)}")
    return FEATURES[name](ledger, clients, spec, t_end, which)
