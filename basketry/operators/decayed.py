"""Time-decayed purchase and feature vectors.

The weight of a period depends only on its age, so a vector is one weighted sum per (client, item): map-side combined,
whatever the number of parameter sets, and no client matrix is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.config import Decay, ItemSet, LedgerSpec
from basketry.functions.decay import decay_weight
from basketry.functions.moments import row_stat
from basketry.operators.panel import densify


def decayed_purchases(
    ledger: DataFrame,
    clients: DataFrame,
    spec: LedgerSpec,
    t_end: int,
    params: dict[str, Decay],
    which: ItemSet = "leg",
) -> DataFrame:
    """Dense (chid, tag) with one decayed purchase count per parameter set."""
    first = min(p.periods(t_end)[0] for p in params.values())
    rows = ledger.filter(F.col("dt").between(first, t_end))
    sums = [F.sum(decay_weight(F.col("dt"), p, t_end)).alias(name) for name, p in params.items()]
    sparse = rows.groupBy("chid", "tag").agg(*sums)
    return densify(sparse, clients, spec, which, {name: F.lit(0.0) for name in params})


def decayed_features(
    ledger: DataFrame,
    clients: DataFrame,
    spec: LedgerSpec,
    t_end: int,
    params: dict[str, tuple[str, Decay, float]],
    which: ItemSet = "leg",
) -> DataFrame:
    """Dense (chid, tag) with decayed sums of values: name -> (value column, decay, imputed value).

    Empty and zero cells count as the imputed value.  The imputed part is the same constant for every item, so only
    the difference on existing rows is summed.
    """
    first = min(p.periods(t_end)[0] for _, p, _ in params.values())
    rows = ledger.filter(F.col("dt").between(first, t_end))
    sums, fills = [], {}
    for name, (value, p, imputed) in params.items():
        base = imputed * sum(p.weights(t_end))
        v = F.col(value).cast("double")
        extra = F.sum(F.when(v != 0, decay_weight(F.col("dt"), p, t_end) * (v - imputed)))
        sums.append((F.lit(base) + F.coalesce(extra, F.lit(0.0))).alias(name))
        fills[name] = F.lit(base)
    return densify(rows.groupBy("chid", "tag").agg(*sums), clients, spec, which, fills)


def variant_stats(df: DataFrame, columns: Sequence[str], stats: Sequence[str], drop: Sequence[int] = ()) -> DataFrame:
    """Row-wise statistics over the parameter variants of a vector; ``drop`` lists variants to remove afterwards."""
    out = df.withColumns({f"{columns[0]}_{s}": row_stat(columns, s) for s in stats})
    return out.drop(*[columns[i] for i in drop])
