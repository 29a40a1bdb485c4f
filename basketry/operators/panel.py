"""Client x item and client x period panels.

Storage stays sparse.  A dense panel is built per client row: the client's items are pivoted into one row (at most the
item dictionary), joined to the spine once on ``chid``, and opened again.  The grid itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.config import ItemSet, LedgerSpec
from basketry.functions.bitmaps import period_bits, period_flags, words


def item_grid(clients: DataFrame, spec: LedgerSpec, which: ItemSet = "leg") -> DataFrame:
    """Every client with every item of a set."""
    tags = F.array(*[F.lit(t) for t in spec.item_set(which)])
    return clients.select("chid", F.explode(tags).alias("tag"))


def period_grid(clients: DataFrame, first: int, last: int) -> DataFrame:
    """Every client with every period."""
    return clients.select("chid", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("dt"))


def densify(
    sparse: DataFrame, clients: DataFrame, spec: LedgerSpec, which: ItemSet, fills: dict[str, Column]
) -> DataFrame:
    """(chid, tag, values) on the dense client x item grid; missing cells take ``fills``."""
    tags = spec.item_set(which)
    names = list(fills)
    packed = (
        sparse.filter(F.col("tag").isin(*tags)).groupBy("chid").pivot("tag", list(tags)).agg(*[F.max(n).alias(n) for n in names])
    )
    cell = "`{tag}_{name}`" if len(names) > 1 else "`{tag}`"
    columns = [
        f"struct({tag} AS tag, {', '.join(cell.format(tag=tag, name=n) + f' AS `{n}`' for n in names)})" for tag in tags
    ]
    joined = clients.select("chid").join(packed, "chid", "left")
    rows = joined.select("chid", F.explode(F.expr(f"array({', '.join(columns)})")).alias("_c"))
    return rows.select(
        "chid", "_c.tag", *[F.coalesce(F.col("_c").getField(n), fill).alias(n) for n, fill in fills.items()]
    )


def purchase_map(ledger: DataFrame, clients: DataFrame, spec: LedgerSpec, t_end: int, which: ItemSet = "all") -> DataFrame:
    """Dense 0/1 map (chid, tag, dt, bought): a row of the ledger exists, whatever its amount."""
    bits = ledger.filter(F.col("dt") <= t_end).groupBy("chid", "tag").agg(*period_bits(t_end))
    cells = densify(bits, clients, spec, which, {w: F.lit(0).cast("long") for w in words(t_end)})
    flags = F.posexplode(period_flags(t_end)).alias("dt", "bought")
    return cells.select("chid", "tag", flags).withColumn("dt", F.col("dt") + 1)


def feature_map(
    ledger: DataFrame, clients: DataFrame, spec: LedgerSpec, value: str, imputed: float, periods: Sequence[int], which: ItemSet = "all"
) -> DataFrame:
    """Dense map (chid, tag, dt, value); missing and zero cells take the imputed value."""
    first, last = periods
    rows = ledger.filter(F.col("dt").between(first, last)).select("chid", "tag", "dt", F.col(value).cast("double").alias("_v"))
    dts = range(first, last + 1)
    wide = rows.groupBy("chid", "tag").pivot("dt", list(dts)).agg(F.max("_v"))
    cells = densify(
        wide.withColumnsRenamed({str(d): f"_{d}" for d in dts}),
        clients,
        spec,
        which,
        {f"_{d}": F.lit(None).cast("double") for d in dts},
    )
    by_dt = ", ".join(f"struct({d} AS dt, coalesce(nullif(_{d}, 0D), {float(imputed)}D) AS value)" for d in dts)
    return cells.select("chid", "tag", F.explode(F.expr(f"array({by_dt})")).alias("_c")).select("chid", "tag", "_c.*")


def pivot_items(
    long: DataFrame, spec: LedgerSpec, values: Sequence[str], which: ItemSet = "leg", suffix: str = "tag"
) -> DataFrame:
    """(chid, tag, values) to one wide row per client, columns ``{value}_tag{tag}``.

    The items are given, so no job looks for them, and each value is pivoted by one aggregate.
    """
    tags = spec.item_set(which)
    wide = (
        long.groupBy("chid").pivot("tag", list(tags)).agg(*[F.max(v).alias(v) for v in values])
    )
    # a single value is named after the item only
    old = "{tag}_{v}" if len(values) > 1 else "{tag}"
    names = [f"`{old.format(tag=t, v=v)}` AS `{v}_{suffix}{t}`" for v in values for t in tags]
    return wide.selectExpr("chid", *names)
