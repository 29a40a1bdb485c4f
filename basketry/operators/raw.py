"""Raw values over time and the client dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.config import PSEUDO_ZERO_PER_COUNT, ItemSet, LedgerSpec
from basketry.operators.panel import item_grid


def lag_table(
    ledger: DataFrame,
    spec: LedgerSpec,
    values: Sequence[str],
    t_end: int,
    window: int,
    which: ItemSet = "all",
    clients: DataFrame | None = None,
) -> DataFrame:
    """Value at t_end and at lags 1..window-1 per (chid, tag), zero where absent; lag n is period t_end - n.

    Keys are the rows of t_end, or the whole client x item grid when ``clients`` is given.  All lags come from one
    conditional aggregate instead of one join per lag.
    """
    rows = ledger.filter(F.col("dt").between(t_end - window + 1, t_end) & F.col("tag").isin(*spec.item_set(which)))
    columns = [
        F.coalesce(F.max(F.when(F.col("dt") == t_end - lag, F.col(v))), F.lit(0)).alias(v if lag == 0 else f"{v}_lag{lag}")
        for v in values
        for lag in range(window)
    ]
    if clients is None:
        present = F.max(F.when(F.col("dt") == t_end, 1)).alias("_here")
        return rows.groupBy("chid", "tag").agg(present, *columns).filter("_here = 1").drop("_here")
    lags = rows.groupBy("chid", "tag").agg(*columns)
    names = [c for c in lags.columns if c not in ("chid", "tag")]
    return item_grid(clients, spec, which).join(lags, ["chid", "tag"], "left").na.fill(0, subset=names)


def flat_vector(
    ledger: DataFrame,
    clients: DataFrame,
    spec: LedgerSpec,
    value: str,
    t_end: int,
    window: tuple[int, int],
    which: ItemSet = "leg",
    imputed: float = 0.0,
) -> DataFrame:
    """One column per (lag, item) and client; missing and zero cells take the imputed value."""
    lo, up = window
    tags = spec.item_set(which)
    rows = ledger.filter(F.col("dt").between(t_end - lo + 1, t_end - up) & F.col("tag").isin(*tags))
    # one pivot key per (lag, item); the keys are known, so no job looks for them
    width = max(spec.items) + 1
    cells = {lag * width + tag: f"{value}_lag{lag}_tag{tag}" for lag in range(lo - 1, up - 1, -1) for tag in tags}
    keyed = rows.select(
        "chid", ((t_end - F.col("dt")) * width + F.col("tag")).alias("_cell"), F.col(value).cast("double").alias("_v")
    )
    wide = keyed.groupBy("chid").pivot("_cell", list(cells)).agg(F.max("_v"))
    filled = [f"coalesce(nullif(`{key}`, 0D), {float(imputed)}D) AS `{name}`" for key, name in cells.items()]
    return clients.join(wide, "chid", "left").selectExpr("chid", *filled)


def limit_stats(profile: DataFrame, clients: DataFrame, limit: str) -> DataFrame:
    """log1p limit per client: min, max, median, mean, sample std; a null std takes the median of all stds.

    A client has at most one row per period, so its median is a built-in; the median over clients is not.
    """
    from basketry.functions.quantiles import exact_quantiles

    logged = profile.select("chid", F.log1p(F.col(limit).cast("double")).alias("v"))
    stats = logged.groupBy("chid").agg(
        F.min("v").alias("lim_min"),
        F.max("v").alias("lim_max"),
        F.median("v").alias("lim_median"),
        F.avg("v").alias("lim_mean"),
        F.stddev_samp("v").alias("lim_std"),
    )
    middle = exact_quantiles(stats, [], "lim_std", {"m": 0.5}).select("m").scalar()
    return clients.join(stats.withColumn("lim_std", F.coalesce("lim_std", middle)), "chid", "left")


def attributes_at(profile: DataFrame, attributes: Sequence[str], t: int) -> DataFrame:
    """Attributes of the clients active in period t, one row each."""
    return profile.filter(F.col("dt") == t).select("chid", *attributes).distinct()


def latest_attributes(profile: DataFrame, attributes: Sequence[str], t_end: int) -> DataFrame:
    """Latest known attributes per client; periods after t_end are not looked at."""
    values = F.struct(*attributes)
    latest = profile.filter(F.col("dt") <= t_end).groupBy("chid").agg(F.max_by(values, F.col("dt")).alias("_a"))
    return latest.select("chid", "_a.*")


def client_attributes(
    profile: DataFrame, attributes: Sequence[str], t_end: int, clients: DataFrame | None = None
) -> DataFrame:
    """Attributes at t_end; with ``clients`` every client, the inactive ones from their latest row.

    The latest row up to t_end of an active client is its row at t_end, so one aggregate serves both.
    """
    if clients is None:
        return attributes_at(profile, attributes, t_end)
    return clients.join(latest_attributes(profile, attributes, t_end), "chid", "left")


def filled_limit(profile: DataFrame, limit: str, n_periods: int) -> DataFrame:
    """Limit of every client and period: the last known (not null) one, 0 before the first.

    Each known value covers the periods until the next one, so the client x period grid appears after the only shuffle.
    """
    w = Window.partitionBy("chid").orderBy("dt")
    spans = profile.select(
        "chid",
        "dt",
        F.coalesce(F.last(limit, ignorenulls=True).over(w), F.lit(0)).alias("_v"),
        F.lead("dt").over(w).alias("_next"),
        F.lag("dt").over(w).alias("_prev"),
    )
    known = F.sequence(F.col("dt"), F.coalesce(F.col("_next") - 1, F.lit(n_periods)))
    before = F.when(F.col("_prev").isNull() & (F.col("dt") > 1), F.sequence(F.lit(1), F.col("dt") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    cells = F.concat(
        F.transform(before, lambda d: F.struct(d.alias("dt"), F.lit(0).cast("long").alias("v"))),
        F.transform(known, lambda d: F.struct(d.alias("dt"), F.col("_v").cast("long").alias("v"))),
    )
    return spans.select("chid", F.explode(cells).alias("c")).select("chid", "c.dt", F.col("c.v").alias(limit))


def melt(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long, keeping ``chid``."""
    return df.unpivot("chid", list(columns), name, value)


def amount_per_count(
    ledger: DataFrame, pairs: dict[str, tuple[str, str]], imputed: float = PSEUDO_ZERO_PER_COUNT, scale: float = 1.0
) -> DataFrame:
    """Amount per count and its state for every pair name -> (amount, count).

    A zero amount is first replaced by the imputed one.  State 0: count is zero; else 1, 2, 3 for an amount below, at or
    above the imputed one.
    """

    def columns(name: str, amount: str, count: str) -> list[Column]:
        a = F.col(amount).cast("double") / scale
        a = F.when(a == 0, F.lit(imputed)).otherwise(a)
        per = F.try_divide(a, F.col(count).cast("double"))
        state = (
            F.when(per.isNull(), 0).when(a < imputed, 1).when(a == imputed, 2).otherwise(3)
        )
        return [per.alias(f"{name}_apc"), state.alias(f"{name}_apc_state")]

    return ledger.select("chid", "dt", "tag", *[c for n, (a, k) in pairs.items() for c in columns(n, a, k)])


def spine(
    ledger: DataFrame, clients: DataFrame, spec: LedgerSpec, t_end: int, mode: str, which: ItemSet = "leg"
) -> DataFrame:
    """Rows of a dataset: ``production`` all clients, ``active`` clients of t_end, ``binary`` (chid, tag) rows of t_end."""
    if mode == "production":
        return clients
    here = ledger.filter(F.col("dt") == t_end)
    if mode == "active":
        return here.select("chid").distinct()
    if mode == "binary":
        return here.filter(F.col("tag").isin(*spec.item_set(which))).select("chid", "tag")
    raise ValueError(f"unknown spine {mode!r}")
