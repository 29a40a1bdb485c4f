"""Descriptive tables: activity, amounts, popularity, distributions, group shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.config import ItemSet, LedgerSpec
from basketry.functions.quantiles import exact_quantiles
from basketry.operators.filters import half_open, pick_items


def mean_items_per_period(ledger: DataFrame, clients: DataFrame, start: int, stop: int) -> DataFrame:
    """Mean number of distinct items per active period in [start, stop); 0 for clients never active."""
    per_period = half_open(ledger, start, stop).groupBy("chid", "dt").agg(F.count_distinct("tag").alias("n"))
    means = per_period.groupBy("chid").agg(F.avg("n").alias("mean_items"))
    return clients.join(means, "chid", "left").na.fill(0.0, subset=["mean_items"])


def mean_amounts(ledger: DataFrame, start: int, stop: int, amount: str) -> DataFrame:
    """Mean amount per (client, item) over the periods bought."""
    return half_open(ledger, start, stop).groupBy("chid", "tag").agg(F.avg(amount).alias("mean_amt"))


def count_map(ledger: DataFrame, spec: LedgerSpec, chid: int | None = None) -> DataFrame:
    """Transaction counts item x period on the dense grid, of all clients or of one."""
    rows = ledger if chid is None else ledger.filter(F.col("chid") == chid)
    sums = rows.groupBy("tag", "dt").agg(F.sum(spec.count).alias("n"))
    grid = (
        ledger.sparkSession.range(1, spec.n_periods + 1)
        .select(F.col("id").cast("int").alias("dt"))
        .select("dt", F.explode(F.array(*[F.lit(t) for t in spec.items])).alias("tag"))
    )
    # one row per item and period at most
    return grid.join(F.broadcast(sums), ["tag", "dt"], "left").na.fill(0).select("tag", "dt", "n")


def total_amounts(ledger: DataFrame, amount: str) -> DataFrame:
    """Total amount per (client, item)."""
    return ledger.groupBy("chid", "tag").agg(F.sum(amount).alias("total"))


def popularity(ledger: DataFrame) -> DataFrame:
    """Number of clients per item.  Distinct pairs first, so a popular item is counted by many tasks."""
    return ledger.select("chid", "tag").distinct().groupBy("tag").agg(F.count("*").alias("n_clients"))


def first_period(ledger: DataFrame, clients: DataFrame, spec: LedgerSpec, which: ItemSet = "leg") -> DataFrame:
    """Clients by their first active period, with the share of all clients of the spine."""
    firsts = pick_items(ledger, spec, which).groupBy("chid").agg(F.min("dt").alias("dt"))
    total = clients.agg(F.count("*").alias("n")).scalar()
    return firsts.groupBy("dt").agg(F.count("*").alias("n_clients")).withColumn("share", F.col("n_clients") / total)


def first_period_by_group(
    ledger: DataFrame, groups: DataFrame, spec: LedgerSpec, which: ItemSet = "leg"
) -> DataFrame:
    """First active period per client group (chid, grp), as share of the group's clients.

    Group sizes are one row per group label; sized and broadcast by Spark.
    """
    firsts = pick_items(ledger, spec, which).groupBy("chid").agg(F.min("dt").alias("dt"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size"))
    counts = firsts.join(groups, "chid").groupBy("grp", "dt").agg(F.count("*").alias("n_clients"))
    return counts.join(sizes, "grp").select("grp", "dt", "n_clients", (F.col("n_clients") / F.col("size")).alias("share"))


def amount_quartiles(ledger: DataFrame, amount: str) -> DataFrame:
    """Quartiles of the amount per item and period."""
    return exact_quantiles(ledger, ["tag", "dt"], amount, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def code_shares(rows: DataFrame, groups: DataFrame, code: str) -> DataFrame:
    """Share of each code among the rows of each client group (chid, grp); absent codes are 0.

    One pass over rows and groups: rows are collapsed per client and code before the group join, whose counts, one per
    group and code, make up the grid as well.
    """
    per_client = rows.groupBy("chid", F.col(code).alias("code")).agg(F.count("*").alias("_n"))
    # also codes without a group and groups without a code
    joined = groups.select("chid", "grp").join(per_client, "chid", "full")
    counts = joined.groupBy("grp", "code").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n"))
    cells = counts.agg(F.collect_list(F.struct("grp", "code", "n")).alias("_c"))
    codes = F.array_sort(F.array_distinct(F.array_compact(F.transform("_c", lambda c: c["code"]))))
    labels = F.array_distinct(F.array_compact(F.transform("_c", lambda c: c["grp"])))
    grid = cells.select("_c", codes.alias("_codes"), F.explode(labels).alias("grp"))
    grid = grid.select("grp", "_codes", F.filter("_c", lambda c: c["grp"] == F.col("grp")).alias("_c"))
    size = F.aggregate("_c", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    found = F.map_from_entries(
        F.transform(F.filter("_c", lambda c: c["code"].isNotNull()), lambda c: F.struct(c["code"], c["n"]))
    )
    dense = grid.select("grp", size.alias("_size"), found.alias("_found"), F.explode("_codes").alias("code"))
    n = F.coalesce(F.try_element_at("_found", F.col("code")), F.lit(0).cast("long"))
    return dense.select("grp", "code", n.alias("n"), F.coalesce(F.try_divide(n, F.col("_size")), F.lit(0.0)).alias("share"))


def with_global_group(groups: DataFrame, clients: DataFrame) -> DataFrame:
    """Adds a group that holds every client."""
    return groups.select("chid", "grp").unionByName(clients.select("chid", F.lit("global").alias("grp")))


def log_histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram of log1p(value) between its minimum and maximum; the last bin is closed."""
    logged = rows.select(F.log1p(F.col(value).cast("double")).alias("x"))
    edge = logged.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e")).scalar()
    lo, hi = edge.getField("lo"), edge.getField("hi")
    place = F.coalesce(F.try_divide(F.col("x") - lo, hi - lo), F.lit(0.0))
    bin_of = F.least(F.floor(place * bins), F.lit(bins - 1)).cast("int")
    return logged.na.drop().groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))


def item_frequency(ledger: DataFrame, start: int, stop: int) -> DataFrame:
    """Personal item frequency: periods bought per (client, item) in [start, stop)."""
    return half_open(ledger, start, stop).groupBy("chid", "tag").agg(F.count("*").alias("pif"))


def amount_heatmap(ledger: DataFrame, spec: LedgerSpec, value: str, chid: int | None = None) -> DataFrame:
    """Item x period table of amounts rounded to one decimal, of all clients or of one."""
    rows = ledger if chid is None else ledger.filter(F.col("chid") == chid)
    periods = range(1, spec.n_periods + 1)
    wide = rows.groupBy("chid", "tag").pivot("dt", list(periods)).agg(F.sum(value))
    return wide.selectExpr("chid", "tag", *[f"round(coalesce(`{dt}`, 0), 1) AS dt{dt}" for dt in periods])
