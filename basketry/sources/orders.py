"""A ledger from order lines: clients are customers, periods are quarters, items are brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_YEAR = 1995  # quarter 1 of this year is period 1
FLAGS = {"a": "A", "n": "N", "r": "R"}


def _period(date: str):
    return ((F.year(date) - F.lit(FIRST_YEAR)) * 4 + F.quarter(date)).cast("int")


def orders_ledger(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """One row per (chid, dt, tag): counts and integer-cent amounts, in total and by channel.

    Three shuffles of narrow rows.  Neither join is hinted: the other side grows with the data, so Spark sizes it at run
    time and AQE splits a hot order or part.  The final grouping combines on the map side, so a client with a third of
    all lines arrives as at most periods x items rows per task.
    """
    lines = lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_returnflag",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )
    heads = orders.select("o_orderkey", F.col("o_custkey").alias("chid"), _period("o_orderdate").alias("dt"))
    items = part.select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("tag"))
    # parts first: a line is narrower with its item than with its client and period, so the second join moves less
    joined = lines.join(items, lines.l_partkey == items.p_partkey).join(heads, lines.l_orderkey == heads.o_orderkey)
    counts = [F.count_if(F.col("l_returnflag") == code).alias(f"cnt_{name}") for name, code in FLAGS.items()]
    cents = [
        F.sum(F.when(F.col("l_returnflag") == code, F.col("cents")).otherwise(F.lit(0).cast("long"))).alias(
            f"cents_{name}"
        )
        for name, code in FLAGS.items()
    ]
    return joined.groupBy("chid", "dt", "tag").agg(
        F.count("*").alias("txn_cnt"), F.sum("cents").alias("amt_cents"), *counts, *cents
    )


def orders_profile(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """One row per (chid, dt): constant attributes, the period's last priority, the period's credit limit.

    Orders are collapsed per client and period before the client join.
    """
    latest = F.struct("o_orderdate", "o_orderkey")
    per_period = (
        orders.select(
            F.col("o_custkey").alias("chid"),
            _period("o_orderdate").alias("dt"),
            "o_orderdate",
            "o_orderkey",
            "o_orderpriority",
            "o_totalprice",
        )
        .groupBy("chid", "dt")
        .agg(
            F.max_by("o_orderpriority", latest).alias("prio_text"),
            F.max(F.round(F.col("o_totalprice") * 100).cast("long")).alias("lim_cents"),
        )
    )
    return (
        per_period.join(client_attributes(customer, nation), "chid")
        .withColumn("prio", F.substring("prio_text", 1, 1).cast("int"))
        .select("chid", "dt", "nation", "segment", "region", "prio", "lim_cents")
    )


def client_attributes(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Constant attributes per client; the nation table is small by nature and sized by Spark."""
    homes = nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return customer.select(
        F.col("c_custkey").alias("chid"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    ).join(homes, "nation")
