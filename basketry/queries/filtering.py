"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.hashing import key_hash_sql
from basketry.operators import filters as flt
from basketry.queries.base import SPEC, T_END, TARGET, Tables, query, rounded

CORE = ("chid", "dt", "tag", "txn_cnt")


@query(
    "f01_item_subsets",
    """SELECT 'leg' AS subset, chid, dt, tag FROM ledger WHERE tag IN (SELECT tag FROM leg)
       UNION ALL SELECT 'illeg', chid, dt, tag FROM ledger WHERE tag NOT IN (SELECT tag FROM leg)
       UNION ALL SELECT 'list', chid, dt, tag FROM ledger WHERE tag IN (4, 9, 25)""",
)
def item_subsets(t: Tables) -> DataFrame:
    parts = [
        flt.pick_items(t.ledger, SPEC, which).select(F.lit(name).alias("subset"), "chid", "dt", "tag")
        for name, which in (("leg", "leg"), ("illeg", "illeg"), ("list", [4, 9, 25]))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f02_trailing_window", "SELECT chid, dt, tag, txn_cnt FROM ledger WHERE dt BETWEEN 18 AND 21")
def trailing(t: Tables) -> DataFrame:
    return flt.trailing_window(t.ledger, T_END, 6, 2).select(*CORE)


@query("f03_period_list", "SELECT chid, dt, tag, txn_cnt FROM ledger WHERE dt IN (4, 8, 12, 23)")
def period_list(t: Tables) -> DataFrame:
    return flt.in_periods(t.ledger, [4, 8, 12, 23]).select(*CORE)


@query("f04_half_open", "SELECT chid, dt, tag, txn_cnt FROM ledger WHERE dt >= 11 AND dt < 24")
def half_open(t: Tables) -> DataFrame:
    return flt.half_open(t.ledger, 11, 24).select(*CORE)


@query(
    "f05_as_of_and_snapshot",
    """SELECT 'as_of' AS cut, chid, dt, tag FROM ledger WHERE dt <= 23
       UNION ALL SELECT 'snapshot', chid, dt, tag FROM ledger WHERE dt = 23""",
)
def as_of(t: Tables) -> DataFrame:
    columns = ("cut", "chid", "dt", "tag")
    before = flt.as_of(t.ledger, T_END).withColumn("cut", F.lit("as_of")).select(*columns)
    return before.unionByName(flt.snapshot(t.ledger, T_END).withColumn("cut", F.lit("snapshot")).select(*columns))


@query("f06_distinct_clients", "SELECT DISTINCT chid FROM ledger WHERE dt = 23")
def distinct_clients(t: Tables) -> DataFrame:
    return flt.active_clients(t.ledger, T_END)


_LAST_SQL = """
    WITH last_amt AS (SELECT chid, tag, max(amt_cents) FILTER (dt = 23) AS now, max(amt_cents) FILTER (dt = 22) AS before
                      FROM ledger WHERE dt IN (22, 23) GROUP BY 1, 2)"""


def _last(t: Tables) -> DataFrame:
    rows = flt.in_periods(t.ledger, [22, 23])
    return rows.groupBy("chid", "tag").agg(
        F.max(F.when(F.col("dt") == 23, F.col("amt_cents"))).alias("now"),
        F.max(F.when(F.col("dt") == 22, F.col("amt_cents"))).alias("before"),
    )


@query("f07_drop_incomplete", _LAST_SQL + " SELECT chid, tag, now, before FROM last_amt WHERE now IS NOT NULL AND before IS NOT NULL")
def drop_incomplete(t: Tables) -> DataFrame:
    return flt.drop_incomplete(_last(t))


@query("f08_zero_fill", _LAST_SQL + " SELECT chid, tag, coalesce(now, 0) AS now, coalesce(before, 0) AS before FROM last_amt")
def zero_fill(t: Tables) -> DataFrame:
    return flt.zero_fill(_last(t), ["now", "before"])


@query(
    "f09_mean_fill",
    _LAST_SQL
    + """ SELECT chid, tag, round(coalesce(now, (SELECT avg(now) FROM last_amt)), 4) AS now,
                 round(coalesce(before, (SELECT avg(before) FROM last_amt)), 4) AS before FROM last_amt""",
)
def mean_fill(t: Tables) -> DataFrame:
    return rounded(flt.mean_fill(_last(t), ["now", "before"]), 4)


@query(
    "f10_hash_sample",
    f"SELECT chid, dt, tag, txn_cnt FROM ledger WHERE {key_hash_sql('chid', 7)} / CAST(2147483647 AS DOUBLE) < 0.3",
)
def hash_sample(t: Tables) -> DataFrame:
    """A repeatable sample of clients (the sampling operator itself)."""
    return flt.sample_rows(t.ledger, 0.3, 7).select(*CORE)


@query(
    "f11_recode",
    """SELECT chid, CAST(dt - 1 AS INTEGER) AS dt, CAST(CASE nation WHEN 24 THEN 3 WHEN 23 THEN 5 ELSE nation END AS INTEGER) AS nation,
              CAST(prio - 1 AS INTEGER) AS prio
       FROM profile""",
)
def recode(t: Tables) -> DataFrame:
    rows = t.profile.select("chid", "dt", "nation", "prio")
    return flt.recode(rows, {"nation": {24: 3, 23: 5}}, {"dt": 1, "prio": 1})


@query("f12_drop_ids", "SELECT dt, txn_cnt, amt_cents FROM ledger")
def drop_ids(t: Tables) -> DataFrame:
    return flt.drop_disabled(t.ledger.select("chid", "tag", "dt", "txn_cnt", "amt_cents"))


@query(
    "f13_label_index",
    f"SELECT chid, tag, label, tag AS back FROM ledger JOIN leg USING (tag) WHERE dt = {TARGET}",
)
def label_index(t: Tables) -> DataFrame:
    """Item to label and back again."""
    rows = flt.label_index(flt.snapshot(t.ledger, TARGET).select("chid", "tag"), SPEC)
    return flt.label_item(rows.withColumn("back", F.col("label")), SPEC, "back")
