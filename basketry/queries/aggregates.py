"""Group statistics and descriptive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import descriptive as des
from basketry.operators import groupstats as grp
from basketry.operators import raw
from basketry.operators.metrics import client_ndcg, performance_groups
from basketry.queries.base import SPEC, T_END, TARGET, Tables, query, rounded

STATS = ["mean", "nanmedian", "std", "quantile_0.25", "nanquantile_0.9"]
_STATS_SQL = ", ".join(
    f"""round(avg({f}), 4) AS {f}_mean, round(median({f}), 4) AS {f}_nanmedian, round(stddev_samp({f}), 3) AS {f}_std,
        round(quantile_cont({f}, 0.25), 4) AS {f}_quantile_0_25, round(quantile_cont({f}, 0.9), 4) AS {f}_nanquantile_0_9"""
    for f in ("txn_cnt", "amt_cents")
)


def _stats(df: DataFrame) -> DataFrame:
    std = [c for c in df.columns if c.endswith("_std")]
    return rounded(df.withColumns({c: F.round(c, 3) for c in std}), 4, tuple(std))


@query(
    "a01_group_stats",
    f"""SELECT nation, prio, {_STATS_SQL} FROM wide
        WHERE dt BETWEEN 18 AND 23 AND tag IN (SELECT tag FROM leg) GROUP BY nation, prio""",
)
def group_stats(t: Tables) -> DataFrame:
    return _stats(grp.windowed_group_stats(t.wide, SPEC, ["nation", "prio"], (18, 23), "leg", ["txn_cnt", "amt_cents"], STATS))


_EACH = " UNION ALL ".join(
    f"SELECT '{a}' AS attr, CAST({a} AS VARCHAR) AS code, {_STATS_SQL} FROM wide WHERE dt BETWEEN 18 AND 23 GROUP BY 1, 2"
    for a in SPEC.attributes
)


@query("a02_each_attribute", _EACH)
def each_attribute(t: Tables) -> DataFrame:
    rows = t.wide.filter(F.col("dt").between(18, 23))
    return _stats(grp.each_attribute_stats(rows, SPEC.attributes, ["txn_cnt", "amt_cents"], STATS))


@query(
    "a03_mean_items_per_period",
    """SELECT chid, round(coalesce(m, 0), 6) AS mean_items FROM clients LEFT JOIN
       (SELECT chid, avg(n) AS m FROM (SELECT chid, dt, count(DISTINCT tag) AS n FROM ledger WHERE dt >= 1 AND dt < 24 GROUP BY 1, 2)
        GROUP BY 1) USING (chid)""",
)
def mean_items(t: Tables) -> DataFrame:
    return rounded(des.mean_items_per_period(t.ledger, t.clients, 1, T_END + 1))


@query(
    "a04_mean_amount_per_basket",
    "SELECT chid, tag, round(avg(amt_cents), 4) AS mean_amt FROM ledger WHERE dt >= 1 AND dt < 24 GROUP BY 1, 2",
)
def mean_amounts(t: Tables) -> DataFrame:
    return rounded(des.mean_amounts(t.ledger, 1, T_END + 1, "amt_cents"), 4)


@query(
    "a05_count_map",
    """SELECT items.tag AS tag, periods.dt AS dt, CAST(coalesce(n, 0) AS BIGINT) AS n FROM items CROSS JOIN periods LEFT JOIN
       (SELECT tag, dt, sum(txn_cnt) AS n FROM ledger GROUP BY 1, 2) AS s ON s.tag = items.tag AND s.dt = periods.dt""",
)
def count_map(t: Tables) -> DataFrame:
    return des.count_map(t.ledger, SPEC)


@query(
    "a06_limit_stats",
    """WITH s AS (SELECT chid, min(v) AS lim_min, max(v) AS lim_max, median(v) AS lim_median, avg(v) AS lim_mean, stddev_samp(v) AS lim_std
                  FROM (SELECT chid, ln(1 + lim_cents) AS v FROM profile) GROUP BY chid)
       SELECT chid, round(lim_min, 6) AS lim_min, round(lim_max, 6) AS lim_max, round(lim_median, 6) AS lim_median,
              round(lim_mean, 6) AS lim_mean,
              round(CASE WHEN lim_mean IS NOT NULL THEN coalesce(lim_std, (SELECT median(lim_std) FROM s)) END, 6) AS lim_std
       FROM clients LEFT JOIN s USING (chid)""",
)
def limit_stats(t: Tables) -> DataFrame:
    return rounded(raw.limit_stats(t.profile, t.clients, "lim_cents"))


@query("a07_total_amount", "SELECT chid, tag, CAST(sum(amt_cents) AS BIGINT) AS total FROM ledger GROUP BY 1, 2")
def total_amount(t: Tables) -> DataFrame:
    return des.total_amounts(t.ledger, "amt_cents")


@query("a08_popularity", "SELECT tag, count(DISTINCT chid) AS n_clients FROM ledger GROUP BY 1")
def popularity(t: Tables) -> DataFrame:
    return des.popularity(t.ledger)


@query(
    "a08_mode_top3",
    """SELECT tag, count(DISTINCT chid) AS n_clients FROM past WHERE tag IN (SELECT tag FROM leg) GROUP BY 1
       ORDER BY 2 DESC, 1 LIMIT 3""",
)
def mode_top3(t: Tables) -> DataFrame:
    rows = t.past.filter(F.col("tag").isin(*SPEC.legit))
    return des.popularity(rows).orderBy(F.col("n_clients").desc(), "tag").limit(3)


@query(
    "a09_first_period",
    """SELECT dt, count(*) AS n_clients, round(count(*) / (SELECT count(*) FROM clients), 6) AS share
       FROM (SELECT chid, min(dt) AS dt FROM ledger WHERE tag IN (SELECT tag FROM leg) GROUP BY chid) GROUP BY dt""",
)
def first_period(t: Tables) -> DataFrame:
    return rounded(des.first_period(t.ledger, t.clients, SPEC))


_GROUPS = """
    WITH grps AS (SELECT chid, CASE WHEN ndcg <= 0 THEN 'zero' WHEN ndcg <= 0.3 THEN '0-0.3' WHEN ndcg <= 0.6 THEN '0.3-0.6'
                                    WHEN ndcg <= 0.7 THEN '0.6-0.7' WHEN ndcg <= 1 THEN '0.7-1' ELSE 'above' END AS grp
                  FROM (SELECT chid, round(ndcg, 9) AS ndcg FROM ndcg_a)
                  UNION ALL SELECT chid, 'perfect' FROM ndcg_a WHERE round(ndcg, 9) = 1
                  UNION ALL SELECT chid, 'global' FROM clients)"""


def _groups(t: Tables) -> DataFrame:
    """Performance groups of the amount ranking, and everybody."""
    scored = rounded(client_ndcg(t.ranking_a, t.ledger, SPEC, TARGET), 9)
    return des.with_global_group(performance_groups(scored), t.clients)


@query(
    "a09_first_period_by_group",
    _GROUPS
    + """SELECT grp, dt, count(*) AS n_clients, round(count(*) / max(size), 6) AS share
         FROM (SELECT chid, min(dt) AS dt FROM ledger WHERE tag IN (SELECT tag FROM leg) GROUP BY chid) JOIN grps USING (chid)
         JOIN (SELECT grp, count(*) AS size FROM grps GROUP BY grp) USING (grp) GROUP BY grp, dt""",
)
def first_period_by_group(t: Tables) -> DataFrame:
    return rounded(des.first_period_by_group(t.ledger, _groups(t), SPEC))


@query(
    "a10_amount_quartiles",
    """SELECT tag, dt, round(quantile_cont(amt_cents, 0.25), 4) AS q25, round(quantile_cont(amt_cents, 0.5), 4) AS q50,
              round(quantile_cont(amt_cents, 0.75), 4) AS q75 FROM ledger GROUP BY 1, 2""",
)
def amount_quartiles(t: Tables) -> DataFrame:
    return rounded(des.amount_quartiles(t.ledger, "amt_cents"), 4)


def _code_sql(rows: str, code: str) -> str:
    return (
        _GROUPS
        + f""", c AS (SELECT grp, {code} AS code, count(*) AS n FROM ({rows}) AS r JOIN grps USING (chid) GROUP BY 1, 2)
         SELECT g.grp AS grp, k.code AS code, coalesce(n, 0) AS n, round(coalesce(n / sum(n) OVER (PARTITION BY g.grp), 0), 6) AS share
         FROM (SELECT DISTINCT grp FROM grps) AS g CROSS JOIN (SELECT DISTINCT {code} AS code FROM ({rows})) AS k
         LEFT JOIN c ON c.grp = g.grp AND c.code = k.code"""
    )


@query("a11_attribute_shares", _code_sql(f"SELECT chid, segment FROM wide WHERE dt = {TARGET}", "segment"))
def attribute_shares(t: Tables) -> DataFrame:
    rows = t.wide.filter(F.col("dt") == TARGET).select("chid", "segment")
    return rounded(des.code_shares(rows, _groups(t), "segment"))


@query("a12_item_shares", _code_sql("SELECT chid, tag FROM ledger WHERE tag IN (SELECT tag FROM leg)", "tag"))
def item_shares(t: Tables) -> DataFrame:
    rows = t.ledger.filter(F.col("tag").isin(*SPEC.legit)).select("chid", "tag")
    return rounded(des.code_shares(rows, _groups(t), "tag"))


@query(
    "a13_limit_histogram",
    """WITH x AS (SELECT ln(1 + lim_cents) AS x FROM profile), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
       SELECT CAST(least(floor((x - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM x, e GROUP BY 1""",
)
def limit_histogram(t: Tables) -> DataFrame:
    return des.log_histogram(t.profile, "lim_cents", 40)


@query("a14_item_frequency", "SELECT chid, tag, count(*) AS pif FROM ledger WHERE dt >= 3 AND dt < 24 GROUP BY 1, 2")
def item_frequency(t: Tables) -> DataFrame:
    return des.item_frequency(t.ledger, 3, 24)


_MONTHS = ", ".join(f"round(coalesce(sum(amt) FILTER (dt = {d}), 0), 1) AS dt{d}" for d in range(1, 28))


@query("a15_amount_heatmap", f"SELECT chid, tag, {_MONTHS} FROM wide GROUP BY 1, 2")
def heatmap(t: Tables) -> DataFrame:
    return des.amount_heatmap(t.priced, SPEC, "amt")
