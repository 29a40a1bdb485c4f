"""Behaviour features, raw values and the client dimension.

The SQL sides work period by period on the dense purchase map, not with the closed forms of the Spark side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import behavior as beh
from basketry.operators import panel as pan
from basketry.operators import raw
from basketry.queries.base import SPEC, T_END, Tables, query, rounded

PSEUDO = 797.165663

# dense client x legit item x period map with the previous period
_MAP = f"""
    WITH pmap AS (SELECT g.chid, g.tag, m.dt, CAST(l.chid IS NOT NULL AS INTEGER) AS b
                  FROM grid g CROSS JOIN (SELECT dt FROM periods WHERE dt <= {T_END}) AS m
                  LEFT JOIN ledger l ON l.chid = g.chid AND l.tag = g.tag AND l.dt = m.dt),
         seq AS (SELECT *, lag(b) OVER (PARTITION BY chid, tag ORDER BY dt) AS prev,
                        CASE WHEN b = 1 THEN lag(CASE WHEN b = 1 THEN dt END) OVER (PARTITION BY chid, tag, b ORDER BY dt) END AS prev_dt
                 FROM pmap)
"""


def _feature(t: Tables, name: str) -> DataFrame:
    return rounded(beh.behavior_feature(name, t.ledger, t.clients, SPEC, T_END))


@query(
    "b00_purchase_map",
    f"""SELECT c.chid AS chid, i.tag AS tag, m.dt AS dt, CAST(l.chid IS NOT NULL AS INTEGER) AS bought
        FROM clients c CROSS JOIN items i CROSS JOIN (SELECT dt FROM periods WHERE dt <= {T_END}) AS m
        LEFT JOIN ledger l ON l.chid = c.chid AND l.tag = i.tag AND l.dt = m.dt""",
)
def purchase_map(t: Tables) -> DataFrame:
    return pan.purchase_map(t.ledger, t.clients, SPEC, T_END)


@query(
    "b00_feature_map",
    f"""SELECT g.chid AS chid, g.tag AS tag, m.dt AS dt, round(coalesce(nullif(amt_cents / CAST(100 AS DOUBLE), 0), {PSEUDO}), 6) AS value
        FROM grid g CROSS JOIN (SELECT dt FROM periods WHERE dt BETWEEN 12 AND {T_END}) AS m
        LEFT JOIN ledger l ON l.chid = g.chid AND l.tag = g.tag AND l.dt = m.dt""",
)
def feature_map(t: Tables) -> DataFrame:
    return rounded(pan.feature_map(t.priced, t.clients, SPEC, "amt", PSEUDO, (12, T_END), "leg"))


@query(
    "b02_gap_since_first",
    _MAP + f"SELECT chid, tag, coalesce({T_END} - min(dt) FILTER (b = 1), 100) AS gap_since_first FROM pmap GROUP BY 1, 2",
)
def gap_since_first(t: Tables) -> DataFrame:
    return _feature(t, "gap_since_first")


@query(
    "b03_gap_since_last",
    _MAP + f"SELECT chid, tag, coalesce({T_END} - max(dt) FILTER (b = 1), 100) AS gap_since_last FROM pmap GROUP BY 1, 2",
)
def gap_since_last(t: Tables) -> DataFrame:
    return _feature(t, "gap_since_last")


@query(
    "b04_mean_gap",
    _MAP + "SELECT chid, tag, round(coalesce(avg(dt - prev_dt - 1), 100), 6) AS avg_gap FROM seq GROUP BY 1, 2",
)
def mean_gap(t: Tables) -> DataFrame:
    return _feature(t, "avg_gap")


@query(
    "b05_state_toggles",
    _MAP
    + """SELECT chid, tag, CAST(count(*) FILTER (prev = 0 AND b = 0) AS INTEGER) AS n00, CAST(count(*) FILTER (prev = 0 AND b = 1) AS INTEGER) AS n01,
                CAST(count(*) FILTER (prev = 1 AND b = 0) AS INTEGER) AS n10, CAST(count(*) FILTER (prev = 1 AND b = 1) AS INTEGER) AS n11
         FROM seq GROUP BY 1, 2""",
)
def state_toggles(t: Tables) -> DataFrame:
    return _feature(t, "st_tgl")


@query("b06_made_ratio", _MAP + f"SELECT chid, tag, round(sum(b) / CAST({T_END} AS DOUBLE), 6) AS made_ratio FROM pmap GROUP BY 1, 2")
def made_ratio(t: Tables) -> DataFrame:
    return _feature(t, "made_ratio")


@query(
    "b07_items_per_period",
    "SELECT chid, "
    + ", ".join(f"count(DISTINCT tag) FILTER (dt = {T_END} - {i}) AS n_items_lag{i}" for i in range(6))
    + " FROM clients LEFT JOIN (SELECT * FROM ledger WHERE tag IN (SELECT tag FROM leg)) USING (chid) GROUP BY chid",
)
def items_per_period(t: Tables) -> DataFrame:
    return _feature(t, "n_shop_tags")


@query("b08_bought_at_end", _MAP + f"SELECT chid, tag, b AS purch_t_end FROM pmap WHERE dt = {T_END}")
def bought_at_end(t: Tables) -> DataFrame:
    return _feature(t, "purch_t_end")


@query(
    "b01_all_features",
    _MAP
    + f"""SELECT chid, tag, coalesce({T_END} - min(dt) FILTER (b = 1), 100) AS gap_since_first,
                 coalesce({T_END} - max(dt) FILTER (b = 1), 100) AS gap_since_last, round(coalesce(avg(dt - prev_dt - 1), 100), 6) AS avg_gap,
                 CAST(count(*) FILTER (prev = 1 AND b = 1) AS INTEGER) AS n11, round(sum(b) / CAST({T_END} AS DOUBLE), 6) AS made_ratio
          FROM seq GROUP BY 1, 2""",
)
def all_features(t: Tables) -> DataFrame:
    """Several features from the one shared aggregate."""
    names = ["gap_since_first", "gap_since_last", "avg_gap", "n11", "made_ratio"]
    return rounded(beh.behavior(t.ledger, t.clients, SPEC, T_END, names))


@query(
    "b09_old_gap",
    """SELECT c.chid AS chid, i.tag AS tag, round(coalesce(g, 24.0), 6) AS old_gap FROM clients c CROSS JOIN items i LEFT JOIN
       (SELECT chid, tag, avg(dt - prev - 1) AS g
        FROM (SELECT chid, tag, dt, lag(dt) OVER (PARTITION BY chid, tag ORDER BY dt) AS prev FROM ledger WHERE txn_cnt <> 0) GROUP BY 1, 2) AS s
       ON s.chid = c.chid AND s.tag = i.tag""",
)
def old_gap(t: Tables) -> DataFrame:
    return rounded(beh.old_gaps(t.ledger, t.clients, SPEC))


_LAGS = ", ".join(
    f"CAST(coalesce(max(amt_cents) FILTER (dt = 23 - {i}), 0) AS BIGINT) AS amt_cents{'' if i == 0 else f'_lag{i}'}" for i in range(4)
)


@query("r01_lags_on_rows", f"SELECT chid, tag, {_LAGS} FROM ledger WHERE tag IN (SELECT tag FROM leg) GROUP BY 1, 2 HAVING bool_or(dt = 23)")
def lags_on_rows(t: Tables) -> DataFrame:
    return raw.lag_table(t.ledger, SPEC, ["amt_cents"], T_END, 4, "leg")


@query("r01_lags_on_grid", f"SELECT chid, tag, {_LAGS} FROM grid LEFT JOIN ledger USING (chid, tag) GROUP BY 1, 2")
def lags_on_grid(t: Tables) -> DataFrame:
    return raw.lag_table(t.ledger, SPEC, ["amt_cents"], T_END, 4, "leg", t.clients)


_FLAT = ", ".join(
    f"CAST(coalesce(max(txn_cnt) FILTER (dt = 23 - {lag} AND tag = {x}), 0) AS DOUBLE) AS txn_cnt_lag{lag}_tag{x}"
    for lag in range(6)
    for x in SPEC.legit
)


@query("r02_flat_vector", f"SELECT chid, {_FLAT} FROM clients LEFT JOIN ledger USING (chid) GROUP BY chid")
def flat_vector(t: Tables) -> DataFrame:
    return raw.flat_vector(t.ledger, t.clients, SPEC, "txn_cnt", T_END, (6, 0))


@query("r03_attributes_at_end", "SELECT chid, nation, segment, prio FROM profile WHERE dt = 23")
def attributes_at_end(t: Tables) -> DataFrame:
    return raw.client_attributes(t.profile, ["nation", "segment", "prio"], T_END)


_LATEST = "(SELECT *, row_number() OVER (PARTITION BY chid ORDER BY dt DESC) AS rn FROM profile WHERE dt <= 23)"


@query(
    "r03_attributes_of_all",
    f"SELECT chid, coalesce(nation, -1) AS nation, coalesce(segment, '-') AS segment, coalesce(prio, -1) AS prio FROM clients LEFT JOIN (SELECT * FROM {_LATEST} WHERE rn = 1) USING (chid)",
)
def attributes_of_all(t: Tables) -> DataFrame:
    rows = raw.client_attributes(t.profile, ["nation", "segment", "prio"], T_END, t.clients)
    return rows.na.fill(-1).na.fill("-")


@query("r04_latest_attributes", f"SELECT chid, nation, prio, lim_cents FROM {_LATEST} WHERE rn = 1")
def latest_attributes(t: Tables) -> DataFrame:
    return raw.latest_attributes(t.profile, ["nation", "prio", "lim_cents"], T_END)


@query(
    "r05_filled_limit",
    """SELECT chid, dt, coalesce(last_value(lim_cents IGNORE NULLS) OVER (PARTITION BY chid ORDER BY dt), 0) AS lim_cents
       FROM (SELECT DISTINCT chid FROM profile) CROSS JOIN periods LEFT JOIN (SELECT chid, dt, lim_cents FROM profile) USING (chid, dt)""",
)
def filled_limit(t: Tables) -> DataFrame:
    return raw.filled_limit(t.profile, "lim_cents", SPEC.n_periods)


@query(
    "r06_melt",
    "SELECT chid, 'n_items_lag' || CAST(lag AS VARCHAR) AS lag_name, n AS n_items FROM "
    "(SELECT chid, unnest(range(6)) AS lag FROM clients) LEFT JOIN (SELECT chid, 23 - dt AS lag, count(*) AS n "
    "FROM ledger WHERE tag IN (SELECT tag FROM leg) GROUP BY 1, 2) USING (chid, lag)".replace("n AS n_items", "coalesce(n, 0) AS n_items"),
)
def melt(t: Tables) -> DataFrame:
    wide = beh.items_per_period(t.ledger, t.clients, SPEC, T_END)
    return raw.melt(wide, [c for c in wide.columns if c != "chid"], "lag_name", "n_items")


_PAIRS = {"txn": ("amt_cents", "txn_cnt"), "a": ("cents_a", "cnt_a"), "n": ("cents_n", "cnt_n"), "r": ("cents_r", "cnt_r")}
_IMPUTED = 1025.89962


def _apc_sql(name: str, amount: str, count: str) -> str:
    a = f"(CASE WHEN {amount} = 0 THEN {_IMPUTED} ELSE {amount} / CAST(100 AS DOUBLE) END)"
    return f"""round({a} / nullif({count}, 0), 6) AS {name}_apc,
               CASE WHEN {count} = 0 THEN 0 WHEN {a} < {_IMPUTED} THEN 1 WHEN {a} = {_IMPUTED} THEN 2 ELSE 3 END AS {name}_apc_state"""


@query("r07_amount_per_count", f"SELECT chid, dt, tag, {', '.join(_apc_sql(n, a, c) for n, (a, c) in _PAIRS.items())} FROM ledger")
def amount_per_count(t: Tables) -> DataFrame:
    return rounded(raw.amount_per_count(t.ledger, _PAIRS, _IMPUTED, scale=100.0))


@query(
    "r08_spines",
    """SELECT 'production' AS spine, chid, 0 AS tag FROM clients UNION ALL SELECT DISTINCT 'active', chid, 0 FROM ledger WHERE dt = 23
       UNION ALL SELECT 'binary', chid, tag FROM ledger WHERE dt = 23 AND tag IN (SELECT tag FROM leg)""",
)
def spines(t: Tables) -> DataFrame:
    out = None
    for mode in ("production", "active", "binary"):
        rows = raw.spine(t.ledger, t.clients, SPEC, T_END, mode)
        tag = F.col("tag") if mode == "binary" else F.lit(0).alias("tag")
        rows = rows.select(F.lit(mode).alias("spine"), "chid", tag)
        out = rows if out is None else out.unionByName(rows)
    return out
