"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import behavior as beh
from basketry.operators import groupstats as grp
from basketry.operators import labels as lab
from basketry.operators import panel as pan
from basketry.operators import raw
from basketry.operators import stacking as stk
from basketry.operators.metrics import client_ndcg, client_set_flags
from basketry.operators.weights import active_weights
from basketry.plans.dataset import DatasetConfig, PurchaseVector, build_features
from basketry.config import Decay
from basketry.queries.base import SPEC, T_END, TARGET, Tables, query, rounded

OOF = (("lgbm", 2), ("xgb", 3), ("blend", 4))


def _wide_sql(value: str, name: str, fill: str) -> str:
    return ", ".join(f"coalesce(max({value}) FILTER (tag = {x}), {fill}) AS {name}_tag{x}" for x in SPEC.legit)


@query(
    "j01_feature_assembly",
    f"""WITH g AS (SELECT chid, tag, CAST({T_END} - max(dt) AS INTEGER) AS gap, count(*) / CAST({T_END} AS DOUBLE) AS ratio FROM past GROUP BY 1, 2),
        d AS (SELECT chid, tag, sum(CAST(1 AS DOUBLE)) AS freq FROM past WHERE dt >= 13 GROUP BY 1, 2),
        b AS (SELECT chid, tag, gap, round(ratio, 6) AS ratio, coalesce(freq, 0) AS freq FROM g LEFT JOIN d USING (chid, tag))
        SELECT chid, {_wide_sql('freq', 'freq', '0')}, {_wide_sql('gap', 'gap_since_last', '100')},
               {_wide_sql('ratio', 'made_ratio', '0')}, coalesce(max(nation), -1) AS nation
        FROM clients LEFT JOIN b USING (chid)
             LEFT JOIN (SELECT chid, max(nation) AS nation FROM profile WHERE dt <= {T_END} GROUP BY chid) USING (chid)
        GROUP BY chid""",
)
def feature_assembly(t: Tables) -> DataFrame:
    """Spine left joined with all feature blocks."""
    cfg = DatasetConfig(
        T_END,
        purchases={"freq": PurchaseVector(Decay(12, 3, 1.0, 1.0))},
        behavior={"gap_since_last": "leg", "made_ratio": "leg"},
        attributes=("nation",),
    )
    out = build_features(t.ledger, t.profile, t.clients, SPEC, cfg)
    return rounded(out.na.fill(-1, subset=["nation"]))


@query(
    "j02_multiclass_labels",
    """SELECT chid, CAST(h AS BIGINT) AS n_rows, label FROM (SELECT chid, count(*) AS h FROM ledger WHERE dt = 23 GROUP BY chid)
       RIGHT JOIN target_labels USING (chid) WHERE h IS NOT NULL""",
)
def multiclass_labels(t: Tables) -> DataFrame:
    features = t.ledger.filter(F.col("dt") == T_END).groupBy("chid").agg(F.count("*").alias("n_rows"))
    return lab.multiclass_labels(features, lab.label_rows(t.ledger, SPEC, T_END))


@query(
    "j03_binary_labels",
    f"""SELECT l.chid, l.tag, CAST(r.chid IS NOT NULL AS INTEGER) AS bought
        FROM ledger l LEFT JOIN ledger r ON l.chid = r.chid AND l.tag = r.tag AND r.dt = {TARGET} WHERE l.dt = {T_END}""",
)
def binary_labels(t: Tables) -> DataFrame:
    rows = t.ledger.filter(F.col("dt") == T_END).select("chid", "tag")
    return lab.binary_labels(rows, t.ledger, TARGET)


@query(
    "j04_group_stats_to_rows",
    """SELECT chid, nation, segment, m AS amt_cents_mean, n AS txn_cnt_mean FROM attrs
       LEFT JOIN (SELECT nation, segment, round(avg(amt_cents), 4) AS m, round(avg(txn_cnt), 4) AS n FROM wide
                  WHERE dt BETWEEN 18 AND 23 GROUP BY 1, 2) USING (nation, segment)""",
)
def group_stats_to_rows(t: Tables) -> DataFrame:
    keys = ["nation", "segment"]
    stats = grp.windowed_group_stats(t.wide, SPEC, keys, (18, 23), "all", ["amt_cents", "txn_cnt"], ["mean"])
    rows = t.attributes.select("chid", *keys)
    joined = grp.join_group_stats(rows, rounded(stats, 4), keys)
    return joined.select("chid", *keys, "amt_cents_mean", "txn_cnt_mean")


_LAGS = ", ".join(f"CAST(coalesce(max(txn_cnt) FILTER (dt = 23 - {i}), 0) AS BIGINT) AS txn_cnt_lag{i}" for i in range(1, 6))


@query(
    "j05_lags_in_one_pass",
    f"""SELECT chid, tag, max(txn_cnt) FILTER (dt = 23) AS txn_cnt, {_LAGS} FROM ledger WHERE dt BETWEEN 18 AND 23
        GROUP BY chid, tag HAVING bool_or(dt = 23)""",
)
def lags(t: Tables) -> DataFrame:
    return raw.lag_table(t.ledger, SPEC, ["txn_cnt"], T_END, 6)


def _matrix_sql(split: str, models=OOF) -> str:
    cells = ", ".join(
        f"round(max(prob) FILTER (model = '{m}' AND version = {v} AND tag = {x}), 9) AS {m}{v}_tag{x}" for m, v in models for x in SPEC.legit
    )
    named = " OR ".join(f"(model = '{m}' AND version = {v})" for m, v in models)
    return f"""SELECT chid, {cells} FROM preds WHERE split = '{split}' AND ({named})
               GROUP BY chid HAVING count(DISTINCT version) = {len(models)}"""


@query("j06_oof_merge", f"SELECT mat.*, label FROM ({_matrix_sql('oof')}) AS mat JOIN target_labels USING (chid)")
def oof_merge(t: Tables) -> DataFrame:
    store = t.predictions.filter(F.col("split") == "oof")
    return rounded(stk.meta_dataset(store, SPEC, OOF, lab.label_rows(t.ledger, SPEC, T_END)), 9)


@query(
    "j07_align_to_active",
    f"""SELECT chid, coalesce(tag, 0) AS tag, round(w, 4) AS weight FROM (SELECT chid, tag, avg(amt_cents) AS w FROM past GROUP BY 1, 2)
        RIGHT JOIN (SELECT DISTINCT chid FROM actual) USING (chid)""",
)
def align(t: Tables) -> DataFrame:
    aligned = rounded(active_weights(t.ledger, SPEC, T_END, "amt_cents"), 4)
    return aligned.select("chid", F.coalesce("tag", F.lit(0)).alias("tag"), "weight")


@query("j08_dense_grid", "SELECT chid, tag FROM grid")
def dense_grid(t: Tables) -> DataFrame:
    return pan.item_grid(t.clients, SPEC, "leg")


@query("j09_semi_join", "SELECT chid, dt, tag FROM past WHERE chid IN (SELECT chid FROM actual)")
def semi_join(t: Tables) -> DataFrame:
    active = t.ledger.filter(F.col("dt") == TARGET).select("chid").distinct()
    return t.past.join(active, "chid", "left_semi").select("chid", "dt", "tag")


@query("j10_anti_join", "SELECT chid FROM clients WHERE chid NOT IN (SELECT chid FROM actual)")
def anti_join(t: Tables) -> DataFrame:
    return t.clients.join(t.ledger.filter(F.col("dt") == TARGET).select("chid"), "chid", "left_anti")


@query("j11_key_concat", "SELECT chid, dt, tag, amt_cents, prio FROM wide")
def key_concat(t: Tables) -> DataFrame:
    """Two tables of the same rows side by side: matched by key, as rows have no position."""
    return t.ledger.join(t.profile, ["chid", "dt"]).select("chid", "dt", "tag", "amt_cents", "prio")


@query(
    "j12_client_sets",
    """SELECT coalesce(a.chid, b.chid) AS chid,
              CASE WHEN b.chid IS NULL THEN 'only_a' WHEN a.chid IS NULL THEN 'only_b' ELSE 'both' END AS member
       FROM (SELECT chid FROM ndcg_a WHERE ndcg = 0) a FULL JOIN (SELECT chid FROM ndcg_b WHERE ndcg = 0) b ON a.chid = b.chid""",
)
def client_sets(t: Tables) -> DataFrame:
    """Clients missed by two rankings: in both, only the first, only the second."""
    zero_a, zero_b = (
        client_ndcg(r, t.ledger, SPEC, TARGET).filter(F.col("ndcg") == 0) for r in (t.ranking_a, t.ranking_b)
    )
    return client_set_flags(zero_a, zero_b)


@query(
    "j13_append_missing",
    f"""SELECT chid, prio FROM profile WHERE dt = {T_END}
        UNION ALL
        SELECT chid, prio FROM (SELECT chid, prio, row_number() OVER (PARTITION BY chid ORDER BY dt DESC) AS rn FROM profile WHERE dt <= {T_END})
        WHERE rn = 1 AND chid NOT IN (SELECT chid FROM profile WHERE dt = {T_END})""",
)
def append_missing(t: Tables) -> DataFrame:
    here = raw.attributes_at(t.profile, ["prio"], T_END)
    missing = raw.latest_attributes(t.profile, ["prio"], T_END).join(here, "chid", "left_anti")
    return here.unionByName(missing)


@query(
    "j14_restack",
    f"""SELECT mat.*, gaps.* EXCLUDE (chid) FROM ({_matrix_sql('unseen')}) AS mat
        LEFT JOIN (SELECT chid, {_wide_sql('g', 'gap_since_last', '100')}
                   FROM clients LEFT JOIN (SELECT chid, tag, CAST({T_END} - max(dt) AS INTEGER) AS g FROM past GROUP BY 1, 2) USING (chid)
                   GROUP BY chid) AS gaps USING (chid)""",
)
def restack(t: Tables) -> DataFrame:
    gaps = beh.behavior(t.ledger, t.clients, SPEC, T_END, ["gap_since_last"])
    store = t.predictions.filter(F.col("split") == "unseen")
    meta = stk.meta_dataset(store, SPEC, OOF, features=pan.pivot_items(gaps, SPEC, ["gap_since_last"]))
    return rounded(meta, 9)
