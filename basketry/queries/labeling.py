"""Labels, folds and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.hashing import key_hash_sql
from basketry.operators import labels as lab
from basketry.operators import weights as wts
from basketry.operators.metrics import client_ndcg
from basketry.queries.base import SPEC, T_END, TARGET, Tables, query, rounded


@query("l01_label_rows", "SELECT chid, tag, label FROM target_labels")
def label_rows(t: Tables) -> DataFrame:
    return lab.label_rows(t.ledger, SPEC, T_END)


@query("l02_warm_clients", "SELECT chid FROM warm")
def warm_clients(t: Tables) -> DataFrame:
    return lab.warm_clients(t.ledger, SPEC, T_END)


@query("l03_eligible_clients", "SELECT chid FROM warm WHERE chid NOT IN (SELECT chid FROM ndcg_b WHERE ndcg = 0)")
def eligible(t: Tables) -> DataFrame:
    missed = client_ndcg(t.ranking_b, t.ledger, SPEC, TARGET).filter(F.col("ndcg") == 0)
    return lab.eligible_clients(t.ledger, SPEC, T_END, blocked=missed)


@query(
    "l04_multi_hot",
    "SELECT chid, "
    + ", ".join(f"CAST(bool_or(label = {i}) AS INTEGER) AS y{i}" for i in range(len(SPEC.legit)))
    + " FROM target_labels GROUP BY chid",
)
def multi_hot(t: Tables) -> DataFrame:
    hot = lab.multi_hot(lab.label_rows(t.ledger, SPEC, T_END), len(SPEC.legit))
    return hot.select("chid", *[F.get("hot", F.lit(i)).alias(f"y{i}") for i in range(len(SPEC.legit))])


@query(
    "l05_temporal_folds",
    """SELECT fold, split, t_end, l.dt AS dt, chid, tag FROM
       (VALUES (0, 'train', 20, 21), (0, 'valid', 21, 22), (1, 'train', 21, 22), (1, 'valid', 22, 23), (2, 'train', 22, 23), (2, 'valid', 23, 24))
       AS f(fold, split, t_end, pred) JOIN ledger l ON l.dt = f.pred WHERE tag IN (SELECT tag FROM leg)""",
)
def temporal_folds(t: Tables) -> DataFrame:
    return lab.fold_label_rows(t.ledger, SPEC, lab.temporal_folds(3, TARGET))


@query(
    "l06_row_folds",
    f"""SELECT chid, tag, label, CAST({key_hash_sql('chid', 168)} % 5 AS INTEGER) AS fold,
               CAST({key_hash_sql(f'chid * {lab.ROW_KEY_STEP} + tag', 168)} % 5 AS INTEGER) AS row_fold FROM target_labels""",
)
def row_folds(t: Tables) -> DataFrame:
    by_row = lab.row_folds(lab.label_rows(t.ledger, SPEC, T_END), 5, by_client=False)
    return lab.row_folds(by_row.withColumnRenamed("fold", "row_fold"), 5)


_WEIGHTS = """
    WITH mw AS (SELECT chid, tag, avg(amt_cents) / CAST(100 AS DOUBLE) AS w FROM past GROUP BY 1, 2),
         aw AS (SELECT mw.* FROM mw JOIN (SELECT DISTINCT chid FROM actual) USING (chid)),
         fills AS (SELECT tag, quantile_cont(w, 0.25) AS denoise FROM aw GROUP BY tag),
         raw AS (SELECT l.chid AS chid, l.tag AS tag, l.label AS label, coalesce(w, denoise) AS raw
                 FROM target_labels l LEFT JOIN aw ON aw.chid = l.chid AND aw.tag = l.tag LEFT JOIN fills ON fills.tag = l.tag)
"""


def _weights(t: Tables) -> DataFrame:
    cells = wts.active_weights(t.ledger, SPEC, T_END, "amt_cents", 100.0)
    return wts.label_weights(lab.label_rows(t.ledger, SPEC, T_END), cells)


@query("w01_mean_weights", _WEIGHTS + "SELECT chid, tag, round(w, 4) AS weight FROM mw")
def mean_weights(t: Tables) -> DataFrame:
    return rounded(wts.mean_weights(t.ledger, T_END, "amt_cents", 100.0), 4)


@query(
    "w02_imputed_weights",
    """WITH mc AS (SELECT chid, tag, avg(amt_cents) AS w FROM past GROUP BY 1, 2),
            ac AS (SELECT mc.* FROM mc JOIN (SELECT DISTINCT chid FROM actual) USING (chid)),
            fc AS (SELECT tag, quantile_cont(w, 0.25) AS denoise, median(w) AS med, avg(w) AS mean FROM ac GROUP BY tag),
            lc AS (SELECT l.chid AS chid, l.tag AS tag, w, denoise, med, mean FROM target_labels l
                   LEFT JOIN ac ON ac.chid = l.chid AND ac.tag = l.tag LEFT JOIN fc ON fc.tag = l.tag)
       SELECT 'denoise' AS method, chid, tag, round(coalesce(w, denoise), 6) AS raw FROM lc
       UNION ALL SELECT 'median', chid, tag, round(coalesce(w, med), 6) FROM lc
       UNION ALL SELECT 'mean', chid, tag, round(coalesce(w, mean), 6) FROM lc
       UNION ALL SELECT 'pseudo_zero', chid, tag, round(coalesce(w, 797.165663), 6) FROM lc""",
)
def imputed_weights(t: Tables) -> DataFrame:
    """Every imputation, in cents; an amount of 797.17 stands for an empty cell in ``pseudo_zero``."""
    labels = lab.label_rows(t.ledger, SPEC, T_END)
    cells = wts.active_weights(t.ledger, SPEC, T_END, "amt_cents")
    out = None
    for method in ("denoise", "median", "mean", "pseudo_zero"):
        rows = wts.label_weights(labels, cells, method).select(F.lit(method).alias("method"), "chid", "tag", "raw")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)


@query("w03_scaled_weights", _WEIGHTS + "SELECT chid, tag, round(raw / max(raw) OVER (PARTITION BY chid), 6) AS scaled FROM raw")
def scaled_weights(t: Tables) -> DataFrame:
    return rounded(_weights(t).select("chid", "tag", "scaled"))


@query(
    "w04_final_weights",
    _WEIGHTS + "SELECT chid, tag, label, round(exp(raw / max(raw) OVER (PARTITION BY chid)), 6) AS weight FROM raw",
)
def final_weights(t: Tables) -> DataFrame:
    return rounded(_weights(t).select("chid", "tag", "label", "weight"))


@query(
    "w05_class_weights",
    """SELECT label, count(*) AS n_class, round((SELECT count(*) FROM target_labels) / ((SELECT count(DISTINCT label) FROM target_labels) * CAST(count(*) AS DOUBLE)), 6)
       AS class_weight FROM target_labels GROUP BY label""",
)
def class_weights(t: Tables) -> DataFrame:
    return rounded(wts.class_weights(lab.label_rows(t.ledger, SPEC, T_END)))
