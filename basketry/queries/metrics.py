"""Metrics and analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import behavior as beh
from basketry.operators import metrics as met
from basketry.queries.base import SPEC, T_END, TARGET, Tables, query, rounded


def _ndcg(t: Tables, which: str = "a") -> DataFrame:
    return met.client_ndcg(t.ranking_a if which == "a" else t.ranking_b, t.ledger, SPEC, TARGET)


@query("m01_mean_ndcg", "SELECT count(*) AS n_clients, round(avg(ndcg), 9) AS ndcg FROM ndcg_b")
def mean_ndcg(t: Tables) -> DataFrame:
    return rounded(met.mean_ndcg(_ndcg(t, "b")), 9)


@query(
    "m01_distinct_ndcg",
    """SELECT chid, round(sum(coalesce(amt_cents, 0) / log2(pos + 1)) / max(ideal), 9) AS ndcg
       FROM (SELECT chid, tag, min(pos) AS pos FROM (SELECT chid, unnest([1, 2, 3]) AS pos, unnest([top1, top2, top3]) AS tag FROM rank_a) GROUP BY 1, 2)
       JOIN ideal USING (chid) LEFT JOIN actual USING (chid, tag) GROUP BY chid""",
)
def distinct_ndcg(t: Tables) -> DataFrame:
    return rounded(met.client_ndcg(t.ranking_a, t.ledger, SPEC, TARGET, distinct=True), 9)


@query("m02_client_ndcg", "SELECT chid, round(ndcg, 9) AS ndcg FROM ndcg_a")
def client_ndcg(t: Tables) -> DataFrame:
    return rounded(_ndcg(t), 9)


# a made-up score of each document against its labels
_SCORED = """
    WITH scored AS (SELECT *, (quality * 2 + (doc_id * 31 + 17) % 97 / CAST(97 AS DOUBLE)) / 3 AS s FROM labels),
         cf AS (SELECT count(*) FILTER (s > 0.5 AND quality = 1) AS tp, count(*) FILTER (s > 0.5 AND quality = 0) AS fp,
                       count(*) FILTER (s <= 0.5 AND quality = 1) AS fn, count(*) FILTER (s <= 0.5 AND quality = 0) AS tn
                FROM (SELECT (doc_id * 31 + quality * 40 + 17) % 97 / CAST(97 AS DOUBLE) AS s, quality FROM labels))
"""


def _confusion(t: Tables) -> DataFrame:
    score = ((F.col("doc_id") * 31 + F.col("quality") * 40 + 17) % 97) / F.lit(97.0)
    return met.confusion(t.table("labels").withColumn("s", score), "s", "quality", 0.5)


@query("m03_confusion", _SCORED + "SELECT tp, fp, fn, tn FROM cf")
def confusion(t: Tables) -> DataFrame:
    return _confusion(t)


@query(
    "m04_binary_scores",
    _SCORED
    + """SELECT round((tp + tn) / (tp + fp + fn + tn), 9) AS acc, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
                round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM cf""",
)
def binary_scores(t: Tables) -> DataFrame:
    return rounded(met.binary_scores(_confusion(t)).drop("auc"), 9)


@query("m05_label_auc", _SCORED + "SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS auc FROM cf")
def label_auc(t: Tables) -> DataFrame:
    return rounded(met.binary_scores(_confusion(t)).select("auc"), 9)


@query(
    "m06_binary_rates",
    _SCORED
    + """SELECT round(fp / (fp + tn), 9) AS fpr, round(fn / (tp + fn), 9) AS fnr, round(tn / (tn + fp), 9) AS tnr, round(tn / (tn + fn), 9) AS npv,
                round(fp / (tp + fp), 9) AS fdr, round(tp / (tp + fn), 9) AS tpr, round(tp / (tp + fp), 9) AS ppv,
                round((tp + tn) / (tp + fp + fn + tn), 9) AS acc FROM cf""",
)
def binary_rates(t: Tables) -> DataFrame:
    return rounded(met.binary_rates(_confusion(t)), 9)


@query(
    "m07_zero_summary",
    """SELECT count(*) AS n_clients, count(*) FILTER (ndcg = 0) AS n_zero, round(avg(ndcg), 9) AS ndcg,
              round(sum(ndcg) / count(*) FILTER (ndcg <> 0), 9) AS ndcg_without_zeros,
              round(count(*) FILTER (ndcg <> 0) / count(*), 9) AS ceiling FROM ndcg_a""",
)
def zero_summary(t: Tables) -> DataFrame:
    return rounded(met.zero_summary(_ndcg(t)), 9)


@query(
    "m08_ndcg_bands",
    """SELECT CASE WHEN ndcg <= 0 THEN 'zero' WHEN ndcg <= 0.3 THEN '0-0.3' WHEN ndcg <= 0.6 THEN '0.3-0.6'
                   WHEN ndcg <= 0.7 THEN '0.6-0.7' WHEN ndcg <= 1 THEN '0.7-1' ELSE 'above' END AS band,
              count(*) AS n_clients, round(count(*) / (SELECT count(*) FROM ndcg_a), 9) AS share
       FROM (SELECT round(ndcg, 9) AS ndcg FROM ndcg_a) GROUP BY 1""",
)
def ndcg_bands(t: Tables) -> DataFrame:
    return rounded(met.ndcg_bands(rounded(_ndcg(t), 9)), 9)


@query(
    "m09_model_discrepancy",
    """WITH j AS (SELECT a.top1 = b.top1 AND a.top2 = b.top2 AND a.top3 = b.top3 AS same, round(na.ndcg, 9) AS na, round(nb.ndcg, 9) AS nb
                  FROM rank_a a JOIN rank_b b USING (chid) JOIN ndcg_a na USING (chid) JOIN ndcg_b nb USING (chid))
       SELECT CASE WHEN same AND na = 1 THEN 'same_full_hit' WHEN same THEN 'same_miss' WHEN na = 1 THEN 'diff_full_hit_a'
                   WHEN nb = 1 THEN 'diff_full_hit_b' WHEN na > nb THEN 'diff_better_a' WHEN na < nb THEN 'diff_better_b'
                   ELSE 'diff_equal' END AS outcome,
              count(*) AS n_clients, round(avg(na), 6) AS mean_a, round(stddev_pop(na), 6) AS std_a,
              round(avg(nb), 6) AS mean_b, round(stddev_pop(nb), 6) AS std_b
       FROM j WHERE na > 0 AND nb > 0 GROUP BY 1""",
)
def model_discrepancy(t: Tables) -> DataFrame:
    a, b = rounded(_ndcg(t), 9), rounded(_ndcg(t, "b"), 9)
    return rounded(met.compare_models(t.ranking_a, t.ranking_b, a, b))


_CDF = f"""
    WITH gaps AS (SELECT tag, avg(dt - prev - 1) AS g
                  FROM (SELECT chid, tag, dt, lag(dt) OVER (PARTITION BY chid, tag ORDER BY dt) AS prev FROM past WHERE tag IN (SELECT tag FROM leg))
                  GROUP BY chid, tag HAVING count(*) > 1),
         binned AS (SELECT tag, least(CAST(floor(g) AS INTEGER) + 1, 11) AS b, count(*) AS n FROM gaps GROUP BY 1, 2),
         cdf AS (SELECT t.tag AS tag, k.b AS b, coalesce(n, 0) AS n_clients,
                        sum(coalesce(n, 0)) OVER (PARTITION BY t.tag ORDER BY k.b) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY t.tag) AS DOUBLE) AS cdf
                 FROM (SELECT DISTINCT tag FROM binned) AS t CROSS JOIN (SELECT CAST(unnest(range(1, 12)) AS INTEGER) AS b) AS k
                 LEFT JOIN binned ON binned.tag = t.tag AND binned.b = k.b)
"""


def _cdf(t: Tables) -> DataFrame:
    gaps = beh.behavior(t.ledger, t.clients, SPEC, T_END, ["avg_gap"])
    return met.gap_cdf(gaps)


@query("m10_gap_cdf", _CDF + "SELECT tag, b, n_clients, round(cdf, 9) AS cdf FROM cdf")
def gap_cdf(t: Tables) -> DataFrame:
    return rounded(_cdf(t), 9)


@query(
    "m11_break_point_weights",
    _CDF
    + """, e AS (SELECT tag, max(cdf) FILTER (b = 3) AS x, max(cdf) FILTER (b = 4) AS y FROM cdf GROUP BY tag)
         SELECT tag, 0 AS part, round(x, 9) AS weight FROM e UNION ALL SELECT tag, 1, round(y - x, 9) FROM e
         UNION ALL SELECT tag, 2, round(1 - y, 9) FROM e""",
)
def break_point_weights(t: Tables) -> DataFrame:
    return rounded(met.break_point_weights(_cdf(t), [3, 4]), 9)
