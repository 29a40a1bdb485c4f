"""Meta-datasets, seed averages and blends with deterministic scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import behavior as beh
from basketry.operators import labels as lab
from basketry.operators import stacking as stk
from basketry.operators.linesearch import MAX_ROUNDS, blend_line_search
from basketry.operators.metrics import client_ndcg
from basketry.operators.ranking import rank_by_probability
from basketry.queries.base import MODELS, SPEC, T_END, TARGET, Tables, query, rounded
from basketry.queries.joining import OOF, _matrix_sql

BLEND = {("lgbm", 1): 0.144372, ("lgbm", 2): 0.856641, ("xgb", 3): 0.307942, ("blend", 4): 0.19094}


@query(
    "p04_meta_dataset",
    f"""SELECT mat.*, label, gaps.n_items_lag0 AS n_items_lag0 FROM ({_matrix_sql('oof')}) AS mat JOIN target_labels USING (chid)
        JOIN (SELECT chid, count(DISTINCT tag) FILTER (dt = {T_END} AND tag IN (SELECT tag FROM leg)) AS n_items_lag0
              FROM clients LEFT JOIN ledger USING (chid) GROUP BY chid) AS gaps USING (chid)""",
)
def meta_dataset(t: Tables) -> DataFrame:
    """Out-of-fold predictions of several models, labels, and raw features next to them."""
    store = t.predictions.filter(F.col("split") == "oof")
    features = beh.items_per_period(t.ledger, t.clients, SPEC, T_END, periods=1)
    return rounded(stk.meta_dataset(store, SPEC, OOF, lab.label_rows(t.ledger, SPEC, T_END), features), 9)


@query("p05_unseen_meta_dataset", _matrix_sql("unseen", MODELS))
def unseen_meta_dataset(t: Tables) -> DataFrame:
    return rounded(stk.meta_dataset(t.predictions.filter(F.col("split") == "unseen"), SPEC, MODELS), 9)


@query("p07_seed_average", "SELECT chid, tag, round(avg(prob), 9) AS prob FROM preds WHERE split = 'unseen' GROUP BY 1, 2")
def seed_average(t: Tables) -> DataFrame:
    refits = t.predictions.filter(F.col("split") == "unseen").withColumnRenamed("version", "seed")
    return rounded(stk.seed_average(refits), 9)


_BLENDED = (
    "round(sum(prob * CASE "
    + " ".join(f"WHEN model = '{m}' AND version = {v} THEN CAST({w} AS DOUBLE)" for (m, v), w in BLEND.items())
    + " END), 9)"
)


@query("p08_blend", f"SELECT chid, tag, {_BLENDED} AS prob FROM preds WHERE split = 'unseen' GROUP BY 1, 2")
def blend(t: Tables) -> DataFrame:
    return rounded(stk.blend(t.predictions.filter(F.col("split") == "unseen"), BLEND), 9)


_RANK_SQL = """top AS (SELECT chid, tag, prob, row_number() OVER (PARTITION BY chid ORDER BY prob DESC, tag DESC) AS pos FROM bl)"""


@query(
    "p08_equal_blend_ndcg",
    f"""WITH bl AS (SELECT chid, tag, round(sum(prob * 0.25), 9) AS prob FROM preds WHERE split = 'unseen' GROUP BY 1, 2), {_RANK_SQL}
        SELECT chid, round(sum(coalesce(amt_cents, 0) / log2(pos + 1)) / max(ideal), 9) AS ndcg
        FROM (SELECT * FROM top WHERE pos <= 3) JOIN ideal USING (chid) LEFT JOIN actual USING (chid, tag) GROUP BY chid""",
)
def equal_blend(t: Tables) -> DataFrame:
    """Equal weights, ranked and scored."""
    mixed = rounded(stk.blend(t.predictions.filter(F.col("split") == "unseen"), MODELS), 9)
    return rounded(client_ndcg(rank_by_probability(mixed, SPEC), t.ledger, SPEC, TARGET), 9)


# candidate weights are multiples of 1/8, so sums of scores tie in the same way everywhere
CANDIDATES = [
    [1.0, 0.0, 0.0, 0.0],
    [0.0, 1.0, 0.0, 0.0],
    [0.25, 0.25, 0.25, 0.25],
    [0.5, 0.25, 0.125, 0.125],
    [0.125, 0.5, 0.25, 0.125],
    [0.0, 0.5, 0.0, 0.5],
]
_CAND = ", ".join(f"({i}, {a}, {b}, {c}, {d})" for i, (a, b, c, d) in enumerate(CANDIDATES))


@query(
    "p09_blend_weight_search",
    f"""WITH cand AS (SELECT * FROM (VALUES {_CAND}) AS c(candidate, w1, w2, w3, w4)),
        p AS (SELECT chid, tag, max(num) FILTER (version = 1) AS p1, max(num) FILTER (version = 2) AS p2, max(num) FILTER (version = 3) AS p3,
                     max(num) FILTER (version = 4) AS p4 FROM (SELECT *, round(prob * 97) AS num FROM preds WHERE split = 'unseen') GROUP BY 1, 2),
        bl AS (SELECT candidate, chid, tag, p1 * CAST(w1 AS DOUBLE) + p2 * CAST(w2 AS DOUBLE) + p3 * CAST(w3 AS DOUBLE) + p4 * CAST(w4 AS DOUBLE) AS s
               FROM p CROSS JOIN cand),
        top AS (SELECT candidate, chid, tag, row_number() OVER (PARTITION BY candidate, chid ORDER BY s DESC, tag DESC) AS pos FROM bl),
        n AS (SELECT candidate, chid, sum(coalesce(amt_cents, 0) / log2(pos + 1)) / max(ideal) AS ndcg FROM top
              JOIN ideal USING (chid) LEFT JOIN actual USING (chid, tag) WHERE pos <= 3 GROUP BY 1, 2)
        SELECT candidate, count(*) AS n_clients, round(avg(ndcg), 9) AS ndcg FROM n GROUP BY candidate""",
)
def blend_search(t: Tables) -> DataFrame:
    """Candidate weight vectors scored by NDCG in one job (probabilities in whole 97ths, so ties are exact)."""
    store = t.predictions.filter(F.col("split") == "unseen").withColumn("prob", F.round(F.col("prob") * 97))
    return rounded(stk.blend_search(store, t.ledger, SPEC, TARGET, MODELS, CANDIDATES), 9)


def _line_search_sql() -> str:
    """The rounds one after the other; a round that gains nothing keeps the weights."""
    k = len(MODELS)
    score = "floor((coalesce(max(a) FILTER (pos = 1), 0) + coalesce(max(a) FILTER (pos = 2), 0) / log2(3) + coalesce(max(a) FILTER (pos = 3), 0) / 2) / max(ideal) * 1e9 + 0.5)"
    sql = """WITH t3 AS MATERIALIZED (SELECT chid, CAST(amt_cents AS DOUBLE) AS a, row_number() OVER (PARTITION BY chid ORDER BY amt_cents DESC) AS rn
                FROM actual WHERE tag IN (SELECT tag FROM leg)),
        top3 AS MATERIALIZED (SELECT chid, coalesce(max(a) FILTER (rn = 1), 0) + coalesce(max(a) FILTER (rn = 2), 0) / log2(3) + coalesce(max(a) FILTER (rn = 3), 0) / 2 AS ideal
                FROM t3 GROUP BY chid),
        px AS MATERIALIZED (SELECT chid, tag, coalesce(CAST(amt_cents AS DOUBLE), 0) AS a, ideal, """
    sql += ", ".join(f"max(num) FILTER (version = {v}) AS p{i}" for i, (_, v) in enumerate(MODELS))
    sql += """ FROM (SELECT *, round(prob * 97) AS num FROM preds WHERE split = 'unseen') JOIN top3 USING (chid) LEFT JOIN actual USING (chid, tag)
                WHERE ideal > 0 GROUP BY ALL),
        """
    # one row per direction of every item: score = c + weight * q
    sql += "s0 AS MATERIALIZED (SELECT " + ", ".join(f"CAST({1 / k} AS DOUBLE) AS w{i}" for i in range(k)) + ", 0 AS moves)"
    for r in range(MAX_ROUNDS + 1):
        weighted = " + ".join(f"p{i} * w{i}" for i in range(k))
        sql += f""",
        v{r} AS MATERIALIZED (SELECT CAST(sum(u) AS BIGINT) AS total FROM (SELECT chid, {score} AS u FROM
              (SELECT chid, a, ideal, row_number() OVER (PARTITION BY chid ORDER BY {weighted} DESC, tag DESC) AS pos FROM px, s{r}) GROUP BY chid))"""
        if r == MAX_ROUNDS:
            break
        lines = " UNION ALL ".join(
            f"SELECT {d} AS d, chid, tag, a, ideal, " + " + ".join(f"p{i} * w{i}" for i in range(k) if i != d) + f" AS c, p{d} AS q FROM px, s{r}"
            for d in range(k)
        )
        moved = ", ".join(f"CASE WHEN m.total > v.total AND m.d = {i} THEN (m.lo + m.hi) / 2 ELSE w{i} END AS w{i}" for i in range(k))
        sql += f""",
        l{r} AS MATERIALIZED ({lines}),
        x{r} AS MATERIALIZED (SELECT DISTINCT d, chid, x FROM (SELECT a.d AS d, a.chid AS chid, (a.c - b.c) / (b.q - a.q) AS x
              FROM l{r} a JOIN l{r} b ON a.d = b.d AND a.chid = b.chid AND a.tag < b.tag AND a.q <> b.q) WHERE x > 0 AND x < 1),
        e{r} AS MATERIALIZED (SELECT *, (lo + lead(lo, 1, 1) OVER (PARTITION BY d, chid ORDER BY lo)) / 2 AS mid
              FROM (SELECT d, chid, x AS lo FROM x{r} UNION ALL SELECT DISTINCT d, chid, CAST(0 AS DOUBLE) FROM l{r})),
        u{r} AS MATERIALIZED (SELECT d, chid, lo, CAST({score} AS BIGINT) AS u FROM
              (SELECT d, chid, lo, a, ideal, row_number() OVER (PARTITION BY d, chid, lo ORDER BY c + mid * q DESC, tag DESC) AS pos
               FROM e{r} JOIN l{r} USING (d, chid)) GROUP BY d, chid, lo),
        g{r} AS MATERIALIZED (SELECT d, lo, sum(change) AS change FROM
              (SELECT d, lo, u - lag(u, 1, 0) OVER (PARTITION BY d, chid ORDER BY lo) AS change FROM u{r}) WHERE change <> 0 OR lo = 0 GROUP BY d, lo),
        b{r} AS MATERIALIZED (SELECT * FROM (SELECT d, lo, lead(lo, 1, 1) OVER (PARTITION BY d ORDER BY lo) AS hi, CAST(sum(change) OVER (PARTITION BY d ORDER BY lo) AS BIGINT) AS total
              FROM g{r}) ORDER BY total DESC, d, lo LIMIT 1),
        s{r + 1} AS MATERIALIZED (SELECT {moved}, moves + CASE WHEN m.total > v.total THEN 1 ELSE 0 END AS moves FROM s{r}, b{r} m, v{r} v)"""
    rounds = " UNION ALL ".join(f"SELECT {r} AS r, s{r}.*, v{r}.total AS total FROM s{r}, v{r}" for r in range(MAX_ROUNDS + 1))
    rows = ", ".join(f"('{name}', {version}, {i})" for i, (name, version) in enumerate(MODELS))
    weight = "CASE i " + " ".join(f"WHEN {i} THEN w{i}" for i in range(k)) + " END"
    return (
        sql
        + f""", best AS MATERIALIZED (SELECT * FROM ({rounds}) ORDER BY total DESC, r LIMIT 1)
        SELECT model, CAST(version AS INTEGER) AS version, round({weight}, 9) AS weight, (SELECT count(DISTINCT chid) FROM px) AS n_clients,
               round(total / CAST(1e9 AS DOUBLE) / (SELECT count(DISTINCT chid) FROM px), 9) AS ndcg, CAST(moves AS INTEGER) AS rounds
        FROM best, (VALUES {rows}) AS m(model, version, i)"""
    )


@query("p09_blend_line_search", _line_search_sql())
def blend_weights(t: Tables) -> DataFrame:
    """The blend weights that exact line searches end with, and their NDCG (probabilities in whole 97ths)."""
    store = t.predictions.filter(F.col("split") == "unseen").withColumn("prob", F.round(F.col("prob") * 97))
    return rounded(blend_line_search(store, t.ledger, SPEC, TARGET, MODELS), 9)
