"""Rankings and the baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.config import Decay
from basketry.operators import ranking as rnk
from basketry.operators.decayed import decayed_purchases
from basketry.operators.metrics import client_ndcg, mean_ndcg
from basketry.plans.training import Sources, search_vectors, vector_grid
from basketry.queries.base import SPEC, T_END, TARGET, Tables, query, rounded


@query("k01_rank_by_probability", "SELECT chid, top1, top2, top3 FROM rank_b")
def rank_by_probability(t: Tables) -> DataFrame:
    return rnk.rank_by_probability(t.scores(1), SPEC)


@query("k02_rank_by_amount", "SELECT chid, top1, top2, top3 FROM rank_a")
def rank_by_amount(t: Tables) -> DataFrame:
    return t.ranking_a


@query(
    "k02_baseline_ndcg",
    "SELECT count(*) AS n_clients, count(*) FILTER (ndcg = 0) AS n_zero, round(avg(ndcg), 9) AS ndcg FROM ndcg_a",
)
def baseline_ndcg(t: Tables) -> DataFrame:
    """Flagship: every client's next three items by past amount, scored on the following period."""
    scored = client_ndcg(t.ranking_a, t.ledger, SPEC, TARGET)
    return rounded(
        scored.agg(
            F.count("*").alias("n_clients"), F.count_if(F.col("ndcg") == 0).alias("n_zero"), F.avg("ndcg").alias("ndcg")
        ),
        9,
    )


_RATING = """
    WITH it AS (SELECT tag, count(*) AS v, avg(amt_cents) / CAST(100 AS DOUBLE) AS r FROM past GROUP BY tag),
         b AS (SELECT quantile_cont(v, 0.8) AS m, avg(r) AS c FROM it),
         rated AS (SELECT tag, v, r, v / (v + m) * r + m / (m + v) * c AS rating FROM it, b WHERE v >= m)
"""


@query("k03_weighted_rating", _RATING + "SELECT tag, v, round(r, 6) AS r, round(rating, 6) AS rating FROM rated")
def weighted_rating(t: Tables) -> DataFrame:
    return rounded(rnk.weighted_ratings(t.past, "amt_cents", 100.0))


@query(
    "k03_rank_by_rating",
    _RATING
    + """, o AS (SELECT tag, row_number() OVER (ORDER BY rating DESC, tag) AS rn FROM rated WHERE tag IN (SELECT tag FROM leg))
         SELECT chid, coalesce((SELECT max(tag) FROM o WHERE rn = 1), 0) AS top1, coalesce((SELECT max(tag) FROM o WHERE rn = 2), 0) AS top2,
                coalesce((SELECT max(tag) FROM o WHERE rn = 3), 0) AS top3 FROM clients""",
)
def rank_by_rating(t: Tables) -> DataFrame:
    """Fewer than three legit items may pass the threshold; the missing places are shown as 0."""
    return rnk.rank_by_rating(t.past, t.clients, SPEC, 100.0).na.fill(0)


@query(
    "k04_rank_by_vector",
    """WITH f AS (SELECT chid, tag, count(*) FILTER (dt >= 13) AS v FROM past GROUP BY 1, 2),
       vec AS (SELECT c.chid AS chid, i.tag AS tag, coalesce(f.v, 0) AS v FROM clients c CROSS JOIN items i
               LEFT JOIN f ON f.chid = c.chid AND f.tag = i.tag),
       ks AS (SELECT chid, round_even(avg(n), 0) AS k FROM (SELECT chid, dt, count(DISTINCT tag) AS n FROM past GROUP BY 1, 2) GROUP BY 1),
       am AS (SELECT chid, tag, avg(amt_cents) AS a FROM past GROUP BY 1, 2),
       r AS (SELECT chid, tag, row_number() OVER (PARTITION BY chid ORDER BY v DESC, tag DESC) AS pos FROM vec),
       o AS (SELECT r.chid AS chid, r.tag AS tag, row_number() OVER (PARTITION BY r.chid ORDER BY pos > coalesce(k, 0),
                    CASE WHEN pos <= coalesce(k, 0) THEN coalesce(a, 0) END DESC NULLS LAST, pos) AS rn
             FROM r LEFT JOIN ks ON ks.chid = r.chid LEFT JOIN am ON am.chid = r.chid AND am.tag = r.tag
             WHERE r.tag IN (SELECT tag FROM leg))
       SELECT chid, max(tag) FILTER (rn = 1) AS top1, max(tag) FILTER (rn = 2) AS top2, max(tag) FILTER (rn = 3) AS top3 FROM o GROUP BY chid""",
)
def rank_by_vector(t: Tables) -> DataFrame:
    vec = decayed_purchases(t.ledger, t.clients, SPEC, T_END, {"v": Decay(12, 3, 1.0, 1.0)}, "all")
    return rnk.rank_by_vector(vec, t.ledger, t.clients, SPEC, "v", 1, T_END + 1)


@query(
    "k05_truth_amounts",
    """SELECT chid, coalesce(max(amt_cents) FILTER (rn = 1), 0) AS amt1, coalesce(max(amt_cents) FILTER (rn = 2), 0) AS amt2,
              coalesce(max(amt_cents) FILTER (rn = 3), 0) AS amt3
       FROM (SELECT chid, amt_cents, row_number() OVER (PARTITION BY chid ORDER BY amt_cents DESC) AS rn FROM actual
             WHERE tag IN (SELECT tag FROM leg)) GROUP BY chid""",
)
def truth_amounts(t: Tables) -> DataFrame:
    return rnk.truth_amounts(t.ledger, SPEC, TARGET)


@query("k06_vector_grid")
def vector_search(t: Tables) -> DataFrame:
    """Grid of decay and neighbour parameters with the NDCG of each point."""
    src = Sources(t.ledger, t.profile, t.clients, SPEC)
    grid = vector_grid([3], [0.5, 0.8], [0.9], [0.9], ["cos", "ed"], [10], [5, 100], window=12)
    return rounded(search_vectors(src, T_END, grid))
