"""Decayed vectors and collaborative vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.config import Decay
from basketry.functions.hashing import key_hash_sql
from basketry.operators import decayed as dec
from basketry.operators import neighbors as nei
from basketry.operators.filters import pick_items
from basketry.queries.base import SPEC, T_END, Tables, query, rounded

PSEUDO = 797.165663
D12 = Decay()
VARIANTS = {
    "v12": Decay(12, 3, 0.5, 0.9),
    "v6": Decay(6, 3, 0.5, 0.9),
    "v18": Decay(18, 6, 0.8, 0.6),
    "v12b": Decay(12, 2, 0.7, 0.9),
    "v9": Decay(9, 1, 0.6, 1.0),
}


def _w(p: Decay) -> str:
    age = f"({T_END} - dt)"
    return f"pow({p.decay_g}, {age} // {p.gp_size}) * pow({p.decay_b}, {age} % {p.gp_size})"


def _dense_sql(cells: str, tags: str = "leg") -> str:
    """Cells summed over the dense client x item x period map (missing periods have null values)."""
    return f"""SELECT c.chid AS chid, i.tag AS tag, {cells}
               FROM clients c CROSS JOIN {tags} i CROSS JOIN (SELECT dt AS dt FROM periods WHERE dt <= {T_END}) AS m
               LEFT JOIN (SELECT chid, tag, dt AS ldt, amt_cents / CAST(100 AS DOUBLE) AS amt, txn_cnt FROM ledger) AS l
                      ON l.chid = c.chid AND l.tag = i.tag AND l.ldt = m.dt GROUP BY 1, 2"""


def _purchase_cell(p: Decay, name: str, places: int = 6) -> str:
    return f"round(coalesce(sum(CASE WHEN amt IS NOT NULL THEN {_w(p)} END) FILTER (dt BETWEEN {p.periods(T_END)[0]} AND {T_END}), 0), {places}) AS {name}"


def _feature_cell(p: Decay, value: str, imputed: float, name: str, places: int = 6) -> str:
    return f"round(sum(coalesce(nullif({value}, 0), {imputed}) * {_w(p)}) FILTER (dt BETWEEN {p.periods(T_END)[0]} AND {T_END}), {places}) AS {name}"


@query("d01_decayed_purchases", _dense_sql(_purchase_cell(D12, "freq"), "items"))
def decayed_purchases(t: Tables) -> DataFrame:
    return rounded(dec.decayed_purchases(t.ledger, t.clients, SPEC, T_END, {"freq": D12}, "all"))


_INCL = Decay(12, 3, 0.5, 0.9, inclusive=True)


@query("d02_window_forms", _dense_sql(f"{_purchase_cell(D12, 'exclusive')}, {_purchase_cell(_INCL, 'inclusive')}"))
def window_forms(t: Tables) -> DataFrame:
    """A window of 12 covers 11 periods, or 12 with the inclusive form."""
    return rounded(dec.decayed_purchases(t.ledger, t.clients, SPEC, T_END, {"exclusive": D12, "inclusive": _INCL}))


@query(
    "d03_decayed_features",
    _dense_sql(f"{_feature_cell(D12, 'amt', PSEUDO, 'amt_vec', 4)}, {_feature_cell(D12, 'txn_cnt', 0.0, 'cnt_vec', 4)}"),
)
def decayed_features(t: Tables) -> DataFrame:
    params = {"amt_vec": ("amt", D12, PSEUDO), "cnt_vec": ("txn_cnt", D12, 0.0)}
    return rounded(dec.decayed_features(t.priced, t.clients, SPEC, T_END, params), 4)


@query("d04_parameter_sets", _dense_sql(", ".join(_purchase_cell(p, n) for n, p in VARIANTS.items())))
def parameter_sets(t: Tables) -> DataFrame:
    return rounded(dec.decayed_purchases(t.ledger, t.clients, SPEC, T_END, VARIANTS))


@query(
    "d05_item_selection",
    "WITH v AS ("
    + _dense_sql(_purchase_cell(D12, "freq"), "items")
    + """) SELECT 'illeg' AS chosen, chid, tag, freq FROM v WHERE tag NOT IN (SELECT tag FROM leg)
         UNION ALL SELECT 'list', chid, tag, freq FROM v WHERE tag IN (1, 2, 24)""",
)
def item_selection(t: Tables) -> DataFrame:
    vec = rounded(dec.decayed_purchases(t.ledger, t.clients, SPEC, T_END, {"freq": D12}, "all"))
    parts = [
        pick_items(vec, SPEC, which).select(F.lit(name).alias("chosen"), "chid", "tag", "freq")
        for name, which in (("illeg", "illeg"), ("list", [1, 2, 24]))
    ]
    return parts[0].unionByName(parts[1])


_V = "[" + ", ".join(VARIANTS) + "]"


@query(
    "d06_variant_stats",
    "WITH v AS ("
    + _dense_sql(", ".join(_purchase_cell(p, n, 12) for n, p in VARIANTS.items()))
    + f"""), u AS (SELECT chid, tag, round(v12, 6) AS v12, round(v6, 6) AS v6, round(v18, 6) AS v18, round(v12b, 6) AS v12b, unnest({_V}) AS x FROM v)
         SELECT chid, tag, max(v6) AS v6, max(v18) AS v18, max(v12b) AS v12b,
                round(avg(x), 5) AS v12_mean, round(median(x), 5) AS v12_median, round(stddev_samp(x), 5) AS v12_std,
                round(CASE WHEN max(x) - min(x) < 1e-9 THEN 0 ELSE skewness(x) END, 5) AS v12_skew,
                round(CASE WHEN max(x) - min(x) < 1e-9 THEN 0 ELSE kurtosis(x) END, 5) AS v12_kurt
         FROM u GROUP BY 1, 2""",
)
def variant_stats(t: Tables) -> DataFrame:
    vec = dec.decayed_purchases(t.ledger, t.clients, SPEC, T_END, VARIANTS)
    out = dec.variant_stats(vec, list(VARIANTS), ["mean", "median", "std", "skew", "kurt"], drop=[0, 4])
    out = out.withColumns({c: F.round(c, 6) for c in ("v6", "v18", "v12b")})
    return rounded(out, 5, ("v6", "v18", "v12b"))


# Collaborative vectors.  Purchase counts are whole numbers, so similarities come out the same in both engines.
FLAT = Decay(12, 3, 1.0, 1.0)
POOLS, CANDIDATES, K, ALPHA = 4, 200, 10, 0.7

_POOLS = f"""
    WITH vec AS ({_dense_sql(_purchase_cell(FLAT, 'v'), 'items')}),
    pooled AS (SELECT chid, {key_hash_sql('chid', 1)} % {POOLS} AS pool, {key_hash_sql('chid', 2)} AS h FROM clients),
    members AS (SELECT chid, pool FROM (SELECT chid, pool, row_number() OVER (PARTITION BY pool ORDER BY h, chid) AS r FROM pooled) WHERE r <= {CANDIDATES}),
    norms AS (SELECT chid, sum(v * v) AS nn, max(v) AS top FROM vec GROUP BY chid),
    arr AS (SELECT chid, list(v ORDER BY tag) AS a FROM vec GROUP BY chid),
    pairs AS (SELECT p.chid AS chid, m.chid AS other, np.nn AS n1, nm.nn AS n2, list_dot_product(ap.a, am.a) AS dot
              FROM pooled p JOIN members m ON m.pool = p.pool AND m.chid <> p.chid
              JOIN norms np ON np.chid = p.chid JOIN norms nm ON nm.chid = m.chid
              JOIN arr ap ON ap.chid = p.chid JOIN arr am ON am.chid = m.chid)"""


def _nearest(order: str) -> str:
    return f"""near AS (SELECT chid, other FROM (SELECT chid, other, row_number() OVER (PARTITION BY chid ORDER BY {order}, other) AS r FROM pairs)
                        WHERE r <= {K})"""


def _blend(alpha: float) -> str:
    return f"""SELECT own.chid AS chid, own.tag AS tag, round({alpha} * own.v + (1 - {alpha}) * coalesce(n.m, 0), 6) AS v
             FROM vec own LEFT JOIN (SELECT near.chid AS chid, tag, avg(v) AS m FROM near JOIN vec ON vec.chid = near.other GROUP BY 1, 2) AS n
             ON n.chid = own.chid AND n.tag = own.tag"""


def _counts(t: Tables) -> DataFrame:
    return dec.decayed_purchases(t.ledger, t.clients, SPEC, T_END, {"v": FLAT}, "all")


_COS = "(CASE WHEN n1 * n2 > 0 THEN dot / (sqrt(n1) * sqrt(n2)) END) DESC NULLS LAST"


@query("n01_cosine_neighbors", f"{_POOLS}, {_nearest(_COS)} {_blend(ALPHA)}")
def cosine(t: Tables) -> DataFrame:
    """Cosine neighbours among the sampled candidates, blended into the own vector."""
    return rounded(nei.neighbor_blend(_counts(t), t.clients, SPEC, "v", CANDIDATES, K, ALPHA, "cos", POOLS))


@query("n02_euclidean_neighbors", f"{_POOLS}, {_nearest('n1 + n2 - 2 * dot')} {_blend(ALPHA)}")
def euclidean(t: Tables) -> DataFrame:
    return rounded(nei.neighbor_blend(_counts(t), t.clients, SPEC, "v", CANDIDATES, K, ALPHA, "ed", POOLS))


@query("n03_blend", f"{_POOLS}, {_nearest(_COS)} {_blend(0.2)}")
def mostly_neighbors(t: Tables) -> DataFrame:
    """The same neighbours with most of the weight on them."""
    return rounded(nei.neighbor_blend(_counts(t), t.clients, SPEC, "v", CANDIDATES, K, 0.2, "cos", POOLS))


_SCALED = """SELECT vec.chid AS chid, tag, coalesce(v / nullif(top, 0), 0) AS s FROM vec JOIN norms ON norms.chid = vec.chid"""


@query(
    "n04_scaled_feature_blend",
    f"""{_POOLS}, sc AS ({_SCALED})
        SELECT own.chid AS chid, own.tag AS tag, round({ALPHA} * own.s + (1 - {ALPHA}) * coalesce(n.m, 0), 10) AS v
        FROM sc own LEFT JOIN (SELECT pairs.chid AS chid, sc.tag AS tag, avg(s) AS m FROM pairs JOIN sc ON sc.chid = pairs.other GROUP BY 1, 2) AS n
        ON n.chid = own.chid AND n.tag = own.tag""",
)
def scaled_blend(t: Tables) -> DataFrame:
    """Every vector divided by its maximum, all candidates averaged."""
    return rounded(nei.neighbor_blend(_counts(t), t.clients, SPEC, "v", CANDIDATES, None, ALPHA, "cos", POOLS, normalize=True), 10)


@query(
    "n05_equal_attribute_blend",
    f"""{_POOLS}, sc AS ({_SCALED}), a AS (SELECT chid, segment, region FROM attrs),
        same AS (SELECT pairs.chid AS chid, pairs.other AS other FROM pairs JOIN a AS x ON x.chid = pairs.chid JOIN a AS y ON y.chid = pairs.other
                 WHERE x.segment = y.segment AND x.region = y.region)
        SELECT own.chid AS chid, own.tag AS tag, round({ALPHA} * own.s + (1 - {ALPHA}) * coalesce(n.m, 0), 10) AS v
        FROM sc own LEFT JOIN (SELECT same.chid AS chid, sc.tag AS tag, avg(s) AS m FROM same JOIN sc ON sc.chid = same.other GROUP BY 1, 2) AS n
        ON n.chid = own.chid AND n.tag = own.tag""",
)
def attribute_blend(t: Tables) -> DataFrame:
    """Neighbours are the candidates with the same segment and region."""
    return rounded(
        nei.attribute_blend(_counts(t), t.attributes, ["segment", "region"], SPEC, "v", CANDIDATES, ALPHA, POOLS), 10
    )
