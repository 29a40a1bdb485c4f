"""Query registry, shared inputs and the SQL building blocks of the checks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.config import ORDERS
from basketry.operators.ranking import rank_by_amount, rank_by_probability
from basketry.sources.prepared import Inputs

SPEC = ORDERS
T_END = 23
TARGET = T_END + SPEC.horizon
MODELS = (("lgbm", 1), ("lgbm", 2), ("xgb", 3), ("blend", 4))


class Tables(Inputs):
    """Inputs plus the few derived tables many queries share."""

    @cached_property
    def priced(self) -> DataFrame:
        """Ledger with the amount in whole units."""
        return self.ledger.withColumn("amt", F.col("amt_cents") / 100)

    @cached_property
    def wide(self) -> DataFrame:
        """Ledger rows with the client's attributes of the period."""
        return self.priced.join(self.profile, ["chid", "dt"])

    @cached_property
    def past(self) -> DataFrame:
        return self.ledger.filter(F.col("dt") <= T_END)

    def scores(self, model: int, clients: DataFrame | None = None) -> DataFrame:
        """Deterministic probabilities (chid, tag, label, prob) of a model, with ties on purpose."""
        tags = F.array(*[F.lit(t) for t in SPEC.legit])
        rows = (clients or self.clients).select("chid", F.posexplode(tags).alias("label", "tag"))
        return rows.withColumn("prob", ((F.col("chid") * 31 + F.col("tag") * 17 + model * 7) % 97) / F.lit(97.0))

    @cached_property
    def predictions(self) -> DataFrame:
        """A prediction store: out-of-fold rows of model m cover the clients active in period 20 + m, unseen rows all."""
        parts = []
        for name, version in MODELS:
            active = self.ledger.filter(F.col("dt") == 20 + version).select("chid").distinct()
            for split, who in (("oof", active), ("unseen", self.clients)):
                parts.append(
                    self.scores(version, who).select(
                        F.lit(name).alias("model"), F.lit(version).alias("version"), F.lit(split).alias("split"), "chid", "tag", "prob"
                    )
                )
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def ranking_a(self) -> DataFrame:
        """Ranking by total past amount."""
        return rank_by_amount(self.past, self.clients, SPEC)

    @cached_property
    def ranking_b(self) -> DataFrame:
        """Ranking by the deterministic score of model 1."""
        return rank_by_probability(self.scores(1), SPEC)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of :class:`Tables` as a query."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        REGISTRY[name] = Query(lambda spark, sf_dir: fn(Tables(spark, sf_dir)), with_blocks(sql) if sql else None)
        return fn

    return wrap


def rounded(df: DataFrame, places: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Double columns rounded, so float noise of a different summation order does not show."""
    cols = [c for c, t in df.dtypes if t == "double" and c not in skip]
    return df.withColumns({c: F.round(c, places) for c in cols}) if cols else df


LEGIT_SQL = ", ".join(str(t) for t in SPEC.legit)
DT_SQL = "CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS INTEGER)"


def score_sql(model: int | str) -> str:
    return f"((chid * 31 + tag * 17 + {model} * 7) % 97) / CAST(97 AS DOUBLE)"


BLOCKS: dict[str, str] = {
    "ledger": f"""
        SELECT o_custkey AS chid, {DT_SQL} AS dt, CAST(substr(p_brand, 7) AS INTEGER) AS tag, count(*) AS txn_cnt,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amt_cents,
               count(*) FILTER (l_returnflag = 'A') AS cnt_a, count(*) FILTER (l_returnflag = 'N') AS cnt_n,
               count(*) FILTER (l_returnflag = 'R') AS cnt_r,
               CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS cents_a,
               CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS cents_n,
               CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS cents_r
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2, 3""",
    "profile": f"""
        SELECT chid, dt, c_nationkey AS nation, c_mktsegment AS segment, n_regionkey AS region, prio, lim_cents
        FROM (SELECT o_custkey AS chid, {DT_SQL} AS dt, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio,
                     row_number() OVER (PARTITION BY o_custkey, {DT_SQL} ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
                     max(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey, {DT_SQL}) AS lim_cents
              FROM orders)
        JOIN customer ON chid = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE rn = 1""",
    "clients": "SELECT c_custkey AS chid FROM customer",
    "attrs": """
        SELECT c_custkey AS chid, c_nationkey AS nation, c_mktsegment AS segment, n_regionkey AS region
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "items": "SELECT CAST(unnest(range(1, 26)) AS INTEGER) AS tag",
    "leg": "SELECT CAST(row_number() OVER (ORDER BY tag) - 1 AS INTEGER) AS label, tag FROM items "
    f"WHERE tag IN ({LEGIT_SQL})",
    "periods": "SELECT CAST(unnest(range(1, 28)) AS INTEGER) AS dt",
    "past": f"SELECT * FROM ledger WHERE dt <= {T_END}",
    "wide": "SELECT ledger.*, amt_cents / CAST(100 AS DOUBLE) AS amt, nation, segment, region, prio, lim_cents "
    "FROM ledger JOIN profile USING (chid, dt)",
    "grid": "SELECT chid, tag FROM clients, leg",
    "totals": "SELECT chid, tag, CAST(sum(amt_cents) AS BIGINT) AS total FROM past WHERE tag IN (SELECT tag FROM leg) GROUP BY 1, 2",
    "mode3": """
        SELECT max(tag) FILTER (rn = 1) AS m1, max(tag) FILTER (rn = 2) AS m2, max(tag) FILTER (rn = 3) AS m3
        FROM (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) AS rn FROM totals GROUP BY tag)""",
    "best3": """
        SELECT chid, max(tag) FILTER (rn = 1) AS t1, max(tag) FILTER (rn = 2) AS t2, max(tag) FILTER (rn = 3) AS t3
        FROM (SELECT chid, tag, row_number() OVER (PARTITION BY chid ORDER BY total DESC, tag) AS rn FROM totals)
        GROUP BY chid""",
    "rank_a": """
        SELECT chid, coalesce(t1, m1) AS top1,
               CASE WHEN t1 IS NULL THEN m2 ELSE coalesce(t2, t1) END AS top2,
               CASE WHEN t1 IS NULL THEN m3 ELSE coalesce(t3, t2, t1) END AS top3
        FROM clients LEFT JOIN best3 USING (chid), mode3""",
    "rank_b": f"""
        SELECT chid, max(tag) FILTER (rn = 1) AS top1, max(tag) FILTER (rn = 2) AS top2, max(tag) FILTER (rn = 3) AS top3
        FROM (SELECT chid, tag, row_number() OVER (PARTITION BY chid ORDER BY {score_sql(1)} DESC, label DESC) AS rn
              FROM clients, leg)
        GROUP BY chid""",
    "actual": f"SELECT chid, tag, amt_cents FROM ledger WHERE dt = {TARGET}",
    "ideal": """
        SELECT chid, sum(amt_cents / log2(rn + 1)) AS ideal
        FROM (SELECT chid, amt_cents, row_number() OVER (PARTITION BY chid ORDER BY amt_cents DESC) AS rn
              FROM actual WHERE tag IN (SELECT tag FROM leg))
        WHERE rn <= 3 GROUP BY chid HAVING sum(amt_cents) > 0""",
    "ndcg_a": """
        SELECT chid, sum(coalesce(amt_cents, 0) / log2(pos + 1)) / max(ideal) AS ndcg
        FROM (SELECT chid, unnest([1, 2, 3]) AS pos, unnest([top1, top2, top3]) AS tag FROM rank_a)
        JOIN ideal USING (chid) LEFT JOIN actual USING (chid, tag) GROUP BY chid""",
    "ndcg_b": """
        SELECT chid, sum(coalesce(amt_cents, 0) / log2(pos + 1)) / max(ideal) AS ndcg
        FROM (SELECT chid, unnest([1, 2, 3]) AS pos, unnest([top1, top2, top3]) AS tag FROM rank_b)
        JOIN ideal USING (chid) LEFT JOIN actual USING (chid, tag) GROUP BY chid""",
    "models": "SELECT * FROM (VALUES ('lgbm', 1), ('lgbm', 2), ('xgb', 3), ('blend', 4)) AS t(model, version)",
    "preds": f"""
        SELECT model, version, 'oof' AS split, chid, leg.tag AS tag,
               ((chid * 31 + leg.tag * 17 + version * 7) % 97) / CAST(97 AS DOUBLE) AS prob
        FROM models JOIN (SELECT DISTINCT chid, dt FROM ledger) AS seen ON seen.dt = 20 + version, leg
        UNION ALL
        SELECT model, version, 'unseen', chid, tag, {score_sql("version")} FROM models, clients, leg""",
    "target_labels": f"SELECT chid, tag, label FROM ledger JOIN leg USING (tag) WHERE dt = {TARGET}",
    "warm": f"""
        SELECT chid FROM ledger WHERE tag IN (SELECT tag FROM leg) GROUP BY chid
        HAVING bool_or(dt = {TARGET}) AND NOT (min(dt) BETWEEN {T_END} - 6 + 1 AND {TARGET})""",
}


def _needs(sql: str) -> list[str]:
    return [name for name in BLOCKS if re.search(rf"\b{name}\b", sql)]


def with_blocks(body: str) -> str:
    """Puts the building blocks a statement names in front of it, each after the ones it needs itself."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _needs(BLOCKS[name]):
            if other != name:
                visit(other)
        ordered.append(name)

    for name in _needs(body):
        visit(name)
    if not ordered:
        return body.strip()
    blocks = ",\n".join(f"{n} AS ({BLOCKS[n].strip()})" for n in ordered)
    rest = body.strip()
    rest = ",\n" + rest[5:] if rest[:5].upper() == "WITH " else "\n" + rest
    return f"WITH {blocks}{rest}"
