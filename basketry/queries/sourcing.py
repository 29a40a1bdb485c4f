"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators.metrics import client_ndcg
from basketry.operators.ranking import complete_ranking, popular_items
from basketry.queries.base import MODELS, SPEC, TARGET, Tables, query, rounded, score_sql
from basketry.session import scratch_path
from basketry.sources import files
from basketry.sources.orders import orders_ledger, orders_profile

RAW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("dt", "chid", "tag", "txn_cnt", "amt_cents", "prio", "segment")]
)
CLEAN = T.StructType(
    [
        T.StructField("dt", T.IntegerType()),
        T.StructField("chid", T.LongType()),
        T.StructField("tag", T.IntegerType()),
        T.StructField("txn_cnt", T.LongType()),
        T.StructField("amt_cents", T.LongType()),
        T.StructField("prio", T.IntegerType()),
        T.StructField("segment", T.StringType()),
    ]
)


@query("s00_ledger", "SELECT * FROM ledger")
def ledger(t: Tables) -> DataFrame:
    """The ledger itself, derived from the order lines in one plan."""
    return orders_ledger(t.table("lineitem"), t.table("orders"), t.table("part"))


@query("s00_profile", "SELECT * FROM profile")
def profile(t: Tables) -> DataFrame:
    """Client attributes and limit per period, derived in one plan."""
    return orders_profile(t.table("orders"), t.table("customer"), t.table("nation"))


def _raw_text(t: Tables) -> str:
    """The ledger as raw text: the last item is ``other``, priority 4 is blank."""
    path = scratch_path(t.spark, "raw_csv")
    rows = t.wide.select(
        "dt",
        "chid",
        F.when(F.col("tag") == 25, F.lit("other")).otherwise(F.col("tag").cast("string")).alias("tag"),
        "txn_cnt",
        "amt_cents",
        F.when(F.col("prio") != 4, F.col("prio").cast("string")).alias("prio"),
        "segment",
    )
    rows.write.option("header", True).csv(path)
    return path


@query(
    "s01_read_csv",
    """SELECT CAST(dt AS VARCHAR) AS dt, CAST(chid AS VARCHAR) AS chid,
              CASE WHEN tag = 25 THEN 'other' ELSE CAST(tag AS VARCHAR) END AS tag, CAST(txn_cnt AS VARCHAR) AS txn_cnt,
              CAST(amt_cents AS VARCHAR) AS amt_cents, coalesce(CASE WHEN prio <> 4 THEN CAST(prio AS VARCHAR) END, '') AS prio,
              segment
       FROM wide""",
)
def read_csv(t: Tables) -> DataFrame:
    return files.read_ledger_csv(t.spark, _raw_text(t), RAW).na.fill("")


@query(
    "s02_clean",
    """SELECT dt, chid, tag, txn_cnt, amt_cents, CAST(CASE WHEN prio = 4 THEN 0 ELSE prio END AS INTEGER) AS prio, segment
       FROM wide""",
)
def clean(t: Tables) -> DataFrame:
    raw = files.read_ledger_csv(t.spark, _raw_text(t), RAW)
    return files.clean_ledger(raw, CLEAN, 25, {"prio": 0})


@query("s03_partitioned_parquet", "SELECT dt, chid, tag, txn_cnt, amt_cents FROM ledger")
def partitioned(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "by_period")
    files.write_ledger(t.ledger.select("dt", "chid", "tag", "txn_cnt", "amt_cents"), path)
    return t.spark.read.parquet(path).select("dt", "chid", "tag", "txn_cnt", "amt_cents")


@query("s04_union_parts", "SELECT dt, chid, tag, txn_cnt FROM ledger")
def union_parts(t: Tables) -> DataFrame:
    """Part folders of nine periods each, with the columns in different order."""
    paths = []
    for part, first in enumerate((1, 10, 19)):
        path = scratch_path(t.spark, f"part{part}")
        columns = ["dt", "chid", "tag", "txn_cnt"][:: -1 if part % 2 else 1]
        t.ledger.filter(F.col("dt").between(first, first + 8)).select(columns).write.parquet(path)
        paths.append(path)
    return files.read_parts(t.spark, paths).select("dt", "chid", "tag", "txn_cnt")


@query(
    "s05_shares_to_amounts",
    """SELECT chid, dt, tag, round(cents_a / CAST(100 AS DOUBLE), 2) AS a_amt, round(cents_n / CAST(100 AS DOUBLE), 2) AS n_amt,
              round(cents_r / CAST(100 AS DOUBLE), 2) AS r_amt
       FROM ledger""",
)
def shares(t: Tables) -> DataFrame:
    """Channel shares of the amount turned back into channel amounts on the same row."""
    shared = t.priced.withColumns({f"{c}_pct": F.try_divide(f"cents_{c}", F.col("amt_cents")) for c in SPEC.channels})
    amounts = files.shares_to_amounts(shared, {f"{c}_pct": f"{c}_amt" for c in SPEC.channels}, "amt")
    return rounded(amounts.select("chid", "dt", "tag", *[f"{c}_amt" for c in SPEC.channels]), 2)


@query("s06_pruned_read", "SELECT dt, chid, txn_cnt FROM ledger WHERE dt BETWEEN 12 AND 23")
def pruned(t: Tables) -> DataFrame:
    return t.ledger.filter(F.col("dt").between(12, 23)).select("dt", "chid", "txn_cnt")


@query("s07_ranking_csv", "SELECT chid, top1, top2, top3 FROM rank_a")
def ranking_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "ranking")
    files.write_ranking(t.ranking_a, path)
    return t.spark.read.schema(files.RANKING_SCHEMA).option("header", True).csv(path)


@query(
    "s08_prediction_store",
    """SELECT model, CAST(version AS INTEGER) AS version, split, chid, tag, round(prob, 9) AS prob FROM preds
       WHERE split = 'oof' AND (model = 'lgbm' AND version = 2 OR model = 'xgb' AND version = 3)""",
)
def prediction_store(t: Tables) -> DataFrame:
    """A store written in two parts, of which one is then replaced."""
    path = scratch_path(t.spark, "predictions")
    lgbm = F.col("model") == "lgbm"
    files.write_predictions(t.predictions.filter(lgbm).withColumn("prob", F.lit(0.5)), path)
    files.write_predictions(t.predictions.filter(~lgbm), path)
    files.write_predictions(t.predictions.filter(lgbm), path)
    stored = files.read_predictions(t.spark, path, "oof", [("lgbm", 2), ("xgb", 3)])
    return rounded(stored.select("model", "version", "split", "chid", "tag", "prob"), 9)


@query(
    "s09_version_labels",
    """SELECT label, CASE substr(label, 1, 1) WHEN 'l' THEN 'lgbm' WHEN 'x' THEN 'xgb' ELSE 'blend' END AS model,
              CASE WHEN substr(label, 2, 1) = 'm' THEN 'meta' ELSE 'base' END AS kind, tag AS number, count(*) AS n_rows
       FROM (SELECT tag, CASE WHEN cnt_a > 0 THEN 'l' WHEN cnt_n > 0 THEN 'x' ELSE 'b' END
                         || CASE WHEN txn_cnt > 1 THEN 'm' ELSE '' END || CAST(tag AS VARCHAR) AS label FROM ledger)
       GROUP BY 1, 2, 3, 4""",
)
def version_labels(t: Tables) -> DataFrame:
    """Version labels made from ledger rows, counted and taken apart."""
    letter = F.when(F.col("cnt_a") > 0, "l").when(F.col("cnt_n") > 0, "x").otherwise("b")
    meta = F.when(F.col("txn_cnt") > 1, "m").otherwise("")
    labels = t.ledger.select(F.concat(letter, meta, F.col("tag").cast("string")).alias("label"))
    counted = labels.groupBy("label").agg(F.count("*").alias("n_rows"))
    return files.parse_version(counted).select("label", "model", "kind", "number", "n_rows")


@query(
    "s10_complete_targets",
    """SELECT chid, coalesce(top1, m1) AS top1, coalesce(top2, m2) AS top2, coalesce(top3, m3) AS top3
       FROM clients LEFT JOIN (SELECT * FROM rank_b WHERE chid IN (SELECT chid FROM actual)) USING (chid), mode3""",
)
def complete_targets(t: Tables) -> DataFrame:
    """A ranking of the active clients completed to the whole target list."""
    active = t.ledger.filter(F.col("dt") == TARGET).select("chid").distinct()
    popular = popular_items(t.past.filter(F.col("tag").isin(*SPEC.legit)))
    return complete_ranking(t.ranking_b.join(active, "chid", "left_semi"), t.clients, popular)


@query(
    "s11_block_list",
    """SELECT chid, tag FROM target_labels WHERE chid NOT IN (SELECT chid FROM ndcg_a WHERE ndcg = 0)""",
)
def block_list(t: Tables) -> DataFrame:
    """Clients a ranking missed completely, written as text, removed from the label rows."""
    path = scratch_path(t.spark, "blocked")
    missed = client_ndcg(t.ranking_a, t.ledger, SPEC, TARGET).filter(F.col("ndcg") == 0)
    files.write_block_list(missed, path)
    blocked = files.read_block_list(t.spark, path)
    rows = t.ledger.filter((F.col("dt") == TARGET) & F.col("tag").isin(*SPEC.legit)).select("chid", "tag")
    return rows.join(blocked, "chid", "left_anti")
