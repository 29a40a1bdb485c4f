"""Raw card ledger text, text sinks and the prepared ledger."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from basketry.queries.base import Tables
from basketry.sources import cards, files
from basketry.sources.orders import orders_ledger

SF = "/root/testdata/sf0.001"


def test_card_ledger_is_cleaned_and_typed(spark, tmp_path):
    names = cards.LEDGER_SCHEMA.names
    assert len(names) == 53
    base = {n: "0" for n in names}
    base.update(dt="3", chid="10000007", shop_tag="other", txn_cnt="4", txn_amt="200.5", masts="", gender_code="", age="", slam="")
    base.update(domestic_online_cnt="4", domestic_online_amt_pct="0.25", card_3_txn_amt_pct="0.5")
    second = {**base, "shop_tag": "37", "gender_code": "1", "slam": "12.5", "masts": "2"}
    path = tmp_path / "raw.csv"
    path.write_text("\n".join([",".join(names)] + [",".join(r[n] for n in names) for r in (base, second)]) + "\n")
    rows = cards.read_card_ledger(spark, str(path)).orderBy("tag").collect()
    assert [r.tag for r in rows] == [37, 49]
    assert (rows[1].masts, rows[1].gender_code, rows[1].age, rows[1].slam) == (0, -1, 0, 0.0)
    assert (rows[0].masts, rows[0].gender_code, rows[0].slam) == (2, 1, 12.5)
    assert rows[0].domestic_online_txn_amt == 50.125 and rows[0].card_3_txn_txn_amt == 100.25
    assert rows[0].chid == 10000007 and rows[0].dt == 3


def test_version_labels(spark):
    df = spark.createDataFrame([("l12",), ("x3",), ("b1",), ("lm11",), ("xm8",)], "label string")
    got = {r.label: (r.model, r.kind, r.number) for r in files.parse_version(df).collect()}
    assert got == {
        "l12": ("lgbm", "base", 12),
        "x3": ("xgb", "base", 3),
        "b1": ("blend", "base", 1),
        "lm11": ("lgbm", "meta", 11),
        "xm8": ("xgb", "meta", 8),
    }


def test_partitions_prune(spark, tmp_path):
    t = Tables(spark, SF)
    path = str(tmp_path / "by_dt")
    files.write_ledger(t.ledger, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("dt="))[0] == "dt=1"
    plan = spark.read.parquet(path).filter("dt = 23").select("chid")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "ReadSchema: struct<chid:bigint>" in plan


def test_prepared_ledger_equals_the_plan_and_follows_the_files(spark, tmp_path):
    for name in ("lineitem", "orders", "part"):
        shutil.copyfile(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    t = Tables(spark, str(tmp_path))
    direct = orders_ledger(t.table("lineitem"), t.table("orders"), t.table("part"))
    assert t.ledger.exceptAll(direct).count() == 0 and direct.exceptAll(t.ledger).count() == 0
    # other files at the same path give another ledger
    half = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_orderkey % 2 = 0")
    half.write.parquet(str(tmp_path / "half"))
    os.replace(tmp_path / "half", tmp_path / "half.parquet")
    (tmp_path / "lineitem.parquet").write_bytes(next((tmp_path / "half.parquet").glob("part-*")).read_bytes())
    again = Tables(spark, str(tmp_path)).ledger
    assert 0 < again.agg(F.sum("txn_cnt")).first()[0] < t.ledger.agg(F.sum("txn_cnt")).first()[0]


@pytest.mark.parametrize("hot", ["client", "order", "part"])
def test_ledger_with_a_hot_key(spark, hot):
    """A third of all lines on one client, order or part: totals stay whole."""
    t = Tables(spark, SF)
    lines, orders = t.table("lineitem"), t.table("orders")
    third = F.col("l_linenumber") <= 2
    if hot == "order":
        lines = lines.withColumn("l_orderkey", F.when(third, F.lit(0)).otherwise(F.col("l_orderkey")).cast("long"))
    if hot == "part":
        lines = lines.withColumn("l_partkey", F.when(third, F.lit(0)).otherwise(F.col("l_partkey")).cast("long"))
    if hot == "client":
        orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey")).cast("long"))
    got = orders_ledger(lines, orders, t.table("part"))
    total = got.agg(F.sum("txn_cnt").alias("n"), F.sum("amt_cents").alias("c")).first()
    want = lines.agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c")).first()
    assert (total.n, total.c) == (want.n, want.c)
    assert got.groupBy("chid", "dt", "tag").count().filter("count > 1").count() == 0


def test_listing_by_spark_equals_the_file_system(spark):
    t = Tables(spark, SF)
    (path, size, stamp), = t._listing(f"file:{SF}/orders.parquet")
    assert size == os.stat(f"{SF}/orders.parquet").st_size and path.endswith("orders.parquet") and stamp


def test_a_prediction_store_is_added_to(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "model string, version int, split string, chid long, tag int, prob double"

    def rows(model, version, split, prob, n=3):
        return [(model, version, split, c, 2, prob) for c in range(n)]

    def seen(split, models=()):
        return sorted((r["model"], r["version"], r["chid"], r["prob"]) for r in files.read_predictions(spark, path, split, models).collect())

    files.write_predictions(spark.createDataFrame(rows("a", 1, "oof", 0.1) + rows("a", 1, "unseen", 0.2), schema), path)
    files.write_predictions(spark.createDataFrame(rows("b", 2, "oof", 0.3), schema), path)
    assert seen("oof") == sorted([("a", 1, c, 0.1) for c in range(3)] + [("b", 2, c, 0.3) for c in range(3)])
    # another version, then fewer rows of the first in place of the old ones
    files.write_predictions(spark.createDataFrame(rows("a", 3, "oof", 0.4), schema), path)
    files.write_predictions(spark.createDataFrame(rows("a", 1, "oof", 0.9, 2), schema), path)
    assert seen("oof", [("a", 1)]) == [("a", 1, 0, 0.9), ("a", 1, 1, 0.9)]
    assert seen("unseen") == [("a", 1, c, 0.2) for c in range(3)] and len(seen("oof")) == 8
    # a writing that ends before its manifest entry is not seen; one without rows changes nothing
    lost = spark.createDataFrame(rows("b", 2, "oof", 7.0), schema).withColumn("generation", F.lit("lost"))
    lost.write.mode("append").partitionBy(*files.STORE_KEY, "generation").parquet(f"{path}/rows")
    files.write_predictions(spark.createDataFrame([], schema), path)
    assert seen("oof", [("b", 2)]) == [("b", 2, c, 0.3) for c in range(3)]
    plan = files.read_predictions(spark, path, "oof", [("a", 1)])._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert files.stored_versions(spark, path).count() == 4


def test_a_bucket_does_not_grow_with_the_sources(spark):
    """One task sorts and groups a bucket, so 6 GiB of sources have more buckets, not larger ones."""
    counts = []
    for size in (1 << 30, 6 << 30):
        t = Tables(spark, SF)
        t.__dict__["_state"] = ("grown", size)
        counts.append(t.bucket_count)
        assert size / t.bucket_count <= 16 << 20
    assert counts[1] == 6 * counts[0]


def test_tables_are_prepared_in_small_partitions(spark):
    """While a table is prepared its shuffles have partitions of a fixed size; the session's settings come back."""
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before, seen = [spark.conf.get(k, None) for k in keys], []
    t = Tables(spark, SF, buckets=3)
    t.__dict__["_state"] = ("partitions", 60 << 30)

    def build(orders):
        seen.extend(int(spark.conf.get(k)) for k in keys)
        return orders.groupBy("o_custkey").count().withColumnRenamed("o_custkey", "chid")

    assert t._prepared("probe", ("orders",), build).count() > 0
    assert seen[0] <= 16 << 20 and seen[0] * seen[1] >= 60 << 30
    assert [spark.conf.get(k, None) for k in keys] == before


def test_lines_meet_their_parts_first(spark):
    """Lines go to their parts, then with the item to their orders: the second join moves no part key."""
    t = Tables(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = orders_ledger(t.table("lineitem"), t.table("orders"), t.table("part"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("hashpartitioning(l_orderkey") < plan.index("hashpartitioning(l_partkey")
