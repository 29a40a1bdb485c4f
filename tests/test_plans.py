"""Physical plans: pruning, pushdown, no cross products, no shuffle where the ledger is already placed."""

from __future__ import annotations

import re

import pytest

from basketry.operators import behavior as beh
from basketry.operators import labels as lab
from basketry.operators import panel as pan
from basketry.queries import REGISTRY
from basketry.queries.base import SPEC, T_END, Tables

SF = "/root/testdata/sf0.01"  # large enough for more than one bucket


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df) -> list[int]:
    """Files each scan of a query opened, from the metrics of the finished plan."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    found = []

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            found.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(execution.executedPlan())
    return found


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def test_client_aggregates_need_no_shuffle(tables):
    plan = plan_of(beh.history(tables.ledger, T_END))
    assert "Exchange" not in plan
    assert "Bucketed: true" in plan


def test_period_filter_and_columns_reach_the_scan(tables):
    plan = plan_of(REGISTRY["s06_pruned_read"].run(tables.spark, SF))
    assert re.search(r"PartitionFilters: \[.*\(dt#\d+ >= 12\), \(dt#\d+ <= 23\)", plan)
    assert "ReadSchema: struct<chid:bigint,txn_cnt:bigint>" in plan


def test_queries_open_the_files_of_their_periods_only(tables):
    periods = tables.ledger.select("dt").distinct().count()
    (every,) = files_read(tables.ledger.select("chid"))
    (one,) = files_read(tables.ledger.filter("dt = 20").select("chid"))
    assert every > periods and 0 < one <= every // periods + 1
    (some,) = files_read(REGISTRY["s06_pruned_read"].run(tables.spark, SF))
    assert 0 < some <= 12 * one
    (labels,) = files_read(REGISTRY["l01_label_rows"].run(tables.spark, SF))
    assert 0 < labels <= one


def test_folds_prune_periods_at_run_time(tables):
    """The periods stand in a table that only the running query knows."""
    (one,) = files_read(tables.ledger.filter("dt = 20").select("chid"))
    rows = REGISTRY["l05_temporal_folds"].run(tables.spark, SF)
    plan = plan_of(rows)
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan
    (opened,) = files_read(rows)
    assert 0 < opened <= 4 * one  # periods 21 to 24
    folds = tables.spark.createDataFrame([(24, 0, "train", 23)], "dt int, fold int, split string, t_end int")
    (opened,) = files_read(lab.fold_label_rows(tables.ledger, SPEC, folds))
    assert 0 < opened <= one


def test_scans_of_quantiles_and_shares(spark):
    """Two passes over the rows for any number of quantiles; one over what is shared out."""
    most = {"a10_amount_quartiles": 2, "w04_final_weights": 4, "a12_item_shares": 6}
    for name, scans in most.items():
        plan = plan_of(REGISTRY[name].run(spark, SF))
        assert plan.count("FileScan") <= scans, name
        assert len(re.findall(r"Exchange ", plan)) <= 8, name


def test_item_filter_reaches_the_scan(tables):
    plan = plan_of(REGISTRY["l01_label_rows"].run(tables.spark, SF))
    assert re.search(r"PushedFilters: \[.*In\(tag", plan) and "Exchange" not in plan


@pytest.mark.parametrize(
    "name",
    ["s00_ledger", "b01_all_features", "d04_parameter_sets", "j01_feature_assembly", "k02_baseline_ndcg", "p09_blend_weight_search", "p13_dataset", "a11_attribute_shares"],
)
def test_no_cross_products(spark, name):
    plan = plan_of(REGISTRY[name].run(spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_python_in_the_feature_plan(spark):
    plan = plan_of(REGISTRY["p13_dataset"].run(spark, SF))
    assert "Python" not in plan and "MapInPandas" not in plan


def test_the_grid_is_not_shuffled(tables):
    """Densifying opens the grid after the client join, and the join itself moves nothing."""
    spark = tables.spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(beh.behavior(tables.ledger, tables.clients, SPEC, T_END, ["gap_since_last"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("Generate explode") < plan.index("SortMergeJoin")
    assert "Exchange" not in plan and "SelectedBucketsCount: 2 out of 2" in plan


def test_a_written_ledger_bucket_keeps_rows_together(tables):
    plan = plan_of(pan.pivot_items(beh.history(tables.ledger, T_END), SPEC, ["last_dt"]))
    assert "Exchange" not in plan


@pytest.mark.parametrize(
    "name",
    ["k04_rank_by_vector", "b01_all_features", "b07_items_per_period", "d04_parameter_sets", "r01_lags_on_grid", "j11_key_concat", "m02_client_ndcg", "j03_binary_labels"],
)
def test_client_queries_move_nothing_by_key(spark, name):
    """Without any broadcast, ledger, profile and clients join and group in place; only item totals are exchanged."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(REGISTRY[name].run(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert [k for k in keys if "chid" in k] == []
