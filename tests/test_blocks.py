"""Feature blocks written once, and sweeps over them."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from basketry.plans import dataset as ds
from basketry.plans import training as tr
from basketry.plans.blocks import BlockStore
from basketry.queries.base import SPEC, T_END, Tables
from basketry.queries.modeling import CONFIG, TRAIN_END, sources
from basketry.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def store(tables, name):
    return BlockStore(tables.spark, f"{tables.state}/{name}", tables.bucket_count)


def test_digests_follow_what_rows_depend_on(tables):
    a, b = store(tables, "a"), store(tables, "b")
    assert a.digest("items", SPEC, 3, {"x": ds.PurchaseVector()}) == a.digest("items", SPEC, 3, {"x": ds.PurchaseVector()})
    others = [a.digest("raw", 3), a.digest("items", 4), a.digest("items", 3, 1), b.digest("items", 3)]
    assert a.digest("items", 3) not in others and len(set(others)) == 4


def test_datasets_of_blocks_equal_plans(tables):
    cfg = replace(
        CONFIG,
        raw={"txn_cnt": ((2, 0), "leg")},
        behavior={**CONFIG.behavior, "n_shop_tags": "leg"},
        group_stats=(*CONFIG.group_stats, ds.GroupStat("each", ("amt",), (6, 0), "leg", ("nanmean",))),
    )
    blocks = store(tables, "equal")
    plain = ds.build_dataset(tables.priced, tables.profile, tables.clients, SPEC, cfg)
    joined = ds.build_dataset(tables.priced, tables.profile, tables.clients, SPEC, cfg, blocks=blocks)
    columns = sorted(plain.columns)
    assert sorted(joined.columns) == columns
    doubles = [c for c, t in plain.dtypes if t == "double"]
    a, b = (df.withColumns({c: F.round(c, 6) for c in doubles}).select(*columns) for df in (plain, joined))
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # another dataset with some of the blocks writes only what is new
    n = len(blocks.built)
    assert n == len(set(blocks.built)) == 8
    again = replace(cfg, behavior={}, raw={}, group_stats=cfg.group_stats[:1], labels=False)
    ds.build_dataset(tables.priced, tables.profile, tables.clients, SPEC, again, blocks=blocks).count()
    assert len(blocks.built) == n
    ds.build_features(tables.priced, tables.profile, tables.clients, SPEC, replace(again, t_end=T_END - 1, group_stats=()), blocks).count()
    assert len(blocks.built) == n + 3


def test_plan_of_a_block_dataset(tables):
    blocks = store(tables, "plan")
    args = (tables.priced, tables.profile, tables.clients, SPEC, CONFIG)
    ds.build_dataset(*args, blocks=blocks)
    plan = ds.build_dataset(*args, blocks=blocks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 15
    tables.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = replace(CONFIG, group_stats=(), drop_cold_start=False)
        plan = ds.build_dataset(*args[:4], plain, blocks=blocks)._jdf.queryExecution().executedPlan().toString()
    finally:
        tables.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan  # blocks, spine and labels join in place


def test_a_sweep_builds_each_block_once_and_goes_on_where_it_stopped(spark, tables):
    sets = {
        "vectors": replace(ds.model_config(TRAIN_END), behavior={}),
        "behavior": replace(ds.model_config(TRAIN_END), purchases={}, features={}),
    }
    algorithms = {"lr": {"rounds": 2}, "rf": {"trees": 2, "depth": 2}, "gbt": {"rounds": 1, "depth": 2}}
    blocks, path = store(tables, "sweep"), scratch_path(spark, "results")
    src = sources(tables, blocks)
    first = tr.sweep(src, {"vectors": sets["vectors"]}, {"lr": {"rounds": 2}}, "amt", path).collect()
    rows = tr.sweep(src, sets, algorithms, "amt", path).collect()
    assert {(r["feature_set"], r["algorithm"]) for r in rows} == {(s, a) for s in sets for a in algorithms} and len(rows) == 6
    assert first[0] in rows and all(0 <= r["ndcg"] <= 1 and r["n_clients"] > 0 for r in rows)
    # three kinds of item features at two ends, and the training rows of each set
    assert len(blocks.built) == len(set(blocks.built)) == 3 * 2 + 2
    jobs = len(blocks.built)
    assert tr.sweep(src, sets, algorithms, "amt", path).count() == 6 and len(blocks.built) == jobs
    plain = tr.sweep(sources(tables), {"vectors": sets["vectors"]}, {"lr": {"rounds": 2}}, "amt").first()
    assert plain["n_clients"] == first[0]["n_clients"] and plain["ndcg"] == pytest.approx(first[0]["ndcg"], abs=1e-6)
