"""Datasets of few blocks, models with attributes and absent classes, stored models, plans that start no job."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from basketry.operators import models as ml
from basketry.operators import neighbors as nei
from basketry.plans import dataset as ds
from basketry.plans import training as tr
from basketry.queries import REGISTRY
from basketry.queries.base import SPEC, T_END, Tables
from basketry.queries.modeling import TRAIN_END, sources
from basketry.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def src(spark):
    return sources(Tables(spark, SF))


@pytest.mark.parametrize(
    "cfg",
    [
        ds.DatasetConfig(T_END),
        ds.DatasetConfig(T_END, behavior={"n_shop_tags": "leg"}),
        ds.DatasetConfig(T_END, purchases={"v": ds.PurchaseVector(ds.Decay(), neighbors={"n_candidates": 20, "k": 3, "n_pools": 2})}),
        ds.DatasetConfig(T_END, attributes=("segment",)),
    ],
    ids=["spine", "counts", "neighbours", "attributes"],
)
def test_datasets_of_one_block(src, cfg):
    out = ds.build_features(src.ledger, src.profile, src.clients, SPEC, cfg)
    assert out.count() == src.clients.count() and out.select("chid").distinct().count() == out.count()


def test_attributes_are_features_of_stored_models(spark, src):
    cfg = replace(ds.model_config(TRAIN_END), attributes=("segment", "prio"))
    model = tr.train_model(src, cfg, "amt", rounds=2)
    root = scratch_path(spark, "models")
    ml.save_model(model, root, "lr", 1, TRAIN_END)
    # a client without history has no attributes at all
    extra = src.clients.union(spark.createDataFrame([(999_999,)], "chid long"))
    scored = tr.predict_clients(replace(src, clients=extra), ml.load_model(root, "lr", 1, TRAIN_END), replace(cfg, t_end=T_END))
    sums = scored.groupBy("chid").agg(F.count("*").alias("n"), F.sum("prob").alias("p"))
    assert sums.count() == extra.count()
    assert sums.where("n <> 8 or abs(p - 1) > 1e-6").count() == 0
    names = {r.feature for r in ml.importance_table(model, scored).collect()}
    assert {"segment", "prio"} <= names


@pytest.mark.parametrize("algorithm", ml.ALGORITHMS)
def test_absent_last_classes_keep_their_rows(spark, spec, algorithm):
    data = spark.createDataFrame([(i, float(i % 5), i % 2) for i in range(60)], "chid long, x double, label int")
    params = {"rounds": 2, "depth": 2} if algorithm == "gbt" else {}
    model = ml.train(data, spec, algorithm, trees=3, **params)
    out = ml.predict(model, data, spec)
    assert out.count() == 60 * len(spec.legit)
    assert out.where("label = 2").agg(F.max("prob")).first()[0] < 0.2
    total = ml.importance_table(model, data).agg(F.sum("normalized")).first()[0]
    assert total == pytest.approx(1.0) or total == 0.0


def test_validation_rows_need_boosted_trees(spark, spec):
    data = spark.createDataFrame([(1, 0.5, 1)], "chid long, x double, label int")
    with pytest.raises(ValueError, match="boosted"):
        ml.train(data, spec, "lr", valid=data)


@pytest.mark.parametrize("name", ["n01_cosine_neighbors", "n05_equal_attribute_blend", "p13_dataset"])
def test_building_a_plan_starts_no_job(spark, src, name):
    tables = Tables(spark, SF)
    tables.ledger, tables.profile, tables.clients  # noqa: B018 - prepared before
    spark.sparkContext.setJobGroup(name, name)
    REGISTRY[name].run(spark, SF)
    started = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(started) == []


def test_neighbours_and_statistics_force_no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("n01_cosine_neighbors", "n05_equal_attribute_blend", "j04_group_stats_join", "a02_each_attribute"):
            if name in REGISTRY:
                plan = REGISTRY[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
                assert "BroadcastHashJoin" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pools_grow_with_clients():
    assert nei.pool_count(100) == 1 and nei.pool_count(10**9) == 50_000 and nei.pool_count(10**6, 50_000) == 10
