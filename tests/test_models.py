"""Properties of queries that train models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketry.operators import labels as lab
from basketry.operators import metrics as met
from basketry.operators import models as ml
from basketry.operators import ranking as rnk
from basketry.operators import stacking as stk
from basketry.plans import dataset as ds
from basketry.plans import training as tr
from basketry.queries import REGISTRY
from basketry.queries.base import MODELS, SPEC, T_END, TARGET, Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def src(spark):
    t = Tables(spark, SF)
    return tr.Sources(t.priced, t.profile, t.clients, SPEC)


def test_production_predictions_cover_everybody_and_beat_the_popular_ranking(spark, src):
    model = tr.train_model(src, ds.model_config(T_END - 1), "amt", "rf", trees=10)
    probs = tr.predict_clients(src, model, ds.model_config(T_END)).cache()
    assert probs.count() == src.clients.count() * len(SPEC.legit)
    sums = probs.groupBy("chid").agg(F.sum("prob").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    ranking = rnk.rank_by_probability(probs, SPEC)
    assert ranking.filter("top1 = top2 OR top2 = top3 OR top1 = top3").count() == 0
    score = met.mean_ndcg(met.client_ndcg(ranking, src.ledger, SPEC, TARGET)).first().ndcg
    t = Tables(spark, SF)
    rated = rnk.rank_by_rating(t.past, t.clients, SPEC, 100.0)
    base = met.mean_ndcg(met.client_ndcg(rated, src.ledger, SPEC, TARGET)).first().ndcg
    assert base < score <= 1
    table = ml.importance_table(model, probs).collect()
    assert sum(r.normalized for r in table) == pytest.approx(1.0)
    probs.unpersist()


def test_missing_label_keeps_its_index(src):
    data = ds.build_dataset(src.ledger, src.profile, src.clients, SPEC, ds.model_config(T_END - 1, features={}))
    model = ml.train(data.filter("label <> 7"), SPEC, "lr", rounds=5)
    got = ml.predict(model, data, SPEC)
    assert got.select("label").distinct().count() == len(SPEC.legit)


def test_boosted_trees_give_probabilities(src):
    cfg = ds.model_config(T_END - 1, features={}, behavior={})
    data = ds.build_dataset(src.ledger, src.profile, src.clients, SPEC, cfg)
    got = ml.predict(ml.train(data, SPEC, "gbt", rounds=2, depth=2), data, SPEC)
    bad = got.groupBy("chid").agg(F.sum("prob").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-9)
    assert bad.count() == 0
    with pytest.raises(ValueError):
        ml.train(data, SPEC, "svm")


def test_out_of_fold_covers_every_client_once(spark):
    t = Tables(spark, SF)
    got = REGISTRY["p06_out_of_fold"].run(spark, SF)
    # the stacker learns from out-of-fold rows: labelled clients that every model has predicted out of fold
    known = stk.prediction_matrix(t.predictions.filter("split = 'oof'"), SPEC, MODELS).select("chid")
    labels = lab.label_rows(t.ledger, SPEC, T_END).join(known, "chid", "left_semi")
    assert got.count() == labels.select("chid").distinct().count() * len(SPEC.legit)
    assert got.groupBy("chid", "tag").count().filter("count > 1").count() == 0


def test_rounds_of_the_refit():
    assert ml.final_rounds(100, 5) == 125
    with pytest.raises(ValueError):
        ml.final_rounds(100, 1)


@pytest.mark.parametrize("name,rows", [("p01_temporal_folds", 2), ("p12_sweep", 6), ("k06_vector_grid", 4)])
def test_scored_tables(spark, name, rows):
    got = REGISTRY[name].run(spark, SF).collect()
    assert len(got) == rows
    assert all(0 < r.ndcg <= 1 and r.n_clients == got[-1].n_clients or name == "p01_temporal_folds" for r in got)


def test_stacker_blend_ranks_every_client(spark):
    t = Tables(spark, SF)
    got = REGISTRY["p08_stacker_and_blend"].run(spark, SF)
    assert got.count() == t.clients.count()
    assert got.filter(~F.col("top1").isin(*SPEC.legit)).count() == 0


def test_multi_label_probabilities(spark):
    t = Tables(spark, SF)
    got = REGISTRY["p11_multi_label"].run(spark, SF)
    assert got.count() == t.clients.count() * len(SPEC.legit)
    assert got.filter("prob < 0 OR prob > 1").count() == 0


def test_all_blocks_have_no_gaps(spark):
    t = Tables(spark, SF)
    got = REGISTRY["p13_all_blocks"].run(spark, SF)
    wide = got.drop("nation", "region", "prio").toPandas()
    assert len(wide) == t.clients.count() and wide["chid"].is_unique
    assert not wide.isna().any().any()


def test_meta_dataset_keeps_clients_of_all_models(spark):
    t = Tables(spark, SF)
    store = t.predictions.filter("split = 'oof'")
    got = stk.prediction_matrix(store, SPEC, MODELS)
    per_client = store.groupBy("chid").agg(F.count_distinct("version").alias("n")).filter(f"n = {len(MODELS)}")
    assert got.count() == per_client.count()
