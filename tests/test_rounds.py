"""Rounds chosen by validation curves, against models trained anew for every round."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import models as ml


@pytest.fixture(scope="module")
def rows(spark, spec):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 3))
    label = (x[:, 0] + 0.6 * rng.normal(size=240) > 0.2).astype(int) + (x[:, 1] > 0.8)
    data = [(i, *map(float, r), int(y), float(w)) for i, (r, y, w) in enumerate(zip(x, label, rng.uniform(0.5, 2, 240)))]
    df = spark.createDataFrame(data, "chid long, a double, b double, c double, label int, weight double")
    return df.filter("chid % 3 > 0").cache(), df.filter("chid % 3 = 0").cache()


def loss_of(model, valid, spec):
    scored = ml.predict(model, valid, spec).join(valid.select("chid", "label", "weight"), ["chid", "label"]).collect()
    return sum(-r["weight"] * np.log(max(r["prob"], 1e-15)) for r in scored) / sum(r["weight"] for r in scored)


@pytest.mark.parametrize("algorithm", ["gbt", "lr"])
def test_curve_equals_training_anew(rows, spec, algorithm):
    data, valid = rows
    params = {"depth": 2} if algorithm == "gbt" else {}
    curve = {r["round"]: r["loss"] for r in ml.validation_curve(data, valid, spec, algorithm, 4, **params).collect()}
    assert sorted(curve) == [1, 2, 3, 4]
    for r in (1, 2, 4):
        model = ml.train(data, spec, algorithm, weight="weight", rounds=r, **params)
        assert curve[r] == pytest.approx(loss_of(model, valid, spec), rel=1e-9)


def test_curve_of_a_forest_ends_with_the_whole_forest(rows, spec):
    data, valid = rows
    curve = {r["round"]: r["loss"] for r in ml.validation_curve(data, valid, spec, "rf", 6, depth=3).collect()}
    model = ml.train(data, spec, "rf", weight="weight", trees=6, depth=3)
    assert sorted(curve) == [1, 2, 3, 4, 5, 6] and curve[6] == pytest.approx(loss_of(model, valid, spec), rel=1e-9)


def test_best_round_is_the_first_of_the_least_mean(spark):
    curves = [(1, 0.9), (2, 0.5), (3, 0.6), (4, 0.1), (1, 0.7), (2, 0.5), (3, 0.4)]
    assert ml.best_rounds(spark.createDataFrame(curves, "round int, loss double")) == 2  # 4 is known to one fold only
    with pytest.raises(ValueError):
        ml.best_rounds(spark.createDataFrame([(1, None)], "round int, loss double"))


def test_cross_validated_rounds(rows, spec):
    data = rows[0].withColumn("fold", (F.col("chid") % 2).cast("int"))
    curves = []
    for i in (0, 1):
        inside, outside = data.filter(F.col("fold") != i).drop("fold"), data.filter(F.col("fold") == i).drop("fold")
        curves.append({n: loss_of(ml.train(inside, spec, "lr", weight="weight", rounds=n), outside, spec) for n in (1, 3, 9)})
    want = min((1, 3, 9), key=lambda n: (curves[0][n] + curves[1][n], n))
    assert ml.cross_validated_rounds(data, spec, 2, "lr", steps=(1, 3, 9)) == want


def test_curves_are_scored_once(spark):
    """Choosing a round scores the validation rows in one job, not once for the folds and once for the best."""
    seen = spark.sparkContext.accumulator(0)

    def loss(r):
        seen.add(1)
        return abs(r - 3) / 10

    curves = spark.range(1, 6).select(F.col("id").cast("int").alias("round"), F.udf(loss, "double")("id").alias("loss"))
    assert ml.best_rounds(curves) == 3
    assert seen.value == 5


@pytest.mark.parametrize("algorithm,steps", [("lr", (1, 3)), ("rf", None), ("gbt", None)])
def test_models_of_a_curve_are_those_of_a_training(spark, spec, algorithm, steps):
    rows = [(i, float(i % 7), float(i * i % 11), i % 3) for i in range(90)]
    data = spark.createDataFrame(rows, "chid long, x double, y double, label int")
    fitted = {}
    params = {} if algorithm == "lr" else {"depth": 2}
    ml.validation_curve(data, data, spec, algorithm, 2, steps=steps, fitted=fitted, **params).collect()
    assert sorted(fitted) == sorted(steps or (2,))
    for rounds, model in fitted.items():
        size = {"trees" if algorithm == "rf" else "rounds": rounds}
        alone = ml.train(data, spec, algorithm, **size, **params)
        got, want = (
            {(r.chid, r.tag): r.prob for r in ml.predict(m, data, spec).collect()} for m in (model, alone)
        )
        assert got == pytest.approx(want)
