"""Classifiers over a wide dataset, with predictions as long (chid, tag, label, prob) rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.config import LedgerSpec

ALGORITHMS = ("lr", "rf", "gbt")
SEEDS = (8, 168, 88, 888, 2022)  # fixed values: seeds of the refits
CLASSES_AT_ONCE = 4  # classes trained side by side one against the rest; each holds its own copy of the binned rows


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    gone = {"chid", "tag", "label", "weight", "fold", "is_valid", *exclude}
    return [c for c in df.columns if c not in gone]


def with_label_metadata(df: DataFrame, n_labels: int, label: str = "label") -> DataFrame:
    """Fixes the number of classes, so a class missing from a fold keeps its index."""
    meta = {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(n_labels)]}}
    return df.withColumn(label, F.col(label).cast("double").alias(label, metadata=meta))


def train(
    data: DataFrame,
    spec: LedgerSpec,
    algorithm: str = "lr",
    features: Sequence[str] | None = None,
    weight: str | None = None,
    rounds: int = 20,
    depth: int = 5,
    trees: int = 20,
    seed: int = 168,
    valid: DataFrame | None = None,
    stages: Sequence[Transformer] | None = None,
) -> PipelineModel:
    """A multi-class model with row weights.

    ``lr`` is multinomial regression, ``rf`` a forest, ``gbt`` boosted trees one against the rest; with ``valid`` rows the
    boosted trees stop early on them.  Missing numbers take the mean of the training rows and unknown or missing strings a
    code of their own; both are part of the model.  ``stages`` are the :func:`encoders` of the same rows, if they are known.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm is one of {ALGORITHMS}")
    if valid is not None and algorithm != "gbt":
        raise ValueError("only boosted trees stop early on validation rows")
    features = list(features or feature_columns(data))
    if weight is None:
        data, weight = data.withColumn("weight", F.lit(1.0)), "weight"
    if algorithm == "gbt" and valid is not None:
        if "weight" not in valid.columns:
            valid = valid.withColumn("weight", F.lit(1.0))
        data = data.withColumn("is_valid", F.lit(False)).unionByName(
            valid.withColumn("is_valid", F.lit(True)).select(*data.columns, "is_valid")
        )
    stages = encoders(data, features) if stages is None else stages
    assembled = with_label_metadata(data, len(spec.legit))
    for stage in stages:
        assembled = stage.transform(assembled)
    if algorithm == "lr":
        learner = LogisticRegression(family="multinomial", maxIter=rounds, regParam=0.01, weightCol=weight)
    elif algorithm == "rf":
        learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol=weight)
    else:
        boosted = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)
        if valid is not None:
            boosted = boosted.setValidationIndicatorCol("is_valid")
        learner = OneVsRest(classifier=boosted, weightCol=weight, parallelism=CLASSES_AT_ONCE)
    return PipelineModel([*stages, learner.fit(assembled)])


def encoders(data: DataFrame, features: Sequence[str]) -> list[Transformer]:
    """Stages from feature columns to a vector, fitted on the training rows."""
    types = dict(data.dtypes)
    strings = [f for f in features if types[f] == "string"]
    numbers = [f for f in features if types[f] != "string"]
    stages: list[Transformer] = []
    if strings:
        indexer = StringIndexer(
            inputCols=strings, outputCols=[f"_code_{f}" for f in strings], handleInvalid="keep", stringOrderType="alphabetAsc"
        )
        stages.append(indexer.fit(data))
    if numbers:
        means = data.agg(*[F.avg(F.col(f"`{f}`").cast("double")) for f in numbers]).first()
        filled = [f"coalesce(double(`{f}`), {float(m or 0.0)!r}D) AS `_num_{f}`" for f, m in zip(numbers, means)]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__"))
    inputs = [f"_code_{f}" if f in strings else f"_num_{f}" for f in features]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")]


def save_model(model: PipelineModel, root: str, name: str, version: int, t_end: int) -> str:
    """Stores a model under its name, version and last training period."""
    path = f"{root}/{name}/v{version}/t{t_end}"
    model.write().overwrite().save(path)
    return path


def load_model(root: str, name: str, version: int, t_end: int) -> PipelineModel:
    return PipelineModel.load(f"{root}/{name}/v{version}/t{t_end}")


def predict(model: PipelineModel, data: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Class probabilities per client as rows (chid, tag, label, prob); one row per client and legit item."""
    scored = model.transform(data.drop("label").dropDuplicates(["chid"]))
    if "probability" in scored.columns:
        probs = vector_to_array("probability")
    else:
        # one-against-rest margins: a sigmoid per class, normalised per client
        raw = F.transform(vector_to_array("rawPrediction"), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(m * -2.0)))
        scored = scored.withColumn("_p", raw)
        total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
        probs = F.transform("_p", lambda p: p / total)
    # classes after the last one of the training rows
    probs = F.concat(probs, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(len(spec.legit)) - F.size(probs))))
    tags = F.array(*[F.lit(t) for t in spec.legit])
    long = scored.select("chid", F.posexplode(probs).alias("label", "prob"))
    return long.select("chid", F.get(tags, F.col("label")).alias("tag"), "label", "prob")


def out_of_fold(
    data: DataFrame, spec: LedgerSpec, folds: int, fit: Callable[[DataFrame], PipelineModel]
) -> DataFrame:
    """Predictions of each fold by the model of the other folds; ``data`` has a ``fold`` column by client.

    A fold that holds all rows has no model, and no predictions.
    """
    parts = [predict(fit(inside), outside, spec) for inside, outside in _splits(data, folds)]
    none = "chid long, tag int, label int, prob double"
    return reduce(DataFrame.unionByName, parts) if parts else data.sparkSession.createDataFrame([], none)


def _splits(data: DataFrame, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(rows of the other folds, rows of the fold) for every fold where neither is empty."""
    sizes = dict(data.groupBy("fold").count().collect())
    at = [i for i in range(folds) if 0 < sizes.get(i, 0) < sum(sizes.values())]
    return [(data.filter(F.col("fold") != i).drop("fold"), data.filter(F.col("fold") == i).drop("fold")) for i in at]


def _assembled(model: PipelineModel, data: DataFrame, labels: int) -> DataFrame:
    rows = with_label_metadata(data, labels)
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    return rows


def _true_by_tree(model: PipelineModel, rows: DataFrame) -> tuple[DataFrame, Column, int]:
    """Rows, the probability of the true label after the first ``round`` trees, and the number of trees."""
    learner, label = model.stages[-1], F.col("label").cast("int")
    if not isinstance(learner, OneVsRestModel):
        votes = []
        for i, tree in enumerate(learner.trees):
            names = {tree.probabilityCol: f"_p{i}", tree.rawPredictionCol: f"_r{i}", tree.predictionCol: f"_y{i}"}
            rows = tree.copy(names).transform(rows).drop(f"_r{i}", f"_y{i}")
            votes.append(F.coalesce(F.get(vector_to_array(f"_p{i}"), label), F.lit(0.0)))
        rows = rows.select("label", "weight", F.array(*votes).alias("_votes"))
        seen = F.aggregate(F.slice("_votes", F.lit(1), F.col("round")), F.lit(0.0), lambda a, x: a + x)
        return rows, seen / F.col("round"), len(votes)
    margins, kept = [], rows.columns
    for c, boosted in enumerate(learner.models):
        steps = []
        for i, (tree, weight) in enumerate(zip(boosted.trees, boosted.treeWeights, strict=True)):
            rows = tree.copy({tree.predictionCol: f"_t{i}"}).transform(rows)
            steps.append(F.col(f"_t{i}") * F.lit(float(weight)))
        rows = rows.withColumn(f"_m{c}", F.array(*steps)).select(*kept, *[f"_m{k}" for k in range(c + 1)])
        margins.append(f"_m{c}")
    most = max(len(m.trees) for m in learner.models)
    rows = rows.select("label", "weight", *margins)
    sums = [F.aggregate(F.slice(m, F.lit(1), F.col("round")), F.lit(0.0), lambda a, x: a + x) for m in margins]
    probs = F.array(*[F.lit(1.0) / (F.lit(1.0) + F.exp(s * -2.0)) for s in sums])
    return rows, F.get(probs, label) / F.aggregate(probs, F.lit(0.0), lambda a, x: a + x), most


def _loss(probability: Column) -> Column:
    """Weighted mean log loss."""
    rows = F.col("weight") * -F.log(F.greatest(probability, F.lit(1e-15)))
    return (F.sum(rows) / F.sum("weight")).alias("loss")


def validation_curve(
    data: DataFrame,
    valid: DataFrame,
    spec: LedgerSpec,
    algorithm: str = "lr",
    rounds: int = 20,
    steps: Sequence[int] | None = None,
    fitted: dict[int, PipelineModel] | None = None,
    **params,
) -> DataFrame:
    """Weighted log loss of the validation rows after each round of training: rows (round, loss).

    Trees are trained once with ``rounds`` rounds, and all rounds are scored in one pass, as the first trees of an ensemble
    are those of a shorter training.  A regression is trained anew for each of ``steps`` iterations (all up to ``rounds``).
    Both sides have a ``weight``, or count 1 each.  ``fitted`` takes the models that were trained, by their rounds.
    """
    if "weight" not in data.columns:
        data = data.withColumn("weight", F.lit(1.0))
    if "weight" not in valid.columns:
        valid = valid.withColumn("weight", F.lit(1.0))
    if algorithm != "lr":
        size = {"trees": rounds} if algorithm == "rf" else {"rounds": rounds}
        model = train(data, spec, algorithm, weight="weight", **size, **params)
        if fitted is not None:
            fitted[rounds] = model
        scored, probability, most = _true_by_tree(model, _assembled(model, valid, len(spec.legit)))
        each = scored.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(most))))
        return each.groupBy("round").agg(_loss(probability))
    parts = []
    stages = encoders(data, params.get("features") or feature_columns(data))
    for r in steps or range(1, rounds + 1):
        model = train(data, spec, "lr", weight="weight", rounds=r, stages=stages, **params)
        if fitted is not None:
            fitted[r] = model
        scored = model.transform(valid.withColumn("label", F.col("label").cast("double")))
        found = F.coalesce(F.get(vector_to_array("probability"), F.col("label").cast("int")), F.lit(0.0))
        parts.append(scored.agg(_loss(found)).select(F.lit(r).alias("round"), "loss"))
    return reduce(DataFrame.unionByName, parts)


def best_rounds(curves: DataFrame) -> int:
    """The round with the least mean loss over all curves (rows (round, loss), one per fold), the earliest of equals; rounds
    that a fold did not reach do not count.
    """
    folds = curves.groupBy("round").agg(F.avg("loss").alias("loss"), F.count("loss").alias("n"))
    # one job, as each scores the validation rows anew
    top = F.max("n").over(Window.partitionBy(F.lit(0)))
    best = folds.withColumn("_top", top).where((F.col("n") == F.col("_top")) & (F.col("n") > 0)).orderBy("loss", "round").first()
    if best is None:
        raise ValueError("no round has a loss")
    return best["round"]


def cross_validated_rounds(data: DataFrame, spec: LedgerSpec, folds: int, algorithm: str = "lr", **params) -> int:
    """Best rounds over the folds of ``data`` (column ``fold``, by client); 1 where no fold can be left out."""
    curves = [validation_curve(inside, outside, spec, algorithm, **params) for inside, outside in _splits(data, folds)]
    return best_rounds(reduce(DataFrame.unionByName, curves)) if curves else 1


def final_rounds(best: int, folds: int) -> int:
    """Rounds of the refit on all rows, scaled up from the share a fold trains on."""
    if folds < 2:
        raise ValueError("at least two folds")
    return int(best / (1 - 1 / folds))


def refit_predictions(
    data: DataFrame, target: DataFrame, spec: LedgerSpec, fit: Callable[[DataFrame, int], PipelineModel], seeds: Sequence[int] = SEEDS
) -> DataFrame:
    """Predictions of one refit per seed, with a ``seed`` column."""
    parts = [predict(fit(data, s), target, spec).withColumn("seed", F.lit(s)) for s in seeds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importance_table(model: PipelineModel, data: DataFrame) -> DataFrame:
    """Normalised feature importances, one row per feature: of trees their own, of trees one against the rest the mean
    over the classes, of regressions the mean absolute coefficient.
    """
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    names = [n.removeprefix("_num_").removeprefix("_code_") for n in assembler.getInputCols()]
    learner = model.stages[-1]
    if isinstance(learner, OneVsRestModel):
        found = sum(m.featureImportances.toArray() for m in learner.models) / len(learner.models)
    elif hasattr(learner, "featureImportances"):
        found = learner.featureImportances.toArray()
    else:
        found = abs(learner.coefficientMatrix.toArray()).mean(axis=0)
    values = [float(v) for v in found]
    total = sum(values) or 1.0
    rows = [(n, v, v / total) for n, v in zip(names, values)]
    return data.sparkSession.createDataFrame(rows, "feature string, importance double, normalized double")


def train_multi_label(
    data: DataFrame, spec: LedgerSpec, features: Sequence[str], rounds: int = 20, weight: str | None = None
) -> list[PipelineModel]:
    """One binary regression per label on a multi-hot target ``hot``, with row weights on request."""
    models = []
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    weights = F.lit(1.0) if weight is None else F.col(weight)
    assembled = assembler.transform(data).select("features", "hot", weights.alias("weight"))
    for i in range(len(spec.legit)):
        rows = assembled.withColumn("y", F.get("hot", F.lit(i)).cast("double"))
        learner = LogisticRegression(labelCol="y", maxIter=rounds, regParam=0.01, family="binomial", weightCol="weight")
        models.append(PipelineModel([assembler, learner.fit(rows)]))
    return models


def predict_multi_label(models: Sequence[PipelineModel], data: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Probability per (chid, tag) of the per-label models, in one pass over the data."""
    rows = models[0].stages[0].transform(data)
    columns = []
    for i, m in enumerate(models):
        learner = m.stages[-1]
        learner = learner.copy({learner.probabilityCol: f"_p{i}", learner.rawPredictionCol: f"_r{i}", learner.predictionCol: f"_y{i}"})
        rows = learner.transform(rows)
        columns.append(F.get(vector_to_array(f"_p{i}"), F.lit(1)))
    tags = F.array(*[F.lit(t) for t in spec.legit])
    long = rows.select("chid", F.posexplode(F.array(*columns)).alias("label", "prob"))
    return long.select("chid", F.get(tags, F.col("label")).alias("tag"), "label", "prob")
