"""Training, evaluation, inference and sweeps built from the dataset plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.config import Decay, LedgerSpec
from basketry.operators import models as ml
from basketry.operators.decayed import decayed_purchases
from basketry.operators.metrics import client_ndcg, mean_ndcg
from basketry.operators.neighbors import GridPoint, grid_blend
from basketry.operators.ranking import rank_by_probability, rank_by_vector
from basketry.operators.weights import active_weights, label_weights
from basketry.operators.labels import label_rows
from basketry.session import scratch_path, written
from basketry.plans.blocks import BlockStore
from basketry.plans.dataset import DatasetConfig, build_dataset, build_features


@dataclass(frozen=True)
class Sources:
    """The three tables every plan starts from; with ``blocks`` features are written once and shared by all plans."""

    ledger: DataFrame
    profile: DataFrame
    clients: DataFrame
    spec: LedgerSpec
    blocks: BlockStore | None = None


def weighted_dataset(
    src: Sources, cfg: DatasetConfig, amount: str, imputation: str = "denoise", blocked: DataFrame | None = None
) -> DataFrame:
    """Training rows with the sample weight of their label, written once: a learner reads them many times.

    With blocks the rows are one as well, so all algorithms of a sweep share them.
    """

    def rows() -> DataFrame:
        data = build_dataset(src.ledger, src.profile, src.clients, src.spec, cfg, blocked, src.blocks)
        labels = label_rows(src.ledger, src.spec, cfg.t_end)
        weights = label_weights(labels, active_weights(src.ledger, src.spec, cfg.t_end, amount), imputation)
        # an item without any history has no weight; exp(0) keeps its rows
        known = weights.select("chid", "label", F.coalesce("weight", F.lit(1.0)).alias("weight"))
        return data.join(known, ["chid", "label"])

    if src.blocks is None or blocked is not None:
        return written(rows(), "training")
    return src.blocks.keep("training", (src.spec, cfg, amount, imputation), rows)


def train_model(
    src: Sources, cfg: DatasetConfig, amount: str, algorithm: str = "lr", valid: DataFrame | None = None, **params
) -> PipelineModel:
    data = weighted_dataset(src, cfg, amount)
    return ml.train(data, src.spec, algorithm, weight="weight", valid=valid, **params)


def predict_clients(src: Sources, model: PipelineModel, cfg: DatasetConfig) -> DataFrame:
    """Production inference: long probabilities of every client at ``cfg.t_end``."""
    cfg = replace(cfg, labels=False, production=True)
    return ml.predict(model, build_features(src.ledger, src.profile, src.clients, src.spec, cfg, src.blocks), src.spec)


def evaluate(src: Sources, predictions: DataFrame, t: int) -> DataFrame:
    """(chid, ndcg) of the ranking behind long probabilities."""
    return client_ndcg(rank_by_probability(predictions, src.spec), src.ledger, src.spec, t)


def reevaluate(src: Sources, models: dict[str, PipelineModel], cfg: DatasetConfig) -> DataFrame:
    """Per-client NDCG of stored models on all clients, one ``model`` label each."""
    parts = []
    for name, model in models.items():
        scored = evaluate(src, predict_clients(src, model, cfg), cfg.t_end + src.spec.horizon)
        parts.append(scored.select(F.lit(name).alias("model"), "chid", "ndcg"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RESULTS = "feature_set string, algorithm string, t_end int, n_clients long, ndcg double"


def sweep(
    src: Sources,
    feature_sets: dict[str, DatasetConfig],
    algorithms: Sequence[str] | dict[str, dict],
    amount: str,
    results: str | None = None,
    **params,
) -> DataFrame:
    """Mean NDCG of every feature set x algorithm on the period after training.

    ``algorithms`` may give parameters of their own.  With blocks a feature set is built once for all algorithms.  Every
    point is appended to the table at ``results`` as soon as it is scored, and points that stand there already are not
    repeated, so a sweep that was cut short goes on where it stopped.
    """
    spark = src.ledger.sparkSession
    path = results or scratch_path(spark, "sweep")
    own = algorithms if isinstance(algorithms, dict) else {a: {} for a in algorithms}
    spark.createDataFrame([], RESULTS).write.mode("append").parquet(path)
    table = spark.read.schema(RESULTS).parquet(path)
    done = {(r[0], r[1], r[2]) for r in table.select("feature_set", "algorithm", "t_end").collect()}
    for (name, cfg), (algorithm, extra) in product(feature_sets.items(), own.items()):
        if (name, algorithm, cfg.t_end) in done:
            continue
        model = train_model(src, cfg, amount, algorithm, **params, **extra)
        valid = replace(cfg, t_end=cfg.t_end + 1)
        score = mean_ndcg(evaluate(src, predict_clients(src, model, valid), valid.t_end + src.spec.horizon))
        point = [F.lit(name).alias("feature_set"), F.lit(algorithm).alias("algorithm"), F.lit(cfg.t_end).alias("t_end")]
        score.select(*point, "n_clients", "ndcg").write.mode("append").parquet(path)
    points = F.lit(False)
    for name, cfg in feature_sets.items():
        points = points | ((F.col("feature_set") == name) & (F.col("t_end") == cfg.t_end) & F.col("algorithm").isin(*own))
    # read again: the files have been added to
    return spark.read.schema(RESULTS).parquet(path).where(points)


@dataclass(frozen=True)
class VectorParams:
    """One point of the vector-ranking grid."""

    decay: Decay
    alpha: float
    measure: str
    k: int
    n_candidates: int


def vector_grid(
    gp_sizes: Sequence[int],
    decays_g: Sequence[float],
    decays_b: Sequence[float],
    alphas: Sequence[float],
    measures: Sequence[str],
    ks: Sequence[int],
    candidates: Sequence[int],
    window: int,
) -> list[VectorParams]:
    """Full grid without the points where k exceeds the candidates."""
    return [
        VectorParams(Decay(window, gp, g, b), a, m, k, n)
        for gp, g, b, a, m, k, n in product(gp_sizes, decays_g, decays_b, alphas, measures, ks, candidates)
        if k <= n
    ]


def search_vectors(src: Sources, t_end: int, grid: Sequence[VectorParams], n_pools: int | None = None) -> DataFrame:
    """Mean NDCG of the vector ranking at every grid point, in one job.

    All decays are aggregated together, every pool is compared once for all points, and rankings and their scores are
    grouped by point; the ledger is read as often for a grid as for one point.
    """
    decays = list(dict.fromkeys(p.decay for p in grid))
    names = {d: f"v{i}" for i, d in enumerate(decays)}
    own = decayed_purchases(src.ledger, src.clients, src.spec, t_end, {names[d]: d for d in decays}, "all")
    points = [GridPoint(decays.index(p.decay), p.n_candidates, p.k, p.alpha, p.measure) for p in grid]
    vectors = grid_blend(own, src.clients, src.spec, list(names.values()), points, n_pools)
    ranking = rank_by_vector(vectors, src.ledger, src.clients, src.spec, "value", 1, t_end + 1, ("point",))
    scored = client_ndcg(ranking, src.ledger, src.spec, t_end + src.spec.horizon, by=("point",))
    found = scored.groupBy("point").agg(F.count("*").alias("n_clients"), F.avg("ndcg").alias("ndcg"))
    rows = [
        (i, p.decay.gp_size, float(p.decay.decay_g), float(p.decay.decay_b), float(p.alpha), p.measure, p.k, p.n_candidates)
        for i, p in enumerate(grid)
    ]
    named = src.ledger.sparkSession.createDataFrame(
        rows, "point int, gp_size int, decay_g double, decay_b double, alpha double, measure string, k int, n_candidates int"
    )
    return named.join(found, "point", "left").drop("point").na.fill(0, subset=["n_clients"])
