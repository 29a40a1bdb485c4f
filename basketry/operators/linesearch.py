"""Blend weights by exact line search.

Along one weight a client's item scores are straight lines, so its ranking and its NDCG@3 change at the crossings of two
lines only.  Every client gives its crossings with the change of its NDCG; added up over all clients and swept in order they
give the mean NDCG at every value of the weight at once, and its best interval.  A round does so for every weight in one
job, moves the one that gains most to the middle of its interval, and the rounds end when none gains.

NDCG is counted in whole billionths, so the sums do not depend on their order.  The sweep is distributed: crossings are
dealt to bins of the weight's range, each bin is swept by a task, and only one row per bin is swept in the end.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.config import LedgerSpec
from basketry.operators.metrics import DISCOUNTS, client_actuals
from basketry.operators.stacking import Model, is_model
from basketry.session import written

UNITS = 1_000_000_000
BINS = 4096
MAX_ROUNDS = 12
#: scores of items at crossings that are in memory at a time
CELLS = 1 << 20


def client_items(store: DataFrame, ledger: DataFrame, spec: LedgerSpec, t: int, models: Sequence[Model]) -> DataFrame:
    """One row per scored client: of its items in order, every model's probability (none: 0) and the amount; the ideal gain."""
    prob = [F.max(F.when(is_model(m), F.col("prob"))).alias(f"p{i}") for i, m in enumerate(models)]
    cells = store.filter(F.col("tag").isin(*spec.legit)).groupBy("chid", "tag").agg(*prob)
    probs = F.array(*[F.coalesce(f"p{i}", F.lit(0.0)) for i in range(len(models))])
    packed = cells.groupBy("chid").agg(F.array_sort(F.collect_list(F.struct("tag", probs.alias("p")))).alias("items"))
    actual = client_actuals(ledger, spec, t).filter(F.col("ideal") > 0)
    amounts = F.transform("items", lambda x: F.coalesce(F.try_element_at("amounts", x["tag"]), F.lit(0.0)))
    probs = F.flatten(F.transform("items", lambda x: x["p"]))
    return packed.join(actual, "chid").select(probs.alias("probs"), amounts.alias("amounts"), "ideal")


def _units(scores: np.ndarray, amounts: np.ndarray, ideal: np.ndarray) -> np.ndarray:
    """NDCG@3 in whole units of scored items (clients, intervals, items); the later item wins a tie."""
    scores, gain = scores.copy(), np.zeros(scores.shape[:2])
    for d in DISCOUNTS:
        best = scores.shape[2] - 1 - scores[:, :, ::-1].argmax(axis=2)
        gain += np.take_along_axis(amounts, best, axis=1) / d
        np.put_along_axis(scores, best[:, :, None], -np.inf, axis=2)
    return np.floor(gain / ideal[:, None] * UNITS + 0.5).astype(np.int64)


def _weighted(probs: np.ndarray, weights: Sequence[float], without: int | None = None) -> np.ndarray:
    """Sums of weight x probability, in the order of the models."""
    out = np.zeros(probs.shape[:2])
    for i, w in enumerate(weights):
        if i != without:
            out = out + probs[:, :, i] * w
    return out


def client_changes(
    probs: np.ndarray, amounts: np.ndarray, ideal: np.ndarray, weights: Sequence[float]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(direction, at, change) of the clients: for each weight the NDCG at 0 and where it changes on the way to 1; and as
    direction -1 the NDCG at the present weights.  Missing items have the amount 0 and no number as probability.
    """
    present = _weighted(probs, weights)
    there = ~np.isnan(present)
    value = _units(np.where(there, present, -np.inf)[:, None, :], amounts, ideal)[:, 0]
    out = [(np.full(len(ideal), -1), np.zeros(len(ideal)), value)]
    first, second = np.triu_indices(probs.shape[1], 1)
    for d in range(len(weights)):
        c, q = _weighted(probs, weights, d), probs[:, :, d]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (c[:, first] - c[:, second]) / (q[:, second] - q[:, first])
        at = np.sort(np.where((at > 0) & (at < 1), at, 1.0), axis=1)
        low = np.concatenate([np.zeros((len(at), 1)), at], axis=1)
        high = np.concatenate([at, np.ones((len(at), 1))], axis=1)
        middle = (low + high) / 2
        scores = c[:, None, :] + middle[:, :, None] * q[:, None, :]
        value = _units(np.where(there[:, None, :], scores, -np.inf), amounts, ideal)
        rows, place = np.nonzero(high > low)
        value = value[rows, place]
        begins = np.append(True, rows[1:] != rows[:-1])
        change = np.where(begins, value, value - np.append(0, value[:-1]))
        kept = begins | (change != 0)
        out.append((np.full(int(kept.sum()), d), low[rows, place][kept], change[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _changes(clients: DataFrame, weights: Sequence[float]) -> DataFrame:
    """:func:`client_changes` of all clients."""
    k = len(weights)

    def padded(column: pa.Array, width: int, fill: float) -> np.ndarray:
        sizes = np.diff(column.offsets.to_numpy())
        out = np.full((len(column), width), fill)
        out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
        return out

    def run(batches):
        for batch in batches:
            most = int(np.diff(batch.column(1).offsets.to_numpy()).max(initial=0))
            if not most:
                continue
            step = max(1, CELLS // (most * (most * (most - 1) // 2 + 1)))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                probs = padded(part.column(0), most * k, np.nan).reshape(len(part), most, k)
                found = client_changes(probs, padded(part.column(1), most, 0.0), part.column(2).to_numpy(), weights)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[0], pa.int32()), pa.array(found[1]), pa.array(found[2])], names=["direction", "at", "change"]
                )

    return clients.mapInArrow(run, "direction int, at double, change long")


def sweep(changes: DataFrame) -> DataFrame:
    """(direction, total, low, high): the greatest running sum of the changes of a direction in order, and the interval
    where it holds, the first one of equals.
    """
    steps = changes.groupBy("direction", "at").agg(F.sum("change").alias("change"))
    steps = steps.withColumn("bin", F.least(F.floor(F.col("at") * BINS), F.lit(BINS - 1)).cast("int"))
    within = Window.partitionBy("direction", "bin").orderBy("at")
    run = F.sum("change").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = steps.withColumns({"run": run, "until": F.lead("at").over(within)})
    bins = steps.groupBy("direction", "bin").agg(
        F.sum("change").alias("all"),
        F.min("at").alias("first"),
        F.max("run").alias("best"),
        F.min_by(F.struct("at", "until"), F.struct(-F.col("run"), F.col("at"))).alias("here"),
    )
    along = Window.partitionBy("direction").orderBy("bin")  # at most BINS rows
    before = F.sum("all").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("all")
    bins = bins.select(
        "direction",
        (before + F.col("best")).alias("total"),
        F.col("here.at").alias("low"),
        F.coalesce(F.col("here.until"), F.lead("first").over(along), F.lit(1.0)).alias("high"),
    )
    top = F.min_by(F.struct("total", "low", "high"), F.struct(-F.col("total"), F.col("low")))
    return bins.groupBy("direction").agg(top.alias("t")).select("direction", "t.*")


def blend_line_search(
    store: DataFrame,
    ledger: DataFrame,
    spec: LedgerSpec,
    t: int,
    models: Sequence[Model],
    start: Sequence[float] | None = None,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """The best weights found from ``start`` (equal ones), each between 0 and 1: rows (model, version, weight, n_clients,
    ndcg, rounds) with the mean NDCG@3 of the blend.

    The clients' items are written once; a round is one job over them that returns a row per weight.
    """
    clients = written(client_items(store, ledger, spec, t, models), "blend-items")
    n_clients = clients.count()
    weights = [1.0 / len(models)] * len(models) if start is None else [float(w) for w in start]
    best: tuple[int, list[float], int] = (-1, weights, 0)
    rounds = 0
    while True:
        found = {r["direction"]: r for r in sweep(_changes(clients, weights)).collect()}
        present = found.pop(-1)["total"] if found else 0
        if present <= best[0]:
            break  # an interval too narrow for its middle to lie inside
        best = (present, weights, rounds)
        move = min(found.values(), key=lambda r: (-r["total"], r["direction"]), default=None)
        if move is None or move["total"] <= present or rounds == max_rounds:
            break
        weights = list(weights)
        weights[move["direction"]] = (move["low"] + move["high"]) / 2
        rounds += 1
    total, weights, rounds = best
    ndcg = total / UNITS / n_clients if n_clients else None
    rows = [(name, version, w, n_clients, ndcg, rounds) for (name, version), w in zip(models, weights, strict=True)]
    return store.sparkSession.createDataFrame(
        rows, "model string, version int, weight double, n_clients long, ndcg double, rounds int"
    )
