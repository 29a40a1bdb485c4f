"""Collaborative vectors: a client's own vector blended with the mean of similar clients.

Each client is compared with a random sample of clients, never with all of them.  Clients are split into pools by key
hash; the members of a pool with the smallest second hash are its candidates.  The clients of a pool are dealt to slices,
as many as the clients ask for, and each slice meets all candidates of its pool in one task, where the comparison is a
matrix product: no pair ever becomes a row, and nothing passes through the driver.  A task holds one slice however many
clients a pool has; the number of pools, where none is named, grows with the clients too (:func:`pool_count`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.config import LedgerSpec
from basketry.functions.hashing import key_hash

POOL_SEED, ORDER_SEED, SPREAD_SEED, SLICE_SEED = 1, 2, 3, 4
SPREAD = 64
POOL_CLIENTS = 20_000


def pool_count(n_clients: int, n_candidates: int = 1000) -> int:
    """Pools of about POOL_CLIENTS clients each, or of twice the candidates if that is more."""
    return max(1, n_clients // max(POOL_CLIENTS, 2 * n_candidates))


def _counted(clients: DataFrame) -> Column:
    """The number of clients, found when the plan runs."""
    return clients.select(F.count(F.lit(1)).alias("n")).scalar()


def pools(clients: DataFrame, n_pools: int | None, n_candidates: int) -> Column:
    """The number of pools named, or else that of :func:`pool_count`."""
    if n_pools is not None:
        return F.lit(n_pools)
    each = max(POOL_CLIENTS, 2 * n_candidates)
    return F.greatest(F.lit(1), F.floor(_counted(clients) / F.lit(each))).cast("int")


def pool_of(n_pools: int | Column, seed: int = 0) -> Column:
    return F.pmod(key_hash(F.col("chid"), seed + POOL_SEED), F.lit(n_pools)).cast("int")


def slice_count(clients: DataFrame, n_pools: int | Column) -> Column:
    """Slices of a pool, so that one has about POOL_CLIENTS clients at most."""
    return F.greatest(F.lit(1), F.ceil(_counted(clients) / (F.lit(n_pools) * F.lit(POOL_CLIENTS)))).cast("int")


def slice_of(n_slices: Column, seed: int = 0) -> Column:
    return F.pmod(key_hash(F.col("chid"), seed + SLICE_SEED), n_slices).cast("int")


def candidate_pools(
    clients: DataFrame, n_pools: int | Column, n_candidates: int, seed: int = 0, rank: str | None = None
) -> DataFrame:
    """(chid, pool) of the candidates: the first ``n_candidates`` clients of a pool in hash order, with their ``rank``
    (from 1) on request.

    Ranked in two steps, first within slices of a pool, so no task ranks a whole pool.
    """
    ranked = clients.select(
        "chid",
        pool_of(n_pools, seed).alias("pool"),
        key_hash(F.col("chid"), seed + ORDER_SEED).alias("_h"),
        F.pmod(key_hash(F.col("chid"), seed + SPREAD_SEED), F.lit(SPREAD)).alias("_slice"),
    )
    order = [F.col("_h"), F.col("chid")]
    in_slice = F.row_number().over(Window.partitionBy("pool", "_slice").orderBy(*order))
    in_pool = F.row_number().over(Window.partitionBy("pool").orderBy(*order))
    kept = ranked.withColumn("_r", in_slice).filter(F.col("_r") <= n_candidates)
    kept = kept.withColumn("_r", in_pool).filter(F.col("_r") <= n_candidates)
    return kept.select("chid", "pool", *([F.col("_r").alias(rank)] if rank else []))


def item_arrays(vectors: DataFrame, spec: LedgerSpec, value: str) -> DataFrame:
    """Long (chid, tag, value) to one array per client in dictionary order; missing items are 0."""
    wide = vectors.groupBy("chid").pivot("tag", list(spec.items)).agg(F.max(F.col(value).cast("double")))
    cells = ", ".join(f"coalesce(`{t}`, 0D)" for t in spec.items)
    return wide.select("chid", F.expr(f"array({cells})").alias("vec"))


def open_arrays(arrays: DataFrame, spec: LedgerSpec, value: str) -> DataFrame:
    """Back to long (chid, tag, value)."""
    tags = F.array(*[F.lit(t) for t in spec.items])
    return arrays.select("chid", F.explode(F.arrays_zip(tags.alias("tag"), F.col("vec").alias("v"))).alias("c")).select(
        "chid", "c.tag", F.col("c.v").alias(value)
    )


def _scaled(m: np.ndarray) -> np.ndarray:
    top = m.max(axis=1, keepdims=True)
    return np.divide(m, top, out=np.zeros_like(m), where=top != 0)


def _distances(own: np.ndarray, pool: np.ndarray, measure: str) -> np.ndarray:
    # undefined distances are the largest finite number, so they rank last
    own_sq, pool_sq = (own * own).sum(axis=1)[:, None], (pool * pool).sum(axis=1)[None, :]
    dot = own @ pool.T
    if measure == "ed":
        return np.maximum(own_sq + pool_sq - 2.0 * dot, 0.0)
    norms = np.sqrt(own_sq) * np.sqrt(pool_sq)
    return np.divide(-dot, norms, out=np.full_like(dot, np.finfo(np.float64).max), where=norms > 0)


def _nearest(far: np.ndarray, mine: np.ndarray, k: int) -> np.ndarray:
    # mask of the k nearest: all below the k-th distance, then ties in id order (candidates are sorted by id)
    far = np.where(mine, np.inf, far)
    edge = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
    nearer, tied = far < edge, far == edge
    room = k - nearer.sum(axis=1, keepdims=True)
    return (nearer | (tied & (np.cumsum(tied, axis=1) <= room))) & ~mine


def _neighbor_means(
    own: np.ndarray, pool: np.ndarray, mine: np.ndarray, k: int | None, far: Callable[[], np.ndarray], normalize: bool
) -> np.ndarray:
    """Mean vector of the k nearest of a pool, or of all others; ``far`` gives the distances."""
    parts = _scaled(pool) if normalize else pool
    if k is None or k >= len(pool):
        # all other candidates: their sum without the own part
        inside = mine.any(axis=1, keepdims=True)
        others = parts.sum(axis=0) - np.where(inside, _scaled(own) if normalize else own, 0.0)
        return others / np.maximum(len(pool) - inside, 1) * (len(pool) > inside)
    chosen = _nearest(far(), mine, k).astype(np.float64)
    return (chosen @ parts) / np.maximum(chosen.sum(axis=1, keepdims=True), 1)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy().reshape(len(table), -1)


def _arrays(chids: pa.ChunkedArray, rows: np.ndarray) -> pa.Table:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.table({"chid": chids, "vec": pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))})


def _blender(k: int | None, alpha: float, measure: str, normalize: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The task side of one slice of a pool."""

    def blend(owners: pa.Table, candidates: pa.Table) -> pa.Table:
        chids, wide = owners["chid"].to_numpy(), _matrix(owners, "vec") if len(owners) else np.zeros((0, 1))
        out = alpha * (_scaled(wide) if normalize else wide)
        if len(candidates) and len(owners):
            candidates = candidates.sort_by("cand_chid")
            ids, pool = candidates["cand_chid"].to_numpy(), _matrix(candidates, "cand_vec")
            for at in range(0, len(chids), 4096):
                rows = slice(at, at + 4096)
                mine = np.equal.outer(chids[rows], ids)
                far = partial(_distances, wide[rows], pool, measure)
                out[rows] += (1.0 - alpha) * _neighbor_means(wide[rows], pool, mine, k, far, normalize)
        return _arrays(owners["chid"], out)

    return blend


@dataclass(frozen=True)
class GridPoint:
    """One way to blend: which of the vectors of a client, how many candidates, neighbours, weight, measure."""

    vector: int
    n_candidates: int
    k: int | None
    alpha: float
    measure: str


def _grid_blender(points: Sequence[GridPoint], n_items: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The task side of one slice of a pool for all points: distances are found once for all k and alpha, and for fewer
    candidates are those of the first ones.
    """

    def blend(owners: pa.Table, candidates: pa.Table) -> pa.Table:
        chids = owners["chid"].to_numpy()
        wide = _matrix(owners, "vec") if len(owners) else np.zeros((0, n_items))
        out = np.zeros((len(chids), len(points) * n_items))
        cells = [slice(i * n_items, (i + 1) * n_items) for i in range(len(points))]
        for cell, p in zip(cells, points, strict=True):
            out[:, cell] = p.alpha * wide[:, p.vector * n_items : (p.vector + 1) * n_items]
        if not len(candidates) or not len(owners):
            return _arrays(owners["chid"], out)
        candidates = candidates.sort_by("cand_chid")
        ids, ranks, every = candidates["cand_chid"].to_numpy(), candidates["cand_rank"].to_numpy(), _matrix(candidates, "cand_vec")
        for at in range(0, len(chids), 2048):
            rows = slice(at, at + 2048)
            mine = np.equal.outer(chids[rows], ids)
            for vector, measure in sorted({(p.vector, p.measure) for p in points}):
                part = slice(vector * n_items, (vector + 1) * n_items)
                own, pool = wide[rows, part], every[:, part]
                far = _distances(own, pool, measure)
                means: dict[tuple[int, int | None], np.ndarray] = {}
                for cell, p in zip(cells, points, strict=True):
                    if (p.vector, p.measure) != (vector, measure):
                        continue
                    if (p.n_candidates, p.k) not in means:
                        first = ranks <= p.n_candidates
                        near = _neighbor_means(own, pool[first], mine[:, first], p.k, partial(far.__getitem__, (slice(None), first)), False)
                        means[p.n_candidates, p.k] = near
                    out[rows, cell] += (1.0 - p.alpha) * means[p.n_candidates, p.k]
        return _arrays(owners["chid"], out)

    return blend


def grid_blend(
    vectors: DataFrame,
    clients: DataFrame,
    spec: LedgerSpec,
    values: Sequence[str],
    points: Sequence[GridPoint],
    n_pools: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """:func:`neighbor_blend` at many points in one pass: rows (chid, point, tag, value), point by its place in ``points``.

    A client's vectors (one per column of ``values``) travel as one array, and every slice of a pool meets its candidates
    once for all points.  Points share the pools, so all have to ask for the same number of them.
    """
    if any(p.measure not in ("cos", "ed") for p in points):
        raise ValueError("measure is cos or ed")
    if any(p.k is not None and p.k > p.n_candidates for p in points):
        raise ValueError("k exceeds the number of candidates")
    most = max(p.n_candidates for p in points)
    if n_pools is None and len({max(POOL_CLIENTS, 2 * p.n_candidates) for p in points}) > 1:
        raise ValueError("points with so many candidates have pools of their own; name n_pools, or search them apart")
    count = pools(clients, n_pools, most)
    wide = vectors.groupBy("chid").pivot("tag", list(spec.items)).agg(*[F.max(F.col(v).cast("double")).alias(v) for v in values])
    cell = "`{t}_{v}`" if len(values) > 1 else "`{t}`"
    cells = ", ".join(f"coalesce({cell.format(t=t, v=v)}, 0D)" for v in values for t in spec.items)
    pooled = wide.select("chid", F.expr(f"array({cells})").alias("vec")).withColumn("pool", pool_of(count, seed))
    pooled = pooled.withColumn("slices", slice_count(clients, count))
    members = candidate_pools(clients, count, most, seed, rank="rank")
    candidates = pooled.join(members.select("chid", "rank"), "chid")
    candidates = candidates.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    candidates = candidates.select(*[F.col(c).alias(f"cand_{c}") for c in ("chid", "vec", "pool", "slice", "rank")])
    blended = (
        pooled.select("chid", "vec", "pool", slice_of(F.col("slices"), seed).alias("slice"))
        .groupBy("pool", "slice")
        .cogroup(candidates.groupBy("cand_pool", "cand_slice"))
        .applyInArrow(_grid_blender(list(points), len(spec.items)), "chid long, vec array<double>")
    )
    tags = F.array(*[F.lit(t) for t in spec.items])
    opened = blended.select("chid", F.posexplode("vec").alias("_at", "value"))
    place = F.floor(F.col("_at") / len(spec.items)).cast("int")
    return opened.select("chid", place.alias("point"), F.get(tags, F.col("_at") % len(spec.items)).alias("tag"), "value")


def neighbor_blend(
    vectors: DataFrame,
    clients: DataFrame,
    spec: LedgerSpec,
    value: str,
    n_candidates: int = 1000,
    k: int | None = 10,
    alpha: float = 0.9,
    measure: str = "cos",
    n_pools: int | None = None,
    normalize: bool = False,
    seed: int = 0,
) -> DataFrame:
    """``alpha * own + (1 - alpha) * mean of the k nearest candidates`` per (chid, tag), for the clients with a vector.

    Candidates are drawn from ``clients``; items a vector does not list are 0.
    Ties go to the smaller client id, a client is never its own neighbour, ``k=None`` takes all candidates.  With
    ``normalize`` every vector is divided by its maximum before it is averaged or blended.  ``n_pools`` follows
    :func:`pool_count` unless named.
    """
    if measure not in ("cos", "ed"):
        raise ValueError("measure is cos or ed")
    if k is not None and k > n_candidates:
        raise ValueError("k exceeds the number of candidates")
    n_pools = pools(clients, n_pools, n_candidates)
    pooled = item_arrays(vectors, spec, value).withColumn("pool", pool_of(n_pools, seed))
    pooled = pooled.withColumn("slices", slice_count(clients, n_pools))
    members = candidate_pools(clients, n_pools, n_candidates, seed)
    candidates = pooled.join(members.select("chid"), "chid", "left_semi")
    candidates = candidates.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    candidates = candidates.select(*[F.col(c).alias(f"cand_{c}") for c in ("chid", "vec", "pool", "slice")])
    blended = (
        pooled.select("chid", "vec", "pool", slice_of(F.col("slices"), seed).alias("slice"))
        .groupBy("pool", "slice")
        .cogroup(candidates.groupBy("cand_pool", "cand_slice"))
        .applyInArrow(_blender(k, alpha, measure, normalize), "chid long, vec array<double>")
    )
    return open_arrays(blended, spec, value)


def attribute_blend(
    vectors: DataFrame,
    attributes: DataFrame,
    keys: Sequence[str],
    spec: LedgerSpec,
    value: str,
    n_candidates: int = 1000,
    alpha: float = 0.9,
    n_pools: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Neighbours are the candidates of the pool with equal attributes.

    Their scaled vectors are summed once per (pool, attributes, item); a client that is itself a candidate takes its own
    part out again, so no pair of clients is formed.
    """
    n_pools = pools(attributes, n_pools, n_candidates)
    top = F.max(F.col(value)).over(Window.partitionBy("chid"))
    scaled = vectors.withColumn("_s", F.coalesce(F.try_divide(F.col(value), top), F.lit(0.0)))
    owners = attributes.select("chid", *keys).withColumn("pool", pool_of(n_pools, seed))
    members = candidate_pools(attributes, n_pools, n_candidates, seed).select("chid", F.lit(1).alias("_in"))
    rows = scaled.join(owners, "chid").join(members, "chid", "left")
    group = ["pool", *keys, "tag"]
    sums = (
        rows.filter("_in = 1").groupBy(*group).agg(F.sum("_s").alias("_sum"), F.count("*").alias("_n"))
    )
    joined = rows.join(sums, group, "left")
    inside = F.coalesce(F.col("_in"), F.lit(0))
    n = F.coalesce(F.col("_n"), F.lit(0)) - inside
    others = F.coalesce(F.col("_sum"), F.lit(0.0)) - F.when(inside == 1, F.col("_s")).otherwise(F.lit(0.0))
    mean = F.when(n > 0, others / n).otherwise(F.lit(0.0))
    return joined.select("chid", "tag", (F.lit(alpha) * F.col("_s") + F.lit(1.0 - alpha) * mean).alias(value))
