"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors (pivots) are drawn from the data, no two of them within twice the threshold's angle of each other:
many pivots in one cluster of near vectors would leave the order of its members' nearest pivots to noise.  A vector is
described by its nearest pivots in order.  The inverted
lists hold, for every set of ``shared`` pivots among a vector's first ``length``, the vectors with that set; vectors that
meet in a list share at least so many pivots, and are compared exactly.  A pair that meets in several lists is compared
in the first of them only.  Long lists are cut into blocks, and each pair of blocks is a task of its own, so no task holds
more than two blocks.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept; vectors of
another length than the pivots' are compared only with their own length's pivots, so never with other lengths; equal
vectors are one class, compared once and counted as links of each other; null ids are kept; an empty table gives an empty
table; columns besides id and vector are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.components import components
from basketry.llm.frames import need
from basketry.session import written

N_PIVOTS = 256
#: vectors that pivots are chosen from, for each pivot wanted
DRAWN = 16
LENGTH = 6
SHARED = 3
THRESHOLD = 0.95
BLOCK = 1024
#: rows of inverted lists that one task group holds on average
GROUP_ROWS = 4096


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Lists of one width as rows."""
    width = len(column[0])
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), width)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: str):
    """True for a vector that can be compared."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def spread(x: np.ndarray, n: int, reach: float) -> np.ndarray:
    """The first ``n`` unit vectors in order, without those that have a cosine of ``reach`` or more with one before."""
    out, free = [], np.ones(len(x), bool)
    for k in range(len(x)):
        if free[k]:
            out.append(k)
            if len(out) == n:
                break
            free &= x @ x[k] < reach
    return x[out]


def pivots(classes: DataFrame, n_pivots: int = N_PIVOTS, seed: int = 0, threshold: float = THRESHOLD) -> dict[int, np.ndarray]:
    """For each width of vector up to ``n_pivots`` unit vectors in seeded hash order, more than twice the threshold's angle
    apart.  Where the data are so close that there are fewer, lists are longer and more is compared.

    Chosen from a bounded sample: DRAWN * n_pivots vectors for all of the (few) widths.
    """
    sample = classes.orderBy(F.xxhash64(F.lit(seed), "key")).limit(DRAWN * n_pivots).select("vector").collect()
    by_width: dict[int, list] = {}
    for r in sample:
        by_width.setdefault(len(r[0]), []).append(r[0])
    reach = 2 * max(threshold, 0.0) ** 2 - 1
    return {w: spread(_unit(np.array(v, np.float64)), n_pivots, reach) for w, v in by_width.items()}


def nearest(x: np.ndarray, points: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest points of each row, nearest first."""
    similar = x @ points.T
    length = min(length, len(points))
    order = np.argpartition(-similar, length - 1, axis=1)[:, :length]
    return np.take_along_axis(order, np.argsort(-np.take_along_axis(similar, order, 1), axis=1, kind="stable"), 1)


def index(classes: DataFrame, points: dict[int, np.ndarray], length: int = LENGTH, shared: int = SHARED) -> DataFrame:
    """Inverted lists: rows (list, key, copies, lists, vector) for all sets of ``shared`` pivots of every class."""
    sent = classes.sparkSession.sparkContext.broadcast(points)
    kind = classes.schema["vector"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            widths = np.array([len(v) for v in batch.column(2)])
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                x = _unit(_matrix(part.column(2)))
                near = sent.value.get(int(width))
                if near is None:  # no pivot of this width: one list for all of it
                    lists = np.full((len(x), 1), -1 - int(width), np.int64)
                else:
                    order = np.sort(nearest(x, near, length), axis=1).astype(np.int64)
                    groups = list(combinations(range(order.shape[1]), min(shared, order.shape[1])))
                    lists = np.zeros((len(x), len(groups)), np.int64)
                    for g, places in enumerate(groups):
                        for p in places:
                            lists[:, g] = lists[:, g] * 65536 + order[:, p] + 1
                    lists = np.sort(lists * 4096 + int(width) % 4096, axis=1)
                offsets = pa.array(np.arange(len(x) + 1) * lists.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(lists.ravel()))],
                    names=["key", "copies", "vector", "lists"],
                )

    rows = classes.select("key", "copies", "vector").mapInArrow(run, f"key long, copies long, vector {kind}, lists array<long>")
    return rows.select(F.explode("lists").alias("list"), "key", "copies", "lists", "vector")


def _first_common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least value that both rows of two matrices with sorted rows hold."""
    out = np.zeros(len(left), np.int64)
    for at in range(0, len(left), 4096):
        part = left[at : at + 4096]
        same = (part[:, :, None] == right[at : at + 4096, None, :]).any(axis=2)
        out[at : at + 4096] = part[np.arange(len(part)), same.argmax(axis=1)]
    return out


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one it is joined with by the pairs."""
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([root(k) for k in range(n)], np.int64)


def _compare(here: int, blocks: tuple[int, int], at: np.ndarray, x: np.ndarray, lists: np.ndarray, threshold: float):
    """Pairs of rows with a cosine of at least ``threshold`` within one block or between two blocks of the list ``here``,
    without those that meet in an earlier list too.
    """
    first, second = (np.flatnonzero(at == b) for b in blocks)
    i, j = np.nonzero(x[first] @ x[second].T >= threshold - 1e-9)
    i, j = first[i], second[j]
    if blocks[0] == blocks[1]:
        i, j = i[i < j], j[i < j]
    exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
    i, j = i[exact], j[exact]
    if len(i):
        now = _first_common(lists[i], lists[j]) == here
        i, j = i[now], j[now]
    return i, j


def _compare_group(group: pa.Table, threshold: float) -> pa.Table:
    """All meetings of a group: per vector its links found and one vector it is joined with."""
    keys, copies, at = (group[c].to_numpy() for c in ("key", "copies", "at"))
    where = np.stack([group[c].to_numpy() for c in ("list", "x", "y")])
    order = np.lexsort((keys, *where[::-1]))
    edges = np.flatnonzero(np.append(True, (np.diff(where[:, order], axis=1) != 0).any(axis=0)))
    vectors, lists = group["vector"].combine_chunks(), group["lists"].combine_chunks()
    out_key, out_root, out_links = [], [], []
    for rows in np.split(order, edges[1:]):
        if len(rows) < 2:
            continue
        take = pa.array(rows)
        here, *blocks = where[:, rows[0]].tolist()
        x, own = _unit(_matrix(vectors.take(take))), _matrix(lists.take(take), np.int64)
        i, j = _compare(here, tuple(blocks), at[rows], x, own, threshold)
        if not len(i):
            continue
        k, c = keys[rows], copies[rows]
        links = np.bincount(i, c[j], len(k)) + np.bincount(j, c[i], len(k))
        told = links > 0
        out_key.append(k[told])
        out_root.append(k[_spanning(len(k), i, j)[told]])
        out_links.append(links[told].astype(np.int64))
    none = [np.zeros(0, np.int64)]
    return pa.table({"key": np.concatenate(out_key or none), "root": np.concatenate(out_root or none), "links": np.concatenate(out_links or none)})


def links(lists: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows (key, root, links): links of a class found in one pair of blocks, and a class it is joined with there."""
    held = lists.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    held = held.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    held = written(held, "lists")
    meetings = held.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
    n_groups = max(1, -(-int(meetings) // GROUP_ROWS))
    rows = lists.join(held.select("list", "blocks"), "list")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # a block meets itself and each other block once
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = rows.select("*", other).withColumn("x", F.least("at", "other")).withColumn("y", F.greatest("at", "other"))
    met = met.withColumn("group", F.pmod(F.xxhash64("list", "x", "y"), F.lit(n_groups)))
    return met.groupBy("group").applyInArrow(lambda g: _compare_group(g, threshold), "key long, root long, links long")


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    n_pivots: int = N_PIVOTS,
    length: int = LENGTH,
    shared: int = SHARED,
    seed: int = 0,
) -> DataFrame:
    """One row per vector: its id, n_links, component_id (least id reachable) and kept (whether it is that one)."""
    need(vectors, vec_id=vec_id, vector=vector)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    # -0.0 and 0.0 are one value
    key = F.xxhash64(F.transform("vector", lambda x: x + F.lit(0).cast("float")))
    rows = rows.withColumn("key", F.when(usable("vector"), key))
    classes = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = written(classes, "vectors")
    found = written(links(index(classes, pivots(classes, n_pivots, seed, threshold), length, shared), threshold), "near")
    parts = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    told = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = classes.select("key", "copies").join(told, "key", "left").join(parts.withColumnRenamed("node", "key"), "key", "left")
    classes = classes.select(
        "key",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "key").alias("component"),
    )
    named = rows.select("vec_id", "key").join(classes, "key", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "component", "left")
    component_id = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.col("vec_id").eqNullSafe(component_id).alias("kept"),
    )
