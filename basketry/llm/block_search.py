"""Nearest vectors by inner product: a block matrix join with int8 tiles.

Queries and candidates are dealt to strips of a bounded size, and every pair of strips is a tile, a task's group of its own.
In a tile all vectors are rounded to 8-bit codes with a scale per vector.  A product of two code blocks gives every pair's
inner product up to a bound that follows from the lengths of what was rounded off; pairs whose upper bound lies below the
query's k-th best lower bound, or below its k-th best exact value so far, cannot be among its nearest.  The others are
computed again from the original vectors in double precision, and go through a heap per query.  The sorted lists of a
query's tiles are then merged by heaps, strip group by strip group.

Codes are multiplied as single-precision numbers, in runs of so many dimensions that every sum is an integer below 2**24 and
so exact; the runs are added up in double precision.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, take no part;
candidates are of the query's own width; rows with the query's id are its own and no candidates; equal rows of candidates are
listed as often as they occur; an id that stands for several vectors among the queries has a list for each; equal scores go
to the smaller id; a product beyond double precision is infinite, and an undefined one (infinity less infinity) the least; an
empty table gives an empty table; columns besides id and vector are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.frames import need
from basketry.session import written

NEAREST = 20
#: a strip holds at most so many components
STRIP_CELLS = 1 << 20
#: rows of a product that is in memory at a time
TILE_QUERIES = 256
TILE_CANDIDATES = 2048
#: dimensions of code products that single precision adds up exactly: 127 * 127 * 1024 < 2**24
EXACT_RUN = 1024
#: components of the pairs that are computed exactly at a time
EXACT_CELLS = 1 << 20
#: partitions of tiles; with more tiles a partition has several, one after the other
MOST_PARTITIONS = 1 << 15
#: strips whose lists one task merges first
MERGED = 64

_LEVELS = 127


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes of the rows of a matrix; per row its scale, the length of scale * codes, and an upper bound of the length
    of what rounding took off.
    """
    scale = np.abs(x).max(axis=1) / _LEVELS
    scale = np.where(scale > 0, scale, 1.0)
    rounded = np.clip(np.rint(x / scale[:, None]), -_LEVELS, _LEVELS)
    near = rounded * scale[:, None]
    slack = 1 + 1e-9
    return rounded.astype(np.int8), scale, _length(near) * slack, _length(x - near) * slack + _length(x) * 1e-12


def _length(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    top = np.maximum(np.abs(x).max(axis=1, initial=0.0), np.finfo(float).tiny)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of 8-bit codes."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_RUN):
        part = slice(at, at + EXACT_RUN)
        out += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return out


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, added up dimension by dimension, so that they do not depend on what
    else is in a tile.
    """
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(x.shape[1]):
            out += x[:, d] * y[:, d]
    return np.where(np.isnan(out), -np.inf, out)


def nearest_in_tile(
    queries: np.ndarray, own: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int
) -> tuple[list[list[tuple[float, int]]], int]:
    """For each query its k best (score, -id) among the candidates with another id, best first; and how many pairs were
    computed exactly.
    """
    heaps: list[list[tuple[float, int]]] = [[] for _ in own]
    # equal scores go to the smaller id, which is pushed first
    order = np.argsort(ids, kind="stable")
    candidates, ids = candidates[order], ids[order]
    q_codes, q_scale, q_near, q_off = codes(queries)
    q_whole = _length(queries)
    floor = np.full(len(own), -np.inf)
    computed = 0
    for c in range(0, len(ids), TILE_CANDIDATES):
        cs = slice(c, c + TILE_CANDIDATES)
        c_codes, c_scale, _, c_off = codes(candidates[cs])
        c_whole = _length(candidates[cs])
        for r in range(0, len(own), TILE_QUERIES):
            rs = slice(r, r + TILE_QUERIES)
            about = code_products(q_codes[rs], c_codes) * (q_scale[rs, None] * c_scale)
            # x y - x' y' = (x - x') y + x' (y - y')
            bound = q_off[rs, None] * c_whole + q_near[rs, None] * c_off
            bound = bound * (1 + 1e-9) + 1e-12 * q_whole[rs, None] * c_whole
            other = own[rs, None] != ids[cs]
            low = np.nan_to_num(np.where(other, about - bound, -np.inf), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            if low.shape[1] >= k:
                floor[rs] = np.maximum(floor[rs], np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            i, j = np.nonzero(other & ~(about + bound < floor[rs, None]))
            i, j = i + r, j + c
            computed += len(i)
            step = max(1, EXACT_CELLS // queries.shape[1])
            for start in range(0, len(i), step):
                a, b = i[start : start + step], j[start : start + step]
                exact = inner(queries[a], candidates[b])
                for q, score, vec in zip(a.tolist(), exact.tolist(), ids[b].tolist(), strict=True):
                    heap = heaps[q]
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -vec))
                    elif (score, -vec) > heap[0]:
                        heapq.heapreplace(heap, (score, -vec))
            full = [h[0][0] if len(h) == k else -np.inf for h in heaps[rs]]
            floor[rs] = np.maximum(floor[rs], full)
    return [sorted(h, reverse=True) for h in heaps], computed


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1)


def _tile(group: pa.Table, k: int) -> pa.Table:
    asks = group["asks"].to_numpy(zero_copy_only=False).astype(bool)
    rows, others = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
    lists: list[list[tuple[float, int]]] = []
    if len(rows) and len(others):
        copies, ids = others["copies"].to_numpy(), others["vec_id"].to_numpy()
        # no list is longer than k, so more copies are never seen
        times = np.minimum(copies, k)
        lists, _ = nearest_in_tile(
            _matrix(rows["vector"]),
            rows["vec_id"].to_numpy(),
            np.repeat(_matrix(others["vector"]), times, axis=0),
            np.repeat(ids, times),
            k,
        )
    sizes = np.array([len(x) for x in lists], np.int64)
    at = np.repeat(np.arange(len(lists)), sizes)
    flat = [x for found in lists for x in found]
    return pa.table(
        {
            "query_id": rows["vec_id"].combine_chunks().take(pa.array(at)),
            "query_key": rows["key"].combine_chunks().take(pa.array(at)),
            "strip": pa.array(np.full(len(flat), group["candidate_strip"][0].as_py()), pa.int32()),
            "vec_id": pa.array([-v for _, v in flat], pa.int64()),
            "score": pa.array([s for s, _ in flat], pa.float64()),
        }
    )


def _merged(group: pa.Table, k: int, ranked: bool) -> pa.Table:
    """Heap merge of a task's sorted lists, query by query."""
    order = np.lexsort(
        [group["vec_id"].to_numpy(), -group["score"].to_numpy(), *(group[c].to_numpy() for c in ("strip", "query_key", "query_id"))]
    )
    group = group.take(pa.array(order))
    rows = zip(*(group[c].to_pylist() for c in ("query_id", "query_key", "strip", "score", "vec_id")), strict=True)
    out = []
    for query, found in groupby(rows, key=lambda r: r[:2]):
        lists = [[(-r[3], r[4]) for r in part] for _, part in groupby(found, key=lambda r: r[2])]
        out += [(*query, rank, vec, -less) for rank, (less, vec) in enumerate(islice(heapq.merge(*lists), k), 1)]
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
    names = ["query_id", "query_key", "rank" if ranked else "strip", "vec_id", "score"]
    table = pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
    if ranked:
        return table
    return table.set_column(2, "strip", pa.array(np.full(len(table), group["part"][0].as_py() if len(group) else 0), pa.int32()))


def usable(vector: str) -> Column:
    """True for a vector that takes part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _strips(rows: int, width: int, least: int, cells: int) -> int:
    """How many strips: bounded ones, and where that leaves too few, enough for every task slot."""
    bounded = -(-rows * width // cells)
    return max(1, bounded, min(least, -(-rows // 256)))


def _widths(sides: DataFrame) -> Iterator[tuple[int, int, int]]:
    """(width, queries, candidates) of every width of vector."""
    for r in sides.groupBy(F.size("vector").alias("width")).agg(F.sum(F.col("asks").cast("long")), F.count(F.lit(1))).collect():
        yield r[0], r[1], r[2]


def nearest_vectors(
    vectors: DataFrame,
    asks: Column,
    k: int = NEAREST,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    strip_cells: int = STRIP_CELLS,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every row for which ``asks`` holds, its k nearest by inner product."""
    need(vectors, vec_id=vec_id, vector=vector)
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks")
    ).where(F.col("vec_id").isNotNull() & usable("vector"))
    # equal rows are one with a count, before anything is dealt
    rows = rows.groupBy("vec_id", "vector", "asks").agg(F.count(F.lit(1)).alias("copies"))
    rows = written(rows.withColumn("key", F.xxhash64("vec_id", "vector")), "vectors")
    schema = "query_id long, query_key long, strip int, vec_id long, score double"
    slots = 2 * spark.sparkContext.defaultParallelism
    layout = [(w, _strips(q, w, 1, strip_cells), _strips(n, w, slots, strip_cells)) for w, q, n in _widths(rows)]
    if not layout:
        layout = [(0, 1, 1)]
    # a table of one entry for each width, in the plan: joined by width, all rows would share a key
    widths = F.size("vector")
    strips = {
        name: F.element_at(F.create_map(*[F.lit(v) for entry in layout for v in (entry[0], entry[at])]), widths).alias(name)
        for at, name in ((1, "query_strips"), (2, "candidate_strips"))
    }
    rows = rows.select("*", widths.alias("width"), *strips.values())

    def own(strips: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(strips), "key"), F.col(strips)).cast("int")

    def every(strips: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(strips) - 1))

    columns = ["width", "vec_id", "vector", "key", "copies"]
    queries = rows.where("asks").select(
        *columns, F.lit(True).alias("asks"), own("query_strips").alias("query_strip"), every("candidate_strips").alias("candidate_strip")
    )
    candidates = rows.select(
        *columns, F.lit(False).alias("asks"), every("query_strips").alias("query_strip"), own("candidate_strips").alias("candidate_strip")
    )
    # by number, as few rows mean long work: partitions of tiles are not to be merged by size
    tile = ["width", "query_strip", "candidate_strip"]
    n_tiles = min(sum(q * c for _, q, c in layout), MOST_PARTITIONS)
    tiles = queries.unionByName(candidates).repartition(n_tiles, *tile).groupBy(*tile)
    found = tiles.applyInArrow(lambda g: _tile(g, k), schema)
    # a query's lists of up to MERGED strips are merged in one task, and so on until one is left
    most = max(s for _, _, s in layout)
    group = F.pmod(F.xxhash64("query_id", "query_key"), F.lit(max(1, sum(q for _, q, _ in layout) * slots))).alias("queries")
    while most > MERGED:
        most = -(-most // MERGED)
        parts = found.withColumn("part", F.floor(F.col("strip") / MERGED).cast("int"))
        found = parts.groupBy(group, "part").applyInArrow(lambda g: _merged(g, k, False), schema)
    ranked = found.groupBy(group).applyInArrow(
        lambda g: _merged(g, k, True), "query_id long, query_key long, rank int, vec_id long, score double"
    )
    return ranked.select("query_id", "rank", "vec_id", "score")
