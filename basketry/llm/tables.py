"""Tables of a fixed size that tasks fill and share: counts by cell, and sets with false positives only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: cells of a table of counts: 2 MB as sent to tasks
COUNT_CELLS = 1 << 18
#: bits of a set: 8 MB as sent to tasks
SET_BITS = 1 << 26
_SLICES = 16
_SET_PART = 1 << 15


def count_slices(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """A task's counts as a few rows (slice, counts)."""
    return [(i, part.astype(np.int64).tobytes()) for i, part in enumerate(np.split(counts, _SLICES))]


def summed(slices: DataFrame) -> np.ndarray:
    """The counts of all tasks from rows (slice, counts); the result has COUNT_CELLS cells whatever the input."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group["counts"].to_pylist())
        return pa.table({"slice": group["slice"][:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    # tasks are first added up in groups, so that no task reads the counts of all others
    spread = slices.withColumn("part", F.spark_partition_id() % 64)
    first = spread.groupBy("slice", "part").applyInArrow(lambda g: add(g.select(["slice", "counts"])), "slice int, counts binary")
    rows = first.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    out = np.zeros((_SLICES, COUNT_CELLS // _SLICES), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def cell(hashes: np.ndarray) -> np.ndarray:
    """The count cell of a 64-bit hash."""
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def hash_set(df: DataFrame, column: str) -> np.ndarray:
    """Bits of a set of 64-bit hashes: one bit each in a table of fixed size."""

    def bits(group: pa.Table) -> pa.Table:
        flags = np.zeros(_SET_PART, np.uint8)
        flags[group["bit"].to_numpy()] = 1
        return pa.table({"part": group["part"][:1], "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    at = F.pmod(F.col(column), F.lit(SET_BITS))
    rows = (
        df.select(
            F.floor(at / _SET_PART).cast("int").alias("part"), F.pmod(at, F.lit(_SET_PART)).cast("int").alias("bit")
        )
        .distinct()
        .groupBy("part")
        .applyInArrow(bits, "part int, bits binary")
    )
    out = np.zeros((SET_BITS // _SET_PART, _SET_PART // 8), np.uint8)
    for r in rows.collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which signed 64-bit hashes may be in the set; none of its members is missed."""
    at = np.mod(hashes, SET_BITS)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
