"""Seeded, repeatable numbers from keys, in plain integer arithmetic.

The same key gives the same number on every run, partitioning and engine, so samples, folds and candidate pools survive
lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus and multipliers of the generator.
MODULUS = 2147483647
MULTIPLIER = 48271
FINAL_MULTIPLIER = 16807


def key_hash(key: Column, seed: int = 0) -> Column:
    """Number in ``[0, MODULUS)``: a linear step, a squaring step and a linear step."""
    m = F.lit(MODULUS).cast("long")
    step = F.pmod(F.pmod(key.cast("long"), m) * F.lit(MULTIPLIER) + F.lit(seed * 69621 + 11), m)
    step = F.pmod(step * step + F.lit(seed + 1).cast("long"), m)
    return F.pmod(step * F.lit(FINAL_MULTIPLIER), m)


def key_fraction(key: Column, seed: int = 0) -> Column:
    """``key_hash`` scaled to ``[0, 1)``."""
    return key_hash(key, seed) / F.lit(float(MODULUS))


def key_hash_sql(key: str, seed: int = 0) -> str:
    """The same number as SQL text."""
    step = f"((({key}) % {MODULUS}) * {MULTIPLIER} + {seed * 69621 + 11}) % {MODULUS}"
    step = f"(({step}) * ({step}) + {seed + 1}) % {MODULUS}"
    return f"((({step}) * {FINAL_MULTIPLIER}) % {MODULUS})"
