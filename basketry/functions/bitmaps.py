"""Sets of periods as bits of longs, 62 periods each; they combine with OR, whatever the number of periods."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: periods of one long
WORD = 62


def words(t_end: int, name: str = "months") -> list[str]:
    """Columns that hold the periods 1..t_end."""
    if t_end < 1:
        raise ValueError("periods begin with 1")
    return [f"{name}{i}" for i in range(-(-t_end // WORD))]


def period_bits(t_end: int, name: str = "months") -> list[Column]:
    """Aggregates of the column ``dt``: period dt is bit (dt - 1) % WORD of word (dt - 1) / WORD."""
    out = []
    for i, word in enumerate(words(t_end, name)):
        first = i * WORD + 1
        bit = F.when(F.col("dt").between(first, first + WORD - 1), F.expr(f"shiftleft(1L, dt - {first})"))
        out.append(F.bit_or(F.coalesce(bit, F.lit(0).cast("long"))).alias(word))
    return out


def count_periods(t_end: int, name: str = "months") -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(w)) for w in words(t_end, name)])


def count_successions(t_end: int, name: str = "months") -> Column:
    """How many periods of a set are followed by one of the set."""
    held = words(t_end, name)
    pairs = [F.bit_count(F.col(w).bitwiseAND(F.shiftright(w, 1))) for w in held]
    for a, b in zip(held, held[1:]):
        # the last period of a word and the first of the next
        pairs.append((F.getbit(F.col(a), F.lit(WORD - 1)) * F.getbit(F.col(b), F.lit(0))).cast("int"))
    return reduce(lambda a, b: a + b, pairs)


def _flag_of(word: str) -> Callable[[Column], Column]:
    return lambda place: F.getbit(F.col(word), place).cast("int")


def period_flags(t_end: int, name: str = "months") -> Column:
    """Array of 0/1 for the periods 1..t_end."""
    parts = []
    for i, word in enumerate(words(t_end, name)):
        places = F.sequence(F.lit(0), F.lit(min(WORD, t_end - i * WORD) - 1))
        parts.append(F.transform(places, _flag_of(word)))
    return F.concat(*parts)
