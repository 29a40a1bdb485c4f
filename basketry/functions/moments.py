"""Statistics across a few columns of one row, with the small-sample corrections Spark's aggregates do not offer.

They are plain column arithmetic: no explode, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_stat(columns: Sequence[str], stat: str) -> Column:
    """``mean``, ``median``, ``std``, ``skew`` or ``kurt`` over non-null double columns of a row.

    ``std``, ``skew`` and excess ``kurt`` are bias-corrected; they are null for fewer than 2, 3 and 4 columns.  Skew and
    kurt of equal values are 0.
    """
    n = len(columns)
    cols = [F.col(c).cast("double") for c in columns]
    mean = reduce(lambda a, b: a + b, cols) / n
    if stat == "mean":
        return mean
    if stat == "median":
        ordered = F.array_sort(F.array(*cols))
        return (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2

    def central(power: int) -> Column:
        return reduce(lambda a, b: a + b, [F.pow(c - mean, power) for c in cols])

    missing = F.lit(None).cast("double")
    m2 = central(2)
    if stat == "std":
        return F.sqrt(m2 / (n - 1)) if n > 1 else missing
    if stat == "skew":
        if n < 3:
            return missing
        factor = n * (n - 1) ** 0.5 / (n - 2)
        return F.coalesce(F.try_divide(central(3) * factor, F.pow(m2, 1.5)), F.lit(0.0))
    if stat == "kurt":
        if n < 4:
            return missing
        scale = n * (n + 1) * (n - 1) / ((n - 2) * (n - 3))
        shift = 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
        raw = F.try_divide(central(4) * scale, m2 * m2)
        return F.coalesce(raw - shift, F.lit(0.0))
    raise ValueError(f"unknown statistic {stat!r}")


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of a double column as decimals with 18 places, so that it does not depend on the order of adding
    up.  Columns that do not fit (no number, beyond 10**20, or nothing over a thousandth) are added up as doubles.
    """
    whole = value.try_cast("decimal(38,18)")
    total = F.try_sum(whole).cast("double")
    fits = (F.count(whole) == F.count(value)) & (F.max(F.abs(value)) >= 1e-3) & total.isNotNull()
    return F.when(fits, total).otherwise(F.sum(value))
