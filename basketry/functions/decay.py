"""Time-decay weights as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.config import Decay


def decay_weight(dt: Column, decay: Decay, t_end: int) -> Column:
    """Weight of a period; null outside the window."""
    table = F.array(*[F.lit(float(w)) for w in decay.weights(t_end)])
    age = F.lit(t_end) - dt
    return F.when(age >= 0, F.get(table, age.cast("int")))
