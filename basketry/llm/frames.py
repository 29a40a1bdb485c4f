"""Small DataFrame helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def extended_schema(df: DataFrame, added: dict[str, str]) -> T.StructType:
    """The columns of df followed by the added ones; a clash of names is refused."""
    held = {c.lower() for c in df.columns}
    if clash := [c for c in added if c.lower() in held]:
        raise ValueError(f"columns {clash} exist already; rename them or choose other output names")
    new = T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in added.items()))
    return T.StructType([*[T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema], *new])


def need(df: DataFrame, **columns: str | None) -> None:
    """Refuses a table that lacks a named column."""
    missing = [c for c in columns.values() if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; the table has {df.columns}")
