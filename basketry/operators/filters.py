"""Row and column selection: item sets, period windows, null handling, recoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.config import ItemSet, LedgerSpec, trailing
from basketry.functions.hashing import key_fraction


def pick_items(df: DataFrame, spec: LedgerSpec, which: ItemSet) -> DataFrame:
    """Rows of an item set; ``isin`` on literals reaches the scan."""
    return df.filter(F.col("tag").isin(*spec.item_set(which)))


def trailing_window(df: DataFrame, t_end: int, lo: int, up: int = 0) -> DataFrame:
    """Rows of the trailing window ``(lo, up)``: periods t_end - lo + 1 to t_end - up."""
    first, last = trailing(t_end, lo, up)
    return df.filter(F.col("dt").between(first, last))


def in_periods(df: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Rows of an explicit list of periods."""
    return df.filter(F.col("dt").isin(*periods))


def half_open(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows with start <= dt < stop."""
    return df.filter((F.col("dt") >= start) & (F.col("dt") < stop))


def as_of(df: DataFrame, t_end: int) -> DataFrame:
    return df.filter(F.col("dt") <= t_end)


def snapshot(df: DataFrame, t: int) -> DataFrame:
    return df.filter(F.col("dt") == t)


def active_clients(ledger: DataFrame, t: int) -> DataFrame:
    """Distinct clients with a row in period t."""
    return snapshot(ledger, t).select("chid").distinct()


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(columns))


def mean_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's mean over the whole set: one scalar subquery for all columns."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means.getField(c)) for c in columns})


def sample_rows(df: DataFrame, fraction: float, seed: int, key: str = "chid") -> DataFrame:
    """Keep a fraction of the keys by their hash: the same rows on every run and for every partitioning."""
    return df.filter(key_fraction(F.col(key), seed) < fraction)


# Category codes that are folded into a gap of the code list.
RECODES = {"poscd": {99: 11}, "cuorg": {35: 10, 38: 33, 40: 34}}
LOWER_BOUNDS = {"dt": 1, "tag": 1, "gender_code": -1}


def recode(
    df: DataFrame, recodes: dict[str, dict[int, int]] | None = None, lower_bounds: dict[str, int] | None = None
) -> DataFrame:
    """Codes to dense zero-based integers: fold listed codes, subtract the lower bound of the others."""
    recodes = RECODES if recodes is None else recodes
    lower_bounds = LOWER_BOUNDS if lower_bounds is None else lower_bounds
    for name, mapping in recodes.items():
        if name in df.columns:
            c = F.col(name)
            for old, new in mapping.items():
                c = F.when(F.col(name) == old, F.lit(new)).otherwise(c)
            df = df.withColumn(name, c.cast("int"))
    shifted = {c: (F.col(c) - low).cast("int") for c, low in lower_bounds.items() if c in df.columns and c not in recodes}
    return df.withColumns(shifted) if shifted else df


def drop_disabled(df: DataFrame, use_chid: bool = False, use_tag: bool = False) -> DataFrame:
    """Remove id columns that are not features."""
    gone = [c for c, used in (("chid", use_chid), ("tag", use_tag)) if not used]
    return df.drop(*gone)


def label_index(df: DataFrame, spec: LedgerSpec, legit_only: bool = True) -> DataFrame:
    """Dense label of an item: position in the legit list, or position in the whole dictionary."""
    tags = spec.legit if legit_only else spec.items
    table = F.create_map(*[F.lit(x) for i, tag in enumerate(tags) for x in (tag, i)])
    return df.filter(F.col("tag").isin(*tags)).withColumn("label", F.try_element_at(table, F.col("tag")))


def label_item(df: DataFrame, spec: LedgerSpec, column: str, legit_only: bool = True) -> DataFrame:
    """Back from label index to item, in one column only."""
    tags = F.array(*[F.lit(t) for t in (spec.legit if legit_only else spec.items)])
    return df.withColumn(column, F.get(tags, F.col(column)))
