"""Exact quantiles of few, very large groups, in two passes over the rows.

Spark's ``percentile`` keeps every distinct value of a group in one task, which is fine for a client's 24 months and
not for a third of all rows.  Here a first pass makes a rank summary of each group, which merges on the map side and
bounds the error of a rank by a known share of the group (``percentile_approx``).  Two values of the summary fence each
wanted rank in.  The second pass counts what lies below the fences, and collapses the values between them to
(value, count) pairs; only those, a share of some 6 / ACCURACY of the group, are sorted.  Ranks within them are exact, and
a rank outside its fences would stop the query instead of giving a wrong value.  Any other aggregate of the groups can be
made in the first pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 1 / ACCURACY is the summary's largest error of a rank, as a share of the group; its size grows with ACCURACY
ACCURACY = 4_000


def _named(value: str, prob: str, single: bool) -> str:
    return prob if single else f"{value}_{prob}"


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Sequence[str],
    probs: dict[str, float],
    extra: Sequence[Column] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linear-interpolated quantiles per ``keys``: one row per group, one column per entry of ``probs``; for a list of value
    columns their names are put in front.  ``extra`` are further aggregates of the same groups, columns of numbers.

    Nulls and NaN in a value are skipped (no value left: null), and null keys drop out.
    """
    single = isinstance(value, str)
    values = [value] if single else list(value)
    names = list(keys)
    shares = [float(p) for p in probs.values()]
    held = {f"_v{i}": F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")) for i, v in enumerate(values)}
    rows = df.withColumns(held)
    if names:
        rows = rows.na.drop("any", subset=names)

    # three times the error on either side, which beyond ``accuracy`` values is more than a rank
    slack = 3.0 / accuracy
    marks = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in shares for d in (-slack, slack)])
    summary = []
    for i in range(len(values)):
        v = f"_v{i}"
        summary += [
            F.count(v).alias(f"_n{i}"),
            F.min(v).alias(f"_min{i}"),
            F.max(v).alias(f"_max{i}"),
            F.percentile_approx(v, marks, accuracy).alias(f"_marks{i}"),
        ]
    before = set(rows.columns)
    groups = (rows.groupBy(*names) if names else rows.groupBy()).agg(*summary, *extra)
    kept = [c for c in groups.columns if c not in names and not c.startswith(("_min", "_max", "_marks"))]
    clash = before & set(kept)
    groups = groups.withColumnsRenamed({c: f"_of_{c}" for c in clash})
    carried = {c: f"_of_{c}" if c in clash else c for c in kept}
    if names:
        rows = rows.join(groups, names)
    else:
        everything = groups.agg(F.first(F.struct(*groups.columns)).alias("_g")).scalar()
        rows = rows.withColumn("_g", everything).withColumns({c: F.col(f"_g.{c}") for c in groups.columns})

    # what each row is to each rank: below its fences (no value), between them, or nothing; of a group of up to
    # ``accuracy`` values every value is opened, once for all ranks
    step = len(shares) + 1
    none = F.greatest(*[F.col(f"_n{i}") for i in range(len(values))], F.lit(0)) == 0
    seen = [F.when(none, F.struct(F.lit(-1).alias("q"), F.lit(None).cast("double").alias("v")))]
    for i in range(len(values)):
        whole, v = F.col(f"_n{i}") <= accuracy, F.col(f"_v{i}")
        seen.append(F.when(whole & v.isNotNull(), F.struct(F.lit(i * step + len(shares)).alias("q"), v.alias("v"))))
        for j in range(len(shares)):
            low, high = F.get(f"_marks{i}", F.lit(2 * j)), F.get(f"_marks{i}", F.lit(2 * j + 1))
            fenced = F.struct(F.lit(i * step + j).alias("q"), F.when(v >= low, v).alias("v"))
            seen.append(F.when(~whole & (v <= high), fenced))
    known = list(carried.values())
    opened = rows.select(*names, *known, F.explode(F.array_compact(F.array(*seen))).alias("_e")).select(*names, *known, "_e.*")
    pairs = opened.groupBy(*names, "q", "v").agg(F.count(F.lit(1)).alias("_m"), *[F.any_value(c).alias(c) for c in known])
    if names:
        pairs = pairs.repartition(*names)
    within = Window.partitionBy(*names, "q").orderBy(F.col("v").asc_nulls_first())
    last = F.sum("_m").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = pairs.withColumn("_last", last)

    out = []
    for i, name in enumerate(values):
        n = F.col(f"_n{i}")
        for j, (prob, p) in enumerate(zip(probs, shares, strict=True)):
            place = F.lit(p) * (n - 1)
            here = F.col("q").isin(i * step + j, i * step + len(shares)) & F.col("v").isNotNull()

            def at(rank: Column) -> Column:
                k = rank.cast("long")
                return F.max(F.when(here & (k < F.col("_last")) & (k >= F.col("_last") - F.col("_m")), F.col("v")))

            frac = F.max(place - F.floor(place))
            low, high = at(F.floor(place)), at(F.ceil(place))
            found = low + (high - low) * frac
            error = F.raise_error(F.lit(f"a quantile of {name} lies outside its fences"))
            found = F.when(found.isNull() & (F.max(n) > 0), error.cast("double")).otherwise(found)
            out.append(found.alias(_named(name, prob, single)))
    named = [_named(v, p, single) for v in values for p in probs]
    further = {c: s for c, s in carried.items() if not c.startswith("_n")}
    result = (ranked.groupBy(*names) if names else ranked.groupBy()).agg(
        *out, *[F.max(s).alias(c) for c, s in further.items()]
    )
    result = result.select(*names, *named, *further)
    # a group of all rows has no row where there are none
    return result if names else result.where(F.coalesce(*[F.col(c) for c in named]).isNotNull())
