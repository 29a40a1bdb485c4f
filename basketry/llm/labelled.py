"""Bounded training samples from a table of labels, with held-out folds by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, "UTF-8")), F.lit(folds)), F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, seed: int = 0) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out fold, half of them of each label.

    Those of least seeded hash are taken, so the sample does not depend on the order of rows.  Ids with contradicting
    labels and labels other than 0 and 1 are left out.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    at = F.xxhash64(F.lit(seed), "doc_id")
    parts = [known.where(F.col("label") == k).orderBy(at, "doc_id").limit(rows // 2) for k in (0, 1)]
    # bounded by ``rows``
    chosen = F.broadcast(parts[0].union(parts[1]))
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "label")
