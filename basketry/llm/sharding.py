"""Random sharding by a two-pass external shuffle.

Pass 1 scatters rows uniformly into buckets that fit in memory, by a seeded hash of the row; pass 2 loads one bucket at
a time, shuffles it by Fisher-Yates with a generator seeded by (seed, bucket), and writes it.  Buckets in order are one
uniform random permutation of all rows; consecutive equal cuts of it are the shards, so shard sizes differ by one row at
most.  Only the row counts of the buckets (one number each) pass through the driver's plan.

Cases: null and empty texts count no bytes; very long texts only make buckets more; equal rows are interchangeable, so
the result is defined up to their order (a table in which one whole row is a large share of all should pass
``copies`` > 1, which spreads copies over that many buckets); an empty table gives an empty table; extra columns are
kept, and columns named bucket, shard or slot are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.frames import extended_schema
from basketry.session import scratch_path

#: bytes a row takes besides its text
ROW_BYTES = 16
BUCKET_BYTES = 16 << 20


def external_shuffle(
    df: DataFrame,
    n_shards: int,
    seed: int = 0,
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    copies: int = 1,
    path: str | None = None,
) -> DataFrame:
    """All rows in random order with ``shard`` (0..n_shards-1) and ``slot`` (0.. within the shard).

    Rows are written below ``path`` (default: a new folder in the shared folder) and read back.  ``df`` has to give the
    same rows when read again, as it is sized first.  One bucket is to hold about ``bucket_bytes`` of text.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    schema = extended_schema(df, {"bucket": "int", "place": "long"})
    extended_schema(df, {"shard": "int", "slot": "long"})
    spark = df.sparkSession
    sizes = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).alias("b"), F.count(F.lit(1)).alias("n"))
    total, rows = sizes.first()
    n_buckets = max(-(-int(total or 0) // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(copies))
    hashed = F.xxhash64(F.lit(seed), *[df[c] for c in df.columns], *([salt] if copies > 1 else []))
    scattered = df.withColumn("bucket", F.pmod(hashed, F.lit(n_buckets)).cast("int"))

    def shuffle_bucket(held: pa.Table) -> pa.Table:
        n, bucket = len(held), held["bucket"][0].as_py()
        # rows of a bucket arrive in any order; the hash order makes the result repeatable
        order = held.sort_by([("row_hash", "ascending")]).drop(["row_hash"])
        at, rng = np.arange(n), np.random.default_rng([seed & 0xFFFFFFFF, bucket])
        for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist(), strict=True):
            at[i], at[j] = at[j], at[i]
        return order.take(pa.array(at)).append_column("place", pa.array(np.arange(n)))

    shuffled = (
        scattered.withColumn("row_hash", F.xxhash64(F.lit(seed + 1), *[df[c] for c in df.columns]))
        .groupBy("bucket")
        .applyInArrow(shuffle_bucket, schema)
    )
    path = path or scratch_path(spark, "shards")
    shuffled.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(schema).parquet(path)
    # one row per bucket: where it starts in the permutation
    starts = (
        written.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("held"))
        .select("bucket", (F.sum("held").over(Window.orderBy("bucket")) - F.col("held")).alias("before"))
    )
    at = F.col("before") + F.col("place")
    # shard s holds the places from ceil(s * rows / shards) on
    shard = F.expr(f"(({n_shards}L * (before + place)) div {max(rows, 1)}L)")
    # broadcast: n_buckets rows of two numbers, one per bucket_bytes of input
    placed = written.join(F.broadcast(starts), "bucket").withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {rows}L + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn("slot", (at - first).cast("long")).drop("bucket", "place", "before")
