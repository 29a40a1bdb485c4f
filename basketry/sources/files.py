"""Text and parquet sources and sinks of a ledger."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_ledger_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Raw ledger text with a header; the schema is given, so nothing is scanned twice to infer it."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def clean_ledger(
    raw: DataFrame, target: T.StructType, other_item: int, blanks: dict[str, int], item: str = "tag"
) -> DataFrame:
    """``other`` becomes the last item, blank text its default, then every column gets its type.  One projection."""

    def cleaned(field: T.StructField):
        c = F.col(field.name)
        if field.name == item:
            c = F.when(c == "other", F.lit(str(other_item))).otherwise(c)
        if field.name in blanks:
            c = F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(str(blanks[field.name]))).otherwise(c)
        return c.cast(field.dataType).alias(field.name)

    return raw.select(*[cleaned(f) for f in target.fields])


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Parquet by period.  The rebalance hint lets AQE split a large period and merge small ones."""
    ledger.hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt").parquet(path)


def read_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One ledger from several part folders, matched by column name."""
    parts = [spark.read.parquet(p) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shares_to_amounts(ledger: DataFrame, shares: dict[str, str], amount: str) -> DataFrame:
    """Amount columns from share columns, on the same row: ``shares`` maps share column to amount column."""
    return ledger.select("*", *[(F.col(s) * F.col(amount)).alias(a) for s, a in shares.items()])


def write_ranking(ranking: DataFrame, path: str) -> None:
    """The submission file: chid, top1, top2, top3."""
    ranking.select("chid", "top1", "top2", "top3").write.mode("overwrite").option("header", True).csv(path)


RANKING_SCHEMA = T.StructType(
    [
        T.StructField("chid", T.LongType()),
        T.StructField("top1", T.IntegerType()),
        T.StructField("top2", T.IntegerType()),
        T.StructField("top3", T.IntegerType()),
    ]
)


def write_block_list(clients: DataFrame, path: str) -> None:
    """One client id per line."""
    clients.select(F.col("chid").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_block_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").cast("long").alias("chid")).na.drop()


STORE_KEY = ("model", "version", "split")
_MANIFEST = "model string, version int, split string, generation string, written long"


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Adds to a prediction store: one folder per model, version and split, and in it one per writing.

    The (model, version, split) of the rows get a new generation, which replaces the one before for readers; all others
    stay as they are.  Files of a generation are complete before the manifest names it, in one small file, so a reader
    sees whole versions only, and a writing that fails changes nothing.
    """
    spark = predictions.sparkSession
    generation, now = uuid.uuid4().hex, time.time_ns()
    rows = predictions.withColumn("generation", F.lit(generation))
    rows.hint("rebalance", *STORE_KEY).write.mode("append").partitionBy(*STORE_KEY, "generation").parquet(f"{path}/rows")
    # of these columns the folders' names are read, not the files
    new = spark.read.parquet(f"{path}/rows").filter(F.col("generation") == generation).select(*STORE_KEY).distinct()
    entry = ["CAST(model AS STRING) AS model", "CAST(version AS INT) AS version", "CAST(split AS STRING) AS split"]
    entries = new.selectExpr(*entry, f"'{generation}' AS generation", f"{now}L AS written")
    entries.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def stored_versions(spark: SparkSession, path: str) -> DataFrame:
    """(model, version, split, generation): the newest generation of everything in a store."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    newest = F.max(F.struct("written", "generation")).alias("_g")
    return manifest.groupBy(*STORE_KEY).agg(newest).select(*STORE_KEY, F.col("_g.generation").alias("generation"))


def read_predictions(spark: SparkSession, path: str, split: str, models: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """Predictions of a split, all or for some (model, version) pairs, of their newest generation.

    Only the folders of those generations are read: the manifest, one row per folder ever written, is sent to all tasks,
    and Spark prunes the folders by it at run time.
    """
    wanted = F.col("split") == split
    if models:
        named = F.lit(False)
        for model, version in models:
            named = named | ((F.col("model") == model) & (F.col("version") == version))
        wanted = wanted & named
    newest = stored_versions(spark, path).filter(wanted)
    store = spark.read.parquet(f"{path}/rows").filter(wanted)
    return store.join(F.broadcast(newest), [*STORE_KEY, "generation"], "left_semi").drop("generation")


# What a version label means.
MODEL_KINDS = {"l": "lgbm", "x": "xgb", "b": "blend"}


def parse_version(df: DataFrame, label: str = "label") -> DataFrame:
    """``l12``, ``x3``, ``b1``, ``lm11`` as model name, kind (base or meta) and number."""
    c = F.col(label)
    name = F.lit(None).cast("string")
    for letter, model in MODEL_KINDS.items():
        name = F.when(c.startswith(letter), F.lit(model)).otherwise(name)
    return df.select(
        "*",
        name.alias("model"),
        F.when(F.substring(c, 2, 1) == "m", "meta").otherwise("base").alias("kind"),
        F.regexp_extract(c, r"(\d+)$", 1).cast("int").alias("number"),
    )
