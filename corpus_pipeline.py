"""From raw documents to tokens: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and is the next
one's docs.  All but the last return the columns of ``documents``.  Documents without an id pass the stages that decide by
id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, decontaminate, line_crf, ngram_join, suffix_dedup
from basketry.llm.queries import QUALITY_CUT, table, vocabulary_path
from basketry.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are good enough, by a model of the labelled ones outside the held-out fold."""
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.score(docs, model, out="quality_score").where(F.col("quality_score") >= QUALITY_CUT).drop("quality_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by 75 % common shingles."""
    return ngram_join.one_per_group(docs)


PASSAGE = suffix_dedup.PASSAGE
PASSAGE_ANCHOR = suffix_dedup.PASSAGE_ANCHOR


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their strings of PASSAGE bytes that occur twice; documents of which nothing is left go."""
    cut = suffix_dedup.remove_repeats(
        docs, length=PASSAGE, anchor=PASSAGE_ANCHOR, kept="kept_text", spans="removed_spans", as_text=True
    )
    touched = F.size("removed_spans") > 0
    left = cut.where(~touched | (F.octet_length("kept_text") > 0))
    text = F.when(touched, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(touched, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with a digest of what they decode to."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path(), decoded="decoded")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: the classifier is trained, so SQL cannot express the rows; tests hold them against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
