"""The operators as queries over whole tables; digests are derived from the operators' real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (
    block_search,
    bpe,
    chunk_dedup,
    decontaminate,
    html_text,
    line_crf,
    ngram_join,
    pivot_index,
    sharding,
    spelling,
    suffix_dedup,
    toxicity,
    whitening,
)
from basketry.llm.labelled import fold

#: name -> (spark, sf_dir) -> DataFrame
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: name -> DuckDB SQL with the same rows, where SQL can express them
SQL: dict[str, str] = {}

SHARDS = 40


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op1_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0..39 by a two-pass shuffle; shard sizes in rows differ by one at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = sharding.external_shuffle(docs, SHARDS, seed=17)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return shards.select(
        "doc_id",
        (F.octet_length(raw) + F.lit(sharding.ROW_BYTES)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoded text, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary_path(), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(bpe.ids_text(), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@_query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and the least id of the documents it is linked with."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "class_key")


@_query
def op10_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.95 and the least id of its component."""
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


#: a document of lower quality is rejected
QUALITY_CUT = 0.3


@_query
def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by a model that has not seen the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_crf.train(docs, labels)
    scored = line_crf.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


#: a document of at least this score is toxic
TOXIC_CUT = 0.7


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a network that has not seen the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.train(docs, labels)
    scored = toxicity.score(docs.select("doc_id", "text"), net)
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"),
    )


def _length(spans: str):
    """Bytes of all spans of a column."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


@_query
def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur twice.

    ``kept_text`` is the text of the bytes that are left; where a cut went through a character, U+FFFD stands for its rest.
    Passages of over 50 words may be shorter than 400 bytes and then stay: ``n_passages`` counts the maximal runs of strings
    of 250 bytes that occur twice, ``n_repeated`` their bytes.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, passages="passages").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        _length("removed").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        _length("passages").alias("n_repeated"),
        F.size("passages").cast("long").alias("n_passages"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


@_query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document leaks."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, items)


def _passages(held: DataFrame) -> DataFrame:
    """``n_passages`` counts passages that other documents hold, ``n_inner`` those that no other document has a part of."""

    def apart(p):
        return ~F.exists("shared", lambda s: (s["start"] < p["end"]) & (s["end"] > p["start"]))

    return held.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        _length("shared").alias("n_repeated"),
        _length("removed").alias("n_removed"),
        F.size("shared").cast("long").alias("n_passages"),
        "first_ids",
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size(F.filter("passages", apart)).cast("long").alias("n_inner"),
    )


@_query
def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage which other documents hold as well, and what is left of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _passages(chunk_dedup.dedup_chunks(docs).where(F.size("shared") > 0))


@_query
def op5_inner_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other documents that lose bytes: to repeats of their own, or in passages that are long enough only with them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _passages(chunk_dedup.dedup_chunks(docs).where((F.size("shared") == 0) & (F.size("removed") > 0)))


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent enough word with its more frequent spelling and the root of its chain of spellings."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: a vector with an id divisible by this asks for its nearest ones
ASKING = 20


@_query
def op12_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every vector with an id divisible by 20."""
    return block_search.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % ASKING == 0, k=20)


SQL["op12_block_search"] = """
with usable as (
    select vec_id, embedding::double[] as v
    from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
        and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        and len([x for x in embedding if x <> 0]) > 0
),
scored as (
    select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v) as score
    from usable q join usable c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
),
ranked as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 32 components of all vectors, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
