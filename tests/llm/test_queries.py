"""The registered queries and the pipeline over whole small tables, against plain versions."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from basketry.llm import suffix_dedup
from basketry.llm.queries import QUERIES, vocabulary_path
from tests.llm.helpers import linked, shingles, without_repeats
from tests.llm.test_duplicates import brute_vectors

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_op1(spark, docs):
    rows = run(spark, "op1_external_shuffle")
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    counts = np.bincount([r["shard"] for r in rows], minlength=40)
    assert len(counts) == 40 and np.ptp(counts) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(c)) for s, c in enumerate(counts))


def test_op2_finds_exact_passages(spark, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, "op2_decontaminate")}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert exact <= got
    for d, i in got - exact:
        assert len(shingles(docs[d]) & shingles(items[i])) >= 0.6 * len(shingles(items[i]))


@pytest.mark.parametrize("name,label,folds,held,cut", [("op3_line_crf", "quality", 5, 0, 0.3), ("op6_toxicity", "toxic", 3, 1, 0.7)])
def test_scores(spark, docs, name, label, folds, held, cut):
    rows = {r["doc_id"]: r for r in run(spark, name)}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held_out = [i for i in labels if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held_out]) >= 0.85


def test_op4(spark):
    rows = run(spark, "op4_html_text")
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and r["text"] for r in rows)


def test_op5_flags_copies_of_long_texts(spark, docs):
    rows = {r["doc_id"]: r for r in run(spark, "op5_chunk_dedup")}
    by_text = {}
    for i, t in docs.items():
        by_text.setdefault(t, []).append(i)
    for t, ids in by_text.items():
        if len(ids) > 1 and len(t.encode()) >= 500:
            assert all(i in rows for i in ids)
            assert all(rows[i]["kept_sha256"] == digest(b"") for i in sorted(ids)[1:])
    # a document without any 128 bytes that another one holds is left alone
    seen, held = {}, set()
    for i, t in docs.items():
        raw = t.encode()
        for at in range(len(raw) - 127):
            other = seen.setdefault(raw[at : at + 128], i)
            if other != i:
                held |= {i, other}
    assert set(rows) <= held


def test_op5_returns_repeats_within_a_document(spark, tmp_path):
    alone = " ".join(f"{n * 7919 % 1000} word" for n in range(60))
    rows = [(1, alone + " and " + alone), (2, "nothing is twice here"), (3, "one " + alone[::-1]), (4, "two " + alone[::-1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    across, inner = ({r["doc_id"]: r for r in entry.queries()[n](spark, str(tmp_path)).collect()} for n in ("op5_chunk_dedup", "op5_inner_repeats"))
    assert set(across) == {3, 4} and set(inner) == {1}
    assert inner[1]["n_removed"] > 0 and (inner[1]["n_passages"], inner[1]["n_repeated"]) == (0, 0) and inner[1]["n_inner"] > 0
    assert across[3]["n_passages"] > 0 and across[3]["n_inner"] == 0 and across[4]["n_removed"] > 0


def test_op7(spark, docs):
    rows = {r["doc_id"]: r for r in run(spark, "op7_ngram_join")}
    assert {i: r["component_id"] for i, r in rows.items()} == linked(docs)
    assert all(r["n_shingles"] == len(shingles(docs[i])) for i, r in rows.items())


def test_op8(spark, docs):
    rows = {r["doc_id"]: r for r in run(spark, "op8_suffix_array")}
    ids = sorted(docs)
    for i, (runs, kept) in zip(ids, without_repeats([docs[i].encode() for i in ids], 400), strict=True):
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(docs[i].encode()), sum(b - a for a, b in runs), len(runs))
        assert r["kept_sha256"] == digest(kept)


def test_op8_tells_what_is_left(spark, tmp_path):
    words = [f"{n * 7919 % 1000:03d} word{n}" for n in range(60)]
    # 60 words of over 400 bytes go, 30 words of fewer stay; the last passage begins and ends within a character
    long, short, within = " ".join(words), " ".join(words[::-1][:30]), "é" * 300
    texts = ["one " + long + " 1", "two " + long + " 2", "three " + short, "four " + short, None, "", "ȩ" + within + "ĩ", "\u0329" + within + "é"]
    rows = list(enumerate(texts))
    assert len(long) > 400 > len(short)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in entry.queries()["op8_suffix_array"](spark, str(tmp_path)).collect()}
    for (i, t), (runs, kept) in zip(rows, without_repeats([(t or "").encode() for t in texts], 400), strict=True):
        assert (got[i]["n_removed"], got[i]["n_spans"]) == (sum(b - a for a, b in runs), len(runs))
        assert (got[i]["kept_sha256"], got[i]["kept_text"]) == (digest(kept), kept.decode("utf-8", "replace"))
    assert got[0]["n_removed"] >= len(long) and got[2]["kept_text"] == texts[2] and got[4]["kept_text"] == ""
    assert any("\ufffd" in r["kept_text"] for r in got.values())


def test_op8_tells_passages_of_51_words(spark, docs, tmp_path):
    """Passages of over 50 words and fewer than 400 bytes are told, though they stay; so on the given table."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnoprstuvw"))

    def prose(n):
        return " ".join("".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(n))

    shared = [prose(51) for _ in range(30)]
    texts = [f"{prose(30)} {shared[i % 30]} {prose(30)}" for i in range(60)] + [prose(90) for _ in range(20)]
    assert all(suffix_dedup.PASSAGE < len(p) < 400 for p in shared)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in entry.queries()["op8_suffix_array"](spark, str(tmp_path)).collect()}
    assert all(len(shared[i % 30]) <= got[i]["n_repeated"] < 400 and got[i]["n_passages"] == 1 for i in range(60))
    assert all((got[i]["n_repeated"], got[i]["n_passages"]) == (0, 0) for i in range(60, 80))
    assert all(got[i]["n_removed"] == 0 and got[i]["kept_text"] == texts[i] for i in range(80))
    rows, ids = {r["doc_id"]: r for r in run(spark, "op8_suffix_array")}, sorted(docs)
    for i, (runs, _) in zip(ids, without_repeats([docs[i].encode() for i in ids], suffix_dedup.PASSAGE), strict=True):
        assert (rows[i]["n_repeated"], rows[i]["n_passages"]) == (sum(b - a for a, b in runs), len(runs))


def test_op9(spark, docs):
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    for r in run(spark, "op9_bpe"):
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), digest(" ".join(map(str, ids)).encode()))
        assert r["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False).encode())


def test_op10(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    links, parts = brute_vectors(vectors)
    rows = run(spark, "op10_pivot_index")
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows} == {i: (links[i], parts[i], parts[i] == i) for i, _ in vectors}


def test_pipeline_equals_plain_stages(spark, docs):
    """Every stage after the classifier against a plain version; the classifier's own choice is taken as it is."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality(spark, table, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) >= 0.9
    least = linked(kept)
    kept = {i: t for i, t in kept.items() if least[i] == i}
    ids = sorted(kept)
    cut = without_repeats([kept[i].encode() for i in ids], corpus_pipeline.PASSAGE)
    kept = {i: (raw.decode("utf-8", "ignore") if runs else kept[i]) for i, (runs, raw) in zip(ids, cut, strict=True) if not runs or raw}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {i for i, t in kept.items() if any(x in t for x in items)}
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= set(kept) - leaking and len(kept) - len(leaking) - len(got) <= 2
    for i, r in got.items():
        assert r["ids"] == library.encode(kept[i], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "some words of a text that are good.", None, "a", 35), (4, "plain words here.", "en", "a", 17), (4, "plain words here.", "en", "a", 17)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (table, table.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs_out = stage(spark, docs, SF)
            assert docs_out.columns == table.columns
            assert docs_out.count() <= docs.count()
        tokens = corpus_pipeline.tokens(spark, docs, SF)
        assert tokens.count() == docs.count()


def test_pipeline_cuts_passages_of_51_words(spark):
    rng = np.random.default_rng(51)
    letters = np.array(list("abcdefghijklmnoprstuvw"))

    def prose(n):
        return " ".join("".join(rng.choice(letters, rng.integers(3, 10))) for _ in range(n))

    shared = [prose(51) for _ in range(40)]
    texts = [f"{prose(30)} {shared[i % 40]} {prose(30)}" for i in range(120)] + [prose(90) for _ in range(20)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    long = [p for p in shared if len(p) >= corpus_pipeline.PASSAGE]
    assert len(long) >= 38 and set(kept) == set(range(140))
    assert not [i for i, t in kept.items() if i < 120 and shared[i % 40] in long and shared[i % 40][5:-5] in t]
    assert all(kept[i] == texts[i] for i in range(120, 140))
