from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import chunk_dedup, ngram_join, pivot_index, suffix_dedup
from basketry.llm.arrow_text import text_slices
from tests.llm.helpers import linked, shingles, without_repeats


def corpus(seed: int, n: int = 150) -> list[tuple]:
    """Random texts with exact, near and partial copies, case changes, shared lines, short and empty texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(n // 3)]
    line = "a common line that many of the texts have"
    while len(texts) < n - 8:
        kind, t = r.randrange(5), r.choice(texts).split()
        if kind == 0:
            texts.append(" ".join(t))
        elif kind == 1:
            for _ in range(r.randrange(1, 4)):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append("  ".join(t))
        elif kind == 2:
            texts.append(" ".join(t).upper() + "\n")
        elif kind == 3:
            texts.append(" ".join(t[: r.randrange(1, len(t) + 1)]) + " " + line)
        else:
            texts.append(line + "\n" + " ".join(t + [r.choice(words) for _ in range(3)]))
    texts += ["", " \n", "one", "one", "two words", "Two WORDS", "é x\ty z w", None]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(docs).collect()}
    want = linked(dict(rows))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(shingles(t)) for i, t in rows}
    kept = {r["doc_id"] for r in ngram_join.one_per_group(docs).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_ngram_join_chain_of_near_copies(spark):
    """Texts each similar to the next only, so that leaders alone would not link all."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(30)] + [(100 + k, " ".join(words[:60])) for k in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(dict(rows))


def test_ngram_join_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_EXCESS", 2)
    monkeypatch.setattr(ngram_join, "SALTS", 3)
    rows = corpus(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(dict(rows))


def test_ngram_join_large_sets_meet_once_filtered(spark):
    """Long texts that share half of their shingles are told apart by their parts; near copies are not."""
    r = random.Random(7)
    half = [f"h{i}" for i in range(2000)]
    texts = [half + [f"t{k}w{i}" for i in range(2000)] for k in range(6)]
    texts += [[*t[:-50], *(f"e{r.random()}" for _ in range(50))] for t in texts[:2]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    members, counts = ngram_join.memberships(docs)
    classes = ngram_join.prefixes(docs, counts)
    keys = {x["key"]: x["doc_id"] for x in members.collect()}
    one, two = (classes.select(F.col("key").alias(k)) for k in "ab")
    left = ngram_join.filtered(one.join(two, F.col("a") < F.col("b")), classes).collect()
    assert sorted(tuple(sorted((keys[x["a"]], keys[x["b"]]))) for x in left) == [(0, 6), (1, 7)]


def test_ngram_join_sets_of_different_parts(spark, monkeypatch):
    """Near copies on either side of a size where the number of parts doubles, with parts beyond the largest count."""
    monkeypatch.setattr(ngram_join, "MOST_IN_PART", 5)
    r = random.Random(5)
    rows = []
    for k in range(60):
        words = [f"k{k // 6}w{i}" for i in range(r.randrange(215, 300) + 256 * (k // 30))]
        for _ in range(r.randrange(8)):
            words[r.randrange(len(words))] = f"e{r.random()}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.near_duplicates(docs).collect()} == linked(dict(rows))


def test_ngram_join_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (3, None), (None, "alone here")], "doc_id int, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 7), (3, 3), (7, 7), (7, 7)]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="missing"):
        ngram_join.near_duplicates(docs.drop("text"))


@pytest.mark.parametrize("most", [1000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_all_windows(spark, seed, most):
    r = random.Random(seed)
    parts = ["".join(r.choice("ab é") for _ in range(r.randrange(5, 40))) for _ in range(25)]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 6))) for _ in range(60)]
    texts += ["a" * 70, "a" * 24, "ab" * 30, "", None, texts[0], texts[0], "é" * 13]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, lo int")
    found = suffix_dedup.remove_repeats(docs, length=24, anchor=16, most=most)
    got = {x["doc_id"]: x for x in found.collect()}
    for i, (runs, kept) in enumerate(without_repeats([(t or "").encode() for t in texts], 24)):
        assert [(s["start"], s["end"]) for s in got[i]["removed"]] == runs, texts[i]
        assert bytes(got[i]["kept"]) == kept


@pytest.mark.parametrize("most", [1000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_passages_beside_repeats_equal_all_windows(spark, seed, most):
    """Runs of shorter strings are told, strings of the full length go; texts with passages only keep all."""
    r = random.Random(seed)
    parts = ["".join(r.choice("ab é") for _ in range(r.randrange(5, 40))) for _ in range(40)]
    texts = ["".join(r.choice(parts) + str(r.random()) * r.randrange(2) for _ in range(r.randrange(0, 6))) for _ in range(60)]
    texts += ["a" * 70, "a" * 24, "ab" * 30, "", None, texts[0], texts[0], "é" * 13, "a" * 14]
    raw = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, runs int")
    found = suffix_dedup.remove_repeats(docs, length=24, anchor=16, most=most, passages="shared", passage=14, passage_anchor=9)
    assert found.columns == ["doc_id", "text", "runs", "shared", "removed", "kept"]
    got = {x["doc_id"]: x for x in found.collect()}
    short, long = without_repeats(raw, 14), without_repeats(raw, 24)
    for i, ((told, _), (runs, kept)) in enumerate(zip(short, long, strict=True)):
        assert [(s["start"], s["end"]) for s in got[i]["shared"]] == told, texts[i]
        assert [(s["start"], s["end"]) for s in got[i]["removed"]] == runs, texts[i]
        assert bytes(got[i]["kept"]) == kept
    assert any(told and not runs for (told, _), (runs, _) in zip(short, long, strict=True))
    assert suffix_dedup.remove_repeats(docs.limit(0), passages="shared").count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, passages="shared", passage=500, passage_anchor=400)


def test_contexts_lose_what_no_other_one_shares():
    number = np.array([0, 0, 0, 1, 1, 2])
    strings = [b"abcd", b"abx", b"", b"abcd", b"abcd", b"abcd"]
    assert suffix_dedup._most_common(number, strings, 3).tolist() == [2, 2, 0, 3, 3, 0]
    # anchors of 5 bytes at place 9, windows of 7 bytes that begin 2 to 0 bytes before them
    rows = {"h": [5, 5, 6, 6], "times": [1] * 4, "tid": [1, 2, 3, 4], "at": [9 << 14 | 2 << 7] * 4}
    for around, want in (
        ([b"xabc", b"yabc", b"pqrs", b"pqrt"], [(1, 8, 9), (2, 8, 9), (3, 7, 8), (4, 7, 8)]),
        ([b"xabc", b"yabd", b"pqrs", b"utsr"], [(1, 8, 8), (2, 8, 8)]),
        ([b"xabc", b"yzde", b"pqrs", b"utsr"], []),
    ):
        found = suffix_dedup._repeated_starts(pa.table(rows | {"around": pa.array(around, pa.binary())}), 7, 5)
        assert sorted(zip(*(found[c].to_pylist() for c in ("tid", "lo", "hi")), strict=True)) == want


def test_repeats_as_text_and_empty(spark):
    docs = spark.createDataFrame([(1, "é" * 30 + "x"), (2, "é" * 30 + "y")], "doc_id int, text string")
    got = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(docs, length=20, anchor=12, as_text=True).collect()}
    assert got == {1: "x", 2: "y"}
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs.withColumn("TID", F.lit(1)))
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, length=400, anchor=100)


def chunk_texts(texts):
    import pyarrow as pa

    part = next(text_slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])], "t", 1 << 30))
    owner, start, end = chunk_dedup.chunks(part)
    return [[part.data[s:e].tobytes() for n, s, e in zip(owner, start, end, strict=True) if n == i] for i in range(len(texts))]


def test_chunks_cover_texts_and_resist_shifts():
    r = random.Random(1)
    body = " ".join(r.choice(["thé", "of", "ändern", "and", "lo", "x", "quite"]) + str(r.randrange(99)) for _ in range(800))
    texts = [body, "inserted " + body, body[:2000] + "!!!" + body[2000:], "", "a" * 5000, "é" * 1000, "b"]
    cut = chunk_texts(texts)
    assert [b"".join(c).decode() for c in cut] == texts
    assert all(len(x) <= chunk_dedup.LARGEST_CHUNK for c in cut for x in c)
    assert all(x.decode() for c in cut for x in c)  # no character is cut
    for other in (cut[1], cut[2]):
        assert len(set(cut[0]) - set(other)) <= 4


def test_chunk_dedup(spark):
    r = random.Random(2)

    def prose(n):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))

    passage, line = prose(60), "one common line of a text"
    rows = [(1, prose(80) + " " + passage + " " + prose(50)), (2, passage + " " + prose(90)), (3, prose(100)), (4, line + "\n" + prose(60)),
            (5, line + "\n" + prose(50)), (6, None), (7, ""), (8, rows8 := prose(70)), (9, rows8), (9, rows8), (None, prose(30)), (10, "ha " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(0))
    got = {}
    for x in chunk_dedup.dedup_chunks(docs).collect():
        got.setdefault(x["doc_id"], []).append(x)
    assert {i for i, xs in got.items() for x in xs if x["shared"]} == {1, 2, 8, 9}
    assert not got[1][0]["removed"] and got[2][0]["removed"] and got[2][0]["first_ids"] == [1]
    assert bytes(got[8][0]["kept"]).decode() == rows8 and all(bytes(x["kept"]) == b"" for x in got[9])
    # repeats within one text are cut, but not shared
    assert got[10][0]["passages"] and not got[10][0]["shared"]
    for x in (y for ys in got.values() for y in ys):
        raw = (x["text"] or "").encode()
        gone = [s for s in x["removed"]]
        assert bytes(x["kept"]) == b"".join(b for i, b in ((i, raw[i : i + 1]) for i in range(len(raw))) if not any(s["start"] <= i < s["end"] for s in gone))
    assert chunk_dedup.dedup_chunks(docs.limit(0)).count() == 0


def test_chunk_dedup_finds_short_passages(spark):
    """Passages of 51 words, each in two documents among other words."""
    r = random.Random(9)

    def prose(n):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))

    rows = []
    for n in range(400):
        passage = prose(51)
        rows += [(2 * n + k, f"{prose(r.randrange(1, 60))} {passage} {prose(r.randrange(1, 60))}") for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"] for x in chunk_dedup.dedup_chunks(docs).where("size(shared) > 0").collect()}
    assert len(found) >= 0.995 * len(rows)


def brute_vectors(rows, threshold=0.95):
    good = {i: np.asarray(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = good[i], good[j]
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return links, {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("block", [1024, 3])
def test_vectors_equal_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(pivot_index.links, "__defaults__", (0.95, block))
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    rows = [v.tolist() for v in base]
    rows += [(base[k % 12] * rng.uniform(0.5, 3) + rng.normal(size=32) * 0.08).tolist() for k in range(60)]
    rows += [rows[0], rows[0], (base[1] * 1e20).tolist(), [0.0] * 32, None, [], [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("x"))
    got = {r["vec_id"]: r for r in pivot_index.near_vectors(df, n_pivots=16).collect()}
    links, parts = brute_vectors(rows)
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == parts
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert pivot_index.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs with a cosine of just over 0.95 are found, too."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(1500, 64))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.951, 0.97, 1500)[:, None]
    both = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    found = pivot_index.near_vectors(df).agg(F.sum("n_links")).first()[0]
    true = int(((both @ both.T) >= 0.95).sum() - len(both))
    assert 0.9 * true <= found <= true


@pytest.mark.parametrize("noise", [(0.2, 0.2), (0.05, 0.6)])
def test_recall_inside_a_large_cluster(spark, noise):
    """A third of all vectors in one noisy cluster."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1800, 64))
    centre = x[0] / np.linalg.norm(x[0])
    x[:600] = centre + rng.normal(size=(600, 64)) / 8 * rng.uniform(*noise, size=(600, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = pivot_index.near_vectors(df).agg(F.sum("n_links")).first()[0]
    true = int(((x @ x.T) >= 0.95).sum() - len(x))
    assert 0.9 * true <= found <= true
