"""Spelling variants: the index, the search schemes, and whole results against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketry.llm import spelling
from basketry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def near_of(words):
    """Near words of every word, by what is left when one code point is struck out."""
    struck, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            struck[w[:i] + w[i + 1 :]].add((w, i))
    for left, group in struck.items():
        for w, i in group:
            if left in words:
                near[w].add(left)
                near[left].add(w)
            near[w] |= {v for v, j in group if j == i and v != w}
    return near


def plain(docs, loss=31):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % loss == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    near, form = near_of(n), {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def rows_of(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("symbols", ["ab", "abcé"])
def test_rotations_are_sorted(symbols):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice(symbols) for _ in range(rng.randint(1, 9))) for _ in range(60)})
    text = "\0" + "\0".join(words)
    codes = np.unique([ord(c) for c in text], return_inverse=True)[1]
    order = spelling.rotations(codes, int(codes.max()) + 1)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:] + text[:i])


def test_intervals_stay_in_step():
    rng = random.Random(4)
    text = "".join(rng.choice("\0abc") for _ in range(400)) + "\0d"
    codes = np.unique([ord(c) for c in text], return_inverse=True)[1]
    ahead, back = spelling.FmIndex(codes, 5), spelling.FmIndex(codes[::-1].copy(), 5)
    low, other, size = 0, 0, len(codes)
    pattern = ""
    for symbol, char in ((2, "b"), (1, "a"), (3, "c")):
        lows, sizes = ahead.extend(np.array([low]), np.array([size]))
        other += int(sizes[0, :symbol].sum())
        low, size, pattern = int(lows[0, symbol]), int(sizes[0, symbol]), char + pattern
        twice = text + text
        held = {i for i in range(len(text)) if twice[i : i + len(pattern)] == pattern}
        assert set(ahead.order[low : low + size].tolist()) == held
        ends = {(len(text) - i - len(pattern)) % len(text) for i in held}
        assert set(back.order[other : other + size].tolist()) == ends


@pytest.mark.parametrize("seed", range(4))
def test_all_pairs_at_distance_one(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice([7, 8, 8, 9]))) for _ in range(700)})
    near = near_of(set(words))
    q, e = spelling.near_pairs(words, words + words, np.repeat([True, False], len(words)))
    asked = words + words
    pairs = {(asked[a], words[b]) for a, b in zip(q.tolist(), e.tolist(), strict=True)}
    assert pairs == {(w, v) for w in words for v in near[w]} and pairs


def test_query_equals_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op11_spelling_variants"](spark, SF)) == plain(docs)


def test_chains_and_ties(spark):
    # one document each, so that hashes differ; none is struck with a loss that no hash has
    counts = {"wordings": 2000, "wordingz": 200, "wordinzz": 20, "wordnzz": 2, "another": 30, "anothers": 30, "anotherz": 3}
    docs = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(counts.items())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["word"]: r for r in spelling.spelling_variants(df, loss=1 << 40).collect()}
    assert {r["root"] for w, r in found.items() if w.startswith("word")} == {"wordings"}
    assert [found[w]["form"] for w in ("wordnzz", "wordinzz", "wordingz", "wordings")] == ["wordinzz", "wordingz", "wordings", None]
    assert found["anotherz"]["form"] == "another" and found["another"]["form"] is None  # of two with 30, the first


@pytest.mark.parametrize("slice_size,index_size", [(60, 200), (200, 1 << 12), (1 << 16, 100)])
def test_one_half_with_most_words(spark, slice_size, index_size):
    rng = random.Random(9)
    words = {"prefixed" + "".join(rng.choice("abc") for _ in range(8)) for _ in range(120)}
    words |= {"".join(rng.choice("abc") for _ in range(8)) + "suffixed" for _ in range(120)}
    words |= {"".join(rng.choice("ab") for _ in range(8)) for _ in range(80)}
    df = spark.createDataFrame([(w, rng.randint(2, 50)) for w in words], "word string, n long")
    n = {r["word"]: r["n"] for r in df.collect()}
    near = near_of(n)
    want = {(w, len(v), min(v, key=lambda x: (-n[x], x))) for w, v in near.items() if v}
    rows = spelling.near_words(df, slice_size, index_size).collect()
    assert {(r["word"], r["n_near"], r["near"]) for r in rows} == want and len(rows) == len(want)


def test_cases(spark):
    schema = "doc_id long, text string, word string, n long, key long"
    long_word = "é" + "abcdefghij" * 700
    texts = [
        (1, None, "x", 1, 1),
        (2, "", "x", 1, 1),
        (None, "Repeated repeated REPEATED repeate", None, None, None),
        (3, "repeated repeated", "x", 1, 1),
        (3, "repeated repeated", "x", 1, 1),
        (4, "straßen STRAßEN Àpfelchen àpfelchen " * 3, "x", 1, 1),
        (5, f"{long_word} {long_word} {long_word[1:]} {long_word[1:]}", "x", 1, 1),
        (6, "repeates " * 200 + "12345678 ābcdefgh", "x", 1, 1),
    ]
    df = spark.createDataFrame(texts, schema)
    assert rows_of(spelling.spelling_variants(df)) == plain([t[:2] for t in texts])
    assert spelling.spelling_variants(df.where("doc_id = 99")).collect() == []
    assert spelling.spelling_variants(df.where("doc_id = 1")).columns == list(COLUMNS)
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, text="other")
