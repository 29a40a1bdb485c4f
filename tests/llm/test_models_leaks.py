from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import decontaminate, line_crf, toxicity
from basketry.llm.arrow_text import text_slices
from basketry.llm.labelled import fold, sample
from tests.llm.helpers import shingles


def one_slice(texts):
    return next(text_slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])], "t", 1 << 30))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    counts = [4, 0, 1, 6, 2]
    first = np.concatenate(([0], np.cumsum(counts)))
    e, start, moves = rng.normal(size=first[-1]) * 2, 0.7, rng.normal(size=(2, 2))
    forward, backward = line_crf.messages(e, first, start, moves)
    got = 1 / (1 + np.exp(-(forward + backward)))
    for n, c in enumerate(counts):
        weight, good = 0.0, np.zeros(c)
        for y in itertools.product((0, 1), repeat=c):
            s = sum(e[first[n] + t] * y[t] for t in range(c)) + (start * y[0] if c else 0)
            s += sum(moves[y[t], y[t + 1]] for t in range(c - 1))
            weight += np.exp(s)
            good += np.exp(s) * np.array(y, float)
        assert np.allclose(got[first[n] : first[n + 1]], good / weight)


def labelled(spark, make, n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, make(r, i % 2), i % 2) for i in range(n)]
    return (
        spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"),
        spark.createDataFrame([(i, y, None) for i, _, y in rows], "doc_id long, quality int, toxic int"),
    )


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 8))) for _ in range(n))


def test_crf_learns_and_scores_odd_rows(spark):
    def make(r, y):
        lines = [prose(r, r.randrange(4, 20)) + "." for _ in range(r.randrange(1, 6))]
        if not y:
            lines[r.randrange(len(lines))] = " ".join(x.upper() + "!!" for x in prose(r, 25).split())
        return "\n".join(lines)

    docs, labels = labelled(spark, make)
    model = line_crf.train(docs, labels)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "\n \n"), (1003, "x"), (1004, "a b\n" * 30000), (None, "q")], "doc_id long, text string")
    got = line_crf.score(docs.union(odd).withColumn("extra", F.lit(1)), model).toPandas()
    assert got["score"].between(0, 1).all()
    held = got[got["doc_id"].isin(range(300)) & (got["doc_id"].map(lambda i: __import__("zlib").crc32(str(int(i)).encode()) % 5 if i == i else 1) == 0)]
    assert ((held["score"] >= 0.3) == (held["doc_id"] % 2 == 1)).mean() > 0.97
    assert (got[got["doc_id"].isin([1000, 1001, 1002])]["score"] == model.empty).all()
    assert line_crf.train(docs, labels.where("quality = 1")) is None
    assert line_crf.score(docs, None).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)
    assert line_crf.score(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        line_crf.score(docs.withColumn("SCORE", F.lit(1)), model)


def test_lines_do_not_see_other_documents():
    alone = line_crf.lines_of(one_slice(["one line\n\nand THE next!!"]))
    among = line_crf.lines_of(one_slice(["AAA BBB", "one line\n\nand THE next!!", "| | |"]))
    assert np.allclose(alone.features, among.features[among.first[1] : among.first[2]])
    assert np.diff(among.first).tolist() == [1, 2, 1]


def test_network_gradients():
    net = toxicity.Network(3)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9, toxicity.IN))
    which = rng.integers(0, 9, (3, 5))
    held = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(x, which, held)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g, dx = net.gradients(x, which, held, y)
    for name in ("xf", "hf", "cb", "hb", "attend", "query", "dense", "bias"):
        p = net.p[name]
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)]:
            kept, step = p[at], 1e-4
            p[at] = kept + step
            up = loss()
            p[at] = kept - step
            down = loss()
            p[at] = kept
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-4, name


def test_windows_cover_every_word():
    for counts in ([0, 1, 24, 25, 36, 37, 100], [0], [5]):
        first = np.concatenate(([0], np.cumsum(counts)))
        owner, places, held = toxicity.windows_of(first)
        assert set(places[held].tolist()) == set(range(first[-1]))
        for n, c in enumerate(counts):
            inside = places[owner == n][held[owner == n]]
            assert ((inside >= first[n]) & (inside < first[n + 1])).all() and (c == 0) == (not len(inside))


def test_toxicity_learns_and_scores_odd_rows(spark):
    def make(r, y):
        words = prose(r, r.randrange(3, 120)).split()
        if y:
            for _ in range(2):
                words.insert(r.randrange(len(words) + 1), "zorgu" + r.choice(["x", "le", "nta", "ber"]))
        return " ".join(words)

    docs, labels = labelled(spark, make, 400)
    labels = labels.withColumn("toxic", F.col("quality"))
    net = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, " \n"), (1003, "x"), (1004, "a b " * 60000), (None, "q")], "doc_id long, text string")
    got = toxicity.score(docs.union(odd), net).withColumn("fold", fold("doc_id", 3)).toPandas()
    assert got["score"].between(0, 1).all()
    held = got[(got["fold"] == 1) & (got["doc_id"] < 400)]
    assert ((held["score"] >= 0.7) == (held["doc_id"] % 2 == 1)).mean() > 0.95
    assert (got[got["doc_id"].isin([1000, 1001, 1002])]["score"] == net.empty).all()
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_sample_is_bounded_and_leaves_out_the_fold(spark):
    docs = spark.range(200).selectExpr("id doc_id", "'t' text")
    labels = spark.range(200).selectExpr("id doc_id", "cast(id % 2 as int) quality").union(spark.createDataFrame([(3, 0), (None, 1), (5, None)], "doc_id long, quality int"))
    rows = sample(docs, labels, "quality", 5, 0, 60).withColumn("fold", fold("doc_id", 5)).collect()
    assert len(rows) == 60 and sum(r["label"] for r in rows) == 30
    assert all(r["fold"] != 0 and r["doc_id"] != 3 for r in rows)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = items[rng.integers(0, 40, 500)]
    for n in range(500):
        for b in rng.choice(64, rng.integers(0, 25), replace=False):
            prints[n] ^= np.uint64(1 << int(b))
    for radius in (0, 5, 16):
        window, item = decontaminate.Index(np.arange(40), items, radius).within(prints)
        near = np.bitwise_count(prints[:, None] ^ items[None]) <= radius
        assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*map(lambda a: a.tolist(), np.nonzero(near)), strict=True))


def test_leaks(spark):
    r = random.Random(6)
    items = [prose(r, r.randrange(12, 50)) for _ in range(20)] + ["", "two words", prose(r, 8)]
    items.append(None)

    def edited(t, k):
        words = t.split()
        words[k] = "other"
        return " ".join(words)

    rows = [(i, prose(r, 60) + " " + t + "\n" + prose(r, 40)) for i, t in enumerate(items[:20])]
    rows += [(30, prose(r, 200)), (31, None), (32, ""), (33, "Two  WORDS"), (34, "the two words are here " + prose(r, 9)), (35, items[3].upper())]
    rows += [(36, prose(r, 30) + " " + edited(items[5], 1) + " " + prose(r, 30)), (37, " ".join(items[6].split()[:6]) + " " + prose(r, 40)), (None, items[7]), (38, items[8][: len(items[8]) - 9])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("item_id", F.lit(0))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.leaks(docs, table).collect()}
    want = {(i, i) for i in range(20)} | {(33, 21), (35, 3), (None, 7)}
    assert {k for k, s in got.items() if s == 1.0} == want
    assert all(s >= 0.75 for s in got.values())
    # near copies: found if the similarity of an item-sized window allows it
    for k, (d, i) in enumerate([(36, 5), (38, 8)]):
        a, b = shingles(dict(rows)[d]) & shingles(items[i]), shingles(items[i])
        if len(a) / (2 * len(b) - len(a)) >= 0.8:
            assert (d, i) in got, k
    assert not {k for k in got if k[0] in (30, 31, 32, 34, 37)}
    small = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.leaks(docs, table, batch_chars=700).collect()}
    assert {k for k, s in small.items() if s == 1.0} == want
    kept = {x["doc_id"] for x in decontaminate.clean(docs, table).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in got if d is not None}
    assert decontaminate.leaks(docs, table.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), table).count() == 0


def jaccard(a, b, weight):
    return sum(weight(x) for x in a & b) / sum(weight(x) for x in a | b)


def test_leaks_just_over_the_threshold(spark):
    """Windows of similarity 0.75 to 0.85 with some foreign words, of plain and templated items, against brute force."""
    r = random.Random(21)
    template = prose(r, 24)
    items = [prose(r, 44) for _ in range(60)] + [template + " " + prose(r, 20) for _ in range(60)]
    held = {}
    for t in items:
        for x in shingles(t):
            held[x] = held.get(x, 0) + 1

    def weight(x):
        return round(64 * np.log(1 + len(items) / held.get(x, 1)))

    docs, want = [], set()
    for n, t in enumerate(items):
        for cut in range(3, 12):
            for words in (t.split()[:-cut] + prose(r, cut).split(), prose(r, cut).split() + t.split()[cut:]):
                if 0.75 <= jaccard(shingles(" ".join(words)), shingles(t), weight) < 0.85:
                    want.add((len(docs), n))
                docs.append(" ".join(words))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), table).collect()}
    plain, templated = ({x for x in want if (x[1] >= 60) == kind} for kind in (False, True))
    assert min(len(plain), len(templated)) > 100
    assert len(plain & got) >= 0.995 * len(plain) and len(templated & got) >= 0.995 * len(templated)


def test_leaks_do_not_depend_on_batches(spark):
    """Partial leaks of templated items have the same rows and similarities however the items are batched."""
    r = random.Random(22)
    heads = [prose(r, 20) for _ in range(4)]
    items = [heads[n % 4] + " " + prose(r, 18) for n in range(60)]
    docs = [prose(r, 30) + " " + " ".join(t.split()[: -(n % 6) or None]) + " " + prose(r, 30) for n, t in enumerate(items)]
    # the foreign words of some windows are those of other items
    docs += [" ".join(t.split()[3:]) + " " + heads[(n + 1) % 4] for n, t in enumerate(items)]
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(2)
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").repartition(2)
    one, *others = ({tuple(x) for x in decontaminate.leaks(docs, table, batch_chars=n).collect()} for n in (8 << 20, 9000, 3000))
    assert any(x[2] < 1 for x in one) and all(other == one for other in others)
