from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from basketry.llm import bpe, html_text, sharding
from basketry.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


def cases():
    r = random.Random(4)
    chars = "aB sß\n'tßΣσ１½²é你好😀́​\x00<|>"
    out = ["", "  \n ", "don'T I'LL we'Re x's", "a<|startoftext|>b <|endoftext|><|STARTOFTEXT|>", "ΑΣ ΣΑΣ İx ǅ", "é Å"]
    out += ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(300)]
    return out + ["word " * 3000 + "z" * 3000 + " end"]


def test_bpe_equals_library(spark):
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    texts = [*cases(), None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("extra", F.lit("x"))
    coded = bpe.encode(df, vocabulary_path(), decoded="decoded")
    again = bpe.decode(coded.drop("decoded"), vocabulary_path(), decoded="decoded2")
    rows = {r["id"]: r for r in coded.join(again.select("id", "decoded2"), "id").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == ids, t
        assert rows[i]["decoded"] == rows[i]["decoded2"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), vocabulary_path()).first()["decoded"] == ""


def test_pieces_join_to_the_text(monkeypatch):
    vocabulary = bpe.Vocabulary(open(vocabulary_path(), encoding="utf-8").read())
    text = "some words\nand <|endoftext|> " * 20 + "w" * 90
    whole = vocabulary.encode(text)
    assert all("".join(bpe.pieces(t, 16)) == t for t in (text, "", "x" * 50, " " * 40))
    monkeypatch.setattr(bpe, "PIECE_CHARS", 16)
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 2)
    monkeypatch.setattr(bpe.pieces, "__defaults__", (16,))
    assert vocabulary.encode(text) == whole


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies to make this site good for all of you, really.</div>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>not here</p> --><div class="ad">Buy this now, it is very good.</div>
<article><h1>A  title</h1><p><b>One.<br><p>Two &amp; three&nbsp;four <a href=x>link</a> w<i>or</i>ds.</p><p>x</p>
<form><label>Mail</label><input></form><aside>A side bar with a text as long as a paragraph would be.</aside>
<ul><li>item of a list</li></ul><div id="comments"><p>A reader says a lot about this article here.</p></div></article>
<div class=sidebar><p>Other things that stand beside the text.</div><footer>&copy; us</footer></body></html>"""


def test_pages(spark):
    texts = [PAGE, None, "", "<p", "<!-- open", "<article><p>cut off &am", "plain words of a page without markup that go on for quite a while"]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string")
    got = [r["text"] for r in html_text.extract(df).orderBy("page_id").collect()]
    assert got[0].split("\n") == ["A title", "One.", "Two & three four link words.", "x", "item of a list"]
    assert got[1:] == ["", "", "", "", "cut off &am", texts[-1]]
    assert html_text.extract(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        html_text.extract(df.withColumn("TEXT", F.lit(1)))


def test_tree_learns_its_table():
    import numpy as np

    x = np.array([r for r, _ in html_text.LABELLED_BLOCKS], float)
    y = np.array([k for _, k in html_text.LABELLED_BLOCKS], bool)
    assert (html_text.classify(html_text.TREE, x) == y).all()


@pytest.mark.parametrize("rows,shards", [(1000, 7), (3, 5), (0, 4), (40, 1)])
def test_shards(spark, rows, shards):
    data = [(i if i % 9 else None, None if i % 11 == 0 else "t" * (i % 13), i) for i in range(rows)]
    df = spark.createDataFrame(data, "doc_id int, text string, extra int").repartition(3).cache()
    got = sharding.external_shuffle(df, shards, seed=3, bucket_bytes=512).collect()
    assert sorted((r["extra"], r["text"], r["doc_id"]) for r in got if r["doc_id"]) == sorted((e, t, d) for d, t, e in data if d)
    assert sorted(r["extra"] for r in got) == list(range(rows))
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.external_shuffle(df, shards, seed=3, bucket_bytes=512).collect()
    assert {(r["extra"], r["shard"], r["slot"]) for r in got} == {(r["extra"], r["shard"], r["slot"]) for r in again}


def test_shards_are_random_and_spread_copies(spark):
    df = spark.range(4000).selectExpr("cast(id as int) doc_id", "'x' text")
    got = sharding.external_shuffle(df, 4, seed=1).toPandas()
    assert abs(got["doc_id"].corr(got["shard"])) < 0.1 and abs(got["doc_id"].corr(got["slot"])) < 0.1
    other = sharding.external_shuffle(df, 4, seed=2).toPandas()
    assert (got.sort_values("doc_id")["shard"].to_numpy() == other.sort_values("doc_id")["shard"].to_numpy()).mean() < 0.4
    same = spark.range(500).selectExpr("1 doc_id", "'x' text")
    sizes = sharding.external_shuffle(same, 5, copies=16).groupBy("shard").count().toPandas()["count"]
    assert sizes.tolist() == [100] * 5
    with pytest.raises(ValueError):
        sharding.external_shuffle(df.withColumn("Bucket", F.lit(1)), 4)
