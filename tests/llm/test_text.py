from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm.arrow_text import shingle_hashes, text_slices, words_of
from basketry.llm.components import components
from basketry.llm.frames import extended_schema
from basketry.llm.suffix_dedup import lyndon_suffix_array
from tests.llm.helpers import LOWER, WORDS, Union, shingles

TEXT = st.text(alphabet="aAbé \n\t .", max_size=60)


def one_slice(texts):
    return next(text_slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])], "t", 1 << 30))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8))
def test_words_and_shingles(texts):
    part = one_slice(texts)
    words = words_of(part)
    for i, t in enumerate(texts):
        got = [part.data[s:e].tobytes().translate(LOWER) for s, e in zip(words.start[words.first[i] : words.first[i + 1]], words.end[words.first[i] : words.first[i + 1]], strict=True)]
        assert got == WORDS.findall((t or "").encode().translate(LOWER))
    hashes, first = shingle_hashes(words)
    names = {}
    for i, t in enumerate(texts):
        own = hashes[first[i] : first[i + 1]].tolist()
        assert len(set(own)) == len(shingles(t))
        # equal sets have equal hashes, over all texts
        assert names.setdefault(shingles(t), set(own)) == set(own)


def test_slices_are_bounded_and_whole():
    texts = ["x" * n for n in (5, 0, 40, 3, 200, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], names=["t", "i"])
    parts = list(text_slices([batch.slice(1), batch.slice(0, 0)], "t", 50))
    assert [p.batch.column(1).to_pylist() for p in parts] == [[1, 2, 3], [4], [5, 6]]
    assert [p.text(i).decode() for p in parts for i in range(len(p.start))] == [t or "" for t in texts[1:]]


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError, match="Score"):
        extended_schema(spark.createDataFrame([(1,)], "score int"), {"Score": "double"})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert lyndon_suffix_array(np.array(text)) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("shape", ["random", "path", "star", "empty"])
def test_components(spark, shape):
    rng = np.random.default_rng(5)
    pairs = {
        "random": rng.integers(0, 120, (90, 2)).tolist(),
        "path": [[i + 1, i] for i in range(60)],
        "star": [[77, i] for i in range(50)] + [[3, None], [None, None]],
        "empty": [],
    }[shape]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    union = Union({n for p in real for n in p})
    for a, b in real:
        union.join(a, b)
    assert got == {n: union.root(n) for n in union.parent}
