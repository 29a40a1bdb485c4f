"""Benchmark decontamination by SimHash windows.

A benchmark item is a bag of five-word shingles, weighted by how few items hold them.  Documents are read in windows of as
many shingles as an item has, at every place.  Windows and items get 64-bit SimHash fingerprints, to which a shingle adds
the square root of its weight, so that their cosine is that of the weights.  An index per item size
cuts fingerprints into one block more than ``radius`` bits may differ, so fingerprints within the radius agree in a block
and none is missed; where blocks would be too short to tell anything, all are compared.  Candidates within the radius are verified by their exact weighted similarity (sum of the lesser over
the sum of the greater weights) of at least ``threshold``.

A window's similarity is at most the share of its weight in shingles that some item holds; windows below the threshold by
that bound are not fingerprinted.

Cases: null and empty texts and items match nothing; an item or document of one to four words is one shingle, so it only
matches the same whole sequence; a document shorter than an item is one window; very long texts are read whole; repeated
rows are found each; null ids pass; an empty table gives an empty table; other columns are not read by ``leaks`` and pass
unchanged through ``clean``.  Items are sent to the tasks in batches of bounded size, one pass over the documents each;
weights are those of the whole benchmark, so results do not depend on the batches.  The shingles that several items hold
(16 bytes each) are sent with every batch, as they alone weigh less than unknown ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.arrow_text import ranks_within, shingle_hashes, text_slices, words_of
from basketry.llm.frames import need
from basketry.session import written

THRESHOLD = 0.75
#: a similarity of 0.75 is a cosine of at least 0.857, 11 bits on average with a deviation of 3; 22 leaves out 2 in 10,000
RADIUS = 22
BITS = 64
#: characters of items that are sent to the tasks at once
BATCH_CHARS = 8 << 20
_FILTER_BITS = 20


def fingerprints(hashes: np.ndarray, weights: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of each window of consecutive shingles by the roots of the weights; rounded, so sums are exact."""
    weights = np.round(64 * np.sqrt(weights)).astype(np.int64)
    bits = np.unpackbits(hashes[:, None].view(np.uint8), axis=1).astype(np.int64) * 2 - 1
    total = np.zeros((len(hashes) + 1, BITS), np.int64)
    np.cumsum(bits * weights[:, None], axis=0, out=total[1:])
    out = np.zeros(len(start), np.uint64)
    for at in range(0, len(start), 8192):
        s = start[at : at + 8192]
        positive = total[s + size[at : at + 8192]] - total[s] > 0
        out[at : at + 8192] = np.packbits(positive, axis=1).view(np.uint64).ravel()
    return out


def _item_shingles(batches) -> list[np.ndarray]:
    """Shingles of every text."""
    out = []
    for part in text_slices(batches, "text", limit=1 << 40):
        hashes, first = shingle_hashes(words_of(part))
        out += np.split(hashes, first[1:-1])
    return out


def common_shingles(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one of all items hold, in order, and how many hold them."""

    def run(batches):
        for batch in batches:
            every = np.concatenate([np.unique(s) for s in _item_shingles([batch])] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], names=["shingle"])

    held = items.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    found = held.where("held > 1").toArrow()
    shingles = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found["held"].to_numpy()[order]


@dataclass
class Index:
    """Items of one size by the blocks of their fingerprints."""

    numbers: np.ndarray
    prints: np.ndarray
    radius: int
    blocks: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        at = 0
        if (self.radius + 1) * 2.0 ** -(BITS / (self.radius + 1)) >= 1:  # the blocks would yield every item
            return
        for k in range(self.radius + 1):
            width = (BITS * (k + 1)) // (self.radius + 1) - at
            key = min(width, 16)  # of a longer block its first bits are looked up
            values = self._block(self.prints, at, key)
            order = np.argsort(values, kind="stable")
            self.blocks.append((at, key, order, np.searchsorted(values[order], np.arange((1 << key) + 1))))
            at += width

    @staticmethod
    def _block(prints: np.ndarray, at: int, width: int) -> np.ndarray:
        return ((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item of this index) whose fingerprints differ in ``radius`` bits at most."""
        if not self.blocks:
            step, rows, items = max(1, (1 << 20) // len(self.prints)), [], []
            for at in range(0, len(prints), step):
                window, item = np.nonzero(np.bitwise_count(prints[at : at + step, None] ^ self.prints) <= self.radius)
                rows.append(window + at)
                items.append(item)
            none = [np.zeros(0, np.int64)]
            return np.concatenate(rows or none), np.concatenate(items or none)
        found = []
        for at, width, order, first in self.blocks:
            value = self._block(prints, at, width)
            counts = first[value + 1] - first[value]
            window = np.repeat(np.arange(len(prints)), counts)
            item = order[np.repeat(first[value], counts) + ranks_within(counts)]
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            found.append(window[near] * len(self.prints) + item[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


class Items:
    """A batch of benchmark items: shingles, weights by how few items hold them, and an index per size.

    ``n_items`` and ``common`` (sorted shingles of more than one item, and how many hold them) are those of the whole
    benchmark.
    """

    def __init__(self, texts: list[bytes], radius: int, n_items: int, common: tuple[np.ndarray, np.ndarray]) -> None:
        self.shingles = per_item = _item_shingles([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])])
        own = np.unique(np.concatenate(per_item or [np.zeros(0, np.uint64)]))
        # those of other batches count for the weight of a window
        self.known = np.union1d(own, common[0])
        self.own = np.isin(self.known, own)
        held = np.ones(len(self.known), np.int64)
        held[np.searchsorted(self.known, common[0])] = common[1]
        # in 64ths, so that sums of weights are exact
        self.unknown = int(round(64 * np.log(1 + n_items))) if n_items else 1
        self.known_weights = np.maximum(1, np.round(64 * np.log(1 + n_items / held))).astype(np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._cell(self.known)] = True
        self.radius = radius
        by_size: dict[int, list[int]] = {}
        for n, s in enumerate(per_item):
            if len(s):
                by_size.setdefault(len(s), []).append(n)
        self.indexes = {}
        for size, numbers in sorted(by_size.items()):
            prints = [fingerprints(h := per_item[n], self.weights(h)[0], np.zeros(1, int), np.array([size]))[0] for n in numbers]
            self.indexes[size] = Index(np.array(numbers), np.array(prints, np.uint64), radius)

    @staticmethod
    def _cell(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def weights(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each shingle, and whether an item of the batch holds it."""
        may = np.flatnonzero(self.filter[self._cell(hashes)])
        out, known = np.full(len(hashes), self.unknown, np.int64), np.zeros(len(hashes), bool)
        if len(may):
            at = np.minimum(np.searchsorted(self.known, hashes[may]), len(self.known) - 1)
            right = self.known[at] == hashes[may]
            out[may[right]] = self.known_weights[at[right]]
            known[may[right]] = self.own[at[right]]
        return out, known

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Exact weighted similarity of two bags of shingles."""
        names, counts = [], []
        for x in (a, b):
            n, c = np.unique(x, return_counts=True)
            names.append(n)
            counts.append(c)
        every = np.union1d(*names)
        one, two = (np.zeros(len(every), np.int64) for _ in range(2))
        one[np.searchsorted(every, names[0])] = counts[0]
        two[np.searchsorted(every, names[1])] = counts[1]
        weights = self.weights(every)[0]
        return float((np.minimum(one, two) * weights).sum() / (np.maximum(one, two) * weights).sum())

    def matches(self, hashes: np.ndarray, threshold: float):
        """(item number, similarity, first shingle, shingles) of the best window for each item that a text leaks."""
        weights, known = self.weights(hashes)
        total = np.concatenate(([0], np.cumsum(weights)))
        hit = np.concatenate(([0], np.cumsum(np.where(known, weights, 0))))
        starts, sizes, classes = [], [], []
        for size in self.indexes:
            own = min(size, len(hashes))
            s = np.arange(len(hashes) - own + 1)
            s = s[hit[s + own] - hit[s] >= threshold * (total[s + own] - total[s])]
            starts.append(s)
            sizes.append(np.full(len(s), own))
            classes.append(np.full(len(s), size))
        start, size, of_size = np.concatenate(starts), np.concatenate(sizes), np.concatenate(classes)
        if not len(start):
            return []
        prints = fingerprints(hashes, weights, start, size)
        best: dict[int, tuple[float, int, int]] = {}
        for s, index in self.indexes.items():
            rows = np.flatnonzero(of_size == s)
            if not len(rows):
                continue
            window, item = index.within(prints[rows])
            for w, i in zip(rows[window].tolist(), index.numbers[item].tolist(), strict=True):
                value = self.similarity(hashes[start[w] : start[w] + size[w]], self.shingles[i])
                if value >= threshold and (i not in best or value > best[i][0]):
                    best[i] = (value, int(start[w]), int(size[w]))
        return [(i, *found) for i, found in sorted(best.items())]


def _batches(items: DataFrame, chars: int) -> Iterator[list[tuple]]:
    """Items in batches of about ``chars`` bytes; each batch is read by itself."""
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = max(1, -(-int(total) // chars))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r[0], (r[1] or "").encode()) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, batch_chars: int = BATCH_CHARS,
) -> DataFrame:
    """Written rows (doc_id, item_id, similarity, first_word, n_words): each item a document leaks, by its best window."""
    need(docs, doc_id=doc_id, text=text)
    need(items, item_id=item_id, item_text=item_text)
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, similarity double, first_word int, n_words int"
    weights = spark.sparkContext.broadcast((names.count(), common_shingles(names)))
    out = None
    for batch in _batches(names, batch_chars):
        # at most batch_chars of text
        shared = spark.sparkContext.broadcast(([r[0] for r in batch], [r[1] for r in batch]))

        def run(batches, shared=shared):
            ids, texts = shared.value
            own, id_type = Items(texts, radius, *weights.value), pa.array(ids[:1]).type if ids else pa.int64()
            for part in text_slices(batches, "text"):
                words = words_of(part)
                hashes, first = shingle_hashes(words)
                hits = np.concatenate(([0], np.cumsum(own.weights(hashes)[1])))
                found, at = [], []
                for n in np.flatnonzero(hits[first[1:]] > hits[first[:-1]]).tolist():
                    n_words = int(words.first[n + 1] - words.first[n])
                    for i, value, start, size in own.matches(hashes[first[n] : first[n + 1]], threshold):
                        at.append(n)
                        found.append((ids[i], value, start, min(size + 4, n_words)))
                columns = list(zip(*found, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [part.batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], id_type),
                     pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                    names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return written(out, "leaks")


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that leak no benchmark item; documents without an id are kept unless all of them leak."""
    found = leaks(docs, items, doc_id, text, **how).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(found, doc_id, "left_anti")
