"""Spelling variants of a corpus' words by search schemes over bidirectional FM-indexes.

Words are counted over all texts.  Two words that differ by one inserted, deleted or replaced code point agree in the
first half of either of them, or in its second half.  So every word asks two times: its first half is matched exactly and
extended to the right over the other half with one error, and its second half is matched exactly and extended to the left.
What it asks is the vocabulary, delimited, in FM-indexes of both directions whose suffix intervals are kept in step, so that
a search can turn round in the middle of the word.

The vocabulary is dealt to many such indexes by the halves of its words: a word stands in the index of every half that a
word one code point shorter, longer or as long could ask for, and asks only in the index of its own half.  A half that
very many words share is cut into slices, and each slice of words meets each slice of questions in a task of its own, so a
task holds a bounded part whatever the data.

Cases: null and empty texts have no words; a null id is written as an empty one; equal documents count as often as they
occur; words of any length take part (a search takes as many steps as the word has code points); a word without
near words has no form and is its own root; an empty table gives an empty table; columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.frames import need
from basketry.session import written

RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: of the words' hashes every 31st loses a code point
LOSS = 31
#: a form stands at least so many times as often as the word
RATIO = 10
#: symbols of the words of one half that a task holds; more are cut into slices
SLICE = 1 << 16
#: symbols of one index on average
INDEX = 1 << 17
#: questions searched at a time
ASKED = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", loss: int = LOSS) -> DataFrame:
    """(word, n): words of at least 7 code points that occur twice or more, A-Z lower-cased; a word whose hash with its
    document's id is divisible by ``loss`` has lost the code point its hash names.
    """
    need(docs, doc_id=doc_id, text=text)
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))).alias("run"),
    )
    # shorter runs are never long enough, whatever they lose
    runs = runs.where(F.char_length("run") >= LEAST_LENGTH).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    length = F.char_length("run")
    at = (F.col("h") % length).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, length))
    words = runs.select(F.when(F.col("h") % loss == 0, less).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# --- the index


def rotations(text: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the rotations of a text in sorted order; symbols are 0..sigma - 1, and no rotation equals another."""
    n = len(text)
    bits = max(1, int(sigma - 1).bit_length())
    width = min(63 // bits, n)
    key, reach = text.astype(np.int64), 1
    # several symbols are one number to begin with
    while 2 * reach <= width:
        key = (key << (bits * reach)) | np.roll(key, -reach)
        reach *= 2
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while rank.max() + 1 < n:
        rank = np.unique(rank * n + np.roll(rank, -reach), return_inverse=True)[1].astype(np.int64)
        reach *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class FmIndex:
    """Backward search over the rotations of a text.  Counts of all symbols stand at every eighth place."""

    STEP = 8

    def __init__(self, text: np.ndarray, sigma: int):
        self.order = rotations(text, sigma)
        self.last = text[self.order - 1]
        n = len(text)
        cells = np.bincount(np.arange(n) // self.STEP * sigma + self.last, minlength=(n // self.STEP + 1) * sigma)
        self.counts = np.zeros((n // self.STEP + 2, sigma), np.int32)
        np.cumsum(cells.reshape(-1, sigma), axis=0, out=self.counts[1:])
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))[:-1]))

    def _before(self, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the places ``at``."""
        block = at // self.STEP
        out = self.counts[block].astype(np.int64)
        for k in range(self.STEP - 1):
            place = block * self.STEP + k
            rows = np.flatnonzero(place < at)
            out[rows, self.last[place[rows]]] += 1
        return out

    def extend(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every interval and symbol: where the interval of the symbol and then the match begins, and its size."""
        before = self._before(low)
        return self.first + before, self._before(low + size) - before


@dataclass
class Questions:
    """Symbols of the exact part and of the other part of every question, each in order of extension and with the
    delimiter at its end.
    """

    exact: np.ndarray
    exact_at: np.ndarray
    other: np.ndarray
    other_at: np.ndarray


def _matched(index: FmIndex, other: FmIndex, ask: Questions, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The questions whose exact part occurs, with its interval in the index of the other direction."""
    n = len(index.last)
    q = rows
    low, low_other, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), n, np.int64)
    out = []
    step = 0
    while len(q):
        symbol = ask.exact[ask.exact_at[q] + step]
        lows, sizes = index.extend(low, size)
        each = np.arange(len(q))
        # what is less than the symbol comes before it in the other direction
        less = np.where(np.arange(sizes.shape[1]) < symbol[:, None], sizes, 0).sum(axis=1)
        low, low_other, size = lows[each, symbol], low_other + less, sizes[each, symbol]
        step += 1
        done = (ask.exact_at[q + 1] - ask.exact_at[q] == step) & (size > 0)
        out.append((q[done], low_other[done], size[done]))
        go = (size > 0) & ~done
        q, low, low_other, size = q[go], low[go], low_other[go], size[go]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (rows, rows, rows)


def one_error(index: FmIndex, other: FmIndex, ask: Questions) -> tuple[np.ndarray, np.ndarray]:
    """(question, place in ``other.order``) of every way a question's exact part and then the other part with exactly one
    error occurs.
    """
    found_q, found_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(ask.exact_at) - 1, ASKED):
        rows = np.arange(start, min(start + ASKED, len(ask.exact_at) - 1))
        q, low, size = _matched(index, other, ask, rows)
        at, wrong = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        while len(q):
            place = ask.other_at[q] + at
            symbol = ask.other[place]
            lows, sizes = other.extend(low, size)
            each = np.arange(len(q))
            same, same_low = sizes[each, symbol], lows[each, symbol]
            ended = symbol == 0
            hit = ended & wrong & (same > 0)
            found_q.append(q[hit])
            found_at.append(same_low[hit])
            on = ~ended & (same > 0)
            right = ~wrong
            # any other symbol in place of this one, or before it; one like it comes as well after it
            sizes[each, symbol] = 0
            sizes[:, 0] = 0
            sizes[wrong] = 0
            r, c = np.nonzero(sizes)
            put = ~ended[r]
            # this symbol left out: of a run of equal ones, the first
            skip = right & ~ended & ((at == 0) | (symbol != ask.other[np.maximum(place - 1, 0)]))
            q, low, size, at, wrong = (
                np.concatenate(x)
                for x in (
                    (q[on], q[r], q[r[put]], q[skip]),
                    (same_low[on], lows[r, c], lows[r, c][put], low[skip]),
                    (same[on], sizes[r, c], sizes[r, c][put], size[skip]),
                    (at[on] + 1, at[r], at[r[put]] + 1, at[skip] + 1),
                    (wrong[on], np.ones(len(r) + int(put.sum()) + int(skip.sum()), bool)),
                )
            )
    return np.concatenate(found_q), np.concatenate(found_at)


# --- the words of one task


def _spans(flat: np.ndarray, start: np.ndarray, length: np.ndarray, back: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
    """Spans of symbols, read backwards if asked, each followed by the delimiter; and where each begins."""
    at = np.concatenate(([0], np.cumsum(length + 1)))
    within = np.arange(at[-1]) - np.repeat(at[:-1], length + 1)
    size, first = np.repeat(length, length + 1), np.repeat(start, length + 1)
    place = first + (size - 1 - within if back else within)
    return np.where(within == size, 0, flat[np.clip(place, 0, len(flat) - 1)]), at


def near_pairs(entries: list[str], asked: list[str], right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(question, entry) pairs at distance one: questions with ``right`` match their first half and extend to the right,
    the others the other way.  Entries differ from each other.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not entries or not asked:
        return none
    codes = np.frombuffer(("\0" + "\0".join(entries) + "\0" + "\0".join(asked)).encode("utf-32-le"), np.uint32)
    symbols, flat = np.unique(codes, return_inverse=True)
    n = len(entries) + sum(map(len, entries))
    text = flat[:n]
    ahead, back = FmIndex(text, len(symbols)), FmIndex(text[::-1].copy(), len(symbols))
    marks = np.flatnonzero(text == 0)
    length = np.fromiter(map(len, asked), np.int64, len(asked))
    start = n + 1 + np.concatenate(([0], np.cumsum(length + 1)[:-1]))
    half = length // 2
    out = []
    for way in (True, False):
        rows = np.flatnonzero(right == way)
        if not len(rows):
            continue
        first, second = (start[rows], half[rows]), (start[rows] + half[rows], (length - half)[rows])
        if way:
            ask = Questions(*_spans(flat, *first, True), *_spans(flat, *second, False))
            q, at = one_error(ahead, back, ask)
            # the delimiter found is the one after the word
            entry = (np.searchsorted(marks, n - 1 - back.order[at]) - 1) % len(marks)
        else:
            ask = Questions(*_spans(flat, *second, False), *_spans(flat, *first, True))
            q, at = one_error(back, ahead, ask)
            entry = np.searchsorted(marks, ahead.order[at])
        pairs = np.unique(rows[q] * len(entries) + entry)
        out.append((pairs // len(entries), pairs % len(entries)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def _bucket(group: pa.Table) -> pa.Table:
    """The questions of one index with near words: their number and the one of greatest count."""
    words = group["word"].to_pylist()
    entry, query = (group[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("entry", "query"))
    held = {w: n for w, n, e in zip(words, group["n"].to_pylist(), entry.tolist(), strict=True) if e}
    entries = sorted(held)  # in code-point order
    rows = np.flatnonzero(query)
    asked = [words[r] for r in rows.tolist()]
    right, slices, own = (group[c].to_numpy()[rows] for c in ("side", "slices", "slice"))
    right = right == 0
    q, e = near_pairs(entries, asked, right)
    if (slices > 1).any():
        # a word stands in one slice of a half, and counts where that slice is asked
        cut = np.fromiter((zlib.crc32(w.encode()) for w in entries), np.int64, len(entries))
        kept = cut[e] % slices[q] == own[q]
        q, e = q[kept], e[kept]
    # what the other side finds as well
    twice = [not s and entries[b][: len(asked[a]) // 2] == asked[a][: len(asked[a]) // 2] for s, a, b in zip(right[q].tolist(), q.tolist(), e.tolist(), strict=True)]
    kept = ~np.array(twice, bool)
    q, e = q[kept], e[kept]
    n = np.fromiter((held[w] for w in entries), np.int64, len(entries))
    order = np.lexsort((e, -n[e], q))
    q, e = q[order], e[order]
    asks, first, count = np.unique(q, return_index=True, return_counts=True)
    return pa.table(
        {
            "word": pa.array([asked[a] for a in asks.tolist()], pa.string()),
            "n_near": pa.array(count, pa.int64()),
            "near": pa.array([entries[b] for b in e[first].tolist()], pa.string()),
            "near_n": pa.array(n[e[first]], pa.int64()),
        }
    )


# --- the vocabulary dealt to tasks


def _halves(word: Column) -> Column:
    """For each half a word stands under: its hash, its side (0 first, 1 second), and whether the word asks for it."""
    length = F.char_length(word)

    def half(side: int, size: Column, asks: Column) -> Column:
        part = F.substr(word, F.lit(1), size) if side == 0 else F.substr(word, length - size + 1, size)
        return F.struct(F.xxhash64(F.lit(side), part).alias("key"), F.lit(side).alias("side"), asks.alias("asks"))

    shorter = F.floor((length - 1) / 2).cast("int")
    rest = (length - 1) - shorter
    own = F.floor(length / 2).cast("int")
    return F.array(
        half(0, shorter, shorter == own),
        half(0, shorter + 1, shorter + 1 == own),
        half(1, rest, rest == length - own),
        half(1, rest + 1, rest + 1 == length - own),
    )


def _dealt(words: DataFrame, slice_size: int, n_buckets: int) -> DataFrame:
    """Rows of every index: entries, questions, or both in one."""
    rows = words.select("word", "n", F.explode(_halves(F.col("word"))).alias("half")).select("word", "n", "half.*")
    heavy = rows.groupBy("key").agg(F.sum(F.char_length("word") + 1).alias("symbols")).where(F.col("symbols") > slice_size)
    heavy = heavy.select("key", F.ceil(F.col("symbols") / slice_size).cast("int").alias("slices"))
    rows = rows.join(heavy, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.crc32(F.encode("word", "UTF-8")), F.col("slices")).cast("int")
    rows = rows.withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("slices") - 1)

    def tile(i: Column, j: Column, entry: Column, query: Column) -> Column:
        return F.struct(i.alias("slice"), j.alias("asking"), entry.alias("entry"), query.alias("query"))

    yes = F.lit(True)
    entries = F.transform(every, lambda x: tile(F.col("own"), x, yes, F.col("asks") & (x == F.col("own"))))
    questions = F.transform(
        F.filter(every, lambda x: F.col("asks") & (x != F.col("own"))), lambda x: tile(x, F.col("own"), F.lit(False), yes)
    )
    rows = rows.select("word", "n", "key", "side", "slices", F.explode(F.concat(entries, questions)).alias("tile"))
    rows = rows.select("word", "n", "key", "side", "slices", "tile.*")
    bucket = F.pmod(F.xxhash64("key", "slice", "asking"), F.lit(n_buckets))
    return rows.select(bucket.alias("bucket"), "word", "n", "side", "slices", "slice", "entry", "query")


def near_words(words: DataFrame, slice_size: int = SLICE, index_size: int = INDEX) -> DataFrame:
    """(word, n_near, near, near_n) for every word with near words; ``near`` is the one of greatest count, then the first
    in code-point order.
    """
    symbols = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    rows = _dealt(words, slice_size, max(1, -(-4 * symbols // index_size)))
    found = rows.groupBy("bucket").applyInArrow(_bucket, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form reached from a word (word, form), in steps that double.

    A form stands ten times as often as its word, so chains are short and have no cycles.
    """
    links = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("on"))
        moved = links.join(on, "root", "left")
        if moved.where("on is not null").isEmpty():
            return links
        links = written(moved.select("word", F.coalesce("on", "root").alias("root")), "roots")


def spelling_variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = RATIO, loss: int = LOSS
) -> DataFrame:
    """Every word of the vocabulary with the more frequent word it is a variant of, if there is one.

    Columns: word, form, root, n, n_near, form_n.
    """
    words = written(vocabulary(docs, doc_id, text, loss), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    near = near.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("near")).alias("form"),
        F.when(formed, F.col("near_n")).alias("form_n"),
    )
    near = written(near, "near-words")
    last = roots(near.where("form is not null"))
    return near.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
