"""Text columns as byte arrays inside Arrow tasks: bounded slices, words and word shingles by array arithmetic.

Nothing here looks at more than one slice of a batch at a time, so a task holds a few megabytes of text however large its
partition is; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: one random 64-bit value per byte, for rolling hashes
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULT = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_PRIME, _INVERSE):
            steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i], times the inverse power of i, equal for equal bytes i..j wherever they stand."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans start..end."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


@dataclass
class Slice:
    """Rows of a batch whose texts stand in ``data``; text i covers bytes start[i]..end[i] and a blank follows each."""

    batch: pa.RecordBatch
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts batches so that each part has about ``limit`` bytes of text; null is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.type not in (pa.string(), pa.binary()):
            texts = texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("" if texts.type == pa.string() else b"")
        rows = len(texts)
        if not rows:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64)
        raw = texts.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            hi = min(hi, lo + 4096, rows)
            lens = np.diff(offsets[lo : hi + 1])
            start = np.cumsum(lens + 1) - lens - 1
            data = np.full(int(lens.sum()) + hi - lo, 32, np.uint8)
            part = raw[offsets[lo] : offsets[hi]]
            if len(part):
                data[np.arange(len(part)) + np.repeat(np.arange(hi - lo), lens)] = part
            yield Slice(batch.slice(lo, hi - lo), data, start, start + lens)
            lo = hi


@dataclass
class Words:
    """Words of a slice in order: byte spans, hashes, and for text i the words first[i]..first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words_of(part: Slice, lower: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text, A-Z lower-cased if asked."""
    data = _LOWER[part.data] if lower else part.data
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_BLANK[data]
    edges = np.diff(solid)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = span_hashes(prefix_hashes(data), start, end)
    first = np.searchsorted(start, np.append(part.start, len(data)))
    return Words(start, end, hashes, first)


def shingle_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles in order, and for text i its shingles first[i]..first[i + 1].

    A text of one to four words is one shingle, the whole sequence; a text without words has none.
    """
    h, first = words.hashes, words.first
    n_words = np.diff(first)
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    at = np.repeat(first[:-1], counts) + ranks_within(counts)
    out = np.zeros(len(at), np.uint64)
    short = np.repeat(np.where(n_words < SHINGLE, n_words, SHINGLE), counts)
    for j in range(SHINGLE):
        held = short > j
        out[held] += h[at[held] + j] * _MULT[j]
    return mix(out + short.astype(np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def ranks_within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each group of the given sizes, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
