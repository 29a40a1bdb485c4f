"""Byte-pair encoding and decoding with a given vocabulary.

Each word is a doubly linked list of symbols; the mergeable neighbours wait in a priority queue by (rank, place).  The
best entry is taken, skipped if one of its symbols has changed since, else both symbols become one and the two new
neighbour pairs are queued.  Decoding joins the vocabulary strings of the ids.

Cases: null and empty texts (and texts of white space only) have no ids and decode to the empty text; every text is
encoded whole, in pieces cut at white space so that a very long one needs no more memory than its ids; rows are
independent, so repeated rows give equal results; other columns pass unchanged, and a clash with an output column is an
error that names the column.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.arrow_text import text_slices
from basketry.llm.frames import extended_schema

PIECE_CHARS = 1 << 18
#: words whose ids a worker remembers; beyond it starts afresh, so memory stays bounded
REMEMBERED_WORDS = 400_000

# fixed values of the vocabulary's format: word pattern, word end and the visible stand-ins of bytes
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# the same for lower-case text of the first 256 characters
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"
WORD_END = "</w>"
# letters and digits that the pattern library knows and the files' library, of an earlier Unicode version, does not
NEWER_CHARACTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
VISIBLE_BYTES = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def byte_symbols() -> list[str]:
    """One visible character per byte: printable ones stand for themselves, the rest follow from 256 on in order."""
    visible = set(chain.from_iterable(VISIBLE_BYTES))
    out, extra = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


@cache
def newer_characters() -> tuple[regex.Pattern, regex.Pattern]:
    """What finds newer characters, and the word pattern that takes them for symbols."""
    gone = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER_CHARACTERS)
    parts = [r"'s|'t|'re|'ve|'m|'ll|'d", rf"(?:(?![{gone}])\p{{L}})+", rf"(?![{gone}])\p{{N}}", rf"(?:[^\s\p{{L}}\p{{N}}]|[{gone}])+"]
    return regex.compile(f"[{gone}]"), regex.compile("|".join(parts))


class Vocabulary:
    """Ids, merge ranks and special strings of a tokenizer file, given as its JSON text."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # left id << 16 | right id -> (rank << 32, merged id)
        self.merges = {self.ids[a] << 16 | self.ids[b]: (rank << 32, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if len(self.ids) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 ids are not supported")
        self.strings = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for s, i in chain(self.ids.items(), self.special.items()):
            self.strings[i] = s
        symbols = byte_symbols()
        self.byte_ids = [self.ids[s] for s in symbols]
        self.end_ids = [self.ids[s + WORD_END] for s in symbols]
        self.latin_words = re.compile(LATIN_PATTERN)
        self.words = regex.compile(WORD_PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.arrow_strings = pa.array(self.strings, pa.string())
        # word -> its ids as bytes
        self.seen: dict[str, bytes] = {}

    def word_ids(self, word: str) -> bytes:
        """Merges one word by rank; its ids as 32-bit integers."""
        raw = word.encode()
        ids = [self.byte_ids[b] for b in raw]
        ids[-1] = self.end_ids[raw[-1]]
        n, merges = len(ids), self.merges
        # entries are rank << 32 | place; a rank belongs to one pair, so a stale entry shows by its pair's rank
        queue = [found[0] | i for i in range(n - 1) if (found := merges.get(ids[i] << 16 | ids[i + 1]))]
        if queue:
            heapq.heapify(queue)
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            while queue:
                entry = heapq.heappop(queue)
                i = entry & 0xFFFFFFFF
                j = right[i]
                if j >= n or ids[i] < 0:
                    continue
                found = merges.get(ids[i] << 16 | ids[j])
                if not found or found[0] != entry - i:
                    continue
                merged = found[1]
                ids[i], ids[j] = merged, -1
                right[i] = k = right[j]
                if k < n:
                    left[k] = i
                    if found := merges.get(merged << 16 | ids[k]):
                        heapq.heappush(queue, found[0] | i)
                h = left[i]
                if h >= 0 and (found := merges.get(ids[h] << 16 | merged)):
                    heapq.heappush(queue, found[0] | h)
            ids = [x for x in ids if x >= 0]
        return array("i", ids).tobytes()

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            # each character is lowered by itself, also a sigma that ends a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            newer, without = newer_characters()
            return (without if newer.search(text) else self.words).findall(text)
        return self.latin_words.findall(text)

    def _plain(self, text: str, out: list[bytes]) -> None:
        words = self._words(text)
        if len(self.seen) > REMEMBERED_WORDS:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = self.word_ids(w)
        out.extend(map(seen.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers."""
        out: list[bytes] = []
        for part in pieces(text):
            if "<|" not in part:
                self._plain(part, out)
                continue
            for k, s in enumerate(self.marks.split(part)):
                if k % 2:
                    out.append(array("i", [self.special[s]]).tobytes())
                elif s:
                    self._plain(s, out)
        return b"".join(out)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """For each list of ids its vocabulary strings, special ones included, joined by one space."""
        if lists.null_count:
            lists = lists.fill_null([])
        values = lists.values if lists.offset == 0 else lists.flatten()
        offsets = pc.subtract(lists.offsets, lists.offsets[0]) if lists.offset else lists.offsets
        strings = self.arrow_strings.take(values)
        return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), " ")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts a text before blanks or line ends; no word, special string or composed character stands across a cut."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at + 1, at + size), text.rfind("\n", at + 1, at + size))
        if cut < 0:
            found = [c for c in (text.find(" ", at + size), text.find("\n", at + size)) if c >= 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


_loaded: dict[str, Vocabulary] = {}


def _share(df: DataFrame, path: str):
    """What gives a task the vocabulary: the file, a fixed few megabytes, is sent to the executors, which may not have
    it, and read once per worker process.
    """
    with open(path, encoding="utf-8") as f:
        content = f.read()
    key = hashlib.sha256(content.encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(content)

    def load() -> Vocabulary:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Vocabulary(shared.value)
        return _loaded[key]

    return load


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids of a text column as array<int> and, if ``decoded`` names a column, their decoded text."""
    names = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    schema = extended_schema(df, names)
    load = _share(df, path)

    def run(batches):
        vocabulary = load()
        for part in text_slices(batches, text):
            coded = [vocabulary.encode(part.text(i).decode()) for i in range(len(part.start))]
            offsets = pa.array([0, *accumulate(len(x) // 4 for x in coded)], pa.int32())
            flat = b"".join(coded)
            values = pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])
            lists = pa.ListArray.from_arrays(offsets, values)
            columns = [*part.batch.columns, lists]
            if decoded:
                columns.append(vocabulary.decode(lists))
            yield pa.RecordBatch.from_arrays(columns, names=[*part.batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that a column of ids stands for; null ids decode to the empty text."""
    schema = extended_schema(df, {decoded: "string"})
    load = _share(df, path)

    def run(batches):
        vocabulary = load()
        for batch in batches:
            out = vocabulary.decode(batch.column(batch.schema.get_field_index(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, schema)


def ids_text(ids: str = "ids"):
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
