"""Removal of repeated substrings by suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the same or another text.

Equal strings are brought together first.  Of the hashes of all ``anchor``-byte strings inside a window of ``length`` bytes
the least one is the window's anchor; equal windows have equal anchors at equal offsets.  Consecutive windows with one
anchor are a context: what lies before the anchor, the anchor, and what follows.  Contexts with an anchor that occurs once
hold nothing repeated; contexts that occur twice as a whole are repeated as a whole.  The distinct contexts of the other
anchors are sorted: many of them, each with its anchor as one symbol, are joined to one string, whose suffix array is
built by linear grouping.  Windows that agree with a neighbour in the array over their whole length are repeated.

The suffix array is built in two phases.  Phase 1 keeps the suffixes in ordered groups by their Lyndon prefix, processes
groups in descending order, points every suffix of the group to the previous suffix of a smaller group, and splits the
groups of the suffixes pointed at.  Phase 2 emits suffixes in ascending order: with each suffix the order within the
groups of those whose prefix ends there is known.  No names are assigned recursively.

Shorter passages can be reported beside the removed strings.  A repeated string of ``length`` bytes holds only repeated
strings of ``passage`` bytes, at both of its places, so it lies within their runs: those are found first, and the strings of
``length`` bytes are looked for in the runs alone.

An anchor with more than ``most`` distinct contexts (a passage with as many surroundings) would make one long string; its
windows are counted by hash over all tasks instead.

Cases: null, empty and texts shorter than ``length`` keep all; very long texts and texts of one repeated character are
handled whole; repeated rows are each other's copies, so all their bytes go; an empty table gives an empty table; other
columns pass unchanged.  Windows are told apart by 64-bit hashes, and by their bytes where contexts are sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import tables
from basketry.llm.arrow_text import Slice, mix, prefix_hashes, ranks_within, span_hashes, text_slices
from basketry.llm.frames import extended_schema
from basketry.session import written

LENGTH = 400
ANCHOR = 300
MOST = 1000
#: bytes of a passage that is reported: 51 words are hardly ever shorter
PASSAGE = 250
#: bytes of it that bring equal strings together
PASSAGE_ANCHOR = 150
#: contexts whose joined string is sorted at once, on average
SORTED_CONTEXTS = 1200
_PACK = 7


def lyndon_suffix_array(text: np.ndarray) -> list[int]:
    """Suffix array of integers whose last one is the only least one."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    opens = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    group_sizes = np.diff(np.append(opens, n))
    of_rank = np.repeat(opens, group_sizes)
    group_of = np.empty(n, np.int64)
    group_of[order] = of_rank
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    sizes = np.zeros(n, np.int64)
    sizes[opens] = group_sizes
    members, group, place, size = order.tolist(), group_of.tolist(), rank.tolist(), sizes.tolist()
    before = [-1] * n

    end = n
    while end > 0:
        start = group[members[end - 1]]
        if end - start == 1:
            j = members[start] - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[members[start]] = j
            if j >= 0:
                own = group[j]
                held = size[own]
                if held > 1:
                    last = own + held - 1
                    other, at = members[last], place[j]
                    members[at], members[last] = other, j
                    place[other], place[j] = at, last
                    size[own], size[last], group[j] = held - 1, 1, last
        else:
            pointed: dict[int, int] = {}
            for i in sorted(members[start:end]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            # those pointed at more often are larger, so they leave their group first, to its upper end
            parts: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                parts.setdefault((-times, group[j]), []).append(j)
            for _, own in sorted(parts):
                part = parts[_, own]
                held, moved = size[own], len(part)
                if moved < held:
                    new = own + held - moved
                    at = new
                    inside = [j for j in part if place[j] >= new]
                    taken = {place[j] for j in inside}
                    for j in part:
                        if place[j] >= new:
                            continue
                        while at in taken:
                            at += 1
                        other, was = members[at], place[j]
                        members[was], members[at] = other, j
                        place[other], place[j] = was, at
                        at += 1
                    size[own], size[new] = held - moved, moved
                    for j in part:
                        group[j] = new
        end = start

    out, filled = [-1] * n, list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            own = group[j]
            out[filled[own]] = j
            filled[own] += 1
            placed[j] = 1
            j = before[j]
    return out


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def contexts(part: Slice, length: int, anchor: int):
    """The contexts of a slice: text number, anchor place, first and last window start, hashes of anchor and context."""
    width = length - anchor + 1
    windows = np.maximum(part.end - part.start - length + 1, 0)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hashes(part.data)
    at = np.arange(len(part.data) - anchor + 1)
    hashes = span_hashes(prefix, at, at + anchor)
    least = _sliding_least(hashes & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64), width)
    owner = np.repeat(np.arange(len(windows)), windows)
    starts = part.start[owner] + ranks_within(windows)
    anchors = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]))
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(starts)) - 1
    owner, b, lo, hi = owner[opens], anchors[opens], starts[opens], starts[closes]
    whole = mix(span_hashes(prefix, lo, hi + length) + (b - lo).astype(np.uint64))
    return owner, b, lo, hi, hashes[b], whole


def _rows(part: Slice, length: int, anchor: int):
    """Contexts as columns: text id, anchor hash, context hash, and place, packed with the distances of its windows."""
    owner, b, lo, hi, h, whole = contexts(part, length, anchor)
    tids = part.batch.column(0).to_numpy()[owner]
    at = (b - part.start[owner]) << (2 * _PACK) | (b - lo) << _PACK | (b - hi)
    return tids, h.view(np.int64), whole.view(np.int64), at, (b, lo, hi)


def _unpacked(at: str = "at"):
    """First and last window start of a packed place, as columns."""
    place, mask = F.shiftright(at, 2 * _PACK), (1 << _PACK) - 1
    first = place - F.shiftright(at, _PACK).bitwiseAND(F.lit(mask).cast("long"))
    last = place - F.col(at).bitwiseAND(F.lit(mask).cast("long"))
    return first.alias("lo"), last.alias("hi")


def _most_common(number: np.ndarray, strings: list[bytes], width: int) -> np.ndarray:
    """Length of the longest prefix, up to ``width``, that each string shares with another one of its number."""
    order = np.array(sorted(range(len(strings)), key=lambda i: (number[i], strings[i])))
    table = np.full((len(order), width), 256, np.uint16)
    for row, i in enumerate(order.tolist()):
        raw = np.frombuffer(strings[i], np.uint8)[:width]
        table[row, : len(raw)] = raw
    same = (table[1:] == table[:-1]) & (number[order[1:]] == number[order[:-1]])[:, None]
    shared = np.where(same.all(axis=1), width, same.argmin(axis=1))
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = shared
    out[order[:-1]] = np.maximum(out[order[:-1]], shared)
    return out


def _repeated_starts(group: pa.Table, length: int, anchor: int) -> pa.Table:
    """Sorts the contexts of a group and gives (tid, lo, hi) of repeated window starts of contexts that occur once.

    Before that, contexts lose what no other context of their anchor has in common with them from the anchor on.
    """
    width = length - anchor + 1
    h, times, at, tid = (group[c].to_numpy() for c in ("h", "times", "at", "tid"))
    left, least = (at >> _PACK) & ((1 << _PACK) - 1), at & ((1 << _PACK) - 1)
    first = at >> (2 * _PACK)
    _, number = np.unique(h, return_inverse=True)
    blobs = group["around"].to_pylist()
    cuts = left.tolist()
    most = np.minimum(left, _most_common(number, [x[:c][::-1] for x, c in zip(blobs, cuts, strict=True)], width - 1))
    least = np.maximum(least, width - 1 - _most_common(number, [x[c:] for x, c in zip(blobs, cuts, strict=True)], width - 1))
    keep = np.flatnonzero(least <= most)
    if not len(keep):
        return pa.table({c: pa.array([], pa.int64()) for c in ("tid", "lo", "hi")})
    ends = zip(keep.tolist(), (left - most)[keep].tolist(), (left + width - 1 - least)[keep].tolist(), strict=True)
    blobs = [blobs[i][p:q] for i, p, q in ends]
    times, tid, number, first, left, least = (x[keep] for x in (times, tid, number, first, most, least))
    count = left - least + 1
    pieces, begin, total = [], [], 0
    for n, blob, before in zip(number.tolist(), blobs, left.tolist(), strict=True):
        raw = np.frombuffer(blob, np.uint8).astype(np.int64) + 2
        begin.append(total)
        pieces += [raw[:before], [258 + n], raw[before:], [1]]
        total += len(raw) + 2
    text = np.concatenate([*pieces, [0]])
    array = np.array(lyndon_suffix_array(text))
    owner = np.repeat(np.arange(len(count)), count)
    starts = np.repeat(begin, count) + ranks_within(count)
    start_of = np.full(len(text), -1)
    start_of[starts] = np.arange(len(starts))
    ranked = start_of[array]
    ranked = ranked[ranked >= 0]
    one, two = ranked[:-1], ranked[1:]
    for k in range(width):
        same = text[starts[one] + k] == text[starts[two] + k]
        one, two = one[same], two[same]
    repeated = np.zeros(len(starts), bool)
    repeated[one] = repeated[two] = True
    repeated &= times[owner] == 1
    edge = np.flatnonzero(repeated & ~(np.append(False, repeated[:-1]) & np.append(False, owner[1:] == owner[:-1])))
    close = np.flatnonzero(repeated & ~(np.append(repeated[1:], False) & np.append(owner[1:] == owner[:-1], False)))
    base = (first - left)[owner] + ranks_within(count)
    return pa.table({"tid": tid[owner[edge]], "lo": base[edge], "hi": base[close]})


def repeated_windows(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """Rows (tid, lo, hi): windows starting at bytes lo..hi of the texts with xxhash64 ``tid`` are repeated."""
    if not 0 < length - anchor < 1 << _PACK or anchor < 1:
        raise ValueError(f"length has to exceed anchor by 1 to {(1 << _PACK) - 1}")
    spark = docs.sparkSession
    rows = docs.where(F.octet_length(text) >= length).select(F.xxhash64(text).alias("tid"), F.col(text).alias("text"))

    def found(batches):
        for part in text_slices(batches, "text"):
            tids, h, whole, at, _ = _rows(part, length, anchor)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, whole, tids, at)], names=["h", "whole", "tid", "at"])

    # hashed once; some 25 bytes for each 50 of text
    every = written(rows.mapInArrow(found, "h long, whole long, tid long, at long"), "every")
    # written, so that the join below is one of two plain shuffles, whose hot keys Spark splits
    often = written(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "often")
    shared = written(every.join(often, "h", "left_semi"), "contexts")

    kinds = shared.groupBy("h", "whole").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("tid", "at")).alias("one"))
    kinds = written(kinds.select("h", "whole", "times", "one.tid", "one.at"), "kinds")
    full = shared.join(kinds.where("times > 1").select("h", "whole"), ["h", "whole"], "left_semi")
    full = full.select("tid", "at").distinct().select("tid", *_unpacked())

    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("held"), F.min("times").alias("least")).where("least = 1")
    sorted_ = written(kinds.join(mixed.select("h", "held"), "h"), "mixed")
    # one text gives each context, however many hold it
    marked = sorted_.select(F.col("whole").bitwiseXOR(F.col("tid")).alias("mark"))
    wanted = spark.sparkContext.broadcast(tables.hash_set(marked, "mark"))
    # most texts give none, so they are not hashed again
    giving = spark.sparkContext.broadcast(tables.hash_set(sorted_.select("tid"), "tid"))

    def around(batches):
        batches = (batch.filter(pa.array(tables.held(giving.value, batch.column(0).to_numpy()))) for batch in batches)
        for part in text_slices(batches, "text"):
            tids, h, whole, _, (b, lo, hi) = _rows(part, length, anchor)
            keep = np.flatnonzero(tables.held(wanted.value, whole ^ tids))
            blobs = [
                part.data[p:q].tobytes() + part.data[q + anchor : r + length].tobytes()
                for p, q, r in zip(lo[keep].tolist(), b[keep].tolist(), hi[keep].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[keep]), pa.array(whole[keep]), pa.array(blobs, pa.binary())], names=["h", "whole", "around"]
            )

    strings = rows.mapInArrow(around, "h long, whole long, around binary")
    strings = strings.groupBy("h", "whole").agg(F.first("around").alias("around"))
    strings = written(sorted_.join(strings, ["h", "whole"]), "strings")

    few = strings.where(F.col("held") <= most)
    groups = max(1, few.count() // SORTED_CONTEXTS)
    # by number, as small strings mean long work: their partitions are not to be merged by size
    few = few.withColumn("group", F.pmod(F.xxhash64("h"), F.lit(groups)).cast("int")).repartition(groups, "group")
    by_order = few.groupBy("group").applyInArrow(
        lambda g: _repeated_starts(g, length, anchor), "tid long, lo long, hi long"
    )

    def windows(batches):
        """Every window of a context by the hash of what surrounds the anchor in it."""
        for part in text_slices(batches, "around"):
            column = {c: part.batch.column(part.batch.schema.get_field_index(c)).to_numpy() for c in ("h", "times", "tid", "at")}
            at = column["at"]
            left = (at >> _PACK) & ((1 << _PACK) - 1)
            count = left - (at & ((1 << _PACK) - 1)) + 1
            owner = np.repeat(np.arange(len(at)), count)
            skip = ranks_within(count)
            start = part.start[owner] + skip
            marks = span_hashes(prefix_hashes(part.data), start, start + length - anchor)
            marks = mix(marks + (left[owner] - skip).astype(np.uint64)).view(np.int64)
            lo = (at >> (2 * _PACK))[owner] - left[owner] + skip
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (column["h"][owner], marks, column["times"][owner], column["tid"][owner], lo)],
                names=["h", "mark", "times", "tid", "lo"],
            )

    many = strings.where(F.col("held") > most).select("h", "times", "tid", "at", "around")
    spread = many.mapInArrow(windows, "h long, mark long, times long, tid long, lo long")
    twice = spread.groupBy("h", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "mark")
    by_hash = spread.where("times = 1").join(twice, ["h", "mark"], "left_semi").select("tid", "lo", F.col("lo").alias("hi"))
    return written(full.union(by_order).union(by_hash), "repeats")


def byte_runs(windows: pa.ListArray, length: int) -> pa.ListArray:
    """Maximal runs (start, end) of the bytes in windows of ``length`` bytes starting at lo..hi, in order; null is empty."""
    owner = np.repeat(np.arange(len(windows)), pc.fill_null(pc.list_value_length(windows), 0).to_numpy())
    flat = windows.flatten()
    lo, hi = (flat.field(flat.type.get_field_index(c)).to_numpy() for c in ("lo", "hi"))
    hi = hi + length
    # texts one after the other, so that none reaches into the next
    shift = owner * (int(hi.max(initial=0)) + 1)
    order = np.argsort(lo + shift, kind="stable")
    lo, hi, shift = (lo + shift)[order], (hi + shift)[order], shift[order]
    top = np.maximum.accumulate(hi)
    opens = np.flatnonzero(np.append(True, lo[1:] > top[:-1])[: len(lo)])
    closes = np.append(opens[1:], len(lo))[: len(opens)] - 1
    counts = np.bincount(owner[opens], minlength=len(windows))
    spans = pa.StructArray.from_arrays([pa.array(lo[opens] - shift[opens]), pa.array(top[closes] - shift[closes])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), spans)


_RUNS = "array<struct<start: bigint, end: bigint>>"


def _runs_of(windows: DataFrame, length: int, name: str) -> DataFrame:
    """Rows (tid, name): the maximal runs of bytes of every text in windows (tid, lo, hi)."""

    def merged(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), byte_runs(batch.column(1), length)], names=["tid", name])

    per_text = windows.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("windows"))
    return per_text.mapInArrow(merged, f"tid long, `{name}` {_RUNS}")


def _within(docs: DataFrame, text: str, runs: DataFrame, length: int, anchor: int, most: int) -> DataFrame:
    """Rows (tid, lo, hi) as of repeated_windows, looked for in the runs (tid, runs) that hold all of them."""

    def pieces(batches):
        for part in text_slices(batches, "text"):
            tids = part.batch.column(0).to_pylist()
            found = [
                (tid, s["start"], part.data[at + s["start"] : at + s["end"]].tobytes())
                for tid, at, own in zip(tids, part.start.tolist(), part.batch.column(2).to_pylist(), strict=True)
                for s in own
                if s["end"] - s["start"] >= length
            ]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["tid", "first", "piece"])

    long = runs.where(F.exists("runs", lambda s: s["end"] - s["start"] >= length))
    texts = docs.where(F.octet_length(text) >= length).select(F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    cut = texts.join(long, "tid").select("tid", "text", "runs").mapInArrow(pieces, "tid long, first long, piece binary")
    cut = written(cut, "pieces")
    places = cut.select("tid", "first", F.xxhash64("piece").alias("own")).distinct()
    found = repeated_windows(cut.select("piece"), "piece", length, anchor, most).withColumnRenamed("tid", "own")
    return places.join(found, "own").select("tid", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST,
    spans: str = "removed", kept: str = "kept", as_text: bool = False,
    passages: str | None = None, passage: int = PASSAGE, passage_anchor: int = PASSAGE_ANCHOR,
) -> DataFrame:
    """Adds the removed byte spans (maximal runs: start, end) and what is kept of a text column, as bytes or, without
    characters that lost some of their bytes, as text.

    ``passages`` names a column for the maximal runs of repeated strings of ``passage`` bytes, fewer than ``length``, of
    which only the removed spans go.
    """
    if passages is not None and passage > length:
        raise ValueError("a passage may not be longer than a removed string")
    kind = "string" if as_text else "binary"
    named = {} if passages is None else {passages: _RUNS}
    schema = extended_schema(docs, named | {spans: _RUNS, kept: kind})
    extended_schema(docs, {"tid": "long"})
    if passages is None:
        per_text = _runs_of(repeated_windows(docs, text, length, anchor, most), length, spans)
    else:
        runs = written(_runs_of(repeated_windows(docs, text, passage, passage_anchor, most), passage, "runs"), "runs")
        gone = _runs_of(_within(docs, text, runs, length, anchor, most), length, spans)
        per_text = runs.withColumnRenamed("runs", passages).join(gone, "tid", "left")
    rows = docs.withColumn("tid", F.xxhash64(text)).join(per_text, "tid", "left")
    rows = rows.select(*docs.columns, *(F.coalesce(c, F.array().cast(_RUNS)).alias(c) for c in [*named, spans]))

    def cut(batches):
        for part in text_slices(batches, text):
            blobs = []
            for i, own in enumerate(part.batch.column(part.batch.num_columns - 1).to_pylist()):
                raw = part.data[part.start[i] : part.end[i]]
                if own:
                    stay = np.ones(len(raw), bool)
                    for s in own:
                        stay[s["start"] : s["end"]] = False
                    raw = raw[stay]
                blobs.append(raw.tobytes().decode("utf-8", "ignore") if as_text else raw.tobytes())
            columns = [*part.batch.columns, pa.array(blobs, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(cut, schema)
