"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where it is greater than at the 16 places on either side, so
chunk borders depend on the 32 bytes before and the 16 after them, whatever borders stand before, and come back at once
after an insertion.  A passage loses some 40 bytes at either edge to chunks that are not wholly its own.  Chunks are told apart by a 64-bit digest.  A chunk whose digest
occurs at another place is repeated; consecutive repeated chunks of at least ``least_run`` bytes are a repeated passage
(shorter ones, such as a common line, are left alone).  Of each repeated chunk the first place by (document id, position)
stays, and the others go.

Cases: null, empty and short texts have no passages; chunks never cross documents; very long texts are cut whole; a text
of one repeated character is cut at the largest chunk size; equal rows (same id and text) are one place, as they cannot be
told apart; null ids come first in order; an empty table gives an empty table; other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.arrow_text import Slice, prefix_hashes, span_hashes, text_slices
from basketry.llm.frames import extended_schema, need
from basketry.session import written

GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)
GEAR_WINDOW = 16
#: a border's hash is the greatest among so many places before and after; at most GEAR_WINDOW, so texts do not meet
REACH = 16
LEAST_CHUNK, LARGEST_CHUNK = 16, 256
LEAST_RUN = 128


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At every byte the sum of the gear values of the last GEAR_WINDOW bytes, each shifted by its distance."""
    h = GEAR[data]
    span = 1
    while span < GEAR_WINDOW:
        shifted = h[:-span] << np.uint32(span) if span < len(h) else h[:0]
        h = h.copy()
        h[span:] += shifted
        span *= 2
    return h


def _borders(part: Slice) -> np.ndarray:
    """Whether a chunk ends after a byte; of equal hashes the first counts."""
    data = part.data
    h = np.concatenate((np.zeros(REACH, np.uint32), gear_hashes(data), np.zeros(REACH + 1, np.uint32)))
    own = h[REACH : REACH + len(data)]
    # no border inside a character, nor where the hash or its neighbours would depend on another text
    own[:-1][(data[1:] & 0xC0) == 0x80] = 0
    own[part.end] = 0
    own[np.minimum(part.start[:, None] + np.arange(GEAR_WINDOW - 1), len(data) - 1).ravel()] = 0
    most, span = h, 1  # of span places from here on
    while span < REACH:
        step = min(span, REACH - span)
        most = np.maximum(most[:-step], most[step:])
        span += step
    return (own > most[: len(data)]) & (own >= most[REACH + 1 : REACH + 1 + len(data)]) & (own > 0)


def chunks(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all chunks of a slice in order: text number, start and end in the slice's data."""
    data = part.data
    places = np.flatnonzero(_borders(part)) + 1
    inside = np.searchsorted(places, np.stack([part.start + GEAR_WINDOW, part.end]))
    whole = places.tolist()
    owner, starts, ends = [], [], []
    for n, (begin, end) in enumerate(zip(part.start.tolist(), part.end.tolist(), strict=True)):
        if begin == end:
            continue
        at = begin
        for cut in (*whole[inside[0, n] : inside[1, n]], end):
            if cut - at < LEAST_CHUNK and cut != end or cut == at:
                continue
            while cut - at > LARGEST_CHUNK:
                forced = at + LARGEST_CHUNK
                while forced > at + LARGEST_CHUNK - 4 and data[forced] & 0xC0 == 0x80:
                    forced -= 1
                owner.append(n)
                starts.append(at)
                ends.append(forced)
                at = forced
            owner.append(n)
            starts.append(at)
            ends.append(cut)
            at = cut
    return np.array(owner, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, tid, start, size, first_id, first, across): places of chunks that occur at more than one place, the
    document of the first one, whether this is it, and whether other documents hold the chunk.  ``docs`` has doc_id and
    text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")

    def cut(batches):
        for part in text_slices(batches, "text"):
            owner, start, end = chunks(part)
            digests = span_hashes(prefix_hashes(part.data), start, end).view(np.int64)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests), part.batch.column(0).take(take), part.batch.column(1).take(take),
                 pa.array((start - part.start[owner]) << 16 | (end - start))],
                names=["digest", "doc_id", "tid", "place"],
            )

    every = rows.mapInArrow(cut, f"digest long, doc_id {kind}, tid long, place long")
    at = F.struct("doc_id", "tid", "place")
    # only chunks counted twice are moved with their places
    twice = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    every = written(every.join(twice, "digest", "left_semi"), "twice")
    often = every.groupBy("digest").agg(F.min(at).alias("least"), F.max(at).alias("most")).where("not (least <=> most)")
    across = F.struct("least.doc_id", "least.tid") != F.struct("most.doc_id", "most.tid")
    found = every.join(often.select("digest", "least", F.coalesce(across, F.lit(True)).alias("across")), "digest")
    found = found.select(
        "doc_id",
        "tid",
        F.shiftright("place", 16).alias("start"),
        F.col("place").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("size"),
        F.col("least.doc_id").alias("first_id"),
        at.eqNullSafe(F.col("least")).alias("first"),
        "across",
    )
    return written(found, "chunks")


def dedup_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """Adds per document ``passages`` (repeated byte spans), ``shared`` (those that other documents hold as well),
    ``removed`` (the parts of passages that stay elsewhere), ``first_ids`` (documents where those stay) and the ``kept``
    bytes.
    """
    need(docs, doc_id=doc_id, text=text)
    id_kind = docs.schema[doc_id].dataType.simpleString()
    spans = "array<struct<start: bigint, end: bigint>>"
    added = {"passages": spans, "shared": spans, "removed": spans, "first_ids": f"array<{id_kind}>", "kept": "binary"}
    schema = extended_schema(docs, added)
    extended_schema(docs, {"tid": "long", "found": "string", "own_id": "string"})
    found = repeated_chunks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    per_text = found.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("start", "size", "first", "first_id", "across")).alias("found"))
    per_text = per_text.withColumnRenamed("doc_id", "own_id").withColumnRenamed("tid", "own_tid")
    rows = docs.withColumn("tid", F.xxhash64(text))
    rows = rows.join(per_text, F.col(doc_id).eqNullSafe(F.col("own_id")) & (F.col("tid") == F.col("own_tid")), "left")
    rows = rows.select(*docs.columns, "found")
    id_type = None

    def merged(parts: list[tuple[int, int]]) -> list[dict[str, int]]:
        out: list[dict[str, int]] = []
        for lo, hi in parts:
            if out and lo == out[-1]["end"]:
                out[-1]["end"] = hi
            else:
                out.append({"start": lo, "end": hi})
        return out

    def run(batches):
        nonlocal id_type
        for part in text_slices(batches, text):
            id_type = id_type or part.batch.schema.field(doc_id).type
            passages, shared, removed, firsts, blobs = [], [], [], [], []
            for i, own in enumerate(part.batch.column(part.batch.schema.get_field_index("found")).to_pylist()):
                own = sorted(own or (), key=lambda c: c["start"])
                runs, common = (
                    [r for r in merged([(c["start"], c["start"] + c["size"]) for c in cs]) if r["end"] - r["start"] >= least_run]
                    for cs in (own, [c for c in own if c["across"]])
                )
                inside = [c for c in own if not c["first"] and any(r["start"] <= c["start"] < r["end"] for r in runs)]
                gone = merged([(c["start"], c["start"] + c["size"]) for c in inside])
                raw = part.data[part.start[i] : part.end[i]]
                if gone:
                    stay = np.ones(len(raw), bool)
                    for s in gone:
                        stay[s["start"] : s["end"]] = False
                    raw = raw[stay]
                passages.append(runs)
                shared.append(common)
                removed.append(gone)
                firsts.append(sorted({c["first_id"] for c in inside if c["first_id"] is not None}))
                blobs.append(raw.tobytes())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [
                *part.batch.columns[:-1], pa.array(passages, span), pa.array(shared, span), pa.array(removed, span),
                pa.array(firsts, pa.list_(id_type)), pa.array(blobs, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.batch.schema.names[:-1], *added])

    return rows.mapInArrow(run, schema)
