"""Exact Jaccard self-join of documents on five-word shingles.

Documents with equal shingle sets are one class; only classes are joined.  The shingles of a class are ordered rare
first (by counts over all documents in a table of fixed size, then by hash), and two classes can only be similar if they
share a shingle within their prefixes.  Rows (shingle, class, set size, position) meet by shingle; candidate pairs pass
the length filter, the positional filter (what can follow two positions bounds the overlap) and the suffix filter (the
sets are cut at pivots, the more the larger they are; differences of the part sizes bound the overlap), and each is
verified once on the full sets.

A group of many near copies would give a quadratic number of pairs.  So the classes that share a shingle are first
compared with one of them, the leader; then all pairs that share a shingle but are still in different components.  A pair
left out is in one component already, so the components are those of all links.

Cases: null and empty texts and texts without words have the empty set and link with nothing; texts of one to four words
are one shingle; very long texts are read whole; equal texts share a class; null ids are kept (a component of null ids
only has the id null); an empty table gives an empty table.  Sets and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm import tables
from basketry.llm.arrow_text import mix, ranks_within, shingle_hashes, text_slices, words_of
from basketry.llm.components import components
from basketry.llm.frames import need
from basketry.session import written

#: similarity of at least 75 / 100
NUM, DEN = 3, 4
#: a set is cut into the least power of two of parts that hold PART_ITEMS shingles at most on average, LEAST_PARTS at least:
#: parts of a fixed number would tell large sets apart the less, the larger they are
PART_ITEMS = 4
LEAST_PARTS = 64
#: larger parts count as this
MOST_IN_PART = 127
#: a shingle in so many more documents than usual is dealt to SALTS tasks
HOT_EXCESS = 10_000
SALTS = 64


def distinct_sets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one after the other, and their counts."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.bincount(owner[keep], minlength=len(first) - 1)


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A signed 64-bit name per set, from its members in any order and its size."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    ends = np.cumsum(counts)
    return mix(total[ends] - total[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def _sets(part):
    hashes, counts = distinct_sets(*shingle_hashes(words_of(part)))
    return hashes, counts, set_keys(hashes, counts)


def part_sizes(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the parts of each set between its pivots, one after the other, and the numbers of parts."""
    bits = np.ceil(np.log2(np.maximum(counts / PART_ITEMS, LEAST_PARTS))).astype(np.int64)
    parts = np.int64(1) << bits
    owner = np.repeat(np.arange(len(counts)), counts)
    at = (hashes >> (64 - bits).astype(np.uint64)[owner]).astype(np.int64) + (np.cumsum(parts) - parts)[owner]
    return np.minimum(np.bincount(at, minlength=int(parts.sum())), MOST_IN_PART), parts


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def memberships(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Written rows (doc_id, tid, key, n), one per document, and shingle counts over all documents by cell."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))

    def run(batches):
        counts = np.zeros(tables.COUNT_CELLS, np.int64)
        kind = None
        for part in text_slices(batches, "text"):
            hashes, sizes, keys = _sets(part)
            counts += np.bincount(tables.cell(hashes), minlength=tables.COUNT_CELLS)
            kind, rows = part.batch.column(0).type, len(sizes)
            yield pa.RecordBatch.from_arrays(
                [part.batch.column(0), part.batch.column(1), pa.array(keys), pa.array(sizes, pa.int64()),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                names=["doc_id", "tid", "key", "n", "slice", "counts"],
            )
        if kind is not None:
            at, blobs = zip(*tables.count_slices(counts), strict=True)
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(at), kind), none, none, none, pa.array(at, pa.int32()), pa.array(blobs, pa.binary())],
                names=["doc_id", "tid", "key", "n", "slice", "counts"],
            )

    both = rows.mapInArrow(run, f"doc_id {id_type}, tid long, key long, n long, slice int, counts binary")
    both = written(both, "members")
    counts = tables.summed(both.where("slice is not null").select("slice", "counts"))
    return both.where("slice is null").select("doc_id", "tid", "key", "n"), counts


def prefixes(docs: DataFrame, counts: np.ndarray, text: str = "text") -> DataFrame:
    """One row per class: key, n, sizes of its parts between the pivots, and its prefix, rarest shingle first.

    An item of the prefix is the shingle and whether it is a frequent one.
    """
    spark = docs.sparkSession
    # a table of fixed size
    shared = spark.sparkContext.broadcast(counts)

    def run(batches):
        table = shared.value
        usual = int(np.median(table))
        for part in text_slices(batches, "text"):
            hashes, sizes, keys = _sets(part)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            often = table[tables.cell(hashes)]
            order = np.lexsort((hashes, often, owner))
            place = ranks_within(sizes)
            length = sizes - (NUM * sizes + DEN - 1) // DEN + 1
            chosen = order[place < length[owner]]
            per = np.where(sizes > 0, length, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(sizes, pa.int64()),
                 _lists(*part_sizes(hashes, sizes), pa.int8()),
                 _lists(hashes[chosen].view(np.int64), per, pa.int64()),
                 _lists(often[chosen] > usual + HOT_EXCESS, per, pa.bool_())],
                names=["key", "n", "parts", "prefix", "frequent"],
            ).filter(pa.array(sizes > 0))

    rows = docs.select(F.col(text).alias("text")).mapInArrow(
        run, "key long, n long, parts array<tinyint>, prefix array<long>, frequent array<boolean>"
    )
    # copies collapse before anything moves
    return rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "parts", "prefix", "frequent")])


def shared_shingles(classes: DataFrame) -> DataFrame:
    """Written rows (shingle, key, place, leader) of prefix shingles that more than one class has; leader is (place, key).

    The leader is the class in whose prefix the shingle comes first.  An original has no shingles of its own before those
    it shares with its edited copies, so it leads them.  These are the most rows that move, so position and set size are
    one number (pos << 32 | n), and what hardly varies stands first, where it compresses.
    """
    items = classes.select("key", "n", F.posexplode(F.arrays_zip("prefix", "frequent")).alias("pos", "item"))
    salt = F.when(F.col("item.frequent"), F.pmod("key", F.lit(SALTS))).otherwise(F.lit(-1)).cast("int")
    place = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n"))
    rows = items.select(salt.alias("salt"), F.col("item.prefix").alias("shingle"), "key", place.alias("place"))
    same = Window.partitionBy("shingle", "salt")
    met = rows.withColumns(
        {
            "leader": F.min(F.struct("place", "key")).over(same),
            "least": F.min("key").over(same),
            "most": F.max("key").over(same),
        }
    )
    return written(met.where("least <> most or salt >= 0").select("shingle", "key", "place", "leader"), "shingles")


def _placed(place: str, k: str = "") -> list:
    """Set size and position of a place, as columns n and pos."""
    n = F.col(place).bitwiseAND(F.lit((1 << 32) - 1))
    return [n.alias(f"n{k}"), F.shiftright(place, 32).alias(f"pos{k}")]


def _fits(n: str, m: str):
    """Length filter."""
    return (F.col(n) * DEN >= F.col(m) * NUM) & (F.col(m) * DEN >= F.col(n) * NUM)


def _least_overlap(n: str, m: str):
    """The overlap that similar sets of these sizes have at least."""
    return F.expr(f"(({n} + {m}) * {NUM} + {NUM + DEN - 1}) div {NUM + DEN}")


def _reaches(n: str, pos: str, m: str, at: str):
    """Positional filter: what follows a common shingle, itself included, can make up the least overlap.

    It holds for the first common shingle of similar sets, at which nothing before is common.
    """
    return F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at)) >= _least_overlap(n, m)


def _apart(p: str, q: str) -> str:
    """Sum of the differences of part sizes."""
    return f"aggregate(zip_with({p}, {q}, (x, y) -> abs(int(x) - int(y))), 0L, (s, x) -> s + x)"


def _halved(p: str) -> str:
    """Part sizes of half as many parts."""
    both = f"int({p}[int(2 * i)]) + int({p}[int(2 * i + 1)])"
    return f"transform(sequence(0, int(size({p}) div 2) - 1), i -> least({both}, {MOST_IN_PART}))"


def filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Written pairs (a, b) that the length and suffix filters leave.

    Sets that pass the length filter have as many parts, or one has twice as many.
    """
    one, two = (classes.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("parts").alias(f"p{k}")) for k in "ab")
    differ = F.expr(
        f"case when size(pa) > size(pb) then {_apart(_halved('pa'), 'pb')} "
        f"when size(pa) < size(pb) then {_apart('pa', _halved('pb'))} else {_apart('pa', 'pb')} end"
    )
    kept = pairs.join(one, "a").join(two, "b").where(_fits("na", "nb"))
    return written(kept.where(differ <= F.col("na") + F.col("nb") - 2 * _least_overlap("na", "nb")).select("a", "b"), "pairs")


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, text: str = "text") -> DataFrame:
    """The pairs of classes whose full shingle sets are similar."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    # one text of each class stands for it
    tids = members.where("n > 0").groupBy("key").agg(F.min("tid").alias("tid"))
    wanted = tables.hash_set(tids.join(ends, "key").select("tid"), "tid")
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches):
        def chosen():
            for batch in batches:
                yield batch.filter(pa.array(tables.held(shared.value, batch.column(0).to_numpy())))

        for part in text_slices(chosen(), "text"):
            hashes, sizes, keys = _sets(part)
            held = _lists(hashes.view(np.int64), sizes, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys), held], names=["key", "held"])

    texts = docs.select(F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    full = texts.mapInArrow(sets, "key long, held array<long>").groupBy("key").agg(F.first("held").alias("held"))
    full = full.join(ends, "key", "left_semi")
    both = pairs.join(full.select(F.col("key").alias("a"), F.col("held").alias("x")), "a")
    both = both.join(full.select(F.col("key").alias("b"), F.col("held").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * DEN >= NUM * (F.size("x") + F.size("y") - common)).select("a", "b")


def class_links(docs: DataFrame, members: DataFrame, counts: np.ndarray, text: str = "text") -> DataFrame:
    """Written links (a, b) of classes; every pair of similar classes is linked or joined by a path of links."""
    classes = written(prefixes(docs, counts, text), "classes")
    shingles = shared_shingles(classes)
    led = shingles.select("key", "leader", *_placed("place"), *_placed("leader.place", "_led"))
    led = led.where((F.col("key") != F.col("leader.key")) & _fits("n", "n_led") & _reaches("n", "pos", "n_led", "pos_led"))
    starred = led.select(F.least("leader.key", "key").alias("a"), F.greatest("leader.key", "key").alias("b")).distinct()
    starred = written(starred, "starred")
    links = written(verified(filtered(starred, classes), docs, members, text), "found")

    parts = components(links)
    named = shingles.drop("leader").join(parts.withColumnRenamed("node", "key"), "key", "left")
    named = written(named.withColumn("component", F.coalesce("component", "key")), "parts")
    open_ = named.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    open_ = named.join(open_.where("x <> y").select("shingle"), "shingle", "left_semi")
    one, two = (open_.select("shingle", *[F.col(c).alias(c + k) for c in ("key", "place", "component")]) for k in "ab")
    rest = (
        one.join(two, "shingle")
        .where("componenta < componentb")
        .select("keya", "keyb", *_placed("placea", "a"), *_placed("placeb", "b"))
        .where(_fits("na", "nb"))
        .where(_reaches("na", "posa", "nb", "posb"))
        .select(F.least("keya", "keyb").alias("a"), F.greatest("keya", "keyb").alias("b"))
        .distinct()
    )
    rest = filtered(rest.join(starred, ["a", "b"], "left_anti"), classes)
    return written(links.union(verified(rest, docs, members, text)), "found")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, class_key (equal shingle sets) and component_id, the least id it is linked to."""
    need(docs, doc_id=doc_id, text=text)
    members, counts = memberships(docs, doc_id, text)
    parts = components(class_links(docs, members, counts, text))
    named = members.where("n > 0").join(parts.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("doc_id", "n", "key", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), "component_id")
    alone = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_key"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group of linked ones: that with the least id.

    Documents without words are all kept.  Rows that share the least id are all of one group and all kept, as they cannot
    be told apart by id; ids are meant to be unique.
    """
    found = near_duplicates(docs, doc_id, text)
    gone = found.where("not (doc_id <=> component_id)").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti")
