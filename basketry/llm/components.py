"""Connected components of a table of links, by alternating large and small stars.

Each round hangs the larger neighbours of every node on its least neighbour (large star), then the smaller ones (small
star); links turn into stars whose centres are the least nodes.  Every round is written to the shared folder, so lost
executors repeat one round only.  Nothing is collected but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import written


def _state(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(hashed), F.sum(F.pmod(hashed, F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its least node.

    Null ends and links of a node with itself are ignored; repeated and reversed links count once.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = links.where("a is not null and b is not null and a <> b").select(u, v).distinct()
    edges = written(edges, "links")
    state = _state(edges)
    while True:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).union(edges.select("v", "u"))
        least = both.groupBy("n").agg(F.least(F.min("w"), F.first("n")).alias("m"))
        large = both.where("w > n").join(least, "n").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("u", "m")).distinct(), "links")
        previous, state = state, _state(edges)
        if state == previous:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
