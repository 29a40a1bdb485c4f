"""Feature blocks that are written once and joined by every dataset that names them.

A block is a table below the shared folder, named by a digest of the source state and of everything its rows depend on.
The first dataset that names it writes it, the others read it.  Blocks of clients are bucketed by client with one bucket
count, so that datasets join them in place; a written block also survives lost executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.session import shared_dir


class BlockStore:
    """Blocks of one state of the sources."""

    def __init__(self, spark: SparkSession, state: str, buckets: int = 8) -> None:
        self.spark, self.state, self.buckets = spark, state, buckets
        #: digests of the blocks this store has written itself, in order
        self.built: list[str] = []

    def digest(self, kind: str, *params: object) -> str:
        """Names a block: equal for equal sources, kind and parameters (dataclasses, numbers, texts, and groups of them)."""
        return hashlib.sha256(repr((self.state, kind, params)).encode()).hexdigest()[:24]

    def keep(self, kind: str, params: tuple, build: Callable[[], DataFrame], client: str | None = "chid") -> DataFrame:
        """The block, written first if it is not there; ``client`` is the column it is bucketed by, if any."""
        digest = self.digest(kind, *params)
        app = "".join(c if c.isalnum() else "_" for c in self.spark.sparkContext.applicationId)
        # one folder per application: a block another application is still writing is never read
        table = f"basketry_block_{app}_{digest}".lower()
        if not self.spark.catalog.tableExists(table):
            rows = build()
            columns = rows.columns
            if client is not None:
                rows = rows.repartition(self.buckets, client)
            writer = rows.write.mode("overwrite")
            if client is not None:
                writer = writer.bucketBy(self.buckets, client).sortBy(client)
            writer.option("path", f"{shared_dir(self.spark)}/basketry/{app}/blocks/{digest}").format("parquet").saveAsTable(table)
            self.built.append(digest)
            return self.spark.table(table).select(*columns)
        return self.spark.table(table)


def kept(
    blocks: BlockStore | None, kind: str, params: tuple, build: Callable[[], DataFrame], client: str | None = "chid"
) -> DataFrame:
    """The block of a store, or without a store the plan itself."""
    return build() if blocks is None else blocks.keep(kind, params, build, client)
