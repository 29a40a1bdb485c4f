"""Ledgers prepared once and shared by all queries.

Deriving the ledger reads every order line, so it is done once per state of the source files and written below the
shared folder as a table partitioned by period and, within a period, bucketed by client.  A query over some periods opens
their files only, also where the periods come from a joined table and are known at run time only.  Grouping by client (or
client and item) needs no shuffle, and ledger, profile and clients join without moving, as all use one bucket count.  A
written table also survives lost executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import shared_dir
from basketry.sources import orders as src

#: bytes of the source files for each bucket.  One task sorts and groups a bucket of all periods, and 16 MiB of files are
#: up to 0.6 GB there; a bucket has a file in every period, so smaller ones would only add files.
BYTES_PER_BUCKET = 16 << 20
#: bytes of a shuffled partition while a table is prepared: a task sorts some fifteen times as much
PARTITION_BYTES = 16 << 20
SMALL_BUCKET = 1 << 20
MAX_BUCKETS = 65536
PERIOD = "dt"
SOURCES = ("lineitem", "orders", "part", "customer", "nation")


class Inputs:
    """Lazy access to the given tables and the ledgers derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str, buckets: int | None = None) -> None:
        """``buckets`` is the bucket count of new tables; by default it follows the size of the sources."""
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.buckets = buckets

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def ledger(self) -> DataFrame:
        return self._prepared("ledger", ("lineitem", "orders", "part"), src.orders_ledger, by_period=True)

    @cached_property
    def profile(self) -> DataFrame:
        return self._prepared("profile", ("orders", "customer", "nation"), src.orders_profile, by_period=True)

    @cached_property
    def attributes(self) -> DataFrame:
        return self._prepared("clients", ("customer", "nation"), src.client_attributes)

    @cached_property
    def clients(self) -> DataFrame:
        return self.attributes.select("chid")

    @cached_property
    def _state(self) -> tuple[str, int]:
        """Fingerprint and size of the source files, from listings only; no file is opened."""
        files = [f for s in SOURCES for f in self._listing(self.path(s))]
        digest = hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:16]
        return digest, sum(size for _, size, _ in files)

    @property
    def state(self) -> str:
        """Names the state of the source files."""
        return self._state[0]

    @property
    def bucket_count(self) -> int:
        return self._buckets

    @cached_property
    def _buckets(self) -> int:
        """One bucket count for all tables, so they join on the client without moving."""
        if self.buckets is not None:
            return self.buckets
        size = self._state[1]
        wanted = -(-size // BYTES_PER_BUCKET)
        spread = min(self.spark.sparkContext.defaultParallelism, -(-size // SMALL_BUCKET))
        return int(max(1, min(MAX_BUCKETS, max(wanted, spread))))

    def _listing(self, path: str) -> list[tuple[str, int, str]]:
        """(path, size, modification time) of the files of one source; in a store only Spark reads, their sum."""
        local = Path(path.removeprefix("file://"))
        if local.exists():
            found = [local] if local.is_file() else [f for f in local.rglob("*") if f.is_file()]
            return [(str(f), (st := f.stat()).st_size, str(st.st_mtime_ns)) for f in found]
        try:
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        except AnalysisException:
            return []  # a table that is not there; reading it will say so
        files = found.select("length", F.xxhash64("path", "length", "modificationTime").alias("_h"))
        size, digest, n = files.agg(F.sum("length"), F.bit_xor("_h"), F.count("*")).first()
        return [(path, size or 0, f"{n} files {digest}")]

    @contextmanager
    def _small_partitions(self) -> Iterator[None]:
        """Shuffled partitions of PARTITION_BYTES, however large the sources are: what a task sorts does not grow.

        The joins stay those of Spark, which splits a hot key; the session has its own settings back afterwards.
        """
        conf = self.spark.conf
        most = max(int(conf.get("spark.sql.shuffle.partitions")), -(-self._state[1] // PARTITION_BYTES))
        wanted = {
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(most),
        }
        before = {key: conf.get(key, None) for key in wanted}
        try:
            for key, value in wanted.items():
                conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)

    def _prepared(
        self, name: str, sources: tuple[str, ...], build: Callable[..., DataFrame], by_period: bool = False
    ) -> DataFrame:
        root = shared_dir(self.spark)
        # one folder per application: a table another application is still writing is never read
        app = "".join(c if c.isalnum() else "_" for c in self.spark.sparkContext.applicationId)
        table = f"basketry_{name}_{app}_{self._state[0]}_{self._buckets}".lower()
        if not self.spark.catalog.tableExists(table):
            with self._small_partitions():
                # a task holds a bucket of all periods, so a period has one file per bucket
                rows = build(*[self.table(s) for s in sources]).repartition(self._buckets, "chid")
                writer = rows.write.mode("overwrite").bucketBy(self._buckets, "chid").sortBy("chid")
                if by_period:
                    writer = writer.partitionBy(PERIOD)
                writer.option("path", f"{root}/basketry/{app}/{table}").format("parquet").saveAsTable(table)
        out = self.spark.table(table)
        # a partition column is stored last
        return out.select("chid", PERIOD, *[c for c in out.columns if c not in ("chid", PERIOD)]) if by_period else out
