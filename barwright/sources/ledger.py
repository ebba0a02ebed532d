"""Parquet tables that micro-batches may be written to twice: data first, then one pointer.

A table is a folder of data folders and numbered manifests. A manifest names the data folders in force, by key
bucket where rows are merged by key, and the last batch of each stream that they hold. A write puts its
rows into a folder of its own and then creates the next manifest, in one step; readers take the highest one. So a
write that dies before that leaves nothing, and a batch that comes again is known by its number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.sources.readers import latest_by_key


class Conflict(RuntimeError):
    """Another writer has committed meanwhile; the write may be tried again."""


@dataclass
class Manifest:
    """``parts``: data folders by bucket (all in "0" for appended tables); ``schema``: DDL of the rows; ``batches``: last one of each stream."""

    version: int = 0
    schema: str = ""
    buckets: int = 1
    parts: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Ledger:
    """A table at ``path``, a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # store ------------------------------------------------------------------------------------------

    def _store(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest:
        """The one in force; an empty one for a table that is not there yet."""
        where, store = self._store(f"{self.path}/_manifests")
        if not store.exists(where):
            return Manifest()
        names = sorted(f.getPath().getName() for f in store.listStatus(where) if f.getPath().getName().endswith(".json"))
        if not names:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/_manifests/{names[-1]}", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _commit(self, made: Manifest) -> None:
        """Creates the manifest under its number: its text goes to a name of its own and is renamed, so that nobody reads half of it."""
        name = f"{self.path}/_manifests/{made.version:012d}.json"
        draft, store = self._store(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = store.create(draft)
        out.write(bytearray(json.dumps(asdict(made)).encode()))
        out.close()
        final, _ = self._store(name)
        if store.exists(final) or not store.rename(draft, final):
            store.delete(draft, False)
            raise Conflict(f"version {made.version} of {self.path} exists already")

    # rows -------------------------------------------------------------------------------------------

    def read(self) -> DataFrame | None:
        """The rows in force; None for a table that is not there yet."""
        return self._rows(self.manifest())

    def _rows(self, manifest: Manifest, buckets: list[str] | None = None) -> DataFrame | None:
        folders = sorted({p for b, own in manifest.parts.items() if buckets is None or b in buckets for p in own})
        if not manifest.schema:
            return None
        if not folders:
            return self.spark.createDataFrame([], manifest.schema)
        return self.spark.read.schema(manifest.schema).parquet(*(f"{self.path}/{p}" for p in folders))

    def _known(self, manifest: Manifest, stream: str | None, batch: int | None) -> bool:
        return stream is not None and manifest.batches.get(stream, -1) >= batch

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Adds rows, once for each batch of a stream; whether it did."""
        now = self.manifest()
        if self._known(now, stream, batch):
            return False
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._commit(Manifest(now.version + 1, now.schema or rows.schema.toDDL(), 1, {"0": [*now.parts.get("0", []), folder]}, now.batches | ({stream: batch} if stream is not None else {})))
        return True

    def upsert(self, rows: DataFrame, key: list[str], order: str, stream: str | None = None, batch: int | None = None, buckets: int = 16) -> bool:
        """Keeps the row of greatest ``order`` per key, merging only buckets that get rows; ``buckets`` counts for a new table alone."""
        now = self.manifest()
        if self._known(now, stream, batch):
            return False
        count = now.buckets if now.version else buckets
        fresh = latest_by_key(rows, key, order)
        at = F.pmod(F.xxhash64(*key), F.lit(count)).cast("string").alias("b")
        touched = [r.b for r in fresh.select(at).distinct().collect()]  # ``count`` rows at most
        old = self._rows(now, touched) if now.version else None
        if old is not None:
            fresh = latest_by_key(fresh.unionByName(old.select(*fresh.columns)), key, order)
        self._replace(now, fresh, key, count, touched, now.batches | ({stream: batch} if stream is not None else {}))
        return True

    def split(self, key: list[str], factor: int = 2) -> None:
        """Deals a keyed table's rows to ``factor`` times as many buckets."""
        now = self.manifest()
        count = now.buckets * factor
        self._replace(now, self._rows(now), key, count, [*map(str, range(count))], now.batches)

    def _replace(self, now: Manifest, rows: DataFrame, key: list[str], count: int, touched: list[str], batches: dict[str, int]) -> None:
        folder = f"data-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(count)))
        dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        parts = {} if count != now.buckets else {b: p for b, p in now.parts.items() if b not in touched}
        where, store = self._store(f"{self.path}/{folder}")
        there = {f.getPath().getName() for f in store.listStatus(where)}
        parts |= {b: [f"{folder}/_bucket={b}"] for b in touched if f"_bucket={b}" in there}
        self._commit(Manifest(now.version + 1, now.schema or rows.schema.toDDL(), count, parts, batches))

    def sink(self, stream: str, key: list[str] | None = None, order: str | None = None):
        """A function for ``foreachBatch``: appends, or merges by ``key``; a batch that comes again changes nothing."""

        def write(batch: DataFrame, number: int) -> None:
            if key:
                self.upsert(batch, key, order, stream, number)
            else:
                self.append(batch, stream, number)

        return write
