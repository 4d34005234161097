"""Versioned Parquet tables: a change writes the buckets it touches, and one pointer file names all that belongs to a version.

A store is a folder of tables. The rows of a table are dealt into buckets by a
hash of their keys, and by the values of the columns it is partitioned by; a
bucket is a folder. A version's pointer file lists the folders of every table.
It is written aside and renamed to its number, which fails if there is one
already. So readers see one version of all tables, a writer that dies leaves
nothing that is read, and of two writers that began from the same version one
gets a ``Conflict``; its rows are in no version. What a version was made from is
said with each change: the snapshot that was read.

The rename is atomic where the file system's is (HDFS, a local disk); stores of
objects need one that has conditional puts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


@dataclass(frozen=True)
class Snapshot:
    """A version: for each table its buckets and their folders."""

    version: int = 0
    folders: dict[str, dict[str, str]] = field(default_factory=dict)

    def of(self, table: str) -> dict[str, str]:
        return self.folders.get(table, {})


class Store:
    """The versions of the tables below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.own = spark, path.rstrip("/"), uuid.uuid4().hex

    def _hadoop(self, *names: str):
        """A path below the store and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def snapshot(self) -> Snapshot:
        folder, fs = self._hadoop("_versions")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        for version in sorted((int(n) for n in names if n.isdigit()), reverse=True):
            path, _ = self._hadoop("_versions", f"{version:012d}")
            stream = fs.open(path)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text:  # a file that another tool left empty names no version
                return Snapshot(version, json.loads(text))
        return Snapshot()

    def publish(self, after: Snapshot, changes: dict[str, dict[str, str]]) -> Snapshot:
        """The version that follows ``after``, with the folders of the changed tables."""
        new = Snapshot(after.version + 1, after.folders | changes)
        aside, fs = self._hadoop("_versions", f".{uuid.uuid4().hex}")
        there, _ = self._hadoop("_versions", f"{new.version:012d}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(new.folders, sort_keys=True).encode()))
        finally:
            stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, there, plain)
        except Exception as error:
            fs.delete(aside, False)
            if fs.exists(there):
                raise Conflict(f"version {new.version} of {self.path} is there already") from error
            raise
        return new

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, computed once: what several tables of a run are made from."""
        path = f"{self.path}/_staging/{self.own}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_staging(self) -> None:
        """What this store has staged; another writer's stays."""
        path, fs = self._hadoop("_staging", self.own)
        fs.delete(path, True)


def partition_name(value: Column) -> Column:
    """A folder name for a string; null and the empty string have different ones."""
    return F.when(value.isNull(), "none").otherwise(F.substring(F.sha2(value.cast("binary"), 256), 1, 32))


def partition_of(value: str | None) -> str:
    return "none" if value is None else hashlib.sha256(value.encode()).hexdigest()[:32]


class Table:
    """One table of a store.

    ``unique``: the keys name one row, so of equal keys in an upsert the last
    wins; otherwise they name a group of rows that is replaced. ``by``: string
    columns, among the keys, whose values have folders of their own.
    """

    def __init__(self, store: Store, name: str, schema: str, keys: list[str], unique: bool = False, buckets: int = BUCKETS, by: tuple[str, ...] = ()):
        self.store, self.name, self.schema, self.keys, self.unique, self.buckets, self.by = store, name, schema, keys, unique, buckets, by
        self.spark = store.spark
        self.empty = self.spark.createDataFrame([], schema)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have the keys, with the names of folders and the bucket of each."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        named = {f"_by{n}": partition_name(F.col(c)) for n, c in enumerate(self.by)}
        return rows.withColumns(named | {"_bucket": bucket})

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return self._keyed(rows.select(*self.empty.columns))

    def _at(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.empty.schema).parquet(*[f"{self.store.path}/{self.name}/{f}" for f in folders]) if folders else self.empty

    def _write(self, dealt: DataFrame) -> dict[str, str]:
        """Rows as one folder for each bucket; which buckets there are."""
        top = f"v-{uuid.uuid4().hex}"
        parts = [f"_by{n}" for n in range(len(self.by))] + ["_bucket"]
        # one task for a bucket, unless its rows are many
        dealt.hint("rebalance", *map(F.col, parts)).write.partitionBy(*parts).parquet(f"{self.store.path}/{self.name}/{top}")
        found = [top]
        for part in parts:
            deeper = []
            for f in found:
                path, fs = self.store._hadoop(self.name, f)
                deeper += [f"{f}/{x.getPath().getName()}" for x in fs.listStatus(path) if x.getPath().getName().startswith(f"{part}=")]
            found = deeper
        return {f.split("/", 1)[1]: f for f in found}

    def read(self, snapshot: Snapshot | None = None, **by) -> DataFrame:
        """All rows of a snapshot (the current one). ``by``: only the folders that can hold these values of partitioning columns."""
        folders = (snapshot or self.store.snapshot()).of(self.name)
        names = {f"_by{self.by.index(c)}={partition_of(value)}" for c, value in by.items()}
        rows = self._at([f for bucket, f in folders.items() if names <= set(bucket.split("/"))])
        for c, value in by.items():
            rows = rows.where(F.col(c).eqNullSafe(F.lit(value)))
        return rows

    # changes: each gives the table's folders in the next version, for Store.publish

    def replaced(self, rows: DataFrame) -> dict[str, str]:
        """All rows anew."""
        return self._write(self._dealt(rows))

    def merged(self, after: Snapshot, rows: DataFrame, order: Column | None = None) -> dict[str, str]:
        """``rows`` in place of those with the same keys; only the buckets of these keys are read and written."""
        return self.changed(after, rows, self.empty, order)

    def changed(self, after: Snapshot, rows: DataFrame, gone: DataFrame, order: Column | None = None) -> dict[str, str]:
        """``rows`` in place of those with the same keys, and none with the keys of ``gone``, unless ``rows`` has them."""
        if self.unique or order is not None:
            rows = last_of(rows, self.keys, order)
        new, old = self._write(self._dealt(rows)), after.of(self.name)
        parts = [f"_by{n}" for n in range(len(self.by))] + ["_bucket"]
        keys = gone.select(*self.keys).distinct()
        emptied = {"/".join(f"{c}={r[c]}" for c in parts) for r in self._keyed(keys).select(*parts).distinct().collect()}  # as many as buckets
        if not (met := [b for b in old if b in new or b in emptied]):
            return old | new
        there = self._at([old[b] for b in met])
        added = self._at([new[b] for b in met if b in new])
        dropped = added.select(*self.keys).unionByName(keys)
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in self.keys]
        kept = there.alias("a").join(dropped.alias("b"), same, "left_anti")
        return {b: f for b, f in old.items() if b not in met} | new | self._write(self._dealt(kept.unionByName(added)))

    def without(self, after: Snapshot, condition: Column) -> dict[str, str]:
        """No rows for which ``condition`` holds; only the buckets that have any are written."""
        old = after.of(self.name)
        rows = self._dealt(self._at(list(old.values())))
        parts = [c for c in rows.columns if c.startswith("_by")] + ["_bucket"]
        hit = F.coalesce(condition, F.lit(False))
        met = {"/".join(f"{c}={r[c]}" for c in parts) for r in rows.where(hit).select(*parts).distinct().collect()}  # as many as buckets
        if not met:
            return old
        kept = self._write(self._dealt(self._at([old[b] for b in met]).where(~hit)))
        return {b: f for b, f in old.items() if b not in met} | kept

    def commit(self, rows: DataFrame, after: Snapshot) -> Snapshot:
        return self.store.publish(after, {self.name: self.replaced(rows)})

    def upsert(self, rows: DataFrame, order: Column | None = None, after: Snapshot | None = None) -> Snapshot:
        after = after or self.store.snapshot()
        return self.store.publish(after, {self.name: self.merged(after, rows, order)})

    def delete(self, condition: Column, after: Snapshot | None = None) -> Snapshot:
        after = after or self.store.snapshot()
        return self.store.publish(after, {self.name: self.without(after, condition)})


def last_of(rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Of rows with equal keys the last, by ``order`` or else as they come."""
    placed = rows.withColumn("_order", F.monotonically_increasing_id() if order is None else order)
    last = Window.partitionBy(*keys).orderBy(F.desc("_order"))
    return placed.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place", "_order")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; of equal keys in ``new``, the last by ``order`` if that is given."""
    if order is not None:
        new = last_of(new, keys, order)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def cached(keys: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits with their values, misses): an entry that has expired is a miss."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("key", "value")
    return keys.join(live, "key"), keys.join(live, "key", "left_anti")


def evicted(cache: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries used last (of equal times, the smaller keys)."""
    return cache.orderBy(F.desc("used_at"), "key").limit(most)


def without_prefix(cache: DataFrame, prefix: str) -> DataFrame:
    return cache.where(~F.col("key").startswith(prefix))


def replayed(requests: DataFrame, cassette: DataFrame) -> DataFrame:
    """Recorded responses for each request key; a key that was never recorded is an error."""
    missing = F.raise_error(F.concat(F.lit("no recording for "), F.col("key")))
    return requests.join(cassette.select("key", F.col("response").alias("_r"), F.lit(True).alias("_there")), "key", "left").withColumn("response", F.when(F.col("_there"), F.col("_r")).otherwise(missing)).drop("_r", "_there")


