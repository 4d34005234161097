"""One sync run: list, diff, fetch, parse, chunk, validate, embed what is new, and commit.

A run reads one snapshot of its workspace and commits all tables in one version,
so one that fails changes nothing, and one that meets another's commit ends with
a ``Conflict``. Index, chunks and manifest are merged bucket by bucket: a run
that changes few documents rewrites few folders.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import filters, ids, vectors
from lodestone.operators import chunk, parse, sync, validate
from lodestone.sources import files
from lodestone.sources.tables import Snapshot, Store, Table


INDEX = "namespace STRING, id STRING, vector ARRAY<DOUBLE>, metadata VARIANT, document_id STRING, chunk_index INT, heading_path STRING, text STRING"


class Workspace:
    """The tables of an index and its manifest: one store, so that a run commits all of them at once or none.

    ``declared``: metadata fields and their types (string or double) that the index keeps as
    columns too, so that filters on them reach the scan.
    """

    def __init__(self, spark: SparkSession, path: str, declared: dict[str, str] | None = None):
        self.spark, self.store, self.declared = spark, Store(spark, path), declared or {}
        table = lambda name, schema, keys, **more: Table(self.store, name, schema, keys, **more)
        self.documents = table("documents", "source_id STRING, document_id STRING, source_uri STRING, revision STRING, content_hash STRING, chunk_count INT, status STRING", ["document_id"])
        self.chunks = table("chunks", "document_id STRING, chunk_id STRING, text_hash STRING, embedded_with STRING", ["document_id"])
        shadows = "".join(f", `{filters.shadow(f)}` {t}" for f, t in self.declared.items())
        self.index = table("index", INDEX + shadows, ["namespace", "id"], unique=True, by=("namespace",))
        self.quarantine = table("quarantine", "document_id STRING, rule STRING, reason STRING, excerpt STRING", ["document_id"])
        self.runs = table("runs", "run_id STRING, source_id STRING, started_at TIMESTAMP, status STRING, report STRING", ["run_id"], buckets=1)
        self.meta = table("meta", "index_name STRING, epoch INT, dimensions INT, embed_model STRING", ["index_name"], buckets=1)

    def records(self, rows: DataFrame) -> DataFrame:
        """Rows of the index: those of ``rows`` with the columns of declared fields."""
        return rows.withColumns({filters.shadow(f): filters.shadowed(F.col("metadata"), f, t) for f, t in self.declared.items()})

    def describe(self, at: Snapshot | None = None) -> Row:
        """Epoch, model, dimensions and number of records."""
        at = at or self.store.snapshot()
        meta = self.meta.read(at).first()
        return Row(epoch=meta.epoch if meta else 0, embed_model=meta.embed_model if meta else None, dimensions=meta.dimensions if meta else None, records=self.index.read(at).count())


@dataclass(frozen=True)
class Settings:
    source_id: str = "files"
    patterns: tuple[str, ...] = ("**/*.md", "**/*.txt")
    exclude: tuple[str, ...] = ()
    size: chunk.ChunkSize = chunk.ChunkSize()
    limits: validate.Limits = validate.Limits()
    model: str = "lexical/64"
    dimensions: int = 64
    price_per_million: float | None = 0.0
    forced: bool = False
    fail_fast: bool = False
    namespace: str | None = None


class Quarantined(ValueError):
    """A document was put into quarantine in a run that was to stop at the first."""


def listed(spark: SparkSession, root: str, s: Settings) -> DataFrame:
    entries = files.listing(spark, root, s.patterns, s.exclude, s.source_id)
    return entries.withColumn("document_id", ids.document_id(F.col("source_id"), F.col("id")))


def model_changed(ws: Workspace, s: Settings, at: Snapshot) -> bool:
    """Whether the index was embedded with another model; other dimensions with the same model are an error."""
    meta = ws.meta.read(at).first()
    if meta and meta.embed_model == s.model and meta.dimensions != s.dimensions:
        raise ValueError(f"the index has {meta.dimensions} dimensions, the model gives {s.dimensions}")
    return bool(meta) and meta.embed_model != s.model


def changes(ws: Workspace, root: str, s: Settings, at: Snapshot) -> tuple[DataFrame, DataFrame]:
    listing = listed(ws.spark, root, s)
    manifest = ws.documents.read(at).where(F.col("source_id") == s.source_id)
    # what was quarantined is tried again
    manifest = manifest.withColumn("revision", F.when(F.col("status") != "quarantined", F.col("revision")))
    return listing, sync.diff(listing, manifest, model_changed(ws, s, at) or s.forced)


def plan(ws: Workspace, root: str, s: Settings = Settings()) -> Row:
    """What a run would do, without doing it."""
    return sync.plan(changes(ws, root, s, ws.store.snapshot())[1], s.price_per_million).first()


def run(ws: Workspace, root: str, s: Settings = Settings()) -> Row:
    """Bring the index up to date with a folder; the counters of the run."""
    at, staged = ws.store.snapshot(), ws.store.staged
    try:
        report, tables = _changed(ws, at, root, s, staged)
        ws.store.publish(at, tables)
    finally:
        ws.store.clear_staging()
    return report


def _changed(ws: Workspace, at: Snapshot, root: str, s: Settings, staged) -> tuple[Row, dict[str, dict[str, str]]]:
    """The report of a run that begins at a snapshot, and the folders of its tables."""
    old_docs, old_chunks, old_index = ws.documents.read(at), ws.chunks.read(at), ws.index.read(at)
    all_again = model_changed(ws, s, at) or s.forced
    listing, status = changes(ws, root, s, at)
    listing, status = staged(listing, "listing"), staged(status, "status")
    work = status.where(F.col("status").isin("added", "changed")).select("document_id")
    fetched = files.fetched(ws.spark, root, listing.join(work, "document_id", "left_semi"))
    lost = fetched.where("content IS NULL").select("document_id", F.lit("fetch").alias("rule"), F.lit("the file could not be read").alias("reason"), F.lit(None).cast("string").alias("excerpt"))
    fetched = fetched.where("content IS NOT NULL").withColumn("content_hash", ids.content_hash(F.col("content")))
    same, fresh = sync.revision_only(fetched, old_docs, all_again)

    good, unread = parse.parsed(fresh)
    checked = staged(validate.validated(chunk.chunked(good, s.size), s.limits), "chunks")
    good = good.drop("content", "text", "blocks")
    unfit = checked.where("rule = 'too_long'").groupBy("document_id").agg(F.first("rule").alias("rule"), F.first("excerpt").alias("excerpt"))
    bad = lost.unionByName(unread.select("document_id", "rule", "reason", F.lit(None).cast("string").alias("excerpt"))).unionByName(unfit.select("document_id", "rule", F.lit("a chunk is too long").alias("reason"), "excerpt"))
    bad = staged(bad, "quarantine")
    if s.fail_fast and (first := bad.first()):
        raise Quarantined(f"{first.document_id}: {first.reason}")
    kept = validate.accepted(checked)
    done = staged(good.join(bad, "document_id", "left_anti"), "done")

    new = staged(sync.to_embed(kept, old_chunks, s.model), "new")
    metadata = F.parse_json(F.to_json(F.struct(F.lit(s.source_id).alias("source_id"), "document_id", "heading_path", F.col("index").alias("chunk_index"))))
    records = vectors.embedded(new, "text", "vector", s.dimensions, "document").select(F.lit(s.namespace).cast("string").alias("namespace"), F.col("chunk_id").alias("id"), "vector", metadata.alias("metadata"), "document_id", F.col("index").alias("chunk_index"), "heading_path", "text")
    records = ws.records(sync.same_width(records, s.dimensions))
    gone = status.where("status = 'deleted'").select("document_id")
    known = old_chunks.join(done, "document_id", "left_semi")
    stale = known.join(kept, ["document_id", "chunk_id"], "left_anti").select("document_id", F.col("chunk_id").alias("id"))
    ended = old_index.join(gone, "document_id", "left_semi").select("namespace", "id").unionByName(old_index.join(stale, ["document_id", "id"], "left_semi").select("namespace", "id"))
    before = old_index.count()
    index = ws.index.changed(at, staged(records, "records"), staged(ended, "ended"))

    counts = kept.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    row = lambda df, state: df.select("source_id", "document_id", F.col("uri").alias("source_uri"), "revision", "content_hash", "chunk_count", F.lit(state).alias("status"))
    indexed = row(done.join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))), "indexed")
    renewed = row(same.join(old_docs.select("document_id", "chunk_count"), "document_id"), "indexed")
    held = row(listing.join(bad.select("document_id").distinct(), "document_id", "left_semi").join(old_docs.select("document_id", "content_hash", "chunk_count"), "document_id", "left"), "quarantined")
    deleted = sync.tombstoned(old_docs.join(gone, "document_id", "left_semi"), gone)
    docs = indexed.unionByName(renewed).unionByName(held).unionByName(deleted)
    new_chunks = kept.select("document_id", "chunk_id", "text_hash", F.lit(s.model).alias("embedded_with"))
    replaced = done.select("document_id").unionByName(gone)

    by_status = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
    embedded = new.count()
    meta = ws.meta.read(at).first()
    epoch = (meta.epoch if meta else 0) + 1
    after, quarantined = ws.index.read(Snapshot(0, {"index": index})).count(), bad.select("document_id").distinct().count()
    report = Row(
        **{k: by_status.get(k, 0) for k in ("added", "changed", "unchanged", "deleted")},
        revision_only=same.count(), quarantined=quarantined, chunks_embedded=embedded, chunks_reused=kept.count() - embedded, records_before=before, records=after, epoch=epoch,
        status="partial" if quarantined else "complete",
    )
    note = ws.spark.range(1).select(F.lit(uuid.uuid4().hex).alias("run_id"), F.lit(s.source_id).alias("source_id"), F.current_timestamp().alias("started_at"), F.lit(report.status).alias("status"), F.lit(str(report.asDict())).alias("report"))
    new_meta = ws.spark.createDataFrame([("main", epoch, s.dimensions, s.model)], ws.meta.schema)
    return report, {
        "index": index,
        "documents": ws.documents.changed(at, docs, docs.limit(0)),
        "chunks": ws.chunks.changed(at, new_chunks, replaced),
        "quarantine": ws.quarantine.replaced(bad),
        "meta": ws.meta.replaced(new_meta),
        "runs": ws.runs.merged(at, note),
    }
