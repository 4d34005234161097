"""Sync as a stream: new files of a folder are parsed, chunked and upserted in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.ids import document_id
from lodestone.operators.chunk import ChunkSize, chunked
from lodestone.operators.parse import parsed
from lodestone.sources.files import below, media_type
from lodestone.sources.tables import Store, Table

CHUNKS = "document_id STRING, index INT, chunk_id STRING, text STRING, start INT, end INT, heading_path STRING, trust STRING, token_count INT"


def chunk_table(store: Store) -> Table:
    return Table(store, "chunks", CHUNKS, ["document_id"])


def quarantine_table(store: Store) -> Table:
    return Table(store, "quarantine", "document_id STRING, rule STRING, reason STRING", ["document_id"])


def upsert_chunks(table: Table, size: ChunkSize, root: str, source_id: str = "files", quarantine: Table | None = None) -> Callable[[DataFrame, int], None]:
    """A micro-batch replaces all chunks of its documents, and their quarantine, in one version; running it again gives the same tables.

    Documents have the ids that a batch run gives them: of their paths below the
    root. ``quarantine`` is a table of the same store. A writer that commits
    between the batch's read and its commit makes it fail with a ``Conflict``,
    and the stream repeats it when it starts again.
    """

    def batch(files: DataFrame, _: int) -> None:
        store, before = table.store, table.store.snapshot()
        docs = store.staged(files.select(document_id(F.lit(source_id), below(F.col("path"), root)).alias("document_id"), media_type(F.col("path")).alias("media_type"), "content"), "batch")
        good, bad = parsed(docs)
        changes = {table.name: table.merged(before, chunked(good, size))}
        if quarantine is not None:
            kept = quarantine.read(before).join(docs.select("document_id"), "document_id", "left_anti")
            changes[quarantine.name] = quarantine.replaced(kept.unionByName(bad.select("document_id", "rule", "reason")))
        store.publish(before, changes)
        store.clear_staging()

    return batch


def sync_stream(spark: SparkSession, folder: str, table: Table, checkpoint: str, size: ChunkSize = ChunkSize(), source_id: str = "files", quarantine: Table | None = None) -> StreamingQuery:
    """Everything that is new in ``folder`` (whose last part may be a pattern), then stop; the checkpoint remembers what was seen."""
    schema = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
    head, _, last = folder.rstrip("/").rpartition("/")
    root = head if any(c in last for c in "*?[{") else folder
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return files.writeStream.foreachBatch(upsert_chunks(table, size, root, source_id, quarantine)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
