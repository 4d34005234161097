"""Incremental sync: what is new, changed, unchanged or gone, as joins of a listing with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(listing: DataFrame, manifest: DataFrame, model_changed: bool = False) -> DataFrame:
    """(document_id, status, reason, size_bytes): added, changed, unchanged or deleted.

    ``listing``: document_id, revision, size_bytes. ``manifest``: document_id,
    revision, status (``deleted`` is a tombstone). Another embedding model makes
    every unchanged document changed.
    """
    new = listing.select("document_id", F.col("revision").alias("now"), "size_bytes")
    old = manifest.select("document_id", F.col("revision").alias("was"), F.col("status").alias("old_status"))
    both = new.join(old, "document_id", "full_outer")
    listed, known = F.col("now").isNotNull(), F.col("old_status").isNotNull() & (F.col("old_status") != "deleted")
    status = (
        F.when(listed & ~known, "added")
        .when(listed & (F.col("now") != F.coalesce("was", F.lit(""))), "changed")
        .when(listed, "changed" if model_changed else "unchanged")
        .when(known, "deleted")
    )
    same = listed & known & (F.col("now") == F.coalesce("was", F.lit("")))
    reason = F.when(same & F.lit(model_changed), "embedding model changed").when(status == "changed", "revision differs")
    return both.select("document_id", status.alias("status"), reason.alias("reason"), "size_bytes").where(F.col("status").isNotNull())


def plan(changes: DataFrame, price_per_million: float | None) -> DataFrame:
    """Counts by status, an upper bound of the tokens to embed, and their cost (null without a price)."""
    work = F.col("status").isin("added", "changed")
    tokens = F.coalesce(F.sum(F.when(work, F.ceil(F.coalesce("size_bytes", F.lit(0)) / 4))), F.lit(0)).cast("bigint")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "unchanged", "deleted")]
    price = F.lit(price_per_million).cast("double")
    return changes.agg(*counts, tokens.alias("tokens")).withColumn("cost_usd", F.col("tokens") / 1e6 * price)


def revision_only(fetched: DataFrame, manifest: DataFrame, forced: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents whose content is as indexed and only need the new revision, documents to index)."""
    if forced:
        return fetched.limit(0), fetched
    same = manifest.where("status = 'indexed'").select("document_id", "content_hash")
    keys = ["document_id", "content_hash"]
    return fetched.join(same, keys, "left_semi"), fetched.join(same, keys, "left_anti")


def to_embed(chunks: DataFrame, known: DataFrame, model: str) -> DataFrame:
    """Chunks that aren't in the manifest with this model."""
    done = known.where(F.col("embedded_with") == model).select("document_id", "chunk_id")
    return chunks.join(done, ["document_id", "chunk_id"], "left_anti")


def reused(chunks: DataFrame, known: DataFrame, model: str) -> DataFrame:
    done = known.where(F.col("embedded_with") == model).select("document_id", "chunk_id")
    return chunks.join(done, ["document_id", "chunk_id"], "left_semi")


def stale(known: DataFrame, kept: DataFrame) -> DataFrame:
    """Chunks of the manifest, for documents that were chunked now, that no longer exist."""
    keys = ["document_id", "chunk_id"]
    return known.join(kept.select("document_id").distinct(), "document_id", "left_semi").join(kept.select(*keys), keys, "left_anti")


def tombstoned(manifest: DataFrame, gone: DataFrame) -> DataFrame:
    """The manifest after deletions: rows stay with status ``deleted`` and no chunks."""
    marked = manifest.join(gone.select("document_id", F.lit(True).alias("_gone")), "document_id", "left")
    lost = F.coalesce("_gone", F.lit(False))
    out = marked.withColumn("status", F.when(lost, "deleted").otherwise(F.col("status")))
    if "chunk_count" in manifest.columns:
        out = out.withColumn("chunk_count", F.when(lost, 0).otherwise(F.col("chunk_count")).cast(manifest.schema["chunk_count"].dataType))
    return out.select(*manifest.columns)


def recorded(manifest_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk manifest with the chunk rows of the documents in ``chunks`` replaced."""
    return manifest_chunks.join(chunks.select("document_id").distinct(), "document_id", "left_anti").unionByName(chunks)


def without(index: DataFrame, ids: list[str] | None = None, condition: Column | None = None, namespace: str | None = None) -> DataFrame:
    """The index without records by id or filter, in all namespaces or one."""
    if not ids and condition is None:
        raise ValueError("a deletion needs ids or a filter")
    hit = F.lit(False)
    if ids:
        hit = hit | F.col("id").isin(*ids)
    if condition is not None:
        hit = hit | F.coalesce(condition, F.lit(False))
    if namespace is not None:
        hit = hit & F.col("namespace").eqNullSafe(F.lit(namespace))
    return index.where(~hit)


def same_width(vectors: DataFrame, dimensions: int, column: str = "vector") -> DataFrame:
    """``vectors``; a vector of another width is an error when it is read."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions, got "), F.size(column).cast("string")))
    return vectors.withColumn(column, F.when(F.size(column) == dimensions, F.col(column)).otherwise(wrong))


def report(outcomes: DataFrame) -> DataFrame:
    """One row for a run: sums over its documents; the cost is unknown if that of any document is; partial if any was quarantined."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks_embedded", "chunks_reused", "chunks_deleted", "tokens")]
    status = F.when(F.count_if(F.col("status") == "quarantined") > 0, "partial").otherwise("complete")
    cost = F.when(F.count(F.lit(1)) == F.count("cost_usd"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)))
    return outcomes.agg(F.count(F.lit(1)).alias("documents"), *sums, cost.alias("cost_usd"), status.alias("status"))


def last_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each source."""
    return runs.groupBy("source_id").agg(F.max_by("run_id", "started_at").alias("run_id"), F.max("started_at").alias("started_at"))
