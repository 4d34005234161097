"""Line dedup: levelled sorted runs of line hashes.

Documents come in batches. A batch is reduced to one row per line key (its
hash, in how many documents it is, the largest doc_id), merge-joined with the
runs written so far, and added as a sorted run of its own. A row that finds no
partner in the runs (the anti-join) is ``fresh``: it brings its key in. The
others only add to a key that an older run brought. When a level has ``fanout``
runs, they are merged into one run of the next level. Runs are bucketed and
sorted by the hash, so neither the merge-joins nor the compactions shuffle what
was written before.

Defined results: a null or empty text is one empty line; a key is a 128-bit
hash of the stripped, A-Z lower-cased line; rows are documents, so a repeated
row counts again, and every row with the largest doc_id keeps its lines; a null
doc_id is smaller than any other; ids may be of any type that has an order. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrowtext import pieces, text_buffers
from lodestone.llm.shared import unused, written

#: Fixed values of the query's contract.
MIN_CHARS = 40
MIN_DOCS = 5

STRIPPED = " \t\n\v\f\r"
KEY = ["h1", "h2"]


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts, and where each text's lines begin."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lines = pc.split_pattern(texts.fill_null(""), "\n")
    offsets = lines.offsets.to_numpy().astype(np.int64)
    return lines.flatten(), offsets - offsets[0]


def long_keys(lines: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lines have a key that is long enough, and those keys' hashes as an (n, 2) array."""
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=STRIPPED))
    which = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
    offsets, raw = text_buffers(keys.take(pa.array(which)))
    digest, at = xxhash.xxh3_128_digest, offsets.tolist()
    hashed = b"".join([digest(raw[a:b]) for a, b in zip(at, at[1:])])
    return which, np.frombuffer(hashed, ">i8").astype(np.int64).reshape(-1, 2)


def document_keys(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text) -> (doc_id, h1, h2): each long key of each row, once."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            lines, begins = split_lines(batch.column(1))
            which, hashes = long_keys(lines, min_chars)
            row = np.searchsorted(begins, which, "right") - 1
            order = np.lexsort((hashes[:, 1], hashes[:, 0], row))
            row, hashes = row[order], hashes[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]).any(axis=1)
            ids = batch.column(0).take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes[first, 0]), pa.array(hashes[first, 1])], ["doc_id", *KEY])

    schema = T.StructType([T.StructField("doc_id", df.schema[0].dataType), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
    return df.mapInArrow(keys, schema)


class LineRuns:
    """Sorted runs of line hashes, in levels. Each run is a bucketed table in the warehouse."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        # a union of bucketed tables is planned as if it kept their buckets, which it may not: rows of one key were left apart
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.count = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, df: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def add(self, documents: DataFrame, min_chars: int = MIN_CHARS) -> None:
        """Reduce a batch (doc_id, text), merge-join it with the runs, write it as a run."""
        batch = document_keys(documents, min_chars).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            brought = run.where("fresh").select(*KEY, F.lit(True).alias(f"in_{i}"))
            batch = batch.join(brought.hint("merge"), KEY, "left")
            known = known | F.col(f"in_{i}").isNotNull()
        self._write(batch.select(*KEY, "n_docs", "last_doc", (~known).alias("fresh")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """Merge all runs of a level into one run of the next."""
        old, self.levels[level] = self.levels[level], []
        self._write(self._merged([self.spark.table(t) for t in old]), level + 1)
        for t in old:
            self.spark.sql(f"DROP TABLE {t}")

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.bool_or("fresh").alias("fresh"))

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(h1, h2, last_doc) of every key in at least ``min_docs`` documents.

        Only the rows of keys that came again are shuffled; each key's fresh row
        is met where it lies.
        """
        runs = self.runs()
        again = self._merged([r.where(~F.col("fresh")) for r in runs]).select(*KEY, F.col("n_docs").alias("more"), F.col("last_doc").alias("later"))
        found = None
        for run in runs:
            fresh = run.where("fresh")
            part = (
                (fresh.join(again.hint("merge"), KEY, "left") if len(runs) > 1 else fresh.withColumns({"more": F.lit(0), "later": F.lit(None)}))
                .where(F.col("n_docs") + F.coalesce("more", F.lit(0)) >= min_docs)
                .select(*KEY, F.greatest("last_doc", "later").alias("last_doc"))
            )
            found = part if found is None else found.unionByName(part)
        return found

    def drop(self) -> None:
        for level in self.levels:
            for t in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.levels = []


def arrival_batches(documents: DataFrame, n: int) -> list[DataFrame]:
    """``n`` batches: of integer ids by equal ranges, which reach the scan as filters, of others by their hash. Nulls are in the first."""
    at = F.col("doc_id")
    if n <= 1:
        return [documents]
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        slot = F.when(at.isNull(), 0).otherwise(F.pmod(F.xxhash64(at), F.lit(n)))
        return [documents.where(slot == k) for k in range(n)]
    low, high = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or high - low < n:
        return [documents]
    edges = [low + (high - low + 1) * i // n for i in range(1, n)]
    return (
        [documents.where(at.isNull() | (at < edges[0]))]
        + [documents.where((at >= a) & (at < b)) for a, b in zip(edges, edges[1:])]
        + [documents.where(at >= edges[-1])]
    )


def dropped_keys(documents: DataFrame, frequent: DataFrame, min_chars: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, keys): the keys that documents lose. ``frequent`` is broadcast only up to ``broadcast_rows`` rows."""
    small = frequent.limit(broadcast_rows + 1).count() <= broadcast_rows
    side = F.broadcast(frequent) if small else frequent
    lost = document_keys(documents, min_chars).join(side, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys"))


def dedup_lines(
    documents: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = 4,
    fanout: int = 3,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """All columns of ``documents`` with ``text`` as it is after the drop, and n_lines, n_dropped.

    Where ``documents`` has columns of these names, the new ones get underscores
    in front.
    """
    spark = documents.sparkSession
    plain = documents.select("doc_id", "text")
    runs = LineRuns(spark, fanout)
    for batch in arrival_batches(plain, batches):
        runs.add(batch, min_chars)
    frequent = written(runs.frequent(min_docs), "frequent_lines")
    runs.drop()
    lost = dropped_keys(plain, frequent, min_chars, broadcast_rows)
    keys, n_lines, n_dropped, lost_id = unused(documents, "line_keys", "n_lines", "n_dropped", "lost_doc_id")
    lost = lost.select(F.col("doc_id").alias(lost_id), F.col("keys").alias(keys))
    rows = documents.join(lost, F.col("doc_id").eqNullSafe(F.col(lost_id)), "left").drop(lost_id)
    at_text, at_keys = rows.columns.index("text"), rows.columns.index(keys)

    def drop(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts, at_text):
            texts, sets = part.column(at_text), part.column(at_keys)
            totals = np.empty(len(texts), np.int64)
            lines, begins = split_lines(texts)
            totals[:] = np.diff(begins)
            gone = np.zeros(len(texts), np.int64)
            kept: list[str | None] | None = None
            hit = np.flatnonzero(sets.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                kept = texts.to_pylist()
                for i in hit.tolist():
                    own = lines[begins[i] : begins[i + 1]]
                    which, hashes = long_keys(own, min_chars)
                    flat = sets[i].values
                    bad = set(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist()))
                    out = {k for k, h in zip(which.tolist(), hashes.tolist()) if tuple(h) in bad}
                    gone[i] = len(out)
                    kept[i] = "\n".join(x for k, x in enumerate(own.to_pylist()) if k not in out)
            columns = [c if k != at_text or kept is None else pa.array(kept, texts.type) for k, c in enumerate(part.columns) if k != at_keys]
            names = [x for k, x in enumerate(part.schema.names) if k != at_keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals), pa.array(gone)], [*names, n_lines, n_dropped])

    schema = T.StructType([*documents.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    return rows.mapInArrow(drop, schema)


def digest_text(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the SHA-256 of a text column (null: of nothing) in place of it."""
    return df.withColumn(name, F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)).drop(column)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest_text(dedup_lines(documents), "text", "kept_sha256").select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT d.doc_id, d.pos, d.line, c.k IS NOT NULL AND d.doc_id <> c.last_doc AS gone
  FROM keyed d LEFT JOIN common c ON d.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
