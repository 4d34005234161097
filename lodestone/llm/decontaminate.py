"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items are put into an automaton, which is broadcast: its
size is bound by ``block_words`` words, or one longer item. Every document's
words are streamed through it, and the longest match that ends at each word is
tracked; words of matches as long as a window are hit. Stretches of words whose
neighbours never stand together in the benchmark cannot hold a window and are
passed over.

A benchmark of more words is cut into blocks of items, each with an automaton
and a pass over the documents of its own, so that a worker holds one block and
the driver builds one at a time. What a pass finds is a row for each text with
hits, joined to the documents by the text's hash.

Defined results: a null or empty text has no words, is clean and stays as it
is; items without words have no windows; equal items are all named; an empty
benchmark leaves all documents as they are. A null item_id is no item.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrowtext import ALNUM, Words, pieces, text_buffers, words_of
from lodestone.llm.shared import unused, written
from lodestone.llm.suffix_automaton import ItemIndex

#: Fixed value of the query's contract.
WINDOW = 10


def item_indexes(benchmark: DataFrame, window: int, block_words: int) -> list[Broadcast]:
    """An index for each block of items of about ``block_words`` words (or of one longer item)."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    # a text of n bytes has at most n / 2 + 1 words
    words = rows.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    blocks = math.ceil(words / block_words)
    out = []
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else rows.collect()
        found = words_of(pa.array([r.text for r in part], pa.string()), ALNUM)
        flat = found.array().to_pylist()
        out.append(sc.broadcast(ItemIndex([(r.item, flat[i:j]) for r, i, j in zip(part, found.texts, found.texts[1:])], window)))
    return out


def scan(words: Words, index: ItemIndex, hit: np.ndarray, found: dict[int, set]) -> None:
    """Mark the hit words of a batch; gather the items found in each text."""
    codes = pc.index_in(words.array(), pa.array(index.words, words.array().type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    text_of = lambda at: int(np.searchsorted(words.texts, at, "right")) - 1
    if index.single:
        for at in np.flatnonzero(np.isin(codes, list(index.single))).tolist():
            hit[at] = True
            found.setdefault(text_of(at), set()).update(index.single[int(codes[at])])
    if len(codes) < 2 or not index.pairs:
        return
    pairs = np.asarray(index.pairs)
    together = codes[:-1] * index.automaton.symbols + codes[1:]
    at = np.minimum(np.searchsorted(pairs, together), len(pairs) - 1)
    linked = (codes[:-1] >= 0) & (codes[1:] >= 0) & (pairs[at] == together)
    edges = words.texts[1:-1]
    linked[edges[(edges > 0) & (edges < len(codes))] - 1] = False
    change = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
    begins, ends = change[::2], change[1::2] + 1
    for a, b in zip(begins.tolist(), ends.tolist()):
        if b - a >= max(2, index.shortest):
            items: set = set()
            index.stream(codes[a:b].tolist(), a, hit, items)
            if items:
                found.setdefault(text_of(a), set()).update(items)


def hits(texts: pa.Array, index: Broadcast | None) -> tuple[Words, np.ndarray, dict[int, set]]:
    words = words_of(texts, ALNUM)
    hit, found = np.zeros(len(words), bool), {}
    if index is not None:
        scan(words, index.value, hit, found)
    return words, hit, found


def per_text(words: Words, hit: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[words.texts[1:]] - total[words.texts[:-1]]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Begins and ends of the hit stretches."""
    change = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(change[::2].tolist(), change[1::2].tolist()))


def without_words(text: pa.Array, words: Words, hit: np.ndarray) -> str:
    """The only text of an array without the bytes from the first to the last word of each hit stretch."""
    raw = bytes(text_buffers(text)[1])
    left, at = [], 0
    for a, b in runs(hit):
        left.append(raw[at : words.starts[a]])
        at = int(words.ends[b - 1])
    return b"".join([*left, raw[at:]]).decode()


def without_hits(text: str, index: Broadcast | None) -> str:
    """The text without its hit spans; cut again as long as what is left makes a window."""
    while True:
        batch = pa.array([text], pa.string())
        words, hit, _ = hits(batch, index)
        if not hit.any():
            return text
        text = without_words(batch, words, hit)


REPORT = T.StructType([T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()))])
#: A hit text, by the MD5 of its bytes: the stretches of its words, and the items, that one block finds.
FOUND = "text_key string, spans array<struct<begin: int, end: int>>, items array<string>"


def text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def found_by_blocks(texts: DataFrame, indexes: list[Broadcast]) -> DataFrame:
    """FOUND for each distinct text of the only column that any block hits; one pass for each block.

    Copies of a text give equal rows, of which one stays before anything is shuffled.
    """

    def one_pass(index: Broadcast) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = pa.schema([("text_key", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
            for batch in pieces(batches, 0):
                words, hit, found = hits(batch.column(0), index)
                rows = []
                for i, items in found.items():
                    text = batch.column(0)[i].as_py().encode()
                    spans = [{"begin": a, "end": b} for a, b in runs(hit[words.texts[i] : words.texts[i + 1]])]
                    rows.append({"text_key": hashlib.md5(text, usedforsecurity=False).hexdigest(), "spans": spans, "items": sorted(items)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

        return texts.mapInArrow(find, FOUND).groupBy("text_key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))

    every = reduce(DataFrame.unionByName, map(one_pass, indexes))
    merged = every.groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 400_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    indexes = item_indexes(benchmark, window, block_words)
    plain = documents.select("doc_id", "text")
    if len(indexes) > 1:
        found = written(found_by_blocks(plain.select("text"), indexes), "contamination")
        n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
        each = plain.select("doc_id", n_words.cast("long").alias("n_words"), text_key(F.col("text")).alias("text_key")).join(found, "text_key", "left")
        places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["end"] - 1))))
        items = F.coalesce("items", F.array().cast("array<string>"))
        return each.select(
            "doc_id",
            "n_words",
            F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_hit"),
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
            F.col("spans").isNotNull().alias("contaminated"),
        )
    index = indexes[0] if indexes else None

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            words, hit, found = hits(batch.column(1), index)
            n_hit = per_text(words, hit)
            items = [sorted(found.get(i, ())) for i in range(batch.num_rows)]
            nothing = hashlib.sha256(b"").hexdigest()
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else nothing for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(words.texts)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(n_hit > 0)],
                ["doc_id", *REPORT.names],
            )

    return plain.mapInArrow(report, T.StructType([plain.schema[0], *REPORT.fields]))


def decontaminate_by_blocks(documents: DataFrame, indexes: list[Broadcast], max_coverage: float) -> DataFrame:
    """``decontaminate`` for a benchmark of several blocks: what was cut is searched again, until nothing is hit."""
    at, columns = documents.columns.index("text"), documents.columns
    key, spans, items, again = unused(documents, "text_key", "spans", "items", "again")
    schema = T.StructType([*documents.schema.fields, T.StructField(again, T.BooleanType())])
    rows, done, most = documents, [], max_coverage
    while True:
        found = found_by_blocks(rows.select("text"), indexes).toDF(key, spans, items).drop(items)
        joined = rows.withColumn(key, text_key(F.col("text"))).join(found, key, "left").select(*columns, spans)

        def cut(batches: Iterator[pa.RecordBatch], most=most) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, at):
                texts, kept, hit_rows = batch.column(at).to_pylist(), [], []
                for i, own in enumerate(batch.column(len(columns)).to_pylist()):
                    hit_rows.append(bool(own))
                    if not own:
                        kept.append(True)
                        continue
                    text = pa.array([texts[i]], pa.string())
                    words = words_of(text, ALNUM)
                    hit = np.zeros(len(words), bool)
                    for span in own:
                        hit[span["begin"] : span["end"]] = True
                    kept.append(bool(hit.sum() <= most * len(words)))
                    texts[i] = without_words(text, words, hit)
                out = [*batch.columns[: len(columns)], pa.array(hit_rows, pa.bool_())]
                if any(hit_rows):
                    out[at] = pa.array(texts, out[at].type)
                yield pa.RecordBatch.from_arrays(out, [*columns, again]).filter(pa.array(kept, pa.bool_()))

        step = written(joined.mapInArrow(cut, schema), "decontaminated")
        done.append(step.where(~F.col(again)).drop(again))
        rows, most = step.where(again).drop(again), 1.0
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.8, block_words: int = 400_000) -> DataFrame:
    """``documents`` with hit spans cut from ``text``; rows of which more than ``max_coverage`` of the words are hit go."""
    indexes = item_indexes(benchmark, window, block_words)
    if len(indexes) > 1:
        return decontaminate_by_blocks(documents, indexes, max_coverage)
    at = documents.columns.index("text")
    index = indexes[0] if indexes else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            words, hit, _ = hits(batch.column(at), index)
            n_hit, n_words = per_text(words, hit), np.diff(words.texts)
            columns = batch.columns
            if n_hit.any():
                texts = columns[at].to_pylist()
                for i in np.flatnonzero((n_hit > 0) & (n_hit <= max_coverage * n_words)).tolist():
                    texts[i] = without_hits(texts[i], index)
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(n_hit <= max_coverage * n_words))

    return documents.mapInArrow(cut, documents.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM dw, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)
), found AS (
  SELECT d.doc_id, d.k, d.i, t.item_id FROM doc_windows d JOIN item_windows t ON d.k = t.k AND d.g = t.g
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
