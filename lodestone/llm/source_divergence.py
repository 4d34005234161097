"""Source divergence audit: how each source's words differ from those of the others of its language.

Texts become counts of (lang, source, term) inside the tasks that read them, so
what is shuffled are counts. The kept terms of a language are cut into blocks,
and its sources into blocks too; a tile is one block of terms with two blocks of
sources: a dense int64 matrix of sources by terms, from which numpy takes all
pairs of sources at once by broadcasting. Each tile gives a partial matrix of
pairs, and for each source a heap of the terms that stand out most; a grouping
sums the matrices, and a window merges the heaps. A tile's size depends on
neither the number of texts, terms nor sources.

Defined results: null lang, source and text are empty strings. A group whose
texts have no kept term has a count of zero for each. A language without kept
terms has pairs of value 0; one with a single source has no pairs. Repeated rows
count each time. An empty table gives an empty result. Very long texts are
slices of their own. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.llm.arrowtext import byte_table, pieces, words_of
from lodestone.llm.shared import written

#: Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
LETTERS = byte_table(lambda c: 0x61 <= c <= 0x7A or c >= 0x80)
#: Fixed values of the query's contract: documents that a kept term needs, the unit of shares, what is added to counts, ranks of terms.
MIN_DOCS, UNIT, ADDED, TOP_TERMS = 10, 1_000_000_000, 2, 10
#: Terms of a tile, sources of one side of it, and cells that are computed at once.
TERMS, SOURCES, CELLS = 512, 128, 1 << 20


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, text) -> (lang, source, term, n, docs): occurrences, and rows that have any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            words = words_of(batch.column(2), LETTERS)
            terms = words.array().dictionary_encode()
            size = max(1, len(terms.dictionary))
            of_text = np.repeat(np.arange(batch.num_rows), np.diff(words.texts))
            # (text, term) with counts, then (group, term)
            own, n = np.unique(of_text * size + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
            langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            width = max(1, len(sources.dictionary))
            group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + sources.indices.to_numpy(zero_copy_only=False)
            keys, place = np.unique(group[own // size] * size + own % size, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, place, n)
            at = lambda encoded, codes: encoded.dictionary.take(pa.array(codes))
            columns = [at(langs, keys // size // width), at(sources, keys // size % width), at(terms, keys % size), pa.array(total), pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    found = documents.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * counts / totals) for counts up to totals: long division by three digits at a time stays within 64 bits."""
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64), counts
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The differences of each row of ``p`` and each of ``q``, summed over the terms."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, CELLS // max(1, out.size))
    for k in range(0, p.shape[1], step):
        out += differences(p[:, None, k : k + step], q[None, :, k : k + step]).sum(axis=2)
    return out


def top_terms(counts: np.ndarray, p: np.ndarray, q: np.ndarray, places: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(source, term, value): the terms that each source has more of than its language, by value and then by their places."""
    out = []
    for s in range(len(p)):
        own = np.flatnonzero((counts[s] > 0) & (p[s] > q))
        values = differences(p[s][own], q[own])
        best = np.lexsort((places[own], -values))[:most]
        out += [(s, int(own[k]), int(values[k])) for k in best]
    return out


def tile(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """One tile: partial values of the pairs of its two blocks of sources; on the diagonal, the sources' terms as well."""
    lang, _, low, high = (x.as_py() for x in key)
    blocks = groups.column("own").to_numpy()
    names = groups.column("source").to_pylist()
    totals, added = groups.column("total").to_numpy(), groups.column("added").to_numpy()
    terms = pc.unique(counts.column("term").combine_chunks()).sort()
    matrix, in_lang = np.zeros((len(names), len(terms)), np.int64), np.zeros(len(terms), np.int64)
    column = pc.index_in(counts.column("term").combine_chunks(), terms).to_numpy(zero_copy_only=False)
    row = pc.index_in(counts.column("source").combine_chunks(), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
    matrix[row, column] = counts.column("n").to_numpy()
    in_lang[column] = counts.column("lang_n").to_numpy()
    p = shares(matrix + ADDED, (totals + added)[:, None])
    a, b = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    values = pair_sums(p[a], p[b])
    # terms of the block that none of these sources has are alike, and need no columns
    absent = groups.column("block_terms").to_numpy()[0] - len(terms)
    nothing = shares(np.full(len(names), ADDED, np.int64), totals + added) if absent else totals
    values += absent * differences(nothing[a][:, None], nothing[b]) if absent else 0
    rows = [("pair", names[x], names[y], int(values[i, j])) for i, x in enumerate(a) for j, y in enumerate(b) if x != y]
    if low != high:
        rows += [(part, y, x, v) for part, x, y, v in rows]
    elif len(terms):
        q = shares(in_lang + ADDED, groups.column("lang_total").to_numpy()[:1] + added[:1])
        rows += [("term", names[s], terms[t].as_py(), v) for s, t, v in top_terms(matrix, p, q, np.arange(len(terms)), TOP_TERMS)]
    parts, sources, items, found = zip(*rows) if rows else ((), (), (), ())
    strings = lambda xs: pa.array(xs, pa.string())
    return pa.table({"lang": strings([lang] * len(rows)), "source": strings(sources), "part": strings(parts), "item": strings(items), "value": pa.array(found, pa.int64())})


def divergence(documents: DataFrame, min_docs: int = MIN_DOCS, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, text) -> lang, source, part, item, value, rank: other sources by their difference, and the terms that stand out."""
    plain = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    all_counts = written(term_counts(plain), "term_counts")
    kept = all_counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs).drop("docs")
    counts = written(all_counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept_counts")

    per_term = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    per_lang = per_term.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = plain.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(per_lang, "lang", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    many = lambda n, size: F.greatest(F.lit(1), F.ceil(none(n) / size)).cast("bigint")
    sizes = written(sizes.select("lang", none("lang_total").alias("lang_total"), (ADDED * none("terms")).alias("added"), many(F.col("terms"), terms).alias("term_blocks"), many(F.col("sources"), sources).alias("source_blocks")), "languages")

    placed = lambda df: df.join(sizes, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("source_blocks")))
    met = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("source_blocks") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sides = placed(groups.join(totals, ["lang", "source"], "left").withColumn("total", none("total")))
    sides = sides.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("term_blocks") - 1)))
    block = F.pmod(F.xxhash64("term"), F.col("term_blocks")).alias("block")
    lengths = per_term.join(sizes, "lang").groupBy("lang", block).agg(F.count(F.lit(1)).alias("block_terms"))
    sides = met(sides.join(lengths, ["lang", "block"], "left").withColumn("block_terms", none("block_terms")))
    cells = met(placed(counts).withColumn("block", block))
    by = ["lang", "block", "low", "high"]
    left = cells.select(*by, "source", "term", "n", "lang_n").groupBy(*by)
    right = sides.select(*by, "source", "own", "total", "added", "lang_total", "block_terms").groupBy(*by)
    tiles = left.cogroup(right).applyInArrow(tile, "lang string, source string, part string, item string, value long")

    summed = tiles.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank of every group of ``documents``."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS MATERIALIZED (SELECT lang, source, i, unnest(w) AS term FROM d),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, lang_n, v, lang_total
  FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN own USING (lang, source, term)
), p AS MATERIALIZED (
  SELECT lang, source, term, n, CAST(1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p,
    CAST(1 + 1000000000 * (lang_n + 2) // (lang_total + 2 * v) AS BIGINT) AS q
  FROM cells
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""
