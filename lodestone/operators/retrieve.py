"""Retrieval: similarity top-k for one query or many, reranking, fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.ids import collapse
from lodestone.functions.vectors import similarity


def top_k(records: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", condition: Column | None = None, min_score: float | None = None) -> DataFrame:
    """(id, score, rank) of the nearest records (id, vector), ties by id. Filters come before scores."""
    rows = records.where(F.coalesce(condition, F.lit(False))) if condition is not None else records
    rows = rows.select("id", similarity(metric, F.col("vector"), F.array(*map(F.lit, query))).alias("score"))
    if min_score is not None:
        rows = rows.where(F.col("score") >= min_score)
    best = rows.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def scores_of(metric: str, records: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Records by queries."""
    products = records @ queries.T
    if metric == "dot":
        return products
    if metric == "cosine":
        norms = np.linalg.norm(records, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        return np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)
    if metric == "euclidean":
        squares = (records**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :] - 2 * products
        return 1 / (1 + np.sqrt(np.maximum(squares, 0)))
    raise ValueError(f"unknown metric {metric!r}")


def matrix_of(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows; those that are null or empty are rows of zeros. Other widths than the one they have are an error."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    full = np.flatnonzero(lengths)
    width = width or (int(lengths[full[0]]) if len(full) else 0)
    if (lengths[full] != width).any():
        raise ValueError("vectors have different widths")
    out = np.zeros((len(vectors), width))
    out[full] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(full), width)
    return out


def units(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray | None:
    """Unit vectors (or zeros) in single precision; None if some vector has no finite length, or an extreme one."""
    if not ((norms == 0) & ~vectors.any(axis=1) | (norms > 1e-100) & (norms < 1e100)).all():
        return None
    return np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0).astype(np.float32)


def first_of_equal(records: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places of the records, without those for which k of the same vector have smaller ids."""
    rows = np.ascontiguousarray(records).view(np.dtype((np.void, records.dtype.itemsize * records.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    places = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    order = np.lexsort((places, group))
    number = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return np.sort(order[number < k])


class Best:
    """The k best records of each of some queries, from blocks of records that come one after another.

    ``empty``: queries without a vector, whose scores are all 0. ``bits``: for each
    query the number of the bit that a record must have set to be seen by it.
    """

    #: Scores of a block of records that are made at once; single ones that are made anew; records of the first screened block.
    SCORES, PAIRS, FIRST = 1 << 22, 1 << 16, 256

    def __init__(self, queries: np.ndarray, empty: np.ndarray, bits: np.ndarray | None, metric: str, k: int, min_score: float | None, ids: pa.DataType):
        self.queries, self.empty, self.bits, self.metric, self.k = queries, empty, bits, metric, k
        self.norms = np.linalg.norm(queries, axis=1)
        self.least = np.full(len(queries), -np.inf if min_score is None else min_score)
        self.unit = units(queries, self.norms) if metric == "cosine" and bits is None and queries.shape[1] else None
        # query, score and record of what is best so far, by query
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], ids)

    def _bounds(self, norms: np.ndarray) -> np.ndarray:
        """What no score of a chunk's records passes, for each query, by the norms alone."""
        if self.metric == "dot":
            most = norms.max() * self.norms
        elif self.metric == "euclidean":
            apart = np.maximum(np.maximum(norms.min() - self.norms, self.norms - norms.max()), 0)
            most = 1 / (1 + apart)
        else:
            return np.full(len(self.norms), np.inf)
        return np.maximum(most * (1 + 1e-9), 0)  # an empty vector scores 0

    def add(self, ids: pa.Array, vectors: pa.Array, bits: np.ndarray | None = None) -> None:
        """``bits``: the words of each record's bit vector."""
        records = matrix_of(vectors, self.queries.shape[1] or None)
        missing = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == 0
        norms = np.linalg.norm(records, axis=1)
        if self.unit is not None and records.shape[1] and (unit := units(records, norms)) is not None:
            return self._screened(ids, records, norms, unit)
        by_norm = np.argsort(-norms, kind="stable")  # chunks of like norms have narrow bounds
        chunk = max(64, self.SCORES // max(1, len(self.norms)))
        for begin in range(0, len(records), chunk):
            own = by_norm[begin : begin + chunk]
            asked = np.flatnonzero(self._bounds(norms[own]) >= self.least)
            if not len(asked):
                continue
            scores = scores_of(self.metric, records[own], self.queries[asked]).T if self.queries.shape[1] and records.shape[1] else np.zeros((len(asked), len(own)))
            scores[:, missing[own]] = 0
            scores[self.empty[asked]] = 0
            seen = scores >= self.least[asked][:, None]
            if self.bits is not None:
                bit = self.bits[asked]
                seen &= (bits[own][:, bit // 64].T >> (bit % 64)[:, None].astype(np.uint64) & np.uint64(1)).astype(bool)
            if scores.shape[1] > self.k:
                hidden = np.where(seen, scores, -np.inf)
                at = scores.shape[1] - self.k
                seen &= scores >= np.partition(hidden, at, axis=1)[:, at : at + 1]
            q, r = np.nonzero(seen)
            self._keep(asked[q], scores[q, r], ids.take(pa.array(own[r])))

    def _screened(self, ids: pa.Array, records: np.ndarray, norms: np.ndarray, unit: np.ndarray) -> None:
        """Cosines in single precision tell which records may be among the best; only these are scored in full.

        ``slack`` is over twice what single precision can be off for unit vectors. Of records
        that have the same vector only the k first by id are looked at: the others come after them.
        """
        slack = (records.shape[1] + 16) * 2.0**-23
        kept = first_of_equal(records, ids, self.k)
        ids, records, norms, unit = ids.take(pa.array(kept)), records[kept], norms[kept], unit[kept]
        begin, most = 0, max(self.FIRST, 4 * self.SCORES // max(1, len(self.norms)))
        while begin < len(records):
            end = min(begin + min(max(begin, self.FIRST), most), len(records))
            near = self.unit @ unit[begin:end].T
            least = self.least - slack
            if near.shape[1] > self.k and len(open_ := np.flatnonzero(self.least == -np.inf)):
                at = near.shape[1] - self.k
                least[open_] = np.partition(near[open_], at, axis=1)[:, at] - 2 * slack
            found = np.flatnonzero(near >= least.astype(np.float32)[:, None])
            for part in np.split(found, range(self.PAIRS, len(found), self.PAIRS)):
                q, r = np.divmod(part, near.shape[1])
                r += begin
                both = norms[r] * self.norms[q]
                scores = np.divide(np.einsum("ij,ij->i", records[r], self.queries[q]), both, out=np.zeros(len(part)), where=both > 0)
                good = scores >= self.least[q]
                self._keep(q[good], scores[good], ids.take(pa.array(r[good])))
            begin = end

    def _keep(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), pa.concat_arrays([self.ids, ids])
        places = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        order = np.lexsort((places, -score, query))
        first = np.searchsorted(query[order], query[order])  # where each query's records begin
        number = np.arange(len(order)) - first
        order = order[number < self.k]
        self.query, self.score, self.ids = query[order], score[order], ids.take(pa.array(order))
        n = np.bincount(self.query, minlength=len(self.least))
        full = np.flatnonzero(n >= self.k)
        last = np.cumsum(n) - 1
        self.least[full] = np.maximum(self.least[full], self.score[last[full]])


#: Up to so many queries are broadcast; more are met with the records in a grid. Queries and records of a cell.
MOST_BROADCAST, CELL_QUERIES, CELL_RECORDS = 1024, 16_384, 65_536
#: So many blocks of queries and of records at least, of so many rows or more, and tasks at most.
LEAST_QUERIES, LEAST_RECORDS, LEAST_ROWS, MOST_TASKS = 12, 4, 1024, 2000


def batch_top_k(records: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", min_score: float | None = None, most_broadcast: int = MOST_BROADCAST, cell: tuple[int, int] = (CELL_QUERIES, CELL_RECORDS), bits: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the nearest records (id, vector) of every query (query_id, vector).

    Up to ``most_broadcast`` queries are broadcast, and records are not shuffled.
    More are dealt into blocks, as the records are; each cell of the grid is a
    block of queries with a block of records, both of a bounded size, met in a
    cogroup, so that neither side is collected and each is read once. In a cell
    whole chunks of records go by their norms alone. What is shuffled afterwards
    is k rows for each query and task or cell. Query ids are distinct and not null.

    ``bits``: records have a column bits (words of 64 bits each), queries a column
    bit; a query sees the records that have its bit set.
    """
    if metric not in ("cosine", "dot", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    kind, plain_id = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(records.schema["id"].dataType)
    types = T.StructType([queries.schema["query_id"], records.schema["id"], T.StructField("score", T.DoubleType())])
    # floats are sent as they are, and made doubles where they are scored
    single = T.ArrayType(T.FloatType())
    vector = lambda df: F.col("vector").cast(single if df.schema["vector"].dataType.simpleString() == single.simpleString() else "array<double>").alias("vector")
    there = records.select("id", vector(records), F.col("bits").cast("array<bigint>").alias("bits") if bits else F.lit(None).cast("array<bigint>").alias("bits"))
    asked = queries.select("query_id", vector(queries), F.col("bit").cast("int").alias("bit") if bits else F.lit(0).alias("bit"))

    def best_of(names: pa.Array, vectors: pa.Array, bit: np.ndarray) -> Best:
        empty = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == 0
        return Best(matrix_of(vectors), empty, bit if bits else None, metric, k, min_score, plain_id)

    def add(best: Best, rows: pa.RecordBatch | pa.Table) -> None:
        own = [rows.column(c).combine_chunks() if isinstance(rows, pa.Table) else rows.column(c) for c in ("id", "vector", "bits")]
        words = None
        if bits and rows.num_rows:
            words = own[2].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(rows.num_rows, -1)
        best.add(own[0], own[1], words)

    few = asked.limit(most_broadcast + 1).collect()  # decides the way; no more than these are collected
    if len(few) <= most_broadcast:
        shared = records.sparkSession.sparkContext.broadcast(([r.query_id for r in few], [r.vector for r in few], np.array([r.bit for r in few], np.int64)))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, bit = shared.value
            names = pa.array(ids, kind)
            best = best_of(names, pa.array(vectors, pa.list_(pa.float64())), bit)
            for batch in batches:
                add(best, batch)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), best.ids, pa.array(best.score)], ["query_id", "id", "score"])

        parts = there.mapInArrow(nearest, types)
    else:
        many = lambda n, size, least: max(1, -(-n // size), min(least, n // LEAST_ROWS))
        across, down = many(asked.count(), cell[0], LEAST_QUERIES), many(there.count(), cell[1], LEAST_RECORDS)
        tasks = min(across * down, MOST_TASKS)
        own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.withColumn("i", own("query_id", across)).withColumn("j", every(down)).repartition(tasks, "i", "j")
        right = there.withColumn("j", own("id", down)).withColumn("i", every(across)).repartition(tasks, "i", "j")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            names = left.column("query_id").combine_chunks()
            best = best_of(names, left.column("vector").combine_chunks(), left.column("bit").to_numpy().astype(np.int64))
            if left.num_rows and right.num_rows:
                add(best, right)
            return pa.table({"query_id": names.take(pa.array(best.query)), "id": best.ids, "score": best.score})

        parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, types)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def ranked(hits: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, id, score) with rank from 0, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = hits.withColumn("rank", F.row_number().over(order) - 1)
    return out if k is None else out.where(F.col("rank") < k)


def word_set(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(collapse(text)), " ")), lambda w: w != "")


def overlap(query: Column, text: Column) -> Column:
    """The share of the query's words that a text has."""
    own = word_set(query)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, word_set(text))) / F.size(own)).otherwise(0.0)


def reranked(candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, id, query, text) by word overlap."""
    return ranked(candidates.withColumn("score", overlap(F.col("query"), F.col("text"))), k)


def fused(hits: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, retriever, id, rank from 0): the sum of 1 / (constant + rank + 1). An extra."""
    scores = hits.groupBy("query_id", "id").agg(F.sum(1 / (constant + F.col("rank") + 1)).alias("score"))
    return ranked(scores, k)


def windows_of(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` words of a text, lower-cased, as 64-bit hashes."""
    words = F.split(F.trim(F.lower(collapse(text))), " ")
    runs = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*[F.get(ws, i + n) for n in range(size)]))
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= size, runs(ws)).otherwise(none)), F.lit(0)))


def shared_windows(records: DataFrame, queries: DataFrame, k: int, size: int = 3) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, query) the records (id, text) that have most of its word windows, ties by id.

    An equi-join of windows, as hashes: a window of a record counts for one of a
    query's by chance once in 2**64 pairs. What is shuffled beside them is a count
    for each pair that has any in common.
    """
    own = queries.select("query_id", F.explode(windows_of(F.col("query"), size)).alias("window"))
    there = records.select("id", F.explode(windows_of(F.col("text"), size)).alias("window"))
    return ranked(there.join(own, "window").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("score")), k)


def usable_ranking(entries: Column, top_k: int, candidates: Column) -> Column:
    """Whether a cached ranking can answer: one that is shorter than what is asked for, and than the candidates, is a miss."""
    return F.coalesce((F.size(entries) >= top_k) | (F.size(entries) >= candidates), F.lit(False))
