"""N-gram Jaccard join: a blocked sparse matrix product with bounds from set sizes.

The incidence matrix has a row for each distinct set of shingles and a column
for each shingle; its product with its own transpose holds the overlaps of all
pairs of sets. Two sets of n and m shingles are similar enough if their overlap
is at least s (n + m) / (1 + s), and this bound cuts the product three times:

1. All columns have one order, rare ones first. Similar sets have a common column
   among the first n - ceil(s n) + 1 of either, the *head* of a row. Only heads
   are multiplied over the whole corpus, column by column. The rows of every
   third column are counted exactly; the order begins with these columns.
2. The first common column of a pair stands at some place of either row; what is
   left of the shorter rest bounds the overlap. So do the parities of groups of
   columns: two rows differ at least where their parities do. Most pairs of a
   column go by these two before they are rows of a table.
3. The entries that are left are computed from whole rows, in blocks of rows by
   rows; overlaps are accumulated column block by column block, and a pair is
   dropped as soon as the columns still to come cannot lift it to the bound.

A column that very many rows have isn't multiplied with itself at once: first
each row is met with the column's *hub*, the row that has it earliest, which
takes as many entries as the heads have. Families of near copies are then one
component each, and only pairs of different components are multiplied. A crowd
of rows that are all just below the bound remains, and is multiplied as pairs.

Defined results: texts without words (or null) have an empty set, which is
linked with nothing. Equal sets are one row of the matrix, and their documents
one component. Rows are documents, so a repeated row is linked with its copies;
the component of documents that all have a null id is null. Very long texts are
slices of their own. Further columns are not looked at, whatever their names. An
empty table gives an empty result. Shingles are XXH64 hashes; sets are named by
64 bits, and named anew if another 64 bits show that two share a name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrowtext import NONSPACE, pieces, ragged, words_of
from lodestone.llm.graph import components
from lodestone.llm.shared import written
from lodestone.llm.simhash import shingle_hashes

#: One in so many columns, by hash, has its rows counted: more columns than a head has, so that heads hold rare ones, see ``shared_columns``.
COUNTED = 3
#: A pair is met at its first common column, if the one before it is among so many head columns before this one in both rows.
BEFORE = 8
#: Names of the columns of a set's parities.
PARITIES = ("odd0", "odd1", "odd2", "odd3")
#: One side of a block of the product: shingles and rows; blocks at least; column blocks of each.
BLOCK_SHINGLES, BLOCK_ROWS, LEAST_BLOCKS, COLUMN_BLOCKS = 1 << 20, 2000, 4, 4


@dataclass(frozen=True)
class Similarity:
    """Sets of ``words``-word shingles are linked if 100 * intersection >= percent * union."""

    words: int = 4
    percent: int = 85

    def head(self, n: int) -> int:
        """How many of a row's first columns hold one that any similar row has in its own."""
        return n - -(-self.percent * n // 100) + 1 if n else 0

    def reached(self, overlap: str, total: str) -> str:
        """SQL: whether an overlap is enough for the sum of both sizes."""
        return f"{100 + self.percent} * ({overlap}) >= {self.percent} * ({total})"


#: Fixed values of the query's contract.
CONTRACT = Similarity(4, 85)


def rows_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    hashes, counts = shingle_hashes(words_of(texts, NONSPACE), words)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []


def names_of(sets: list[np.ndarray], seed: int) -> list[pa.Array]:
    """Both halves of a 128-bit hash of each set."""
    names = [xxhash.xxh3_128_intdigest(x.tobytes(), seed) for x in sets]
    return [pa.array(np.array([x >> shift & (1 << 64) - 1 for x in names], np.uint64).view(np.int64)) for shift in (0, 64)]


def parities(sets: list[np.ndarray]) -> list[pa.Array]:
    """For each set, which of 256 groups of columns have an odd number of its columns, as four longs."""
    odd = np.zeros((len(sets), 64 * len(PARITIES)), bool)
    for k, own in enumerate(sets):
        odd[k] = np.bincount((own >> np.uint64(20)).astype(np.int64) % odd.shape[1], minlength=odd.shape[1]) & 1
    words = np.packbits(odd, axis=1, bitorder="little").view(np.int64).reshape(len(sets), len(PARITIES))
    return [pa.array(np.ascontiguousarray(words[:, k])) for k in range(len(PARITIES))]


def listed(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of hashes as lists of signed 64-bit integers."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def named_rows(documents: DataFrame, like: Similarity, seed: int) -> DataFrame:
    """(doc_id, set, other, n, odd0 to odd3, counted, filler) of every row of ``documents`` (doc_id, text).

    set, other: two hashes of its set; n: the set's size; odd: see ``parities``; counted: the columns
    whose documents will be counted; filler: the first of the others, where the
    counted ones are fewer than a head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets = rows_of(batch.column(1), like.words)
            n = pa.array(np.fromiter(map(len, sets), np.int32, len(sets)))
            some = [x % COUNTED == 0 for x in sets]
            counted = [x[c] for x, c in zip(sets, some)]
            filler = [x[~c][: max(0, like.head(len(x)) - int(c.sum()))] for x, c in zip(sets, some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *names_of(sets, seed), n, *parities(sets), listed(counted), listed(filler)], ["doc_id", *[name for name, _ in kinds]])

    kinds = [("set", T.LongType()), ("other", T.LongType()), ("n", T.IntegerType()), *[(c, T.LongType()) for c in PARITIES], ("counted", T.ArrayType(T.LongType())), ("filler", T.ArrayType(T.LongType()))]
    return documents.mapInArrow(run, T.StructType([T.StructField("doc_id", documents.schema[0].dataType), *[T.StructField(*x) for x in kinds]]))


def named_sets(documents: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame, int]:
    """The rows of ``documents`` and their distinct sets (set, first_doc, copies, n, odd0 to odd3), written, and the names' seed. Names that two sets share are all made anew."""
    seed = 0
    while True:
        rows = written(named_rows(documents, like, seed), "rows")
        own = [F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", *PARITIES)], (F.min("other") < F.max("other")).alias("mixed")]
        sets = written(rows.where("n > 0").groupBy("set").agg(*own), "distinct_sets")
        if sets.where("mixed").isEmpty():
            return rows, sets.drop("mixed"), seed
        seed += 1


def one_row_each(rows: DataFrame, sets: DataFrame, broadcast_rows: int) -> DataFrame:
    """One of the ``rows`` of each set."""
    copied = sets.where("copies > 1").select("set", "first_doc", F.lit(True).alias("copied"))
    side = F.broadcast(copied) if copied.limit(broadcast_rows + 1).count() <= broadcast_rows else copied
    marked = rows.where("n > 0").join(side, "set", "left")
    first = marked.where("copied AND doc_id <=> first_doc").dropDuplicates(["set"])
    return marked.where("copied IS NULL").unionByName(first)


def shared_columns(rows: DataFrame, sets: DataFrame, like: Similarity, broadcast_rows: int) -> DataFrame:
    """(shingle, set, n, place, hub): the head entries of ``sets`` in columns of two rows or more; hub is the column's row that has it earliest.

    The order of columns: the counted ones by the number of their rows, then the
    others. A head lies in the counted columns, or has all of them and the
    filler. Columns of one row make no pairs, so only their number counts.
    """
    once = one_row_each(rows, sets, broadcast_rows)
    counted = once.select("set", F.explode("counted").alias("shingle"), F.lit(None).cast("int").alias("behind"))
    filler = once.where("size(filler) > 0").select("set", F.posexplode("filler").alias("behind", "shingle"))
    # dealt once: the number of a column's rows is found beside them, in a window that spills, not joined to a second exchange
    column = Window.partitionBy("shingle")
    several = {"rows": F.count(F.lit(1)), "least": F.min("set"), "most": F.max("set"), "behind_most": F.max("behind")}
    dealt = counted.unionByName(filler.select(*counted.columns)).withColumns({c: f.over(column) for c, f in several.items()})
    repeated = dealt.where("least < most").withColumn("last", F.col("behind_most").isNotNull()).drop("least", "most", "behind_most")
    sizes = once.select("set", "n", F.size("counted").alias("all"))
    own = F.count(F.when(~F.col("last"), 1)).over(Window.partitionBy("set"))
    number = F.row_number().over(Window.partitionBy("set").orderBy("last", "rows", "shingle"))
    placed = repeated.withColumn("own", own).withColumn("number", number).join(sizes, "set")
    placed = placed.withColumn("place", F.when(F.col("last"), F.col("all") + F.col("behind")).otherwise(F.col("all") - F.col("own") + F.col("number") - 1))
    head = F.expr(f"n - ceil({like.percent} * n / 100) + 1")
    entries = written(placed.where(F.col("place") < head).select("shingle", "set", "n", "place"), "head_entries")
    hubs = entries.groupBy("shingle").agg(F.min(F.struct("place", "n", "set")).alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return entries.join(hubs.select("shingle", "hub"), "shingle")


def star(entries: DataFrame, like: Similarity) -> DataFrame:
    """(a, b): each row with the hubs of its columns, where their sizes allow it."""
    close = like.reached("least(n - place, hub.n - hub.place)", "n + hub.n")
    return entries.where(f"set <> hub.set AND {close}").select(F.least("set", "hub.set").alias("a"), F.greatest("set", "hub.set").alias("b")).distinct()


def crossing(entries: DataFrame, roots: DataFrame, like: Similarity) -> DataFrame:
    """(a, b): pairs of different roots with a common column, where their sizes and parities allow it. ``roots``: (set, root, odd0 to odd3).

    A group of columns of which two sets have an even and an odd number has a
    column of one set alone, so the sets differ in as many columns at least as
    there are such groups. A pair that has another common column just before this
    one is met there too, at places that allow no less, and is no row here.
    """
    # of the windows of places, set by set, the join before them has made the exchange
    before = F.collect_list("shingle").over(Window.partitionBy("set").orderBy("place").rowsBetween(-BEFORE, -1))
    known = entries.select("shingle", "set", "n", "place").join(roots, "set").withColumn("before", before)
    side = lambda c: known.select("shingle", *[F.col(x).alias(f"{c}_{x}") for x in ("set", "n", "place", "before", "root", *PARITIES)])
    close = like.reached("least(a_n - a_place, b_n - b_place)", "a_n + b_n")
    apart = " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in PARITIES)
    alike = f"{100 + like.percent} * (a_n + b_n - ({apart})) >= {2 * like.percent} * (a_n + b_n)"
    pairs = side("a").join(side("b"), "shingle").where(f"a_set < b_set AND a_root <> b_root AND {close} AND {alike} AND NOT arrays_overlap(a_before, b_before)")
    return pairs.select(F.col("a_set").alias("a"), F.col("b_set").alias("b")).distinct()


def whole_rows(documents: DataFrame, wanted: DataFrame, words: int, seed: int, broadcast_rows: int) -> DataFrame:
    """(set, shingles) of the rows of ``documents`` whose doc_id is one of ``wanted`` (first_doc). Other texts are not hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets = rows_of(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([names_of(sets, seed)[0], listed(sets)], ["set", "shingles"])

    ids = wanted.select("first_doc").distinct()
    side = F.broadcast(ids) if ids.limit(broadcast_rows + 1).count() <= broadcast_rows else ids
    own = documents.join(side, F.col("doc_id").eqNullSafe(F.col("first_doc")), "left_semi")
    return own.mapInArrow(run, "set long, shingles array<long>")


def product(pairs: pa.Table, rows: pa.Table, like: Similarity) -> pa.Table:
    """The pairs (a, b) of one block whose overlap reaches the bound.

    Row by row: the row's columns are marked, and the marks under its partners'
    columns are summed, for one block of columns after the other.
    """
    lists = rows.column("shingles").combine_chunks()
    offsets = lists.offsets.to_numpy()
    columns, local = np.unique(lists.values.to_numpy(zero_copy_only=False), return_inverse=True)
    names = rows.column("set").combine_chunks()
    at = lambda c: pc.index_in(pairs.column(c).combine_chunks(), names).to_numpy(zero_copy_only=False)
    a, b = at("a"), at("b")
    n = np.diff(offsets)
    # where each row's part of each column block begins; sets are sorted as unsigned, local numbers are not
    block_of = local * COLUMN_BLOCKS // max(1, len(columns))
    order = np.lexsort((block_of, np.repeat(np.arange(len(n)), n)))
    local, block_of = local[order], block_of[order]
    sizes = np.bincount(np.repeat(np.arange(len(n)), n) * COLUMN_BLOCKS + block_of, minlength=len(n) * COLUMN_BLOCKS).reshape(len(n), COLUMN_BLOCKS)
    begins = offsets[:-1, None] - offsets[0] + np.cumsum(sizes, axis=1) - sizes
    left = n[:, None] - np.cumsum(sizes, axis=1)
    marked = np.zeros(len(columns) + 1, bool)
    good = np.zeros(len(a), bool)
    by_row = np.argsort(a, kind="stable")
    for own in np.split(by_row, np.flatnonzero(np.diff(a[by_row])) + 1) if len(a) else []:
        x = a[own[0]]
        mine = local[offsets[x] - offsets[0] : offsets[x + 1] - offsets[0]]
        marked[mine] = True
        overlap, alive = np.zeros(len(own), np.int64), np.arange(len(own))
        for k in range(COLUMN_BLOCKS):
            y = b[own[alive]]
            taken = sizes[y, k]
            sums = np.concatenate([[0], np.cumsum(marked[local[ragged(begins[y, k], taken)]])])
            ends = np.cumsum(taken)
            overlap[alive] += sums[ends] - sums[ends - taken]
            most = overlap[alive] + np.minimum(left[x, k], left[y, k])
            alive = alive[(100 + like.percent) * most >= like.percent * (n[x] + n[y])]
        good[own[alive]] = True
        marked[mine] = False
    return pairs.select(["a", "b"]).filter(pa.array(good))


def multiplied(pairs: DataFrame, sets: DataFrame, documents: DataFrame, like: Similarity, seed: int, broadcast_rows: int) -> DataFrame:
    """The distinct ``pairs`` (a, b) of ``sets`` (set, first_doc, n) that are similar enough, written.

    Rows are dealt into blocks; the whole row of a set is sent once to each block of pairs that needs it.
    """
    # each side is made distinct before both are put together: a set of many pairs is one row from the start
    ends = lambda df, *by: df.select(*by, F.col("a").alias("set")).distinct().unionByName(df.select(*by, F.col("b").alias("set")).distinct()).distinct()
    wanted = written(ends(pairs).join(sets.select("set", "first_doc", "n"), "set"), "wanted_rows")
    n, total = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_SHINGLES), -(-n // BLOCK_ROWS))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    placed = pairs.select("a", "b", at("a").alias("i"), at("b").alias("j"))
    needed = ends(placed, F.col("i").alias("row"), F.col("j").alias("column"))
    # several documents may share a doc_id, or a null one: only rows of wanted sets are sent, each once
    whole = whole_rows(documents, wanted, like.words, seed, broadcast_rows)
    sent = needed.join(whole, "set").select("row", "column", "set", "shingles")
    good = placed.groupBy("i", "j").cogroup(sent.groupBy("row", "column")).applyInArrow(lambda p, r: product(p, r, like), "a long, b long")
    return written(good, "similar_rows")


def with_roots(sets: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``sets`` with the least set of each one's component, written."""
    roots = components(links).withColumnRenamed("node", "set")
    return written(sets.drop("root").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")), name)


def similar_groups(documents: DataFrame, like: Similarity = CONTRACT, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``documents`` (doc_id, text)."""
    plain = documents.select("doc_id", "text")
    rows, sets, seed = named_sets(plain, like)
    entries = written(shared_columns(rows, sets, like, broadcast_rows), "shared_columns")
    check = lambda pairs: multiplied(pairs, sets, plain, like, seed, broadcast_rows)
    near_hubs = written(star(entries, like), "hub_pairs")
    found = check(near_hubs)
    rooted = with_roots(sets, found, "families")
    pairs = crossing(entries, rooted.select("set", "root", *PARITIES), like).join(near_hubs, ["a", "b"], "left_anti")
    rooted = with_roots(sets, found.unionByName(check(written(pairs, "crossing_pairs"))), "rooted_sets")
    # a table of its own, so that the join can split the rows of one large component; documents that are alone need no row in it
    groups = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.sum("copies").alias("documents")).where("documents > 1")
    least = written(groups.select("root", "component_id"), "component_least")
    named = written(rooted.join(least, "root").select("set", "component_id"), "component_ids")
    return rows.select("doc_id", "set", F.col("n").cast("bigint").alias("n_shingles")).join(named, "set", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reached AS (
  SELECT doc_id, doc_id AS other FROM w
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
