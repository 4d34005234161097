"""Near copies: SimHash families first, then all other pairs by exact similarity of shingle sets.

The fingerprints of ``simhash`` find the families: a multi-index search for set
fingerprints that differ in a few bits. At a similarity of 4/5 two fingerprints
differ in some 10 of 64 bits, further than such a search can look. So sets
of different families are met by an equi-join of prefixes, which loses no pair:
all shingles have one order; two sets of n and m shingles with a Jaccard
similarity of 4/5 have at least t = 4 (n + m) / 9 of them in common, and the
first of these in the order is no later than place n - t of the one and m - t of
the other. The order is free: shingles seen often come last, by counts that need
not be exact, and the others by their hashes. Pairs of large sets whose two
fingerprints differ by five deviations more than those of such sets do are left
out; the others of both searches are verified on the complete sets, which travel to a grid of blocks, so that a
set is sent once to each block of pairs and not once for each pair.

Copies are one set, and only sets that are of different families are paired. A
crowd of sets just below the threshold, of no family, is compared pair by pair.

Defined results: as in ``simhash``; texts without words are one group. Very long
texts are slices of their own. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import simhash
from lodestone.llm.arrowtext import NONSPACE, pieces, words_of
from lodestone.llm.graph import components
from lodestone.llm.shared import written
from lodestone.llm.simhash import majority_bits, remixed, shingle_hashes

#: Shingles that a slice of texts has in so many different sets are counted, and come last from so many in all, up to a bound.
SEEN_IN_SLICE, OFTEN, MOST_OFTEN = 2, 8, 200_000
#: Of the 128 bits of two fingerprints, 19 differ on average at a similarity of 4/5, with a deviation of 4: five deviations are left.
#: Small sets deviate further, so the bound holds from so many shingles of both sets together on, and smaller ones are all verified.
FAR, FAR_FROM = 40, 80
#: A pair is met at its first common shingle, if the one before it is among so many shared shingles before this one in both.
BEFORE = 8
#: Verification: shingles and sets of one side of a block of pairs.
BLOCK_SHINGLES, BLOCK_SETS, LEAST_BLOCKS = 1 << 20, 2000, 8
#: So many fingerprints that look alike in a part are linked without pairs.
HOT_BUCKET = 1024


def sets_of(batch: pa.RecordBatch, shingle_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct shingles of each text (column 1), sorted, and a hash of each set."""
    hashes, counts = shingle_hashes(words_of(batch.column(1), NONSPACE), shingle_words)
    sets = [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []
    return sets, np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)


def listed(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of hashes as lists of signed 64-bit integers."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def often(documents: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are seen often, sorted, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets, ids = sets_of(batch, shingle_words)
            own = [sets[k] for k in np.unique(ids, return_index=True)[1]]
            shingles, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)
            some = n >= SEEN_IN_SLICE
            yield pa.RecordBatch.from_arrays([pa.array(shingles[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["shingle", "n"])

    seen = documents.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    rows = seen.orderBy(F.desc("n"), "shingle").limit(MOST_OFTEN).collect()
    shingles = np.array([r.shingle for r in rows], np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.array([r.n for r in rows], np.int64)[order]


def prefixes(documents: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, set, n, fp, fp2, prefix) of every row of ``documents`` (doc_id, text).

    n: its distinct shingles; fp, fp2: fingerprints of them; prefix: the first of
    them in the order, which any set of enough similarity has one of.
    """
    shared = documents.sparkSession.sparkContext.broadcast(often(documents, shingle_words))

    def first(own: np.ndarray) -> np.ndarray:
        shingles, counts = shared.value
        size = len(own) + (-4 * len(own) // 5) + 1 if len(own) else 0
        if not len(shingles):
            return own[:size]
        at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
        return own[np.argsort(np.where(shingles[at] == own, counts[at], 0), kind="stable")[:size]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets, ids = sets_of(batch, shingle_words)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            prints = [pa.array(majority_bits(x, n)) for x in (flat, remixed(flat))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids), pa.array(n.astype(np.int32)), *prints, listed([first(x) for x in sets])], ["doc_id", *names])

    kinds = (T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()))
    names = ["set", "n", "fp", "fp2", "prefix"]
    return documents.mapInArrow(run, T.StructType([T.StructField("doc_id", documents.schema[0].dataType), *map(T.StructField, names, kinds)]))


def whole_sets(documents: DataFrame, wanted: DataFrame, shingle_words: int, broadcast_rows: int) -> DataFrame:
    """(set, shingles) of the rows of ``documents`` whose doc_id is one of ``wanted`` (first_doc). Other texts are not hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets, ids = sets_of(batch, shingle_words)
            yield pa.RecordBatch.from_arrays([pa.array(ids), listed(sets)], ["set", "shingles"])

    ids = wanted.select("first_doc").distinct()
    side = F.broadcast(ids) if ids.limit(broadcast_rows + 1).count() <= broadcast_rows else ids
    own = documents.join(side, F.col("doc_id").eqNullSafe(F.col("first_doc")), "left_semi")
    return own.mapInArrow(run, "set long, shingles array<long>")


def similar(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs (a, b) of a block whose sets have a similarity of 4/5 or more."""
    lists = sets.column("shingles").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    place = {s: k for k, s in enumerate(sets.column("set").to_pylist())}
    own = lambda s: flat[offsets[place[s]] : offsets[place[s] + 1]]
    good = []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
        x, y = own(a), own(b)
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        good.append(9 * common >= 4 * len(both))
    return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame, documents: DataFrame, shingle_words: int, broadcast_rows: int) -> DataFrame:
    """The distinct ``pairs`` (a, b) of ``sets`` (set, first_doc, n) with a similarity of 4/5 or more, written."""
    # each side is made distinct before both are put together: a set of many pairs is one row from the start
    ends = lambda df, *by: df.select(*by, F.col("a").alias("set")).distinct().unionByName(df.select(*by, F.col("b").alias("set")).distinct()).distinct()
    names = ends(pairs)
    wanted = written(names.join(sets.select("set", "first_doc", "n"), "set"), "wanted_sets")
    n, total = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_SHINGLES), -(-n // BLOCK_SETS))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    placed = pairs.select("a", "b", at("a").alias("i"), at("b").alias("j"))
    needed = ends(placed, F.col("i").alias("row"), F.col("j").alias("column"))
    whole = whole_sets(documents, wanted, shingle_words, broadcast_rows)
    sent = needed.join(whole, "set").select("row", "column", "set", "shingles")
    good = placed.groupBy("i", "j").cogroup(sent.groupBy("row", "column")).applyInArrow(similar, "a long, b long")
    return written(good, "similar_sets")


def families(sets: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` (set, fp): those that the search of fingerprints links, by the least set of each fingerprint."""
    prints = written(sets.groupBy("fp").agg(F.min("set").alias("least"), F.max("set").alias("most")), "set_fingerprints")
    found = simhash.links(prints.select("fp"), distance, hot_bucket=HOT_BUCKET)
    end = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"set_{c}"))
    near = found.join(end("a"), "a").join(end("b"), "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    same = sets.join(prints.where("least < most").select("fp", "least"), "fp").where("set <> least").select(F.col("least").alias("a"), F.col("set").alias("b"))
    return near.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: The first common shingle of similar sets is so early in both that 4 (n + m) / 9 shingles can be common from there on.
#: A pair that has another common shingle just before this one is met there, and is no row here.
NEAR = f"""a_set < b_set AND a_root <> b_root AND 9 * least(a_n - a_place, b_n - b_place) >= 4 * (a_n + b_n)
  AND (a_n + b_n < {FAR_FROM} OR bit_count(a_fp ^ b_fp) + bit_count(a_fp2 ^ b_fp2) <= {FAR})
  AND NOT arrays_overlap(a_before, b_before)"""


def crossing(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of ``sets`` (set, root, n, fp, fp2, first_doc, copies) of different roots that may be similar enough,
    by an equi-join of the prefixes of ``rows``."""
    copied = sets.where("copies > 1").select("set", "first_doc")
    once = rows.join(copied, "set", "left").where("first_doc IS NULL OR doc_id <=> first_doc")
    # one exchange of narrow rows: a shingle's sets are told apart in a window, and what is before it is looked up for shared ones only
    placed = once.select("set", F.posexplode("prefix").alias("place", "shingle"))
    same = Window.partitionBy("shingle")
    counted = placed.withColumn("least", F.min("set").over(same)).withColumn("most", F.max("set").over(same))
    shared = written(counted.where("least < most").select("set", "place", "shingle"), "shared_shingles")
    fields = ["set", "root", "n", "fp", "fp2"]
    own = shared.groupBy("set").agg(F.array_sort(F.collect_set(F.struct("place", "shingle"))).alias("own"))
    before = F.expr(f"""flatten(transform(array(own.shingle), s -> transform(own, (x, i) -> named_struct('place', x.place, 'shingle', x.shingle,
      'before', slice(s, greatest(i - {BEFORE}, 0) + 1, least(i, {BEFORE}))))))""")
    known = written(own.join(sets.select(*fields), "set").select(*fields, F.inline(before)), "shingles_of_sets")
    side = lambda c: known.select("shingle", *[F.col(x).alias(f"{c}_{x}") for x in (*fields, "place", "before")])
    return side("a").join(side("b"), "shingle").where(NEAR).select(F.col("a_set").alias("a"), F.col("b_set").alias("b")).distinct()


def with_roots(sets: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``sets`` with the least set of each one's component, written."""
    roots = components(links).withColumnRenamed("node", "set")
    return written(sets.drop("root").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")), name)


def near_copy_groups(documents: DataFrame, shingle_words: int = 5, distance: int = simhash.MAX_DISTANCE, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, component_id) of every row of ``documents`` (doc_id, text)."""
    plain = documents.select("doc_id", "text")
    rows = written(prefixes(plain, shingle_words), "prefixes")
    first = [F.first(c).alias(c) for c in ("n", "fp", "fp2")]
    sets = written(rows.groupBy("set").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), *first), "distinct_sets")
    check = lambda pairs: verified(pairs, sets, plain, shingle_words, broadcast_rows)
    found = check(written(families(sets, distance), "family_pairs"))
    pairs = written(crossing(rows, with_roots(sets, found, "families")), "crossing_pairs")
    rooted = with_roots(sets, found.unionByName(check(pairs)), "rooted_sets")
    # a table of its own, so that the join can split the rows of one large component
    least = written(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "component_least")
    named = written(rooted.join(least, "root").select("set", "component_id"), "component_ids")
    return rows.select("doc_id", "set").join(named, "set").select("doc_id", "component_id")
