"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint is cut into segments. If two fingerprints differ in at
most r bits, then in some segment they differ in few bits: each fingerprint
enumerates the small Hamming ball of each of its segments, fetches the
fingerprints that have these values from the table of segments, and verifies
the complete distance. Only distinct fingerprints take part, so copies cost
nothing, and each pair is looked up from its smaller side alone.

A segment value that very many fingerprints share would pair them all. Beyond
``hot_bucket`` fingerprints, the bucket is left out of the join and its
fingerprints, and those that look it up, are linked through half-way points
instead: two fingerprints differ in at most r bits exactly if the balls of
radius ceil(r/2) and floor(r/2) around them meet, which is one grouping and
makes no pairs. No link is lost either way.

Defined results: null and empty texts have no words, and fingerprint zero; a
text with fewer words than a shingle is one shingle; rows are documents, and a
repeated row is one more document; the component of documents that all have a
null doc_id is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrowtext import NONSPACE, Words, pieces, ragged, words_of
from lodestone.llm.graph import components
from lodestone.llm.shared import written

BITS = 64
#: Fixed values of the query's contract.
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
#: An odd number whose bits look random: the golden ratio's.
MIXER = np.uint64(0x9E3779B97F4A7C15)

#: Byte b -> the eight bits of b as eight counters of one byte each.
SPREAD = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, repeats included, and how many each text has."""
    joined, begins, ends = words.joined()
    n = np.diff(words.texts)
    counts = np.maximum(n - size + 1, np.minimum(n, 1))
    first = ragged(words.texts[:-1], counts)
    last = first + np.repeat(np.minimum(n, size) - 1, counts)
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[first].tolist(), ends[last].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(first)), counts


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the bits that are set in over half of its hashes, as signed 64-bit integers."""
    out = np.zeros((len(counts), BITS), bool)
    some = np.flatnonzero(counts)
    if len(some):
        own = counts[some]
        parts = -(-own // 255)  # a byte counts to 255
        begins = np.repeat(np.cumsum(own) - own, parts) + 255 * ragged(np.zeros(len(own), np.int64), parts)
        bytes_of = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes = np.add.reduceat(SPREAD[bytes_of[:, k]], begins).view(np.uint8).reshape(-1, 8)
            totals = np.add.reduceat(lanes.astype(np.int64), np.cumsum(parts) - parts)
            out[some, 8 * k : 8 * k + 8] = 2 * totals > own[:, None]
    return np.packbits(out, axis=1, bitorder="little").view(np.int64).ravel()


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles: a multiplication and a shift mix all bits anew."""
    mixed = hashes * MIXER
    return (mixed ^ (mixed >> np.uint64(32))) * MIXER


def fingerprints(df: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): one row per row."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            hashes, counts = shingle_hashes(words_of(batch.column(1), NONSPACE), shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority_bits(hashes, counts))], ["doc_id", "fp"])

    return df.mapInArrow(prints, T.StructType([T.StructField("doc_id", df.schema[0].dataType), T.StructField("fp", T.LongType())]))


def segment_plan(segments: int, distance: int) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of each segment; radii as small as the pigeonhole principle allows."""
    small, more = divmod(distance, segments)
    out, offset = [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        radius = small if i <= more else small - 1
        if radius >= 0:
            out.append((offset, width, radius))
        offset += width
    return out


def balls(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``width`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def entries(fps: DataFrame, plan: list[tuple[int, int, int]], asks: bool) -> DataFrame:
    """``fps`` with a row for each key: the values in a ball around each segment.

    Two segments that differ in at most r bits have a value between them: the
    side that asks enumerates a ball of radius ceil(r / 2), and the table holds
    one of floor(r / 2), which are far fewer rows than a ball of r on one side.
    """
    parts = []
    for seg, (offset, width, radius) in enumerate(plan):
        masks = ", ".join(f"{m}L" for m in balls(width, -(-radius // 2) if asks else radius // 2))
        parts.append(f"transform(array({masks}), m -> ((shiftrightunsigned(fp, {offset}) & {(1 << width) - 1}L) ^ m) | ({seg}L << 40))")
    return fps.withColumn("key", F.explode(F.expr(f"concat({', '.join(parts)})")))


def half_way(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) through half-way points: a is the smallest fingerprint whose ball holds the point."""
    masks = lambda r: F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)) for m in balls(BITS, r)])
    near = lambda r: fps.select("fp", F.explode(masks(r)).alias("m")).select("fp", F.expr("fp ^ m").alias("point"))
    far, close = near(-(-distance // 2)), near(distance // 2)
    if distance % 2 == 0:
        least = far.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
        return far.join(least, "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    # odd distances: points of the larger ball link to the fingerprints whose smaller ball holds them
    both = far.withColumn("inner", F.lit(False)).unionByName(close.withColumn("inner", F.lit(True)))
    least = both.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("a")).where("a is not null")
    return both.join(least, "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, distance: int = MAX_DISTANCE, segments: int | None = None, hot_bucket: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps`` (fp) whose connected components are those
    of all pairs that differ in at most ``distance`` bits. Outside hot buckets, all these pairs.

    ``segments``: by default four, three beyond 2**19 fingerprints and two
    beyond 2**24, so that a segment has about as many values as there are
    fingerprints. The links are the same for any number.

    Where half-way balls would have a radius above three (a distance above six),
    hot buckets are joined like any other, and split by Spark's skew join.
    """
    if segments is None:
        n = fps.count()
        segments = 4 if n <= 1 << 19 else 3 if n <= 1 << 24 else 2
    plan = segment_plan(segments, distance)
    close = f"a < b AND bit_count(a ^ b) <= {distance}"
    asks, has = entries(fps, plan, True).withColumnRenamed("fp", "a"), entries(fps, plan, False).withColumnRenamed("fp", "b")
    if distance > 6:
        return asks.join(has, "key").where(close).select("a", "b").distinct()
    hot = written(has.groupBy("key").count().where(F.col("count") > hot_bucket).select("key"), "hot_segments")
    if hot.isEmpty():
        return asks.join(has, "key").where(close).select("a", "b").distinct()
    # both sides lose the hot keys, and the fingerprints on either side of them go the other way
    pairs = asks.join(hot, "key", "left_anti").join(has.join(hot, "key", "left_anti"), "key").where(close).select("a", "b")
    sides = asks.select("key", F.col("a").alias("fp")).unionByName(has.select("key", F.col("b").alias("fp")))
    crowd = written(sides.join(hot, "key", "left_semi").select("fp").distinct(), "hot_fingerprints")
    return pairs.unionByName(half_way(crowd, distance)).distinct()


def near_duplicate_groups(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, segments: int | None = None, hot_bucket: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``documents`` (doc_id, text)."""
    prints = written(fingerprints(documents.select("doc_id", "text"), shingle_words), "fingerprints")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct_fingerprints")
    roots = components(links(fps.select("fp"), distance, segments, hot_bucket))
    rooted = written(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    # a table of its own, so that the join can split the rows of one large component
    least = written(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "component_least")
    named = written(rooted.join(least, "root").select("fp", "component_id"), "component_ids")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = near_duplicate_groups(documents)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
