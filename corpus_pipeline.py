"""A corpus through quality rules, dedup, decontamination and tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of their ``docs``. They hold for null and empty texts, ties,
repeated rows, empty tables and further columns, as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, line_dedup, near_sets, quality_rules
from lodestone.llm.shared import unused, written

#: Near copies: five-word shingles with a similarity of 0.8 or more.
SHINGLE_WORDS = 5


def counted(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars (if there is one) that of the text as it is now."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many have; those that had nothing else go."""
    out = line_dedup.dedup_lines(docs)
    n_lines, n_dropped = out.columns[-2:]
    return counted(out.where(F.col(n_dropped) < F.col(n_lines)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    The families that fingerprints show first, then all other pairs of that similarity.

    Rows that repeat doc_id and text are one document. Rows that share a doc_id
    but not the text are each kept if that doc_id is the smallest of their group.
    """
    groups = near_sets.near_copy_groups(docs, SHINGLE_WORDS)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    (kept_id,) = unused(docs, "kept_doc_id")
    kept = docs.join(first.withColumnRenamed("doc_id", kept_id), F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    repeated = groups.groupBy("doc_id").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are hardly anything else go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return counted(decontaminate.decontaminate(docs, benchmark), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return bpe.token_report(docs, bpe.default_tokenizer(spark))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", contamination),
    ("bpe", tokens),
]

#: SQL cannot express connected components and byte-pair merges; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
