"""Line-delimited JSON: evaluation datasets, quarantine and baseline files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "id STRING, query STRING, expected_document_ids ARRAY<STRING>, expected_chunk_ids ARRAY<STRING>, reference_answer STRING, tags ARRAY<STRING>, metadata STRING"


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases. Blank lines and those that begin with // are skipped; a bad line or a repeated id is an error."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(//.*)?$"))
    cases = lines.select(F.from_json("value", CASE, {"mode": "FAILFAST"}).alias("case")).select("case.*")
    none = F.array().cast("array<string>")
    cases = cases.withColumns({c: F.coalesce(c, none) for c in ("expected_document_ids", "expected_chunk_ids", "tags")})
    twice = cases.groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).collect()
    if twice:
        raise ValueError(f"case id {twice[0].id!r} is missing or repeated in {path}")
    return cases


def write_dataset(cases: DataFrame, path: str) -> None:
    """One object for each case, keys sorted, nulls and empty lists left out."""
    plain = [F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in sorted(cases.dtypes)]
    cases.select(F.to_json(F.struct(*plain)).alias("value")).write.mode("overwrite").text(path)


def write_quarantine(rows: DataFrame, path: str) -> None:
    """The quarantine of a run; each run replaces the file of the last."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def write_baseline(suite: str, k: int, metrics: DataFrame, cases: DataFrame, path: str) -> None:
    """A suite's metrics (metric, value), and those of its cases (query_id, metric, value), as one object, which grows with the suite's cases."""
    own = metrics.select(F.lit(None).cast("string").alias("case"), "metric", "value")
    rows = own.unionByName(cases.select(F.col("query_id").cast("string").alias("case"), "metric", "value"))
    maps = rows.groupBy("case").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("own"))
    listed = F.collect_list(F.when(F.col("case").isNotNull(), F.struct("case", "own")))
    whole = maps.agg(F.any_value(F.when(F.col("case").isNull(), F.col("own")), True).alias("metrics"), F.map_from_entries(listed).alias("cases"))
    whole.select(F.lit(suite).alias("suite"), F.lit(k).alias("k"), "metrics", "cases").coalesce(1).write.mode("overwrite").json(path)


def read_case_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, metric, baseline) rows of a baseline file."""
    whole = spark.read.schema("cases MAP<STRING,MAP<STRING,DOUBLE>>").json(path, multiLine=True)
    return whole.select(F.explode("cases").alias("query_id", "own")).select("query_id", F.explode("own").alias("metric", "baseline"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(metric, baseline) rows of a baseline file."""
    whole = spark.read.schema("suite STRING, k INT, metrics MAP<STRING,DOUBLE>").json(path, multiLine=True)
    return whole.select(F.explode("metrics").alias("metric", "baseline"))
