"""Usage, prices, budgets and metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: US dollars for a million tokens in, out, embedded, and for a call.
PRICES = [
    ("openai/gpt-4o", 2.50, 10.00, None, None),
    ("openai/gpt-4o-mini", 0.15, 0.60, None, None),
    ("openai/gpt-4.1", 2.00, 8.00, None, None),
    ("openai/gpt-4.1-mini", 0.40, 1.60, None, None),
    ("openai/gpt-4.1-nano", 0.10, 0.40, None, None),
    ("openai/o3-mini", 1.10, 4.40, None, None),
    ("openai/text-embedding-3-small", None, None, 0.02, None),
    ("openai/text-embedding-3-large", None, None, 0.13, None),
    ("openai/text-embedding-ada-002", None, None, 0.10, None),
    ("anthropic/claude-3-5-haiku-latest", 0.80, 4.00, None, None),
    ("anthropic/claude-3-7-sonnet-latest", 3.00, 15.00, None, None),
    ("anthropic/claude-sonnet-4-0", 3.00, 15.00, None, None),
    ("anthropic/claude-opus-4-0", 15.00, 75.00, None, None),
    ("cohere/rerank-v3.5", None, None, None, 0.002),
]
SCHEMA = "model_id STRING, in_price DOUBLE, out_price DOUBLE, embed_price DOUBLE, call_price DOUBLE"


def price_table(spark: SparkSession, prices: list[tuple] = PRICES) -> DataFrame:
    return spark.createDataFrame(prices, SCHEMA)


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model_id, tokens_in, tokens_out, tokens_embedded, calls) with cost_usd: 0 for fake/ models, null for unknown ones."""
    rows = usage.join(F.broadcast(prices), "model_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    known = F.coalesce("in_price", "out_price", "embed_price", "call_price").isNotNull()
    tokens = F.col("tokens_in") * zero("in_price") + F.col("tokens_out") * zero("out_price") + F.col("tokens_embedded") * zero("embed_price")
    cost = F.when(F.col("model_id").startswith("fake/"), 0.0).when(known, tokens / 1e6 + F.col("calls") * zero("call_price"))
    return rows.withColumn("cost_usd", cost).drop("in_price", "out_price", "embed_price", "call_price")


def by_step(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Sums for each step; a call of unknown cost makes the step's cost unknown, and so does having none."""
    unknown = F.count_if((F.col("calls") > 0) & F.col("cost_usd").isNull())
    return usage.groupBy(*keys).agg(
        F.sum("calls").alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.bool_or("estimated").alias("estimated"),
        F.when(unknown == 0, F.sum("cost_usd")).alias("cost_usd"),
    )


def exceeded(totals: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(what, observed, limit) of the budgets that are exceeded, in the order cost, calls, tokens, steps; unknown cost never is."""
    order = [c for c in ("cost_usd", "calls", "tokens", "steps") if c in limits]
    rows = [F.struct(F.lit(n).alias("place"), F.lit(c).alias("what"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("observed"), F.lit(float(limits[c])).alias("limit")) for n, c in enumerate(order)]
    return totals.select(F.explode(F.array(*rows)).alias("b")).select("b.*").where("observed > limit").orderBy("place").drop("place")


def series(samples: DataFrame) -> DataFrame:
    """(kind, name, labels, ts, value) -> counter sums, histogram counts and sums, and last gauge values."""
    counted = samples.groupBy("kind", "name", "labels").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max_by("value", F.struct("ts", "value")).alias("last"))
    return counted.select("kind", "name", "labels", F.when(F.col("kind") == "histogram", F.col("n")).alias("n"), F.when(F.col("kind") == "gauge", F.col("last")).otherwise(F.col("total")).alias("value"))


def prometheus(rows: DataFrame) -> DataFrame:
    """A text line for each series."""
    labels = F.when(F.col("labels") != "", F.concat(F.lit("{"), F.col("labels"), F.lit("}"))).otherwise("")
    return rows.select(F.concat(F.col("name"), labels, F.lit(" "), F.col("value").cast("string")).alias("line"))
