"""From questions to cited answers: embed, retrieve, pack, answer, check."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import guards, vectors
from lodestone.functions.filters import Filter, compiled, implied, shadow
from lodestone.operators import context, generate, retrieve


def in_namespace(index: DataFrame, namespace: str | None) -> DataFrame:
    """The records of one namespace; None is that of records without one, which "" is not."""
    return index.where(F.col("namespace").eqNullSafe(F.lit(namespace).cast("string")))


def visible(index: DataFrame, condition: Filter) -> Column:
    """Whether records pass a filter over their metadata and document_id."""
    return compiled(condition, F.col("metadata"), {"document_id": F.col("document_id")})


def declared(index: DataFrame) -> dict[str, tuple[Column, str]]:
    """The columns of the index that stand for metadata fields, and their types."""
    head = shadow("")
    return {c.removeprefix(head): (F.col(f"`{c}`"), t) for c, t in index.dtypes if c.startswith(head)}


def with_texts(hits: DataFrame, index: DataFrame) -> DataFrame:
    texts = index.select("id", "text", "metadata", "document_id", F.col("chunk_index").alias("index"), F.col("heading_path").alias("source"))
    return hits.join(texts, "id")


def embedded_questions(questions: DataFrame, dimensions: int, *more: str) -> DataFrame:
    return vectors.embedded(questions, "query", "vector", dimensions, "query").select("query_id", "vector", *more)


def retrieved(index: DataFrame, questions: DataFrame, k: int = 20, dimensions: int = 64, condition: Filter | None = None, min_score: float | None = None, namespace: str | None = None) -> DataFrame:
    """(query_id, query) -> hits of an index table: query_id, id, score, rank, text, metadata, document_id, index, source.

    ``namespace``: None for the records without one. The filter sees the records'
    metadata, and their document_id; what it says of declared fields reaches the
    scan.
    """
    rows = in_namespace(index, namespace)
    if condition is not None:
        rows = rows.where(visible(rows, condition))
        if (pushed := implied(condition, declared(index))) is not None:
            rows = rows.where(pushed)
    hits = retrieve.batch_top_k(rows, embedded_questions(questions, dimensions), k, min_score=min_score)
    return with_texts(hits, rows)


def masked(rows: DataFrame, conditions: list[Filter]) -> Column:
    """A bit vector for each record, as words of 64 bits: bit n says whether it passes the n-th filter."""
    bits = [F.shiftleft(visible(rows, c).cast("bigint"), n % 64) for n, c in enumerate(conditions)]
    words = [reduce(lambda a, b: a.bitwiseOR(b), bits[n : n + 64]) for n in range(0, len(bits), 64)]
    return F.array(*words)


def retrieved_for(index: DataFrame, questions: DataFrame, filters: dict[str, Filter], by: str = "principal", k: int = 20, dimensions: int = 64, min_score: float | None = None, namespace: str | None = None) -> DataFrame:
    """(query_id, query, principal): each question sees only what the filter of its principal lets through; one without a filter sees nothing.

    One search for all: every record gets a bit for each different filter, in one
    projection, and a query's scores are masked by its own. Scans do not grow with
    the number of principals.
    """
    rows = in_namespace(index, namespace)
    conditions = list({json.dumps(f.to_json(), sort_keys=True): f for f in filters.values()}.values())
    if not conditions:
        return with_texts(retrieve.batch_top_k(rows, embedded_questions(questions, dimensions).limit(0), k), rows)
    number = {json.dumps(f.to_json(), sort_keys=True): n for n, f in enumerate(conditions)}
    bit_of = questions.sparkSession.createDataFrame([(name, number[json.dumps(f.to_json(), sort_keys=True)]) for name, f in filters.items()], f"`{by}` string, bit int")
    asked = embedded_questions(questions.join(bit_of, by), dimensions, "bit")
    hits = retrieve.batch_top_k(rows.withColumn("bits", masked(rows, conditions)), asked, k, min_score=min_score, bits=True)
    return with_texts(hits, rows)


def answers(index: DataFrame, questions: DataFrame, k: int = 20, budget: int = 4000, dimensions: int = 64, policy: str = "abstain") -> DataFrame:
    """(query_id, query) -> query_id, answer, context, grounded (the share of supported claims)."""
    kept = context.packed(retrieved(index, questions, k, dimensions), budget).where("dropped IS NULL")
    items = context.cited(context.ordered(kept))
    shown = context.rendered(items, questions)
    passages = items.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("citation_key", "text"))).alias("passages"))
    rows = questions.join(shown, "query_id").join(passages, "query_id", "left")
    first = F.try_element_at("passages", F.lit("1"))
    answer = generate.answered(F.coalesce(F.map_contains_key("passages", F.lit("1")).cast("int"), F.lit(0)), first, F.lit("1"), F.col("query"), policy)
    rows = rows.withColumn("answer", answer)
    share = F.when(F.col("passages").isNotNull(), guards.groundedness(F.col("answer"), F.col("passages"))).otherwise(1.0)
    return rows.select("query_id", "answer", "context", share.alias("grounded"))
