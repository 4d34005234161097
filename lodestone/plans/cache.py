"""Searches and rankings through a cache: what is known by its key is read, the rest is computed once for each key, and kept.

A key names all that a result follows from: the index and its epoch, the model,
the text, the filter and the parameters; a new epoch makes new keys, so old
entries are never wrong, only unused. An entry is a list of at most k hits. Keys
and entries are met by a join, so neither side passes the driver. Queries that share a key are
computed once. If all keys are known, nothing is computed, and no plan for it is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions.filters import Filter
from lodestone.operators import retrieve
from lodestone.plans import answer
from lodestone.sources.tables import Conflict, Store, Table, cached

#: How often entries are written anew after another writer's commit.
TRIES = 5


def cache_table(store: Store, name: str, id_type: str = "string") -> Table:
    """Entries by key: hits (id, score, rank), and when they expire (null: never), in seconds."""
    return Table(store, name, f"key string, value array<struct<id:{id_type},score:double,rank:int>>, expires_at double", ["key"], unique=True)


def split(keyed: DataFrame, entries: DataFrame, now: float, usable: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, with their value; misses) of ``keyed`` (key, ...). An entry that has expired, or isn't ``usable`` (over both sides' columns), is a miss."""
    found, missed = cached(keyed, entries, F.lit(now))
    if usable is None:
        return found, missed
    fit = F.coalesce(usable, F.lit(False))
    return found.where(fit), missed.unionByName(found.where(~fit).drop("value"))


def once_each(missed: DataFrame) -> DataFrame:
    """One row of each key; what differs between rows of one key does not count for its result."""
    return missed.dropDuplicates(["key"])


def entries_of(missed: DataFrame, results: DataFrame, expires_at: float | None) -> DataFrame:
    """(key, value, expires_at) of every missed key, from its results (key, id, score, rank). A key without results has an empty entry, which counts as known."""
    lists = results.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("value"))
    rows = missed.select("key").distinct().join(lists, "key", "left")
    none = F.array().cast(lists.schema["value"].dataType)
    hit = lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), x["rank"].cast("int").alias("rank"))
    return rows.select("key", F.transform(F.coalesce("value", none), hit).alias("value"), F.lit(expires_at).cast("double").alias("expires_at"))


def opened(keyed: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, id, score, rank) of ``keyed`` (key, query_id)."""
    return keyed.select("key", "query_id").join(entries.select("key", "value"), "key").select("query_id", F.inline("value"))


def through(keyed: DataFrame, cache: Table, compute: Callable[[DataFrame], DataFrame], now: float, ttl: float | None = None, usable: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank) of every row of ``keyed`` (key, query_id, ...).

    ``compute`` makes results (key, id, score, rank) of rows with distinct keys.
    They are committed before anything is returned, and what is returned is read
    from that version. A commit that another writer forestalls is made again.
    """
    store = cache.store
    snapshot = store.snapshot()
    _, missed = split(keyed, cache.read(snapshot), now, usable)
    if not missed.isEmpty():
        missed = store.staged(once_each(missed), "missed")
        new = store.staged(entries_of(missed, compute(missed), None if ttl is None else now + ttl), "entries")
        for left in reversed(range(TRIES)):
            try:
                snapshot = cache.upsert(new)
                break
            except Conflict:
                if not left:
                    raise
        store.clear_staging()
    return opened(keyed, cache.read(snapshot))


def search_keys(questions: DataFrame, index: str, epoch: int, model: str, k: int, condition: Filter | None = None, min_score: float | None = None, namespace: str | None = None) -> DataFrame:
    """``questions`` (query_id, query, ...) with the key of their search."""
    chosen = ids.stable_hash(None if condition is None else condition.to_json())
    params = ids.stable_hash({"k": k, "min_score": min_score, "namespace": namespace})
    return questions.withColumn("key", ids.retrieval_key(index, F.lit(epoch), model, F.col("query"), chosen, params))


def retrieved_through(cache: Table, index: DataFrame, questions: DataFrame, name: str, epoch: int, now: float, ttl: float | None = None, k: int = 20, dimensions: int = 64, condition: Filter | None = None, min_score: float | None = None, namespace: str | None = None) -> DataFrame:
    """As ``answer.retrieved``, of which only the searches that the cache does not know are made. ``name``, ``epoch``: of the index."""
    keyed = search_keys(questions, name, epoch, f"lexical-{dimensions}", k, condition, min_score, namespace)

    def search(missed: DataFrame) -> DataFrame:
        asked = missed.select(F.col("key").alias("query_id"), "query")
        hits = answer.retrieved(index, asked, k, dimensions, condition, min_score, namespace)
        return hits.select(F.col("query_id").alias("key"), "id", "score", "rank")

    return answer.with_texts(through(keyed, cache, search, now, ttl), answer.in_namespace(index, namespace))


def ranking_keys(candidates: DataFrame, model: str) -> DataFrame:
    """(query_id, key, query, candidates: their number) of candidates (query_id, id, query, text), which are a top-k."""
    lists = candidates.groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list("id")).alias("ids"))
    names = F.transform("ids", lambda x: x.cast("string"))
    return lists.select("query_id", ids.rerank_key(model, F.col("query"), names).alias("key"), "query", F.size("ids").alias("candidates"))


def reranked_through(cache: Table, candidates: DataFrame, k: int, now: float, ttl: float | None = None, model: str = "overlap") -> DataFrame:
    """As ``retrieve.reranked``, of which only the queries are ranked that the cache does not know, or knows too few of."""
    keyed = ranking_keys(candidates, model)
    usable = retrieve.usable_ranking(F.col("value"), k, F.col("candidates"))

    def rank(missed: DataFrame) -> DataFrame:
        own = candidates.join(missed.select("query_id", "key"), "query_id", "left_semi")
        return retrieve.reranked(own, k).join(missed.select("query_id", "key"), "query_id").select("key", "id", "score", "rank")

    return through(keyed, cache, rank, now, ttl, usable).where(F.col("rank") < k)
