"""Caches in the path of searches and rankings, tokenizers as measures, and records of what was refused."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import guards, tokens
from lodestone.operators import context, generate, retrieve, validate
from lodestone.plans import answer, cache
from lodestone.sources import jsonl
from lodestone.sources.tables import Conflict, Store

HITS = ["query_id", "id", "score", "rank"]


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or HITS)).collect())


@pytest.fixture(scope="module")
def index(spark):
    texts = [(None, f"r{n:02}", f"passage {n} about subject {n % 7} and {n % 5}", "{}", f"d{n}", 0, None) for n in range(60)]
    df = spark.createDataFrame(texts, "namespace string, id string, text string, metadata string, document_id string, chunk_index int, heading_path string")
    return answer.vectors.embedded(df, "text", "vector", 16, "document").withColumn("metadata", F.parse_json("metadata"))


def test_a_search_is_made_once_for_each_key(spark, index, tmp_path, monkeypatch):
    table = cache.cache_table(Store(spark, str(tmp_path / "s")), "searches")
    asked = spark.createDataFrame([("q1", "subject 3"), ("q2", " subject   3 "), ("q3", "passage 11")], "query_id string, query string")
    made = []
    search = answer.retrieved
    monkeypatch.setattr(answer, "retrieved", lambda index, asked, *more: made.append(asked.count()) or search(index, asked, *more))
    ask = lambda epoch, now, df=asked, **more: rows(cache.retrieved_through(table, index, df, "i", epoch, now, 100.0, 5, 16, **more))
    want = rows(search(index, asked, 5, 16))
    assert ask(1, 0.0) == want and len(want) == 15 and made == [2]
    assert ask(1, 50.0) == want and made == [2]  # all known: no plan of a search is made
    assert "MapInArrow" not in cache.retrieved_through(table, index, asked, "i", 1, 50.0, 100.0, 5, 16)._jdf.queryExecution().toString()
    more = asked.unionByName(spark.createDataFrame([("q4", "passage 12")], asked.schema))
    assert len(ask(1, 60.0, more)) == 20 and made == [2, 1]
    assert ask(1, 120.0) == want and made == [2, 1, 2]  # expired
    assert ask(2, 120.0) == want and made == [2, 1, 2, 2]  # a new epoch
    nothing = ask(2, 120.0, min_score=2.0)
    assert nothing == ask(2, 121.0, min_score=2.0) == [] and made == [2, 1, 2, 2, 2]  # an empty result is known too


def test_a_commit_of_entries_is_made_again(spark, index, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    table, asked = cache.cache_table(store, "searches"), spark.createDataFrame([("q1", "subject 3")], "query_id string, query string")
    publish, failed = store.publish, []

    def late(after, changes):
        if len(failed) < 2:
            failed.append(1)
            raise Conflict("another writer")
        return publish(after, changes)

    monkeypatch.setattr(store, "publish", late)
    assert len(rows(cache.retrieved_through(table, index, asked, "i", 1, 0.0, k=5, dimensions=16))) == 5 and len(failed) == 2


def test_rankings_through_a_cache(spark, tmp_path):
    table = cache.cache_table(Store(spark, str(tmp_path / "s")), "rankings")
    words = ["red", "green", "blue", "black"]
    own = [(f"q{q}", f"d{n}", " ".join(words[: q + 1]), " ".join(words[n % 4 :])) for q in range(3) for n in range(6 - q)]
    candidates = spark.createDataFrame(own, "query_id string, id string, query string, text string")
    ask = lambda k: rows(cache.reranked_through(table, candidates, k, 0.0))
    for k in (2, 3, 2, 6, 10):
        assert ask(k) == rows(retrieve.reranked(candidates, k))
    assert table.read().count() == 3
    # entries that are too short for what is asked, but as long as there are candidates, are used
    version = table.store.snapshot().version
    assert len(ask(20)) == 15 and table.store.snapshot().version == version


def test_a_tokenizer_as_measure(spark):
    def count(text):
        if "bad" in text:
            raise RuntimeError("no such character")
        return -1 if "negative" in text else None if "none" in text else 7

    texts = ["fine", "a bad text", "negative", "none at all", "", None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    got = {r.n: r.tokens for r in df.select("n", tokens.measured(count)(F.col("text")).alias("tokens")).collect()}
    assert got == {0: 7, 1: 3, 2: 2, 3: 3, 4: 7, 5: 0}
    hits = spark.createDataFrame([("q", f"d{n}", 1.0 - n / 10, None, t) for n, t in enumerate(["x" * 100, "a bad one", "fine"])], "query_id string, id string, score double, source string, text string")
    fate = {r.id: (r.cost, r.dropped) for r in context.packed(hits, 20, "preamble", measure=tokens.measured(count)).collect()}
    assert fate == {"d0": (7, None), "d1": (4, None), "d2": (7, "token_budget")}


def test_refusals_say_why(spark):
    texts = [("a", 0, "c0", "u", "  "), ("a", 1, "c1", "u", "x"), ("a", 2, "c2", "u", "many words " * 9), ("a", 3, "c3", "u", "many words " * 9), ("a", 4, "c4", "u", "y" * 500), ("a", 5, "c5", "u", "-" * 40)]
    df = spark.createDataFrame(texts, "document_id string, index int, chunk_id string, source_uri string, text string")
    out = {r.chunk_id: r for r in validate.rejections(validate.validated(df, validate.Limits(100, 8, 0.75))).collect()}
    assert {k: r.rule for k, r in out.items()} == {"c0": "empty", "c1": "too_short", "c3": "duplicate", "c4": "too_long", "c5": "boilerplate"}
    assert out["c4"].reason == "125 tokens, at most 100 fit" and out["c1"].reason == "1 tokens, at least 8 are wanted"
    assert all(r.reason and r.source_uri == "u" for r in out.values())


def test_answers_that_were_not_given_are_not_checked(spark):
    df = spark.createDataFrame([(n, "Nothing here has any support at all.", n != 1) for n in range(2)] + [(2, "Nothing here has any support at all.", None)], "n int, answer string, answered boolean")
    guard = guards.groundedness_guard(F.col("answer"), F.create_map(F.lit("1"), F.lit("other")), answered=F.col("answered"))
    assert [r.action for r in df.select("n", guard["action"].alias("action")).orderBy("n").collect()] == ["flag", "allow", "flag"]


def test_variables_are_ascii():
    assert generate.VARIABLE.findall("{{ a_1 }} {{ é }} {{ aé }} {{x}}") == ["a_1", "x"]


def test_a_baseline_is_written_and_read(spark, tmp_path):
    metrics = spark.createDataFrame([("mrr", 0.5), ("recall@5", 0.25)], "metric string, value double")
    cases = spark.createDataFrame([(1, "mrr", 1.0), (2, "mrr", 0.0), (2, "recall@5", None)], "query_id int, metric string, value double")
    path = str(tmp_path / "baseline")
    jsonl.write_baseline("suite", 5, metrics, cases, path)
    assert rows(jsonl.read_baseline(spark, path), "metric", "baseline") == [("mrr", 0.5), ("recall@5", 0.25)]
    assert rows(jsonl.read_case_baseline(spark, path).where("baseline IS NOT NULL"), "query_id", "metric", "baseline") == [("1", "mrr", 1.0), ("2", "mrr", 0.0)]
