"""Parsing, chunking, validation, sources, sync, retrieval, context and evaluation."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions.tokens import estimate
from lodestone.operators import chunk, context, evaluate, generate, parse, retrieve, sync, usage, validate
from lodestone.plans.pipeline import Pipeline, Step
from lodestone.sources import files, jsonl, tables
from lodestone.streaming.sync_stream import chunk_table, sync_stream

MARKDOWN = """# Billing
Intro text here.

## Refunds
- one
- two

Setext
------
```python
# not a heading

x = 1
```
Last line
"""


def test_markdown_blocks():
    got = [(b[0], b[1], b[2]) for b in parse.markdown(MARKDOWN)]
    assert got == [
        ("heading", "Billing", 1),
        ("paragraph", "Intro text here.", None),
        ("heading", "Refunds", 2),
        ("list", "- one\n- two", None),
        ("heading", "Setext", 2),
        ("code", "```python\n# not a heading\n\nx = 1\n```", None),
        ("paragraph", "Last line", None),
    ]
    for kind, text, _, a, b in parse.markdown(MARKDOWN):
        assert text in MARKDOWN[a:b] and (kind == "heading" or MARKDOWN[a:b].strip() == text)
    assert parse.markdown("```\nopen") == [("code", "```\nopen", None, 0, 8)]
    assert parse.markdown("") == []


def test_parsers(spark):
    rows = [(1, "text/markdown", MARKDOWN.encode()), (2, "text/plain", b"a\xff b\n \t\n\nc"), (3, "text/plain", b" \n"), (4, "image/png", b"x")]
    good, bad = parse.parsed(spark.createDataFrame(rows, "document_id int, media_type string, content binary"))
    got = {x.document_id: x for x in good.collect()}
    assert set(got) == {1, 2} and len(got[1].blocks) == 7
    assert got[2].text == "aÿ b\n \t\n\nc" and got[2].parse_warnings == ["not UTF-8; read as Latin-1"]
    assert [(b.text, got[2].text[b.start : b.end].strip()) for b in got[2].blocks] == [("aÿ b", "aÿ b"), ("c", "c")]
    assert {x.document_id for x in bad.collect()} == {3, 4}
    j = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("no",)], "t string").select(F.to_json(parse.tolerant_json(F.col("t"))).alias("j")).collect()
    assert [x.j for x in j] == ['{"a":1}', None]


def block(text, kind="paragraph", level=None, at=0):
    return {"kind": kind, "text": text, "level": level, "start": at, "end": at + len(text)}


def test_chunks():
    size = chunk.ChunkSize(20, 5, 3)
    r = random.Random(1)
    for _ in range(50):
        blocks = [block(" ".join("w" * r.randrange(1, 9) + r.choice([".", ""]) for _ in range(r.randrange(1, 40))), *r.choice([("paragraph", None), ("heading", 1), ("heading", 2)])) for _ in range(5)]
        got = chunk.chunks_of(blocks, size)
        words = [w for b in blocks for w in b["text"].split()]
        seen = [w for c in got for w in c["body"].split()]
        it = iter(seen)
        assert all(w in it for w in words)  # nothing is lost, order is kept
        whole = max((estimate(b["text"]) for b in blocks if b["kind"] == "heading"), default=0)  # a heading is never cut
        assert all(estimate(c["body"]) <= size.target + size.overlap + size.least + 8 + whole for c in got)
    got = chunk.chunks_of([block("A", "heading", 1), block("x" * 40), block("B", "heading", 2), block("y" * 40), block("C", "heading", 1), block("z")], chunk.ChunkSize(50, 5, 0))
    assert [c["trail"] for c in got] == [["A"], ["A", "B"], ["C"]]
    code = chunk.pieces_of(block("\n".join("c" * 30 for _ in range(5)), "code"), 20)
    assert all(set(p) <= {"c", "\n"} for p in code) and "\n".join(code).count("c") == 150
    with pytest.raises(ValueError):
        chunk.ChunkSize(10, 10)


def test_chunk_rows(spark):
    blocks = [block("A", "heading", 1), block("text of a"), block("B", "heading", 2), block("text of b")]
    df = spark.createDataFrame([("doc_1", blocks), ("doc_2", [])], f"document_id string, blocks {parse.BLOCKS}")
    got = chunk.chunked(df, chunk.ChunkSize(50, 5, 0)).orderBy("index").collect()
    assert [x.text for x in got] == ["A\n\ntext of a", "A\n\nB\n\ntext of b"]
    assert [x.heading_path for x in got] == ["A", "A > B"] and all(x.trust == "untrusted" for x in got)
    assert len({x.chunk_id for x in got}) == 2


def test_validation(spark):
    good = "A sentence that is long enough to be kept."
    rows = [(1, 0, good), (1, 1, " \n"), (1, 2, "x"), (1, 3, "-- ** -- ** -- ** -- ** -- ** -- ** a"), (1, 4, good.replace(" ", "  ")), (2, 0, good), (2, 1, "w" * 500)]
    v = validate.validated(spark.createDataFrame(rows, "document_id int, index int, text string"), validate.Limits(100, 8, 0.25))
    got = {(x.document_id, x["index"]): x.rule for x in v.collect()}
    assert got == {(1, 0): None, (1, 1): "empty", (1, 2): "too_short", (1, 3): "boilerplate", (1, 4): "duplicate", (2, 0): None, (2, 1): "too_long"}
    assert [(x.document_id, x["index"]) for x in validate.accepted(v).collect()] == [(1, 0)]
    assert max(len(x.excerpt) for x in validate.rejections(v).collect()) == 123


def test_rules_outside_ascii(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("aB7é漢Ⅷ—…_- \t\xa0\u3000*") for _ in range(r.randrange(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = rows.select("n", validate.rule_of(F.col("t"), F.length("t"), validate.Limits(20, 3, 0.5)).alias("rule")).orderBy("n").collect()

    def rule(t):
        bare = "".join(t.split())
        letters = sum(unicodedata.category(c)[0] in "LN" for c in bare)
        return "empty" if not bare else "too_long" if len(t) > 20 else "too_short" if len(t) < 3 else "boilerplate" if letters / len(bare) < 0.5 else None

    assert [x.rule for x in got] == [rule(t) for t in texts]


def test_listing_and_stream(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# T\n\nSome text of the document.")
    (root / "sub" / "b.txt").write_text("plain text")
    (root / "sub" / "c.png").write_bytes(b"x")
    got = {x.id: x for x in files.listing(spark, str(root), exclude=("a.*",)).collect()}
    assert set(got) == {"sub/b.txt"} and got["sub/b.txt"].folder == "sub" and got["sub/b.txt"].size_bytes == 10
    full = files.fetched(spark, str(root), files.listing(spark, str(root)))
    assert {(x.id, bytes(x.content)) for x in full.collect()} == {("a.md", b"# T\n\nSome text of the document."), ("sub/b.txt", b"plain text")}
    table = chunk_table(tables.Store(spark, str(tmp_path / "store")))
    for text in (None, "# T\n\nOther text.\n\n# U\n\nMore."):
        if text:
            (root / "d.md").write_text(text)
        sync_stream(spark, str(root / "*.md"), table, str(tmp_path / "cp")).awaitTermination()
    assert sorted(x.heading_path for x in table.read().collect()) == ["T", "T", "U"]


def test_jsonl(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('// note\n\n{"id": "1", "query": "q", "expected_document_ids": ["d"], "tags": ["x"]}\n{"id": "2", "query": "r"}\n')
    cases = jsonl.load_dataset(spark, str(good))
    assert [(x.id, x.tags) for x in cases.orderBy("id").collect()] == [("1", ["x"]), ("2", [])]
    jsonl.write_dataset(cases, str(tmp_path / "out"))
    assert jsonl.load_dataset(spark, str(tmp_path / "out")).count() == 2
    assert evaluate.with_tags(cases, ["x", "y"]).count() == 1
    good.write_text('{"id": "1"}\n{"id": "1"}\n')
    with pytest.raises(ValueError):
        jsonl.load_dataset(spark, str(good))


def test_sync_life(spark, tmp_path):
    """New, again, edited, deleted, and another model."""
    manifest = tables.Table(tables.Store(spark, str(tmp_path)), "m", "document_id STRING, revision STRING, status STRING, chunk_count INT", ["document_id"])
    listing = lambda rows: spark.createDataFrame(rows, "document_id string, revision string, size_bytes long")
    run = lambda rows, changed=False: {x.document_id: x.status for x in sync.diff(listing(rows), manifest.read(), changed).collect()}
    first = [("a", "1", 10), ("b", "1", 20)]
    assert run(first) == {"a": "added", "b": "added"}
    manifest.upsert(listing(first).select("document_id", "revision", F.lit("indexed").alias("status"), F.lit(1).alias("chunk_count")))
    assert run(first) == {"a": "unchanged", "b": "unchanged"}
    assert run(first, True) == {"a": "changed", "b": "changed"}
    assert run([("a", "2", 10)]) == {"a": "changed", "b": "deleted"}
    gone = sync.diff(listing(first[:1]), manifest.read()).where("status = 'deleted'")
    before = manifest.store.snapshot()
    manifest.commit(sync.tombstoned(manifest.read(before), gone), before)
    assert run(first) == {"a": "unchanged", "b": "added"} and run(first[:1]) == {"a": "unchanged"}
    plan = sync.plan(sync.diff(listing(first), manifest.read()), None).first()
    assert (plan.added, plan.tokens, plan.cost_usd) == (1, 5, None)
    assert manifest.store.snapshot().version == 2
    with pytest.raises(Exception, match="dimensions"):
        sync.same_width(spark.createDataFrame([([1.0],)], "vector array<double>"), 2).collect()


def test_store(spark):
    cache = spark.createDataFrame([("a:1", "x", None, 1), ("a:2", "y", 5, 2), ("b:1", "z", 50, 3)], "key string, value string, expires_at int, used_at int")
    keys = spark.createDataFrame([("a:1",), ("a:2",), ("c",)], "key string")
    found, missed = tables.cached(keys, cache, F.lit(10))
    assert [x.key for x in found.collect()] == ["a:1"] and sorted(x.key for x in missed.collect()) == ["a:2", "c"]
    assert sorted(x.key for x in tables.evicted(cache, 2).collect()) == ["a:2", "b:1"]
    assert [x.key for x in tables.without_prefix(cache, "a:").collect()] == ["b:1"]
    tape = spark.createDataFrame([("a:1", "r")], "key string, response string")
    assert tables.replayed(keys.limit(1), tape).first().response == "r"
    with pytest.raises(Exception, match="no recording"):
        tables.replayed(keys, tape).collect()


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_batch_top_k_equals_single(spark, metric):
    r = random.Random(2)
    rows = [(i, [float(r.randrange(3)) for _ in range(4)]) for i in range(60)] + [(60, []), (61, [0.0] * 4)]
    records = spark.createDataFrame(rows, "id int, vector array<float>")
    queries = spark.createDataFrame([(n, [float(r.randrange(3)) for _ in range(4)]) for n in range(7)] + [(7, [])], "query_id int, vector array<double>")
    both = [retrieve.batch_top_k(records, queries, 5, metric, **way).collect() for way in ({}, {"most_broadcast": 3, "cell": (3, 17)})]
    for q in queries.collect():
        want = [(x.id, round(x.score, 6), x["rank"]) for x in retrieve.top_k(records, q.vector, 5, metric).collect()]
        for got in both:
            assert sorted((x.id, round(x.score, 6), x["rank"]) for x in got if x.query_id == q.query_id) == sorted(want)


def test_batch_top_k_over_many_batches(spark):
    r = random.Random(4)
    rows = [(f"r{i:03d}", [float(r.randrange(3)) for _ in range(3)]) for i in range(90)]
    records = spark.createDataFrame(rows, "id string, vector array<double>").coalesce(2)
    queries = spark.createDataFrame([(n, [float(r.randrange(3)) for _ in range(3)]) for n in range(4)], "query_id int, vector array<double>")
    whole = sorted(map(tuple, retrieve.batch_top_k(records, queries, 6, min_score=0.2).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, retrieve.batch_top_k(records, queries, 6, min_score=0.2).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in queries.collect():
        want = [(x.id, x["rank"]) for x in retrieve.top_k(records, q.vector, 6, min_score=0.2).collect()]
        assert [(x[1], x[3]) for x in whole if x[0] == q.query_id] == sorted(want)


def test_top_k_plan_is_bounded(spark):
    records = spark.range(1000).select("id", F.array(F.col("id").cast("double")).alias("vector"))
    plan = retrieve.top_k(records, [1.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_packing(spark):
    hits = [("q", "a", 0.9, "same"), ("q", "b", 0.8, "x" * 400), ("q", "c", 0.7, "same"), ("q", "d", 0.6, "small"), ("r", "a", 0.1, "x" * 400)]
    df = spark.createDataFrame(hits, "query_id string, id string, score double, text string").withColumns({"source": F.lit(None).cast("string"), "document_id": F.lit("d"), "index": F.lit(0)})
    got = {(x.query_id, x.id): x.dropped for x in context.packed(df, 20).collect()}
    assert got == {("q", "a"): None, ("q", "b"): "token_budget", ("q", "c"): "duplicate", ("q", "d"): None, ("r", "a"): "token_budget"}
    kept = context.packed(df, 20).where("dropped IS NULL")
    items = context.cited(context.ordered(kept, "relevance_with_edges"))
    text = {x.query_id: x.context for x in context.rendered(items, df.select("query_id").distinct(), "P").collect()}
    assert text["q"] == "<retrieved_context>\nP\n\n[1]\nsame\n\n[2]\nsmall\n</retrieved_context>"
    assert text["r"] == "<retrieved_context>\nP\n\n(no passages were retrieved)\n</retrieved_context>"
    assert [x.citation_key for x in context.cited(context.ordered(kept), "source").orderBy("id").collect()] == ["d#0", "d#0"]


def test_a_repeated_id_is_packed_once_for_each_hit(spark):
    hits = [("q", "a", 0.9, "one"), ("q", "a", 0.8, "two"), ("q", "a", 0.8, "one"), ("q", "b", 0.1, "y" * 400)]
    df = spark.createDataFrame(hits, "query_id string, id string, score double, text string").withColumn("source", F.lit(None).cast("string"))
    got = sorted((x.text[:3], x.dropped or "") for x in context.packed(df, 20).collect())
    assert got == [("one", ""), ("one", "duplicate"), ("two", ""), ("yyy", "token_budget")]


def test_only_changed_files_are_read(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"f [{n}].md").write_text(f"text {n}")
    entries = files.listing(spark, str(tmp_path))
    one = entries.where("id = 'f [2].md'")
    got = files.fetched(spark, str(tmp_path), one)
    assert [bytes(x.content) for x in got.collect()] == [b"text 2"]
    assert sum("%5B" in f or "[" in f for f in got.select("content").inputFiles()) <= 1 + 4  # the listing's four, and one
    none = files.fetched(spark, str(tmp_path), entries.where("id = ''"))
    assert none.count() == 0
    gone = spark.createDataFrame(one.collect(), one.schema)
    (tmp_path / "f [2].md").unlink()
    assert [x.content for x in files.fetched(spark, str(tmp_path), gone).collect()] == [None]
    assert files.fetched(spark, str(tmp_path), files.listing(spark, str(tmp_path)), most_listed=1).count() == 3


def test_stream_ids_and_quarantine(spark, tmp_path):
    from lodestone.functions.ids import document_id
    from lodestone.streaming.sync_stream import quarantine_table

    root = tmp_path / "docs"
    for folder in ("a", "b"):
        (root / folder).mkdir(parents=True)
        (root / folder / "x.md").write_text(f"# T\n\nText of {folder}.")
    (root / "a" / "empty.md").write_text(" ")
    store = tables.Store(spark, str(tmp_path / "store"))
    table, bad = chunk_table(store), quarantine_table(store)
    for folder in ("a", "b"):
        sync_stream(spark, str(root / folder), table, str(tmp_path / f"cp{folder}"), source_id=folder, quarantine=bad).awaitTermination()
    want = {r[0] for r in spark.createDataFrame([("a", "x.md"), ("b", "x.md")], "s string, p string").select(document_id(F.col("s"), F.col("p"))).collect()}
    assert {x.document_id for x in table.read().collect()} == want and [x.rule for x in bad.read().collect()] == ["parse"]


def test_headings_fences_and_roles():
    assert len(chunk.chunks_of([block("h " * 60, "heading", 1)], chunk.ChunkSize(20, 0, 0))) == 1
    assert [b[0] for b in parse.markdown("- a\n        ```\n# no\n        ```\nx")] == ["list", "code", "paragraph"]
    assert generate.sections("--- SYSTEM ---\nS") == [("system", "S")]


def test_cases_and_caches(spark):
    e = spark.createDataFrame([(["s:a/b.md", "doc_1", "plain", "plain"],)], "e array<string>").select(evaluate.resolved_documents(F.col("e")).alias("e")).first().e
    assert len(e) == 3 and e[0].startswith("doc_") and e[1:] == ["doc_1", "plain"]
    row = spark.range(1).select(*[retrieve.usable_ranking(F.array(F.lit(1), F.lit(2)), k, F.lit(n)).alias(f"c{k}{n}") for k, n in ((2, 9), (3, 9), (3, 2))], generate.fate(F.lit(0), "escalate").alias("f"), generate.fate(F.lit(2), "escalate").alias("g")).first()
    assert tuple(row) == (True, False, True, "escalated", None)


def test_metrics_by_hand(spark):
    rank = [("q", "a", 0, True), ("q", "b", 1, True), ("q", "c", 2, False), ("e", "z", 0, True)]
    ranking = spark.createDataFrame(rank, "query_id string, item_id string, rank int, included boolean")
    expected = spark.createDataFrame([("q", "b"), ("q", "c"), ("q", "x"), ("none", "y")], "query_id string, item_id string")
    got = {x.query_id: x.asDict() for x in evaluate.case_metrics(ranking, expected, 2).collect()}
    assert set(got) == {"q", "none"}
    q = got["q"]
    assert (q["hit_rate@2"], q["precision@2"], round(q["recall@2"], 6), q["mrr"], q["context_precision"]) == (1.0, 0.5, 0.333333, 0.5, 0.5)
    assert abs(q["ndcg@2"] - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-9
    assert all(v == 0 for k, v in got["none"].items() if k != "query_id")


def test_gate(spark):
    m = spark.createDataFrame([("mrr", 0.5), ("error_rate", 0.1)], "metric string, value double")
    t = spark.createDataFrame([("mrr", 0.6), ("error_rate", 0.2), ("hit", 0.1)], "metric string, threshold double")
    b = spark.createDataFrame([("mrr", 0.51), ("error_rate", 0.0)], "metric string, baseline double")
    assert {x.metric for x in evaluate.threshold_failures(m, t).collect()} == {"mrr", "hit"}
    assert {x.metric for x in evaluate.regressions(m, b).collect()} == {"error_rate"}
    assert evaluate.gate(m, t, b).first().passed is False
    costs = spark.createDataFrame([(1.0, False), (None, True)], "cost_usd double, errored boolean")
    assert tuple(evaluate.case_costs(costs).first()) == (1.0, 0.5)
    assert evaluate.case_costs(costs.withColumn("errored", F.lit(False))).first().total_cost_usd is None
    assert evaluate.percentile_latency(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "v double"), "v").first().p95 == pytest.approx(8.8)


def test_usage(spark):
    rows = [("openai/gpt-4o", 1000, 100, 0, 1), ("fake/m", 5, 5, 5, 1), ("what/ever", 1, 1, 1, 1)]
    u = usage.priced(spark.createDataFrame(rows, "model_id string, tokens_in long, tokens_out long, tokens_embedded long, calls long"), usage.price_table(spark))
    assert {x.model_id: x.cost_usd for x in u.collect()} == {"openai/gpt-4o": pytest.approx(0.0035), "fake/m": 0.0, "what/ever": None}
    totals = spark.createDataFrame([(None, 5, 100, 2)], "cost_usd double, calls int, tokens int, steps int")
    assert [x.what for x in usage.exceeded(totals, {"cost_usd": 0.0, "calls": 4, "tokens": 50, "steps": 9}).collect()] == ["calls", "tokens"]


def test_prompts_and_pipeline(spark):
    assert generate.sections("hi\n--- system ---\nS\n--- user ---\n\n--- assistant ---\nA") == [("user", "hi"), ("system", "S"), ("assistant", "A")]
    with pytest.raises(KeyError):
        generate.rendered("{{ a }}", {})
    row = spark.range(1).select(generate.rendered("x {{ a }} {{b}}", {"a": F.lit("{{ b }}"), "b": F.lit(1)}).alias("r"), generate.extractive(F.lit("Too short. This one has just enough words. No."), F.lit("1"), F.lit("q")).alias("e"), generate.answered(F.lit(0), F.lit(None).cast("string"), F.lit("1"), F.lit("q")).alias("n")).first()
    assert row.r == "x {{ b }} 1" and row.e == "This one has just enough words. [1]" and row.n == generate.ABSTENTION
    p = Pipeline("p", [Step("bad", lambda d: d.select("nope"), "skip"), Step("ok", lambda d: d.withColumn("y", F.lit(1)))])
    assert p.run(spark.range(1)).columns == ["id", "y"] and p.degradations[0][0] == "bad" and p.describe() == "p: bad -> ok"
    with pytest.raises(ValueError):
        Pipeline("p", [Step("a", lambda d: d), Step("a", lambda d: d)])


def test_queries_equal_their_sql(spark):
    import duckdb

    from lodestone.plans.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "orders events documents embeddings pages benchmark conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    for name, f in QUERIES.items():
        df = f(spark, folder)
        rows = [tuple(map(str, x)) for x in df.collect()]
        assert rows, name
        if name in ORACLE_SQL:
            want = con.sql(ORACLE_SQL[name])
            order = [want.columns.index(c) for c in df.columns]
            assert sorted(rows) == sorted(tuple(str(x[k]) for k in order) for x in want.fetchall()), name




def test_exact_quantiles_without_one_group(spark):
    rows = spark.range(4000).select((F.rand(1) * F.when(F.rand(2) < 0.01, 1e9).otherwise(3)).alias("v")).unionByName(spark.range(900).select(F.lit(1.5).alias("v"))).unionByName(spark.range(2).select(F.lit(None).cast("double").alias("v")))
    rows = spark.createDataFrame(rows.collect(), "v double")
    want = rows.agg(F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.95)).alias("p95")).first()
    for few in (10_000, 20):
        got = evaluate.percentile_latency(rows, "v", few=few, error=0.01).first()
        assert got.p50 == pytest.approx(want.p50, rel=1e-12) and got.p95 == pytest.approx(want.p95, rel=1e-12)
    assert evaluate.order_statistics(rows, "v", [0, 4899], few=3, error=0.01) == {0: rows.agg(F.min("v")).first()[0], 4899: rows.agg(F.max("v")).first()[0]}
    assert tuple(evaluate.percentile_latency(rows.limit(0), "v").first()) == (0.0, 0.0)
