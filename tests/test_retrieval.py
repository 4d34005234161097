"""Namespaces, metadata filters and many principals over an index table; top-k in a grid."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.filters import Field, any_of
from lodestone.operators import retrieve
from lodestone.plans import answer, ingest

RECORDS = [
    ("chk_a", '{"tenant": "acme", "year": 2024, "tags": ["urgent", "new"], "public": true}'),
    ("chk_b", '{"tenant": "acme", "year": 2022, "tags": ["old"], "public": false}'),
    ("chk_c", '{"tenant": "globex", "year": 2024, "tags": []}'),
]
tenant, year = Field("tenant"), Field("year")
#: A filter for each operator, and what it finds.
CASES = {
    "eq": (tenant.eq("acme"), "ab"), "ne": (tenant.ne("acme"), "c"), "in": (tenant.in_(["acme", "globex"]), "abc"), "nin": (tenant.nin(["acme"]), "c"),
    "gt": (year.gt(2022), "ac"), "gte": (year.gte(2022), "abc"), "lt": (year.lt(2024), "b"), "lte": (year.lte(2022), "b"),
    "contains": (Field("tags").contains("urgent"), "a"), "exists": (Field("public").exists(), "ab"),
    "and": (tenant.eq("acme") & year.gte(2024), "a"), "or": (tenant.eq("globex") | year.lt(2023), "bc"), "not": (~tenant.eq("acme"), "c"),
}


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    ws = ingest.Workspace(spark, str(tmp_path_factory.mktemp("ws")), {"tenant": "string", "year": "double"})
    plain = spark.createDataFrame([(ns, i, [1.0, 0.0], m, f"doc_{i}", n, None, f"text of {i}") for ns in (None, "tenant_a") for n, (i, m) in enumerate(RECORDS)] + [("tenant_b", "chk_z", [1.0, 0.0], '{"tenant": 5}', "doc_z", 0, None, "z"), ("", "chk_y", [], "{}", "doc_y", 0, None, "y")], "namespace string, id string, vector array<double>, metadata string, document_id string, chunk_index int, heading_path string, text string")
    ws.index.upsert(ws.records(plain.withColumn("metadata", F.parse_json("metadata"))))
    return ws


@pytest.fixture(scope="module")
def index(workspace):
    return workspace.index.read()


def found(index, spark, **options):
    asked = spark.createDataFrame([("q", "which text")], "query_id string, query string")
    return sorted(x.id[-1] for x in answer.retrieved(index, asked, 100, 2, **options).collect())


@pytest.mark.parametrize("name", CASES)
def test_filters_over_metadata(spark, index, name):
    condition, want = CASES[name]
    assert "".join(found(index, spark, condition=condition)) == want
    assert "".join(found(index, spark, condition=condition, namespace="tenant_a")) == want


def test_namespaces_are_isolated(spark, workspace, index):
    assert found(index, spark, namespace="tenant_a") == ["a", "b", "c"] and found(index, spark, namespace="tenant_b") == ["z"]
    assert found(index, spark) == ["a", "b", "c"] and found(index, spark, namespace="") == ["y"] and found(index, spark, namespace="other") == []
    own = workspace.index.read(namespace="tenant_b")
    assert len(own.inputFiles()) == 1 and found(own, spark, namespace="tenant_b") == ["z"]
    hit = answer.retrieved(index, spark.createDataFrame([("q", "x")], "query_id string, query string"), 1, 2, Field("document_id").eq("doc_chk_c")).first()
    assert hit.id == "chk_c" and '"globex"' in hit.metadata.toJson()


def test_declared_fields_reach_the_scan(spark, index):
    rows = index.where(answer.implied(tenant.eq("acme") & year.gte(2024), answer.declared(index)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "EqualTo(declared_tenant,acme)" in pushed and "GreaterThan" in pushed  # the plan cuts long lists
    columns = answer.declared(index)
    for condition in (~tenant.eq("acme"), tenant.ne("acme"), Field("other").eq("x"), tenant.eq("acme") | Field("other").eq("x"), tenant.eq(5), year.eq("2024"), tenant.in_([])):
        assert answer.implied(condition, columns) is None
    assert found(index, spark, condition=any_of(tenant.eq(5), year.in_([2022, True])), namespace="tenant_b") == ["z"]


def test_many_principals_are_one_search(spark):
    r = random.Random(5)
    rows = [(None, f"r{n:03}", [r.random() for _ in range(8)], f'{{"team": {n % 40}}}', f"d{n}", 0, None, "t") for n in range(200)]
    index = spark.createDataFrame(rows, "namespace string, id string, vector array<double>, metadata string, document_id string, chunk_index int, heading_path string, text string").withColumn("metadata", F.parse_json("metadata"))
    filters = {f"p{n}": Field("team").eq(n % 100) if n % 3 else Field("team").lt(n % 50) for n in range(300)}
    asked = spark.createDataFrame([(f"q{n}", f"question {n}", f"p{n}") for n in range(0, 310, 10)], "query_id string, query string, principal string")
    got = answer.retrieved_for(index, asked, filters, k=4, dimensions=8)
    rows_got = sorted((x.query_id, x.id, round(x.score, 9), x["rank"]) for x in got.collect())
    want = []
    for q in asked.where("query_id IN ('q0', 'q10', 'q60', 'q200', 'q300')").collect():
        if q.principal in filters:
            one = answer.retrieved(index, spark.createDataFrame([q[:2]], "query_id string, query string"), 4, 8, filters[q.principal])
            want += [(x.query_id, x.id, round(x.score, 9), x["rank"]) for x in one.collect()]
    assert [x for x in rows_got if x[0] in ("q0", "q10", "q60", "q200", "q300")] == sorted(want) and want
    scans = [answer.retrieved_for(index, asked, some, k=4, dimensions=8)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") for some in (filters, {"p0": filters["p0"]})]
    assert scans == [2, 2]  # one for the search, one for the texts of what it found
    assert answer.retrieved_for(index, asked, {}, k=4, dimensions=8).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_a_grid_of_cells_equals_a_broadcast(spark, metric):
    vectors = lambda n, seed: spark.range(n).select(F.col("id"), F.array(*[F.floor(F.rand(seed + j) * 9) / 2 for j in range(5)]).alias("vector"))
    records = vectors(3000, 1)
    queries = vectors(1500, 100).withColumnRenamed("id", "query_id")
    one = retrieve.batch_top_k(records, queries, 3, metric, min_score=0.1, most_broadcast=5000)
    grid = retrieve.batch_top_k(records, queries, 3, metric, min_score=0.1, cell=(400, 700))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("Range (0") == 2
    rows = lambda df: sorted((x.query_id, x.id, round(x.score, 9), x["rank"]) for x in df.collect())
    assert rows(one) == rows(grid) and len(rows(grid)) > 4000


def test_widths(spark):
    records = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, vector array<double>")
    with pytest.raises(Exception, match="different widths"):
        retrieve.batch_top_k(records, spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, vector array<double>")).collect()


def test_screened_cosines_are_exact(monkeypatch):
    """Few pairs are scored in full, and the best are those of all scores, with ties by id, copies and empty vectors."""
    r = np.random.default_rng(7)
    base = r.normal(size=(1500, 16))
    records = np.concatenate([base, base[:700] + 1e-3 * r.normal(size=(700, 16)), np.repeat(base[:1], 900, axis=0), np.zeros((3, 16))])
    names = r.permutation(len(records))
    queries = np.concatenate([records[:1100], np.zeros((1, 16))])
    best = retrieve.Best(queries, np.zeros(len(queries), bool), None, "cosine", 4, None, pa.int64())
    scored, divide = [], np.einsum
    monkeypatch.setattr(retrieve.np, "einsum", lambda *a: scored.append(len(a[1])) or divide(*a))
    for part in (slice(0, 2000), slice(2000, None)):
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(records[part]) * 16 + 1, 16), pa.int32()), pa.array(records[part].ravel()))
        best.add(pa.array(names[part]), vectors)
    norms = np.linalg.norm(records, axis=1)
    for q in range(len(queries)):
        both = norms * np.linalg.norm(queries[q])
        scores = np.divide(divide("ij,j->i", records, queries[q]), both, out=np.zeros(len(both)), where=both > 0)
        want = np.lexsort((names, -scores.round(13)))[:4]
        own = best.query == q
        assert np.allclose(best.score[own], scores[want], rtol=0, atol=1e-13)
        if q == 0 or q == len(queries) - 1:
            assert best.ids.to_numpy()[own].tolist() == names[want].tolist()
    assert 0 < sum(scored) < len(queries) * len(records) / 20
