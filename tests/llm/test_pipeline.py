"""run() against a brute-force version, odd rows, and the registration of all queries."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import bpe, quality_rules
from lodestone.llm.decontaminate import WINDOW
from tests.llm.test_near_copies import exact_groups
from tests.llm.test_text_operators import brute_hits, brute_lines, brute_quality, lower


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(12)
    word = lambda: r.choice(["the", "of", *("".join(r.choices("abcdefgh", k=5)) for _ in range(4))])
    item = " ".join(f"bench{n}" for n in range(14))
    license_line = "licensed to all under the terms of some long license line"
    docs = []
    for n in range(50):
        lines = [" ".join(word() for _ in range(r.randrange(20, 40))) for _ in range(4)]
        if n % 4 == 0:
            lines.insert(2, license_line)
        if n % 10 == 3:
            lines[1] += f" {item} and more"
        docs.append("\n".join(lines))
    docs += docs[:5] + [docs[6].replace("the", "a", 1), docs[7] + " end", None, "", "short", "$$ %% " * 60, item + " x" * 0]
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(n, t, "en", "src0", None if t is None else len(t), "more") for n, t in enumerate(docs)] + [(5, docs[5], "en", "src0", len(docs[5]), "more")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), [(x[0], x[1]) for x in rows], [(1, item)]


def verdict(t):
    words, chars, symbols, dup, rep, base = brute_quality(t)
    if base:
        return False
    own = re.findall(r"[^\x20\x09-\x0D]+", t)
    letters = sum(c.isalpha() for c in t)
    return symbols * 100 <= 10 * words and letters * 2 >= chars and 100 * sum(w in quality_rules.STOP_WORDS for w in own) >= words and dup * 2 <= len(t.split("\n"))


def without_items(t, items):
    out = []
    pattern = "".join(rf"{re.escape(w)}[^a-z0-9\x80-\U0010ffff]+" for w in items[0][1].split()[:-1]) + re.escape(items[0][1].split()[-1])
    at = 0
    for m in re.finditer(pattern, lower(t)):
        out.append(t[at : m.start()])
        at = m.end()
    return "".join([*out, t[at:]])


def test_run_equals_brute_force(spark, corpus):
    folder, rows, items = corpus
    rows = [(i, t) for i, t in rows if verdict(t)]
    digests = {}
    for i, n, gone, sha in brute_lines(rows):
        digests[i] = (n, gone, sha)
    kept = []
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    where = {}
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 40:
                where.setdefault(k, []).append(i)
    for i, t in rows:
        lines = [x for x in t.split("\n") if not (len(where.get(key(x), [])) >= 5 and i != max(where[key(x)]))]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == digests[i][2]
        if lines:
            kept.append((i, "\n".join(lines)))
    kept = sorted(set(kept))
    group = exact_groups([t for _, t in kept], corpus_pipeline.SHINGLE_WORDS)
    kept = [x for n, x in enumerate(kept) if group[n] == n]
    kept = [(i, without_items(t, items)) for i, t in kept if brute_hits(t, items, WINDOW)[1] <= 0.8 * brute_hits(t, items, WINDOW)[0]]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = bpe.MergeReplay(f.read(), public_tokenizers.PATTERN)
    want = set()
    for i, t in kept:
        (raw,) = coder.encode([t])
        ids = np.frombuffer(raw, np.int32).tolist()
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(x) for x in corpus_pipeline.run(spark, folder).collect()]
    assert set(got) == want and len(got) == len(want)
    assert 30 < len(got) < 56


def test_stages_keep_columns_and_decisions(spark, corpus):
    folder, _, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert all(x.n_chars is None or x.n_chars == len(x.text) for x in out.collect()), name
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0
    left = corpus_pipeline.contamination(spark, docs, folder).collect()
    assert all(brute_hits(x.text, items, WINDOW)[1] == 0 for x in left)


def test_one_of_equal_rows_stays(spark):
    rows = [(3, "same text here", "x"), (3, "same text here", "x"), (4, "same text here", "x"), (9, "other words", "x"), (None, "other words", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(x.doc_id for x in got) == [3, 9]


def test_all_operators_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_oracles_agree(spark):
    import duckdb

    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    sql = __spark_entry__.oracle_sql()
    for name, f in __spark_entry__.queries().items():
        if name.startswith("op") and name in sql:
            df = f(spark, folder)
            want = con.sql(sql[name])
            order = [want.columns.index(c) for c in df.columns]
            assert sorted(map(str, df.collect())) == sorted(str(_row(df.columns, [r[k] for k in order])) for r in want.fetchall()), name


def _row(columns, values):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values)))
