"""Line dedup, decontamination, quality rules and SimHash against brute force, with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lodestone.llm import decontaminate, line_dedup, quality_rules, simhash
from lodestone.llm.suffix_automaton import ItemIndex

LONG = "this is a line that is long enough to be a key of its own"
ODD = [None, "", " ", "\n", "\n\n", "a\x00b", "é" * 50, LONG, LONG.upper() + " \r", "x" * 200_000, "w " * 30_000]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "taken", 1) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines string, kept int")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    shared = [f"{LONG} number {n}" for n in range(6)]
    own = ["\n".join(r.choice([*shared, f"own line {r.random()} of some document that is long", "short"]) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    return [*own, *ODD, *[LONG] * 7]


def brute_lines(rows, min_docs=5):
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    where = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                where[k].append(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(where[key(x)]) >= min_docs and (-1 if i is None else i) != max(where[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout,broadcast", [(4, 3, 1000), (5, 2, 0), (1, 3, 1000)])
def test_line_dedup(spark, texts, batches, fanout, broadcast):
    ids = [None, *range(len(texts) - 3), 5, 5]
    df = docs_of(spark, texts, ids)
    out = line_dedup.dedup_lines(df, batches=batches, fanout=fanout, broadcast_rows=broadcast)
    assert out.columns == ["doc_id", "text", "n_lines", "kept", "_n_lines", "n_dropped"]
    got = [(r.doc_id, r._n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=str) == brute_lines(list(zip(ids, texts)))


def test_line_dedup_of_string_ids(spark, texts):
    rows = [(f"d{n:03d}", t) for n, t in enumerate(texts)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string"), batches=3)
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()]
    assert sorted(got) == sorted((f"d{i:03d}", *rest) for i, *rest in brute_lines(list(enumerate(texts))))


def test_line_runs_compact_without_losing_counts(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    for n in range(5):
        runs.add(docs_of(spark, [LONG, f"{LONG} {n}"], [2 * n, 2 * n + 1]).select("doc_id", "text"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [r.last_doc for r in runs.frequent(5).collect()] == [8]
    assert runs.frequent(6).count() == 0
    runs.drop()


def test_empty_tables(spark):
    none = docs_of(spark, []).select("doc_id", "text")
    assert line_dedup.dedup_lines(none).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert simhash.near_duplicate_groups(none).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, empty).count() == 0
    some = docs_of(spark, ["a b c", None])
    assert decontaminate.decontaminate(some, empty).count() == 2


def brute_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    hit, found = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item or ""))
        k = min(window, len(own))
        for i in range(len(own) - k + 1) if k else ():
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [400_000, 30])
def test_contamination(spark, block_words):
    r = random.Random(3)
    word = lambda: r.choice("a b C é 1 dd".split())
    items = [(n, " ".join(word() for _ in range(r.randrange(0, 9)))) for n in range(12)] + [(3, None), (20, "A-b c"), (21, "solo")]
    texts = [r.choice(" .-\n").join(word() for _ in range(r.randrange(0, 60))) for _ in range(60)] + ["Solo!", None, ""]
    df = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x[0]: tuple(x[1:]) for x in decontaminate.contamination(df, bench, window=4, block_words=block_words).collect()}
    assert got == {i: brute_hits(t, items, 4) for i, t in enumerate(texts)}
    left = decontaminate.decontaminate(df, bench, window=4, max_coverage=1.0, block_words=block_words)
    assert left.columns == df.columns
    assert all(brute_hits(x.text, items, 4)[1] == 0 for x in left.collect())
    assert left.where("doc_id >= 61").orderBy("doc_id").select("text").collect()[0].text is None


def test_blocks_of_a_benchmark_equal_one(spark):
    """Copies, names that clash, texts to cut twice and rows that go, with the benchmark in one block and in many."""
    r = random.Random(6)
    word = lambda: r.choice("a b c d é".split())
    items = [(f"i{n}", " ".join(word() for _ in range(r.randrange(1, 7)))) for n in range(30)] * 2 + [("u v w x", "u v w x"), (None, "d d d d")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [" ".join([word(), *("q" for _ in range(r.randrange(3))), word(), "u v", *["u v w x"] * r.randrange(3), "w x"]) for _ in range(40)]
    rows = [(n % 50, t, "k", [1]) for n, t in enumerate([*texts, *texts, None, "", "q " * 50_000 + "u v w x"])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, text_key string, spans array<int>")
    for measure in (decontaminate.contamination, lambda d, b, **k: decontaminate.decontaminate(d, b, max_coverage=0.6, **k)):
        one, many = (measure(docs, bench, window=4, block_words=n) for n in (400_000, 25))
        assert one.schema.simpleString() == many.schema.simpleString()
        assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))


def test_automaton_holds_all_windows():
    r = random.Random(1)
    items = [(n, [r.choice("abc") for _ in range(r.randrange(1, 12))]) for n in range(20)]
    index = ItemIndex(items, 3)
    for _ in range(300):
        doc = [r.choice("abc") for _ in range(r.randrange(1, 20))]
        hit, found = np.zeros(len(doc), bool), set()
        if index.shortest > 1 or index.words:
            codes = [index.words.index(w) if w in index.words else None for w in doc]
            if None in codes:
                continue
            index.stream(codes, 0, hit, found)
        want = set()
        for n, own in items:
            k = min(3, len(own))
            if k > 1 and any(doc[j : j + k] == own[i : i + k] for i in range(len(own) - k + 1) for j in range(len(doc) - k + 1)):
                want.add(n)
        assert found == want


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {p for i, g in enumerate(grams) if many[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    rep = len(covered)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, len(words) < 50 or 100 * rep > 50 * len(words))


def test_quality_measures(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("a b c dd # $x".split()) for _ in range(r.randrange(0, 90))) for _ in range(80)] + ODD
    texts += ["\n".join(["same", "same", " ", "other"]), " ".join(str(n // 2 % 100) for n in range(3000))]
    out = quality_rules.judge(docs_of(spark, texts))
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in out.collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert "_kept" in out.columns and "kept" in out.columns


def test_quality_keeps_good_and_rejects_junk(spark):
    good = " ".join(f"the word{n} of it{n}" for n in range(40)) + "."
    junk = [" ".join(f"word{n}$$$ the%%%" for n in range(60)), " ".join(f"THE WORD{n}!!" for n in range(60)), None]
    kept = quality_rules.keep_good(docs_of(spark, [good, *junk]))
    assert [x.doc_id for x in kept.collect()] == [0]
    assert kept.columns == ["doc_id", "text", "n_lines", "kept"]


def fingerprint(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, distance):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("distance,segments,hot", [(4, 3, 4096), (4, None, 4096), (4, 4, 2), (3, 2, 1), (7, 4, 4096), (6, 4, 2), (9, 4, 4096)])
def test_simhash_groups(spark, distance, segments, hot):
    r = random.Random(11)
    base = [[f"w{r.randrange(5000)}" for _ in range(120)] for _ in range(6)]
    texts = [None, "", "one", "one two", "ONE two", "x" * 50_000]
    for b in base:
        for _ in range(6):
            own = list(b)
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = f"new{r.randrange(99)}"
            texts.append(" ".join(own))
    prints = [fingerprint(t) for t in texts]
    got = simhash.near_duplicate_groups(docs_of(spark, texts), 4, distance, segments, hot).collect()
    assert {x.doc_id: x.fp % 2**64 for x in got} == dict(enumerate(prints))
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(brute_groups(prints, distance)))


def test_components_of_long_chains(spark):
    from lodestone.llm.graph import components

    chain = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 200), (7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
