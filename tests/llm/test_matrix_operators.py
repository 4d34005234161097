"""Source divergence, Lloyd clusters and the n-gram join against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import lloyd, ngram_join, source_divergence
from lodestone.llm.ngram_join import Similarity, similar_groups

ODD = [None, "", " ", "one", "ONE", "one two", "a\x00b", "é" * 50, "w " * 30_000, "x" * 200_000]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


# -- source divergence


def brute_divergence(rows, min_docs=10):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) for _, _, t in rows]
    docs, own, whole = Counter(), defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), ws in zip(rows, words):
        docs.update((lang, w) for w in set(ws))
        own[lang, source].update(ws)
        whole[lang].update(ws)
    out = []
    for lang in whole:
        terms = [w for w in whole[lang] if docs[lang, w] >= min_docs]
        share = lambda counts: {w: 1 + 10**9 * (counts[w] + 2) // (sum(counts[x] for x in terms) + 2 * len(terms)) for w in terms}
        p, q = {s: share(own[lang, s]) for g, s in own if g == lang}, share(whole[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(t, sum(f(p[s][w], p[t][w]) for w in terms)) for t in p if t != s]
            top = [(w, f(p[s][w], q[w])) for w in terms if own[lang, s][w] > 0 and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, n + 1) for n, (w, v) in enumerate(items) if part == "pair" or n < 10]
    return sorted(out)


@pytest.mark.parametrize("terms,sources", [(512, 128), (7, 2), (1, 1)])
def test_source_divergence(spark, terms, sources):
    r = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("ab", "Ö", "éa", "zz", "𝔘")]
    rows = []
    for lang, names, n in (("en", "pqrst", 90), ("de", "pq", 40), (None, ["p", None, ""], 30), ("solo", "p", 15), ("rare", "pq", 3)):
        for _ in range(n):
            s = r.choice(list(names))
            rows.append((lang, s, " ".join(r.choices(vocabulary[: 40 if s != "p" else 9], k=r.randrange(0, 60)))))
    rows += [("en", "empty", None), ("en", "empty", ""), ("de", "hot", "hot " * 40_000), ("de", "hot", "hot"), *[("de", "digits", "1 2_3")] * 3, *rows[:9]]
    df = spark.createDataFrame([(n, *x, 1) for n, x in enumerate(rows)], "doc_id long, lang string, source string, text string, n int")
    got = source_divergence.divergence(df, terms=terms, sources=sources)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows)
    assert source_divergence.divergence(df.limit(0)).collect() == []


def test_shares_of_large_counts_are_exact():
    total = 7 * 10**14 + 11
    counts = np.array([2, 12345, 10**12 + 3, total - 1, total], np.int64)
    assert source_divergence.shares(counts, np.array([total])).tolist() == [1 + 10**9 * int(c) // total for c in counts]


# -- Lloyd


def brute_lloyd(rows, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1])
    centres = [v for _, v in sorted(kept, key=name)[:clusters]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    at = lambda v: min(range(len(centres)), key=lambda k: (apart(v, centres[k]), k))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[at(v)].append(v)
        centres = [[sum(x) // len(own[k]) for x in zip(*own[k])] if own[k] else c for k, c in enumerate(centres)]
    placed = [(i, at(v), apart(v, centres[at(v)])) for i, v in kept]
    of = Counter()
    for _, k, d in placed:
        of[k] += d
    return sorted(((i, k, d, of[k], sum(of.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, k, d in placed), key=str)


def test_lloyd_with_odd_vectors(spark):
    r = random.Random(8)
    near = lambda m: [float(np.float32(r.gauss(m, 0.3))) for _ in range(64)]
    rows = [(n, near(r.choice([-1, 0, 0.2, 2]))) for n in range(150)]
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65), (204, [None] + [0.1] * 63), (205, [math.nan] + [0.1] * 63), (206, [math.inf] + [0.1] * 63)]
    rows += [(None, near(0)), (3, near(1)), rows[5], rows[5], (2**53 + 1, near(0)), (2**53 + 2, [-0.0] * 64), (7, [1e-9] * 64)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    for part in (df, df.where("vec_id < 5"), df.where("vec_id BETWEEN 200 AND 206")):
        vectors = lloyd.Lloyd(part, "vec_id", "embedding")
        got = sorted(map(tuple, vectors.assigned(vectors.fit()).collect()), key=str)
        assert got == brute_lloyd([(x.vec_id, x.embedding) for x in part.collect()])


def test_equal_vectors_leave_clusters_empty_and_ties_go_to_the_smaller(spark):
    df = spark.createDataFrame([(n, [0.25] * 64) for n in range(20)] + [(99, [4.0] * 64)], "vec_id long, embedding array<double>")
    vectors = lloyd.Lloyd(df, "vec_id", "embedding")
    got = sorted(map(tuple, vectors.assigned(vectors.fit()).collect()), key=str)
    assert got == brute_lloyd([tuple(x) for x in df.collect()]) and len({x[1] for x in got}) <= 2
    far = lloyd.Lloyd(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    with pytest.raises(ValueError, match="too large"):
        far.first(1, 3)


# -- n-gram join


def brute_groups(rows, like):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        return {tuple(w[i : i + like.words]) for i in range(max(1, len(w) - like.words + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and root[i] != root[j] and 100 * common >= like.percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    least = {}
    for (i, _), k in zip(rows, root):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return sorted(((i, len(s), least.get(k)) for (i, _), s, k in zip(rows, sets, root)), key=str)


def texts_of(r, families, members, words, changes):
    out = []
    for _ in range(families):
        base = [f"w{r.randrange(400)}" for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(r.choice(changes)):
                own[r.randrange(len(own))] = f"new{r.randrange(9999)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("like,counted,block", [(Similarity(4, 85), 4, 2000), (Similarity(5, 80), 4, 20), (Similarity(2, 50), 1, 2000), (Similarity(1, 100), 9, 20)])
def test_ngram_join(spark, monkeypatch, like, counted, block):
    r = random.Random(like.percent)
    texts = texts_of(r, 20, 4, 100, [0, 1, 2, 3]) + texts_of(r, 30, 4, 9, [0, 1]) + texts_of(r, 20, 3, 24, [0, 1])
    passage = " ".join(f"p{r.randrange(90)}" for _ in range(30))
    texts += [f"{passage} own {n} " + " ".join(f"q{r.randrange(900)}" for _ in range(r.randrange(8))) for n in range(60)] + ODD
    rows = [*enumerate(texts), (None, texts[0]), (None, ""), (3, texts[3]), (3, "another text of the same id"), (None, "alone without an id"), (900, "one"), (901, "")]
    want = brute_groups(rows, like)
    df = spark.createDataFrame([(i, t, 1, "set") for i, t in rows], "doc_id long, text string, n int, set string")
    monkeypatch.setattr(ngram_join, "COUNTED", counted)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    assert sorted(map(tuple, similar_groups(df, like).collect()), key=str) == want
    assert similar_groups(df.limit(0), like).collect() == []


def test_a_crowd_around_one_text_and_string_ids(spark):
    """Variants of one text with up to nine changes: some are linked by way of others, many with none."""
    r = random.Random(12)
    texts = texts_of(r, 1, 500, 150, range(10))
    df = spark.createDataFrame([(f"d{n:04}", t) for n, t in enumerate(texts)], "doc_id string, text string")
    got = sorted(map(tuple, similar_groups(df).collect()), key=str)
    assert got == brute_groups([(f"d{n:04}", t) for n, t in enumerate(texts)], ngram_join.CONTRACT)
    assert 50 < len({x[2] for x in got}) < 450


def test_heads_of_similar_sets_always_meet():
    """The least overlap that two similar sets can have is more than both sets have outside the head."""
    for like in (Similarity(4, 85), Similarity(5, 80), Similarity(1, 1), Similarity(1, 100)):
        for n in range(1, 120):
            for m in range(n, 120):
                least = -(-like.percent * (n + m) // (100 + like.percent))
                if least <= n:  # else they cannot be similar
                    assert n - like.head(n) < least and m - like.head(m) < least
