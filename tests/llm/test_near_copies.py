"""Near copies of the pipeline against exact similarity of all pairs."""

import random

import corpus_pipeline

from lodestone.llm import near_sets, shared
from tests.llm.test_text_operators import docs_of


def shingles(t, k):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def exact_groups(texts, k):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def varied(r, changes, families, members):
    out = [None, "", "one", "one two", "ONE two"]
    for _ in range(families):
        base = [f"w{r.randrange(5000)}" for _ in range(200)]
        for _ in range(members):
            own = list(base)
            for _ in range(changes(r)):
                own[r.randrange(len(own))] = f"new{r.randrange(9999)}"
            out.append(" ".join(own))
    return out


def test_all_pairs_at_the_stated_similarity_are_found(spark, monkeypatch):
    # one word in 200 changed is five shingles of 196: four changes of each of two texts are about 0.8
    texts = varied(random.Random(5), lambda r: r.choice([1, 2, 3, 4]), 40, 3)
    want = exact_groups(texts, corpus_pipeline.SHINGLE_WORDS)
    for often in (50, 3):
        monkeypatch.setattr(near_sets, "OFTEN", often)
        monkeypatch.setattr(near_sets, "HOT_BUCKET", often // 20)
        got = near_sets.near_copy_groups(docs_of(spark, texts), corpus_pipeline.SHINGLE_WORDS).collect()
        assert {x.doc_id: x.component_id for x in got} == dict(enumerate(want))
    kept = corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), "").collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(want))


def test_repeated_passages_repeated_rows_and_null_ids(spark):
    """Sets count a repeated shingle once, whatever it does to a fingerprint of all words."""
    r = random.Random(6)
    passage = " ".join(f"p{r.randrange(900)}" for _ in range(60))
    own = " ".join(f"q{r.randrange(900)}" for _ in range(8))
    texts = [f"{passage} {own}", " ".join([passage] * 30) + f" {own}", f"{own} " + " ".join(f"z{n}" for n in range(60)), "", None, "  "]
    ids = [3, 1, 7, 9, None, 4]
    rows = [(i, t) for i, t in zip(ids, texts)] + [(3, texts[0]), (7, "another text of the same id")]
    got = near_sets.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sorted(((x.doc_id, x.component_id) for x in got), key=str) == sorted([(3, 1), (1, 1), (3, 1), (7, 7), (7, 7), (9, 4), (None, 4), (4, 4)], key=str)


def test_a_large_group_of_near_copies(spark):
    """A chain of variants: each is near its neighbours, the ends are not near each other."""
    r = random.Random(9)
    words = [f"w{n}" for n in range(150)]
    texts = []
    for n in range(300):
        words[r.randrange(150)] = f"new{n}"
        texts.append(" ".join(words))
    want = exact_groups(texts, 5)
    got = near_sets.near_copy_groups(docs_of(spark, texts), 5).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(want)) and len(set(want)) < 30


def test_short_texts_at_the_stated_similarity_are_found(spark):
    """4 of 5 shingles: fingerprints of so small sets differ widely, and none of 4,000 pairs is lost."""
    texts = []
    for n in range(4000):
        words = [f"w{n}x{k}" for k in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    got = near_sets.near_copy_groups(docs_of(spark, texts), 5).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: i - i % 2 for i in range(len(texts))}


def test_a_crowd_below_the_threshold_is_met_once(spark, monkeypatch):
    """Pairs with many common shingles are few rows of the join, and none is lost, however few shingles are looked back at."""
    r = random.Random(3)
    base = [f"w{n}" for n in range(200)]
    texts = [" ".join(f"x{r.randrange(10**6)}" if r.random() < 0.03 else w for w in base) for _ in range(150)]
    want = dict(enumerate(exact_groups(texts, 5)))
    assert 20 < len(set(want.values()))
    for before in (1, 8):
        monkeypatch.setattr(near_sets, "BEFORE", before)
        got = near_sets.near_copy_groups(docs_of(spark, texts), 5).collect()
        assert {x.doc_id: x.component_id for x in got} == want


def test_shingles_that_one_set_has_are_dealt_once_and_narrow(spark, monkeypatch):
    """Most shingles are of one set only: what is before them in the order is not sent along, nor are they sent twice."""
    plans = {}

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return shared.written(df, name)

    monkeypatch.setattr(near_sets, "written", written)
    texts = varied(random.Random(8), lambda r: 4, 5, 3)
    got = near_sets.near_copy_groups(docs_of(spark, texts), 5).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(exact_groups(texts, 5)))
    plan = plans["shared_shingles"]
    assert plan.count("Exchange hashpartitioning(shingle") == 1 and "slice(" not in plan
