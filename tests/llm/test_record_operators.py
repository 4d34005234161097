"""HTML, WARC, PII, sharding, toxicity and BPE: brute force, round trips, held-out accuracy, odd rows."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe, html_text, pii, sharding, toxicity, warc


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ARTICLE = "First   paragraph with a <a href='/x'>link</a> and&nbsp;more text &amp; so on, long enough to be an article of its own."
SOUP = f"""<html><head><title>t</title><script>var a="</p>";</script></head><body><header class="top"><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div id=wrap><div class="post"><h2>The title</h2><p>{ARTICLE}<ul><li>One<li>Two</ul><p>Short.<p>Another paragraph, which is <em>long</em>er than the first by some words.</p>
<form><input><button>Send</button></form></div><div class="sidebar"><a href=1>Other story</a></div>
<section id="comments"><p>Great article, I liked it very much indeed, thanks for the story.</p></section></div>
<div class="cookie-notice">We use cookies.</div><footer>&copy; 2020</footer></body></html>"""
TEXT = "First paragraph with a link and more text & so on, long enough to be an article of its own."


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("a &lt; b &am", "a < b &am"),
        (SOUP, f"The title\n{TEXT}\nOne\nTwo\nShort.\nAnother paragraph, which is longer than the first by some words."),
        (f"<body><nav>Menu</nav><article><h1>T</h1><p><b>{ARTICLE}<br><p>x</article><div class='ad'>Buy</div>", f"T\n{TEXT}\nx"),
        (f"<main><p>{ARTICLE}</p><aside>More</aside></main><div>Other</div>", TEXT),
        ("<!-- c --><style>p{}</style><p>only</p><!-- open", "only"),
        ("<p title='a>b'>x</p>", "x"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def brute_counts(node):
    """(chars, link chars, tags, link tags) of a node by recursion."""
    inner = [x for x in node.parts if isinstance(x, html_text.Node) and not x.out]
    own = [brute_counts(x) for x in inner]
    c = sum(len(re.sub(r"\s", "", x)) for x in node.parts if isinstance(x, str)) + sum(x[0] for x in own)
    lc = c if node.tag == "a" else sum(x[1] for x in own)
    return c, lc, sum(x[2] + 1 for x in own), sum(y[3] + (x.tag == "a") for x, y in zip(inner, own))


def brute_density(node, root):
    c, lc, t, lt = brute_counts(node)
    if not c:
        return 0.0
    whole = brute_counts(root)
    base = np.log(c * lc / max(1, c - lc) + c * whole[1] / whole[0] + np.e)
    ratio = max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))
    return c / max(1, t) * np.log(ratio) / np.log(max(base, 1.0) + np.e - 1)


def test_densities_equal_brute_force():
    r = random.Random(5)

    def some(depth):
        if depth == 0 or r.random() < 0.3:
            return " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(9)))
        tag = r.choice(["div", "p", "a href=x", "ul", "span", "section"])
        return f"<{tag}>" + "".join(some(depth - 1) for _ in range(r.randrange(1, 4))) + f"</{tag.split()[0]}>"

    for _ in range(60):
        root = html_text.tree(f"<body>{some(4)}{some(3)}</body>")
        for node in html_text.weigh(root):
            assert (node.chars, node.links, node.tags, node.link_tags) == brute_counts(node)
            assert node.density == pytest.approx(brute_density(node, root), abs=1e-9)
            assert node.sum == pytest.approx(sum(brute_density(x, root) for x in node.parts if isinstance(x, html_text.Node)), abs=1e-9)


def test_density_decides_where_names_say_nothing(spark, monkeypatch):
    """Without class names, and with article elements renamed, density leaves the adverts out of nearly all pages; without density none."""
    pages = [x.html for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if x.html]
    want = [html_text.main_text(x) for x in pages]
    renamed = [x.replace("<article", "<div").replace("</article", "</div") for x in pages]
    assert [html_text.main_text(x) for x in renamed] == want
    bare = [re.sub(r' class="[^"]*"', "", x) for x in renamed]
    same = lambda: sum(html_text.main_text(x) == w for x, w in zip(bare, want))
    assert same() >= 0.95 * len(pages)
    monkeypatch.setattr(html_text, "densest", lambda nodes, root: root)
    assert same() < 0.1 * len(pages)


def test_pages_of_many_stray_tags_take_linear_time():
    import time

    begin = time.perf_counter()
    k = 50_000
    assert html_text.main_text('<div class="header">' * k + "x") == ""
    for page in ("<span>" * k + "</b>" * k, "<b><div>" + "<span>" * k + "</b>" * k, "<span>" * k + "<div></div>" * k, "<table><tr>" + "<td>a" * k):
        assert html_text.main_text(page + "x").endswith("x")
    assert time.perf_counter() - begin < 60


def test_extract_carries_columns_and_survives_odd_pages(spark):
    odd = [None, "", "<" * 50_000, "<div>" * 20_000 + "x", "<a '" * 5_000, "&#0;&#xD800;&bogus;", "</p></div>"]
    df = pages_of(spark, [(i, None, h) for i, h in enumerate(odd)]).withColumn("text", F.lit(1))
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text", "_text", "n_chars"]
    rows = out.collect()
    assert len(rows) == len(odd) and all(x.n_chars == len(x._text) for x in rows)
    assert html_text.extract(pages_of(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_warc_round_trip(spark, tmp_path, broadcast):
    r = random.Random(2)
    long = "".join(r.choice("é𝒳ab\r\n ") for _ in range(3000))
    same = "s" * 1500
    rows = [(1, "http://a/\r\nx", long), (2, None, same), (3, "u", same), (None, "u", same), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n\r\n"), (7, "u", "short"), (8, "u", "short"), (3, "u", same), (1, "http://a/", long)]
    path = str(tmp_path / "w")
    warc.write_archives(pages_of(spark, rows), path, segment_bytes=700, chunk_bytes=64, records_per_file=2, broadcast_rows=broadcast)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        best = max((j for j, _, g in rows if (g or "").encode() == raw and j is not None), default=None)
        revisit = len(raw) >= 1000 and i != best
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    got = [tuple(x) for x in warc.archived_pages(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    payloads = warc.read_archives(spark, path).where("record_type = 'response'").collect()
    assert sorted(bytes(x.payload) for x in payloads) == sorted((h or "").encode() for (_, _, h), w in zip(rows, want) if w[3] == "response")
    parts = warc.archive_records(spark, path).where("segment IS NOT NULL")
    lost = warc.reassembled(parts.where("NOT (segment = 2 AND origin LIKE '%:1:%')"))
    wrong = warc.reassembled(parts.withColumn("total", F.col("total") + 1))
    for rows in (lost, wrong):
        rows = rows.where("record_id LIKE '<urn:page:1:%'").collect()
        assert rows and all(x.block is None for x in rows)


def test_archives_of_others(spark, tmp_path):
    """A gzip member for each record, a plain archive, and broken ones."""
    import gzip

    record = lambda n, body: warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{n}:x>")], b"HTTP/1.1 200 OK\r\n\r\n" + body) + warc.END
    whole = [record(n, b"x" * n * 1000) for n in range(1, 4)]
    read = lambda name: sorted((x.record_id[10], None if x.payload is None else len(x.payload)) for x in warc.read_archives(spark, str(tmp_path / name)).collect())
    for name, content in {
        "members": b"".join(map(gzip.compress, whole)),
        "plain": b"".join(whole),
        "short": b"".join(whole)[:-500],
        "cut": b"".join(map(gzip.compress, whole[:2])) + gzip.compress(whole[2])[:-20],
        "junk": b"".join(map(gzip.compress, whole[:2])) + b"no archive at all",
        "head": whole[0] + b"WARC/1.1\r\nContent-Length: x\r\n\r\n",
        "empty": b"",
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(content)
    assert read("members") == read("plain") == [("1", 1000), ("2", 2000), ("3", 3000)]
    assert read("short") == [("1", 1000), ("2", 2000), ("3", None)]
    assert read("cut")[:2] == [("1", 1000), ("2", 2000)] and read("junk") == [("1", 1000), ("2", 2000)]
    assert read("head") == [("1", 1000)] and read("empty") == []


def test_empty_warc(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages_of(spark, []), path)
    assert warc.archived_pages(spark, path).count() == 0


KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def is_valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def brute_spans(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in KINDS for m in p.finditer(t or "") if is_valid(k, m.group()))


def test_base_spans(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("a.@-_%+b 1234567890..@@ -()\né𝒳") for _ in range(r.randrange(60))) for _ in range(800)]
    texts += ["".join(r.choice("0123456789 -4.") for _ in range(60)) for _ in range(400)]
    texts += [None, "", "1" * 30_000, "a" * 50_000, "1 " * 10_000, "a.b@c.d" * 1500, "+1" * 10_000, "1.1.1.1 " * 800, "4111 1111 1111 1111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x[0]: x[1] for x in df.select("doc_id", pii.joined(pii.base_spans(F.coalesce("text", F.lit(""))))).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_terms_that_reveal_an_entity(spark, broadcast):
    r = random.Random(4)
    common = ["river", "stone", "cloud", "table", "green"]
    texts = [" ".join(r.choices(common, k=12)) for _ in range(60)] + [None]
    texts += [f"{r.choice(common)} ask Zebulon at zeb@mail.example.com about {r.choice(common)} {n}" for n in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.all_spans(df, broadcast_rows=broadcast).collect()
    assert len(rows) == len(texts)
    found = {s.value.lower() for x in rows for s in x.term_spans}
    assert "zebulon" in found and not found & set(common)
    for x in rows:
        assert all(texts[x.doc_id][s.start : s.end] == s.value for s in [*x.spans, *x.term_spans])
    clean = [x.text for x in pii.sanitised(pii.all_spans(df)).collect()]
    assert len(clean) == 5 and all("Zebulon" not in t and "@" not in t and "[EMAIL]" in t for t in clean)
    assert pii.all_spans(df.limit(0)).count() == 0


WORD = regex.compile(r"[\p{L}\p{N}]+")


def brute_terms(rows, context=100, support=3, disclosure=0.8):
    """Term spans of each row by the definition: sets and counts over all rows."""
    terms = lambda t: {w for w in WORD.findall(t.lower()) if len(w) >= 3 and not re.fullmatch("[0-9]+", w)}
    base = [[(k, m.start(), m.end(), f"{n}:{m.group().lower()}") for n, (k, p) in enumerate(KINDS) for m in p.finditer(t or "") if is_valid(k, m.group())] for _, t in rows]
    holds, near = {}, {}
    for (_, t), spans in zip(rows, base):
        for _, a, b, e in spans:
            holds.setdefault(e, []).append(t)
            words = [m.group() for m in WORD.finditer(t) if m.start() >= a - context and m.end() <= a or m.start() >= b and m.end() <= b + context]
            near.setdefault((e, t), set()).update(terms(" ".join(words)))
    n, telling = len(rows), {}
    for e in holds:
        texts = set(holds[e])
        n_e = sum(t in texts for _, t in rows)
        for w in set().union(*(near[e, t] for t in texts)):
            own = {t for t in texts if w in near[e, t]}
            n_te, n_t = sum(t in own for _, t in rows), sum(w in terms(t or "") for _, t in rows)
            if len(own) >= support and len(texts) >= support and n_e < n and np.log2(n_te / n_t * n / n_e) >= disclosure * np.log2(n / n_e) - 1e-12:
                telling.setdefault(e, set()).add(w)
    out = []
    for (i, t), spans in zip(rows, base):
        own = set().union(*(telling.get(e, set()) for *_, e in spans)) if spans else set()
        found = [(m.start(), m.end()) for m in WORD.finditer(t or "") if m.group().lower() in own]
        out.append((i, [(a, b) for a, b in found if not any(a < y and x < b for _, x, y, _ in spans)]))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_term_spans_equal_brute_force(spark, broadcast):
    r = random.Random(3)
    common = [f"word{n}" for n in range(25)]
    filler = lambda k: " ".join(r.choices(common, k=k))
    texts = [filler(20) for _ in range(30)]
    texts += [f"{filler(3)} Zebulon zeb@x.example.com {filler(30)} omega{n % 2} zeb@x.example.com {filler(12)}, Quux" for n in range(8)]
    texts += [f"from noreply@hot.example.com {filler(9)} {name} +49 170 123456{n % 3} {filler(6)}" for n, name in enumerate(["anna", "berta", "carla"] * 15)]
    texts += [texts[30]] * 4 + ["", "zebulon alone", f"{'x' * 95} cutword zeb@x.example.com"]
    rows = list(enumerate(texts))
    want = brute_terms(rows)
    assert sum(bool(s) for _, s in want) > 20
    for _ in range(2):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted((x.doc_id, [(s.start, s.end) for s in x.term_spans]) for x in pii.all_spans(df, broadcast_rows=broadcast).collect())
        assert got == want


def brute_table(names, slots):
    order = []
    for s in names:
        at, skip = sharding.hash_of(s, "offset") % slots, sharding.hash_of(s, "skip") % (slots - 1) + 1
        order.append([(at + k * skip) % slots for k in range(slots)])
    table, turn = {}, 0
    while len(table) < slots:
        k = turn % len(names)
        table[next(x for x in order[k] if x not in table)] = k
        turn += 1
    return [table[x] for x in range(slots)]


def test_lookup_table():
    names = sharding.shard_names(7)
    table = sharding.lookup_table(names, 101)
    assert table == brute_table(names, 101)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 40
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_placement(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (5, 2), (5, 3), (6, 4)], "key long, shard int")
    out = sharding.place(df, F.col("key"), sharding.shard_names(3), 101)
    assert out.columns == ["key", "shard", "slot", "_shard"]
    rows = out.collect()
    table = sharding.lookup_table(sharding.shard_names(3), 101)
    for x in rows:
        slot = int(hashlib.md5(("" if x.key is None else str(x.key)).encode()).hexdigest()[:15], 16) % 101
        assert (x.slot, x._shard) == (slot, table[slot])
    sharding.write_shards(df, F.col("key"), sharding.shard_names(3), str(tmp_path / "s"), 101, 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    hot = spark.range(0, 4000, 1, 8).select(F.lit(7).alias("key"), F.lit("copy").alias("text"))
    sharding.write_shards(hot, F.col("key"), sharding.shard_names(3), str(tmp_path / "hot"), 101, 8)
    files = spark.read.parquet(str(tmp_path / "hot")).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 2 and max(x["count"] for x in files) < 2500
    assert sharding.place(df.limit(0), F.col("key"), ["a"], 101).count() == 0


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(6)
    words, bad = [f"word{n}" for n in range(200)], ["vileone", "viletwo", "vilethree", "nasty"]
    rows, labels = [], []
    for i in range(600):
        own, toxic = r.choices(words, k=40), i % 4 == 0
        if toxic:
            own += r.sample(bad, 2)
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1001, "nasty vileone viletwo")], "doc_id long, text string")
    marks = spark.createDataFrame([x for x in labels if x[0] % 2 == 0 or x[0] % 3], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, min_chi2=20.0)
    out = toxicity.score(docs, model).collect()
    got = {x.doc_id: x.toxic for x in out if x.doc_id < 600}
    assert np.mean([got[i] == bool(t) for i, _, t in labels]) > 0.98
    assert all(0 <= x.expected_severity <= 3 and 0 <= x.grade <= 3 for x in out)
    assert np.all(np.diff(model.cuts) > 0)
    none = toxicity.fit(docs, marks.limit(0))
    assert not any(x.toxic or x.grade for x in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0).withColumn("toxic", F.lit(1)), model).columns[-1] == "_toxic"


def test_gradient_equals_differences():
    r = np.random.default_rng(1)
    rows, features, values = r.integers(0, 30, 90), r.integers(0, 7, 90), r.integers(1, 4, 90).astype(float)
    grades, params = r.integers(0, toxicity.GRADES, 30), r.normal(size=7 + toxicity.GRADES - 1)
    _, up = toxicity.likelihood(params, rows, features, values, grades, 0.01)
    step = 1e-6 * np.eye(len(params))
    value = lambda p: toxicity.likelihood(p, rows, features, values, grades, 0.01)[0]
    assert np.allclose(up, [(value(params + d) - value(params - d)) / 2e-6 for d in step], atol=1e-6)


def test_toxicity_sample_is_bounded_and_severity_rises(spark):
    r = random.Random(2)
    bad = ["vileone", "viletwo", "vilethree", "nasty"]
    docs = [(n, " ".join(r.choices([f"w{k}" for k in range(60)], k=30) + (r.sample(bad, 1 + n // 2 % 4) if n % 2 else []))) for n in range(300)]
    docs += [(1, "nasty words again")] * 500 + [(0, "x" * 300_000)]
    labels = [(n, n % 2) for n in range(300)] + [(1, 0)] * 20 + [(None, 1), (2, None)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks, sample_rows=250, min_docs=5, min_chi2=10.0)
    assert len(model.weights) and set(model.features[0]) <= {*bad, *(f"w{k}" for k in range(60))}
    more = spark.createDataFrame([(k, " ".join(bad[:k])) for k in range(5)], "doc_id long, text string")
    got = [x.expected_severity for x in toxicity.score(more, model).orderBy("doc_id").collect()]
    assert got == sorted(got) and got[0] < 0.5 < got[-1]


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        content = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return content, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay_equals_the_library(reference):
    content, library = reference
    r = random.Random(8)
    replay, words = bpe.MergeReplay(content, public_tokenizers.PATTERN, keep_words=500), bpe.Vocabulary(content, "")
    texts = ["".join(r.choice("aabcde ABtheing  \n\t's'll12 3é ßΩ中文🙂.,!-\x1c\x85　\xa0²½") for _ in range(r.randrange(80))) for _ in range(1500)]
    texts += ["a" * 20_000, "ab" * 9_000, " " * 3_000, "", "<|endoftext|>"]
    for begin in range(0, len(texts), 400):
        part = texts[begin : begin + 400]
        got = [np.frombuffer(x, np.int32) for x in replay.encode(part)]
        assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in part]
        assert [words.decode(x).decode() for x in got] == part


def test_token_report(spark, reference):
    _, library = reference
    texts = [None, "", "Hello world, it's 2024!", "Hello world, it's 2024!", "é" * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")) for i, t in enumerate(texts) for ids in [library.encode_ordinary(t or "")]}
    tokenizer = bpe.default_tokenizer(spark)
    both = bpe.decode(bpe.encode(df.withColumn("decoded", F.lit(1)), tokenizer), tokenizer, "_ids")
    assert both.columns == ["doc_id", "_ids", "ids", "decoded", "_decoded"]
    assert [bytes(x._decoded).decode() for x in both.orderBy("doc_id").collect()] == [t or "" for t in texts]
    assert {tuple(x) for x in bpe.token_report(df, tokenizer).collect()} == want
    assert bpe.token_report(df.limit(0), tokenizer).count() == 0
