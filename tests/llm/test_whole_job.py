"""Places where operators once did less than the whole job."""

import random

from lodestone.llm import pii
from lodestone.llm.html_text import main_text

P = "A long story that goes on with many words, sentence after sentence, until it ends here."
STORY = f"<p>{P}</p>" * 4
TEXT = "\n".join([P] * 4)


def test_class_names_do_not_take_out_the_article():
    for attributes in ('class="content with-sidebar"', 'id="main" class="no-sidebar"', 'class="post has-comments"', 'class="social-policy"', 'class="widget"'):
        for tag in ("div", "article", "section"):
            page = f'<body><div class="ad">Buy</div><{tag} {attributes}><h1>T</h1>{STORY}</{tag}><div class="cookie-notice">We use cookies.</div></body>'
            assert main_text(page) == f"T\n{TEXT}", (tag, attributes)
    assert main_text(f'<body><div class="widget"><article>{STORY}</article></div></body>') == TEXT
    assert main_text(f'<body><div class="share">{STORY}</div><p>x</p></body>').startswith(TEXT)


def test_articles_beside_the_core():
    teaser = "<article><p>Read another story.</p></article>"
    assert main_text(f"<body><div>{STORY}</div>{teaser}</body>").startswith(TEXT)
    assert main_text(f"<body><div><article>{STORY}</article><article>{STORY}<p>{P}</p></article></div></body>") == f"{TEXT}\n{TEXT}\n{P}"


def test_reader_comments_are_no_article():
    says = "".join(f"<p>I liked sentence {n} of this story very much, thank you.</p>" for n in range(30))
    for attributes in ('class="comments"', 'id="comments-section"', 'class="comment-list"', 'class="user-comments"'):
        for inner in (says, f"<h3>30 comments</h3>{says}", says[: says.index("3 of")] + "</p>", f'<article class="comment-body">{says}</article>'):
            room = f"<section {attributes}>{inner}</section>"
            assert main_text(f"<body><article><h1>T</h1>{STORY}</article>{room}</body>") == f"T\n{TEXT}", attributes
            assert main_text(f"<body><article><h1>T</h1>{STORY}{room}</article></body>") == f"T\n{TEXT}", attributes
    for name in ("with-comments", "comments-open", "no-comments"):
        assert main_text(f'<body><article class="{name}">{STORY}</article></body>') == TEXT
    assert main_text(f'<body><div class="comments">{STORY}</div><p>x</p></body>').startswith(TEXT)
    assert main_text(f'<body><div class="comment-page"><h1>T</h1>{STORY}</div></body>') == f"T\n{TEXT}"


def test_tags_without_an_end_take_linear_time():
    import time

    begin = time.perf_counter()
    for piece in ("<a ", '<a "', "<a \"'", "<!", "<?", "<a<b", "<a '\"", "</a '"):
        for end in ("", ">", "'>"):
            main_text(piece * 200_000 + end)
    assert time.perf_counter() - begin < 20
    assert main_text("<p>a<b 'c<!-- d") == "a<b 'c"
    assert main_text("<p title=\"it's\">x</p><p title='>y</p><p title=\"a>b\">z</p>") == "x\ny\nz"


def test_a_hot_entity_meets_terms_by_the_words_of_its_texts(spark, monkeypatch):
    """One address in 1,500 texts with 101 telling terms: each text meets the two terms that it has."""
    texts = [f"a text about nothing {n}" for n in range(2000)] + [f"{n} desk@mail.example.com asks name{'abcdefghij'[n % 10]}{'abcdefghij'[n // 10 % 10]}" for n in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, real = [], pii.written

    def counted(rows, name):
        out = real(rows, name)
        if name == "pii_terms":
            met.extend(x.n for x in out.selectExpr("size(terms) AS n").collect())
        return out

    monkeypatch.setattr(pii, "written", counted)
    for broadcast in (200_000, 0):
        met.clear()
        rows = pii.all_spans(df, broadcast_rows=broadcast).collect()
        assert len(met) == 1500 and set(met) == {2}
        assert all({s.value for s in x.term_spans} == set(texts[x.doc_id].split()[2:]) for x in rows if x.doc_id >= 2000)


def test_all_places_of_an_entity_tell(spark):
    r = random.Random(6)
    filler = lambda n: " ".join(r.choices(["river", "stone", "cloud", "table", "green"], k=n))
    texts = [filler(60) for _ in range(30)]
    texts += [f"zebulon zeb@mail.example.com {filler(60)} zeb@mail.example.com {filler(60)} zeb@mail.example.com omega {filler(60)} {n} " + "zeb@mail.example.com " * 20 for n in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {s.value.lower() for x in pii.all_spans(df).collect() for s in x.term_spans}
    assert {"zebulon", "omega"} <= found and not found & {"river", "stone", "cloud", "table", "green"}
