import itertools
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq

from quire.llm import mincut

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><a href=x>Home</a></header>
<nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main-content"><h2>Head &amp; line</h2><p>First paragraph with quite
 a few words in it, and a <a href="u">link</a>.</p><p>Short.</p><div class="ad-banner">Buy now!</div>
<p>Second paragraph &#8211; with more words to read here.</p><ul><li>item one is good</li><li>item two</li></ul></div>
<aside>Side stuff here</aside><section class="comments"><h3>Comments</h3><p>I liked this article a lot, thanks.</p></section>
<form><label>Name</label><input></form><footer>&copy; 2020</footer><script>var a="</p>";</script></body></html>"""
TEXT = "Head & line\nFirst paragraph with quite a few words in it, and a link.\nShort.\nSecond paragraph – with more words to read here.\nitem one is good\nitem two"


def test_page():
    assert mincut.main_text(PAGE)[0] == TEXT


def test_article_with_malformed_tags():
    page = '<body><nav><a>x</a></nav><!-- c --><div class="ad">Ad text of a few words.</div><article><h1>Title</h1><p><b>Title and text.<br><p>To.</p><p>More &amp;&amp;&amp; of it.</p></article><footer>&copy; x</footer>'
    assert mincut.main_text(page)[0] == "Title\nTitle and text.\nTo.\nMore &&& of it."
    assert mincut.main_text(page[: page.index("of it")] + "&am")[0].endswith("More &&& &am")


def test_containers():
    body = "<p>A first paragraph with enough words to be read as text.</p><p>And then a second one, which is as long as that.</p>"
    text = "A first paragraph with enough words to be read as text.\nAnd then a second one, which is as long as that."
    note = "<p>I have read this and wish to say a few words about it.</p>"
    assert mincut.main_text(f'<body class="single with-sidebar"><div class="wrap has-ads"><article>{body}</article></div></body>')[0] == text
    assert mincut.main_text(f'<body><main>{body}</main><article class="comment">{note}</article></body>')[0] == text
    assert mincut.main_text(f'<body><article>{body}<div id="comments"><article>{note}</article></div></article></body>')[0] == text
    head = '<div class="entry-header"><h1>The title of it</h1><span>by somebody on a day</span></div>'
    assert mincut.main_text(f"<body><article>{head}{body}</article></body>")[0] == "The title of it\n" + text
    assert mincut.main_text(f'<body><div class="header"><p>{"Words of a page header. " * 3}</p></div><div>{body}</div></body>')[0] == text
    assert mincut.main_text(f'<body><div>{body}</div><aside>{note}</aside><form>{note}</form><div role="alert">{note}</div></body>')[0] == text


def test_defined_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p"), (3, "w", "<p>" + "word " * 30000), (3, "w", "<script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.id), str(r.url), len(r.text)) for r in mincut.extracted(df).collect())
    assert got == [("1", "u", 0), ("2", "None", 0), ("3", "w", 0), ("3", "w", 149999), ("None", "v", 0)]
    assert mincut.extracted(df.limit(0)).collect() == []


def test_minimum_cut():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 7)
        own = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 1.5)) for _ in range(10)]

        def cost(labels, own=own, edges=edges):
            alone = sum(max(x, 0) if not y else max(-x, 0) for x, y in zip(own, labels, strict=True))
            return alone + sum(c for a, b, c in edges if labels[a] != labels[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(mincut.minimum_cut(own, edges)) - best) < 1e-6


def test_many_blocks_are_fast():
    page = "<body>" + "".join(f"<div><p>w{i}</p><a>l</a></div>" for i in range(5000))
    assert mincut.main_text(page)[1] == 10000


def test_names_alone_do_not_decide():
    body = "<p>A first paragraph with enough words to be read as text.</p>"
    more = '<p class="more">And a second one that goes on with what the first one says.</p>'
    effects = '<div class="side-effects"><p>Sleep, rest and water, and what they do to those who take it.</p></div>'
    for page in (f"<article>{body}{more}{effects}{body}</article>", f"<div>{body}{more}{effects}{body}</div>"):
        assert len(mincut.main_text(f"<body><nav><a>x</a></nav>{page}</body>")[0].split("\n")) == 4
    assert len(mincut.main_text(f'<body><article>{body}<p class="ad">Buy one now, and get one more.</p>{body}</article></body>')[0].split("\n")) == 2


def stripped(page):
    """A page without the tags that say what is an article."""
    return re.sub(r"<(/?)(?:article|main|nav|footer|aside|header)\b[^>]*>", r"<\1div>", page)


def test_the_cut_helps_where_tags_do_not_say():
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist()
    model = mincut.fit_cut(pages[:300])
    alone = cut = moved = total = 0
    for page in pages[300:1500]:
        truth, blocks = mincut.weak_labels(mincut.blocks_of(page)), mincut.blocks_of(stripped(page))
        assert len(truth) == len(blocks)
        scores = mincut.content_scores(blocks, model)
        kept = mincut.minimum_cut(scores, mincut._edges(blocks, model))
        for s, k, y in zip(scores, kept, truth, strict=True):
            if y >= 0:
                total, alone, cut, moved = total + 1, alone + ((s > 0) == y), cut + (k == y), moved + ((s > 0) != k)
    assert moved > 0 and cut > alone and cut >= 0.999 * total


def test_fit():
    assert mincut.fit_cut([]) is mincut.DEFAULT and mincut.fit_cut(["<p>text without an article"]) is mincut.DEFAULT
    page = "<body><nav><p>one</p></nav><article>" + "<p>Two words.</p>" * 5 + "</article></body>"
    model = mincut.fit_cut([page] * 20)
    assert np.abs(model.weights - mincut.DEFAULT.weights).max() < 3 and (model.near <= mincut.PULL).all()


def test_unclosed_raw_tags_are_fast():
    began = time.time()
    assert mincut.main_text("<body>" + "<p>a few words of text.</p><svg><math>" * 40_000)[1] == 40_000
    assert time.time() - began < 20


def test_ties_go_to_boilerplate():
    assert mincut.minimum_cut([0.0, 1.0, -1.0], [(1, 2, 1.0)]) == [False, False, False]
