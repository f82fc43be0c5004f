import itertools
import re
import time

import numpy as np
import pytest

from spectroloom.llm import html_extract as H
from spectroloom.llm.html_layouts import labelled_pages
from spectroloom.llm.html_tree import Page

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return H.built_in_model()


PAGES = {
    "<body><header><h1>Site</h1></header><article><h1>T</h1><p>Hello <i>big</i> world &amp; all<br>next</p><p>x</p><aside>promo</aside><div class='comments'><p>a reader's words, quite a few of them</p></div><form><label>Mail</label></form></article><footer>f</footer>": "T\n\nHello big world & all next\n\nx",
    "<body><div class='cookie-notice'>We use cookies</div><div id='content'><h1>T</h1><p>One.</p><p>Two &lt;3</div><div class='sidebar'><p>Related words</p></div>": "T\n\nOne.\n\nTwo <3",
    "<main><p>a</p><script>if (1<2) {'</p>'}</script><!-- <p>no</p> --><div class=advertisement><p>buy this now please</p></div><ul><li>p1<li>p2</ul></main>": "a\n\np1\n\np2",
    "": "",
    "<p": "",
    "<article><p>" + "long " * 30000 + "</article>": "long " * 29999 + "long",
}


def test_main_text(spark, model):
    for source, text in PAGES.items():
        assert H.main_text(model, source) == text
    rows = [(i, f"u{i}", s, 0) for i, s in enumerate(PAGES)] + [(None, None, None, 1), (3, "u", "<main>Some words.</main>", 2), (3, "u", "<main>Some words.</main>", 2)]
    got = H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    assert sorted(len(r.text) for r in got) == sorted(r.n_chars for r in got) == sorted([*map(len, PAGES.values()), 0, 11, 11])
    assert H.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chrome_outweighs_its_text(model):
    said = "<p>" + "a reader has words and more of them to say here, at length " * 3 + "</p>"
    for n in range(1, 11):
        for start, end in (("<section class='comments'>", "</section>"), ("<aside>", "</aside>"), ("<div class='sidebar'>", "</div>"), ("<div class='cookie notice'>", "</div>"), ("<div id='comments'><div>", "</div></div>"), ("<div class='comments'><article>", "</article></div>"), ("<aside><div class='content'>", "</div></aside>")):
            part = start + n * said + end
            for source in (f"<article><h1>T</h1><p>Own.</p>{part}</article>", f"<body><article><h1>T</h1><p>Own.</p></article>{part}</body>"):
                assert H.main_text(model, source) == "T\n\nOwn."
    own = "<p>One line.</p>"
    for source in (f"<article class='post has-comments'>{own}</article>", f"<body class='has-sidebar'><div class='wrap no-sidebar'><div class='post comments-open'>{own}", f"<div class='menu-wrap'><article>{own}", f"<main class='search'>{own}"):
        assert H.main_text(model, source) == "One line."
    for source in (f"<article class='comment'>{own}", f"<div class='post-comments'>{own}", "<p class='no-comments'>One line.", f"<div class='post' hidden>{own}"):
        assert H.main_text(model, source) == ""
    many = H.main_text(model, f"<article>{2000 * said}<aside>{2000 * said}</aside></article>")
    assert many.count("at length") == 3 * 2000


L = " ".join("Words of the piece follow here, one after another, until it ends." for _ in range(4))
P3, T3 = f"<p>{L}</p><p>{L}</p><p>{L}</p>", "\n\n".join([L] * 3)
NAV = "<ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li><li><a href=/b>Contact</a></li></ul>"
#: Pages by hand whose names say nothing or mislead.
PLAIN = [
    (f"<body><p>{L}</p></body>", L),
    (f"<div id=wrap><div class=x1><h1>Big day</h1><p>{L}</p></div></div>", f"Big day\n\n{L}"),
    (f"<div class=content><div class=share-price><p>{L}</p></div></div>", L),
    (f"<article><h1>Big day</h1><p>{L}</p><h2 id=related-work>Related work</h2><p id=notice>{L}</p></article>", f"Big day\n\n{L}\n\nRelated work\n\n{L}"),
    (f"<form id='aspnetForm'><div id='header'><a>Site</a></div><div id='content'><h1>Big day</h1>{P3}</div></form>", "Big day\n\n" + T3),
    (f"<body>{NAV}<h1>Big day</h1>{P3}<div>&copy; 2020 Us</div></body>", "Big day\n\n" + T3),
    (f"<body><div>{NAV}</div><div><h1>Big day</h1>{P3}</div><div>Copyright 2020. All rights reserved.</div></body>", "Big day\n\n" + T3),
    (f"<body><div><div><div>{P3}</div></div></div></body>", T3),
    (f"<table><tr><td>{NAV}</td><td><h1>Big day</h1>{P3}</td></tr></table>", "Big day\n\n" + T3),
    (f"<body><center><h1>Big day</h1></center>{P3}</body>", "Big day\n\n" + T3),
    (f"<body>{L}<br><br>{L}</body>", L + " " + L),
    (f"<div class='a7'><span>{L}</span></div>", L),
    (f"<body><section><h1>Big day</h1>{P3}<ul><li>First point</li><li>Second point</li></ul></section></body>", f"Big day\n\n{T3}\n\nFirst point\n\nSecond point"),
    (f"<div id='q1'><h2>Big day</h2><div class='z'>{P3}</div><blockquote>Said so by all of them.</blockquote></div>", f"Big day\n\n{T3}\n\nSaid so by all of them."),
    (L, L),
    (f"<body><nav>{NAV}</nav><div class='u8'>{P3}</div></body>", T3),
    (f"<body><div class='u8'>{P3}</div><footer>Us</footer></body>", T3),
    (f"<body><div class='u8'>{P3}<div class='k'><label>Mail</label><input><button>Send</button></div></div></body>", T3),
    (f"<body><div class='u8'><h1>Big day</h1><p>{L} <a href=x>a link</a> and so on.</p><pre>x = 1</pre></div></body>", f"Big day\n\n{L} a link and so on.\n\nx = 1"),
    (f"<body><div><h1>Big day</h1>{P3}</div><div><h3>Comments</h3><div><b>Ann</b><p>I think so too, well said.</p></div><div><b>Bob</b><p>Not me.</p></div></div></body>", "Big day\n\n" + T3),
    (f"<body><header><h1>Site</h1></header><div><h1>Big day</h1>{P3}</div></body>", "Big day\n\n" + T3),
    (f"<body><div><p>{L}</p></div><div><p>{L}</p></div></body>", f"{L}\n\n{L}"),
    (f"<body><div class='x'><p>{L}</p><table><tr><td>one</td><td>two</td></tr></table></div></body>", f"{L}\n\none\n\ntwo"),
    (f"<dl><dt>Term</dt><dd>{L}</dd></dl>", f"Term\n\n{L}"),
    (f"<body><main><h1>Big day</h1>{P3}<p>Subscribe to my view that words matter.</p></main></body>", f"Big day\n\n{T3}\n\nSubscribe to my view that words matter."),
    (f"<body><div class='page'><div class='col'>{NAV}</div><div class='col'><h1>Big day</h1>{P3}</div></div></body>", "Big day\n\n" + T3),
]


def test_pages_without_telling_names(model):
    right = [H.main_text(model, source) == text for source, text in PLAIN]
    assert all(right[:4]) and sum(right) >= len(PLAIN) - 2  # what the README says


def test_names_and_article_tags_are_only_evidence(spark, model):
    """Without any article element, class or id, nearly all pages give the same text."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    bare = [re.sub(r"(</?)article", r"\1div", re.sub(r" (class|id)=(\"[^\"]*\"|'[^']*'|[^ >]+)", "", p)) for p in pages]
    same = sum(H.main_text(model, a) == H.main_text(model, b) for a, b in zip(pages, bare))
    assert same >= 0.95 * len(pages)


def test_held_out_layouts(model):
    wrong = runs = 0
    for source in labelled_pages(150, seed=99):
        page = Page(source)
        want = H.labels(page)
        got = [p > 0.5 for p in model.marginals(Page(re.sub(r" y='\w+'", "", source)))]
        told = [k for k, text, _ in page.runs if text.strip()]
        runs += len(told)
        wrong += sum(got[k] != (want[k] == H.TEXT) for k in told)
    assert wrong < 0.02 * runs


def test_messages_match_enumeration(model):
    """Marginals of a small tree by summing over all labellings."""
    for source in ("<div class='content'><p>some words here.</p><ul><li><a>x</a></ul></div><nav>y</nav>", "<h1>a b</h1><div><p>Some words. And more.</p><p>x</p></div>"):
        page = Page(source)
        nodes, n = H.Nodes(page), len(page.tag)
        given = [model.given(*kh) for kh in zip(nodes.keys, nodes.hints)]
        own = [model.evidence(o, w) for o, w in zip(nodes.own, nodes.weight)]
        total, content = 0.0, np.zeros(n)
        for y in itertools.product(range(3), repeat=n):
            w = 1.0
            for k in range(n):
                frame, text = given[k]
                w *= own[k][y[k]] * (frame, (0.0, *text), (0.0, 0.0, 1.0))[y[page.parent[k]] if k else H.FRAME][y[k]]
            total += w
            content += w * (np.array(y) == H.TEXT)
        assert np.allclose(model.marginals(page), content / total, atol=1e-9)


def test_reader_is_linear(model):
    took = {}
    for n in (20_000, 40_000):
        start = time.process_time()
        for source in ("<div>" * n + "x", "<p><b>" * n, "<table><tr><td>" * n, "</i>" * n + "<li>" * n, "<a href='x" * n, "<script" * n):
            Page(source)
        H.main_text(model, "<div>" * n + "x")
        took[n] = time.process_time() - start
    assert took[40_000] < 3.5 * took[20_000]


def test_fit_on_given_pages(spark):
    pages = [s for s in labelled_pages(60, seed=3)]
    once = spark.createDataFrame([(s,) for s in pages], "html string")
    copies = spark.createDataFrame([(s,) for s in [*pages, *60 * pages[:1], None]], "html string").repartition(3)
    a, b = H.fit_tree_model(once), H.fit_tree_model(copies)
    assert np.array_equal(a.weights, b.weights) and a.own == b.own
    assert H.main_text(a, f"<article><h1>T</h1>{P3}</article>") == "T\n\n" + T3
    nothing = H.fit_tree_model(once.limit(0))
    assert nothing is H.built_in_model() and H.fit_tree_model(spark.createDataFrame([("<p>x</p>",)], "html string")) is nothing
