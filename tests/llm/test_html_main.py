import itertools
import random

import numpy as np
import pytest

from tenura.llm import html_main

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy now, it is cheap.</div>
<main><article><header><h1>A title &amp; more</h1></header>
<p>First   paragraph,
 with <b>bold</b> and <a href=x>a link</a> in it.<p>Second one&nbsp;here, it has no end tag.
<script>document.write("<p>script</p>")</script><ul><li>An item of the list, which belongs.</li></ul>
</article><div id="comments"><p>I like this text very much, thank you for it.</p></div></main>
<aside class=sidebar>Other pages you may want to read.</aside><div class="cookie-notice">We use cookies, as all do.</div>
<form><label>Mail</label><input name=m><button>Send</button></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_the_article_and_nothing_else():
    assert html_main.main_text(PAGE, html_main.START).split("\n") == [
        "A title & more",
        "First paragraph, with bold and a link in it.",
        "Second one here, it has no end tag.",
        "An item of the list, which belongs.",
    ]


def test_blocks_of_broken_markup():
    texts = lambda page: [b.text for b in html_main.blocks_of(page)]
    assert texts("") == [] and texts("   ") == []
    assert texts("plain &lt;text&gt; &#233; &unknown;") == ["plain <text> é &unknown;"]
    assert texts("<p>a<p>b<div>c</p>d") == ["a", "b", "c", "d"]
    assert texts("<p>a <b>b<br>c</b></p><p") == ["a b c"]
    assert texts("<p>x</p><script>var a='<p>no</p>'") == ["x"]
    assert texts("<p title=\"a > b\">x</p><p title='unclosed>y</p>") == ["x", "y"]
    assert texts("<!-- open <p>x") == []
    assert len(html_main.blocks_of("<div>" * 3000 + "deep" + "<p>x" * 500)) == 501


def test_cut_is_minimal():
    rng = random.Random(0)
    for n in (1, 2, 5, 8):
        for _ in range(60):
            gain = [rng.uniform(-2, 2) for _ in range(n)]
            edges = [(a, b, rng.uniform(0, 1)) for a in range(n) for b in range(a) if rng.random() < 0.6]
            kept = html_main.minimum_cut(gain, edges)

            def cost(flags):
                terminal = sum(max(g, 0) if not f else max(-g, 0) for g, f in zip(gain, flags, strict=True))
                return terminal + sum(w for a, b, w in edges if flags[a] != flags[b])

            best = min(cost(f) for f in itertools.product([True, False], repeat=n))
            assert cost(kept) == pytest.approx(best)


def test_training_finds_what_tells_text_apart():
    found = [b for _ in range(20) for b in html_main.blocks_of(PAGE)]
    x = html_main.features(found)
    y = html_main.hinted_labels(x)
    weights = html_main.train(x[y >= 0], y[y >= 0])
    assert weights[2] < 0  # links
    assert (weights[html_main.HINTS] == html_main.START[html_main.HINTS]).all()
    assert (html_main.train(x[:0], y[:0]) == html_main.START).all()
    assert html_main.main_text(PAGE, weights).startswith("A title & more\nFirst paragraph")


def test_extract_odd_rows(spark):
    long = "<article>" + "<p>A paragraph of some words, and more of them.</p>" * 3000 + "</article>"
    rows = [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (2, None, None, "c"), (3, "v", "", "c"), (None, "w", long, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_main.extract(pages, html_main.fit(pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((str(r.page_id), r.url, r.n_chars, r.text.count("\n")) for r in got.collect())
    assert [(f[0], f[3]) for f in found] == [("1", 3), ("1", 3), ("2", 0), ("3", 0), ("None", 2999)]
    assert [f[2] for f in found][2:4] == [0, 0]
    assert html_main.extract(pages.where("false"), html_main.fit(pages.where("false"))).count() == 0
    assert np.isfinite(html_main.fit(pages)).all()


def test_neighbours_outvote_a_name():
    """A paragraph that is named like a notice but reads like its neighbours stays; a short advert goes."""
    long = "This sentence belongs to the story, as its length, commas and full stop suggest, and so do the others. "
    page = (
        "<body><nav><a href=x>Home</a> <a href=y>News</a></nav><article>"
        f"<p>{long * 4}</p><p>{long * 3}</p><p class='notice'>{long * 4}</p><p>{long * 4}</p><p>{long * 3}</p>"
        "<div class='ad'><a href=z>Buy now</a></div></article><footer>© 2020 All rights reserved</footer></body>"
    )
    found = html_main.blocks_of(page)
    weights = html_main.START.copy()
    flags = html_main.content_flags(found, weights)
    assert [b.text[:4] for b, keep in zip(found, flags, strict=True) if keep] == ["This"] * 5
    alone = html_main.content_flags(found, weights, smooth=0.0)
    assert [i for i, (a, b) in enumerate(zip(flags, alone, strict=True)) if a != b] == [3]


def test_shared_elements_are_counted():
    page = "<div>a<section><p>b</p><p>c</p></section><ul><li>d<li>e</ul>f</div>g"
    found = html_main.blocks_of(page)
    assert [(b.text, b.depth, b.common) for b in found] == [
        ("a", 1, 0), ("b", 3, 1), ("c", 3, 2), ("d", 3, 1), ("e", 3, 2), ("f", 1, 1), ("g", 0, 0),
    ]
    assert found[1].parent == found[2].parent != found[3].parent == found[4].parent


def test_a_megabyte_of_nested_elements():
    import time
    import tracemalloc

    for page in ("<div>x " * 150_000, "<span>x " * 130_000 + "</b>" * 1000, "<div><p>Words, some. <a>y</a></p>" * 30_000):
        html_main.blocks_of(page[:7000])
        start = time.process_time()
        found = html_main.blocks_of(page)
        html_main.content_flags(found, html_main.START)
        assert time.process_time() - start < 8  # some two seconds on a machine of its own
    tracemalloc.start()
    html_main.blocks_of("<div>x " * 150_000)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
