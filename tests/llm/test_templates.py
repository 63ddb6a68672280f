"""Templates of hosts: every page of a host counts."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftcorpus.llm import html_extract
from weftcorpus.llm.alignment import Tree, match, siblings


def words(seed, n=12):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def texts(spark, bodies):
    rows = [(i, f"https://h.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_each_layout_has_its_template(spark):
    body = lambda i: f'<div class="{"a" if i % 2 else "b"}"><p>{"Odd" if i % 2 else "Even"} pages greet you</p><p>{words(i)}</p></div>'
    assert texts(spark, map(body, range(40))) == {i: words(i) for i in range(40)}


def test_notice_of_a_part_of_the_pages(spark):
    body = lambda i: f"<div><p>{words(i)}</p>{'<p>Our shop moves in May</p>' if i % 5 < 3 else ''}</div>"
    assert texts(spark, map(body, range(40))) == {i: words(i) for i in range(40)}


def test_near_copies_show_no_template(spark):
    bodies = [f"<div><p>{words(1)}</p><p>{words(2)} {c}</p></div>" for c in "xyz"]
    assert texts(spark, bodies) == {i: f"{words(1)} {words(2)} {c}" for i, c in enumerate("xyz")}


def test_middle_of_long_pages(spark):
    body = lambda i: "<div>" + "".join(f"<p>{words(1000 * i + k, 2)}</p>" + ("<p>Read on below</p>" if k == 120 else "") for k in range(240 + i)) + "</div>"
    got = texts(spark, map(body, range(6)))
    assert got == {i: " ".join(words(1000 * i + k, 2) for k in range(240 + i)) for i in range(6)}
    (a, _), (b, _) = (html_extract.skeleton(html_extract.parse(body(i))) for i in range(2))
    size, pairs = match(a, b)
    assert len([1 for u, v in pairs if a.text[u] and a.text[u] == b.text[v]]) == 1
    assert size == sum(2 if a.text[u] and a.text[u] == b.text[v] else 1 for u, v in pairs)


def test_elements_without_an_end_hide_nothing():
    text = lambda page: html_extract.extract(html_extract.parse(page))
    for tag in ("select", "object", "svg", "noscript", "template"):
        assert text(f"<article><p>a</p><{tag}><p>b</p><p>c</p></article>") == "a b c"
        assert text(f"<article><p>a</p><{tag}></{tag}><p>b</p></article>") == "a b"
    assert text("<article>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b <object data=q>in words</object></article>") == "a x = 2 b in words"
    assert text("<article>a<select><option>1<option>2</select> b<svg><title/><text>t</text></svg> c<template><p>no</p></template> d<script>e") == "a b c d"


def test_names_of_prose_and_own_headers():
    text = lambda page: html_extract.extract(html_extract.parse(page))
    page = '<header>Site</header><article><header><h1>Title</h1></header><p>Body</p><p class="related-work">one</p><p id="search">two</p><math>x</math><p class="ad">Buy</p><div class="related-links">no</div><footer>Tags</footer></article>'
    assert text(page) == "Title Body one two x"


def tree(r, n):
    """A random tree in document order, with few labels and texts."""
    parent = [0] + [r.randrange(i) for i in range(1, n)]
    kids = [[j for j in range(1, n) if parent[j] == i] for i in range(n)]
    order, todo = [], [0]
    while todo:
        order.append(todo.pop())
        todo += reversed(kids[order[-1]])
    place = {x: i for i, x in enumerate(order)}
    return Tree([place[parent[x]] for x in order], [1] + [r.randrange(1, 3) for _ in order[1:]], [0 if kids[x] else r.randrange(1, 4) for x in order], [False] * n)


def largest(a, b, u=0, v=0):
    """Simple tree matching as its recurrence states it."""
    if a.label[u] != b.label[v]:
        return 0
    x, y = a.kids[u], b.kids[v]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + largest(a, b, p, q))
    return 1 + (a.text[u] == b.text[v] != 0) + m[-1][-1]


def test_matches_are_the_largest():
    for seed in range(200):
        r = random.Random(seed)
        a, b = tree(r, r.randrange(1, 25)), tree(r, r.randrange(1, 25))
        size, pairs = match(a, b)
        assert size == largest(a, b) == sum(1 + (a.text[u] == b.text[v] != 0) for u, v in pairs)
        assert all(u == v == 0 or (a.parent[u], b.parent[v]) in pairs for u, v in pairs)
        assert Tree.unpacked(a.packed()).kids == a.kids


def test_split_tables_lose_nothing():
    for seed in range(40):
        r = np.random.default_rng(seed)
        w = r.integers(0, 3, r.integers(1, 60, 2))
        whole, split = (siblings(lambda i, lo, hi: w[i, lo:hi], *w.shape, most_cells=k) for k in (1 << 20, 40))
        assert sum(w[p] for p in whole) == sum(w[p] for p in split) and sorted(split) == sorted(split, key=lambda p: p[1])


def test_deep_wide_and_broken_pages(spark):
    deep = lambda i: "<div>" * 3000 + f"<p>{words(i)}</p><p>Same for all</p>"
    assert texts(spark, map(deep, range(5))) == {i: words(i) for i in range(5)}
    assert html_extract.extract(html_extract.parse("<b>" * 20000 + "x" + "</i>" * 20000)) == "x"
    assert html_extract.extract(html_extract.parse("<p>" * 20000 + "x<br>y" + "</div>" * 20000)) == "x y"


def test_links_of_the_frame_are_template(spark):
    """Of pages without a marked article, links with varying words in a constant place."""
    body = lambda i: f'<div><p><a href="/{i}">{words(i, 2)}</a></p><p>{words(100 + i)} <a href="#">{words(200 + i, 1)}</a></p></div>'
    assert texts(spark, map(body, range(8))) == {i: f"{words(100 + i)} {words(200 + i, 1)}" for i in range(8)}
    marked = lambda i: f"<article>{body(i)}</article>"
    assert texts(spark, map(marked, range(8))) == {i: f"{words(i, 2)} {words(100 + i)} {words(200 + i, 1)}" for i in range(8)}


def test_texts_that_never_meet_on_a_page(spark):
    """Each of two notices is on most pages, on some without the other: more than one pivot is needed."""
    body = lambda i: f"<div><p>{words(i)}</p>{'<p>Closed on Monday</p>' if i % 10 < 6 else ''}{'<p>Open on Sunday</p>' if i % 10 > 3 else ''}</div>"
    assert texts(spark, map(body, range(40))) == {i: words(i) for i in range(40)}


def test_no_pages_and_odd_columns(spark):
    df = spark.createDataFrame([(1, "https://h.example/1", None, "x", 1), (None, None, "<p>a b</p>", "x", 2), (2, "nowhere", "", "x", 3), (2, "nowhere", "", "x", 3)], "page_id long, url string, html string, host string, layout int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_extract.main_text(df).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("None", "a b", 3)]
    assert html_extract.main_text(df.where(F.lit(False))).count() == 0


def test_names_that_merely_have_a_listed_word():
    text = lambda page: html_extract.extract(html_extract.parse(page))
    kept = [("section", "id", "search-engines"), ("table", "class", "market-share"), ("section", "class", "ad-hoc-networks"), ("div", "class", "menu-of-the-day"), ("div", "class", "hidden-gems"), ("section", "id", "reply-to-critics"), ("div", "class", "product-promotion-history"), ("section", "id", "discussion")]
    for tag, kind, name in kept:
        inner = "<tr><td>words of it</td></tr>" if tag == "table" else "<p>words of it</p>"
        assert text(f'<article><p>a</p><{tag} {kind}="{name}">{inner}</{tag}><p>b</p></article>') == "a words of it b", name
    gone = ["ad", "ads", "ad-slot", "cookie-notice", "cookie_banner", "share-buttons", "user-comments", "comments-section", "comment-list", "related-posts", "newsletter-signup", "sidebar", "sidebar-left", "site-header", "page-footer", "main-menu", "breadcrumbs", "promo", "notice", "search-box", "article-comments", "ad-3"]
    for name in gone:
        assert text(f'<article><p>a</p><div class="x {name}"><p>words of it</p></div><p>b</p></article>') == "a b", name
    for name in ("article-header", "post-footer-notes", "entry-header"):
        assert text(f'<article><div class="{name}">t</div><p>a</p></article>') == "t a", name
    assert text('<article><p>a</p><p style="display: none">b</p><span aria-hidden="true">c</span></article>') == "a b c"
    assert text('<body><p>a</p><p style="display: none">b</p></body>') == "a"
    assert text('<main><article class="comment">x</article><article class="commentary">y</article></main>') == "y"


def test_lists_of_links():
    text = lambda page: html_extract.extract(html_extract.parse(page))
    links = "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(3))
    assert text(f"<body><ul>{links}</ul><h1>Title</h1><ul>{links}</ul><p>The first prose of this page.</p><ul>{links}</ul></body>") == "Title The first prose of this page. link 0 link 1 link 2"
