import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcorpus.llm import additive_ann, bpe, html_extract
from weftcorpus.llm.alignment import match

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    ids = [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return ids, [t.decode(x, skip_special_tokens=False) for x in ids]


def strange_texts():
    random.seed(1)
    some = ["", "  ", "a<|endoftext|>b  <|endoftext|>", "x" * 3000, " \n\n\t  x", "😀 你好,世界! ՘ a՘", "don't we'll 'S 123abc ½ ²", "\x1c\x1d a\x85b c", "=-" * 200, "‍﻿"]
    some += ["".join(random.choice("abe thin'\n  1²éß😀中՘.,<|>") for _ in range(60)) for _ in range(200)]
    return some + ["".join(chr(random.choice([random.randrange(32, 0x250), random.randrange(0x2000, 0x2100), random.randrange(0x500, 0xD000)])) for _ in range(50)) for _ in range(200)]


def test_ids_are_those_of_the_library(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(strange_texts(), 5000)), "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    keys = list(texts)
    ids, decoded = reference([texts[k] for k in keys])
    want = {k: (len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for k, i, d in zip(keys, ids, decoded)}
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == docs.count() and all(tuple(r[1:]) == want[r.doc_id] for r in got)
    encoded = bpe.encode(docs, PATH)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == dict(zip(keys, ids))
    assert {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()} == dict(zip(keys, decoded))


def test_forgotten_words_are_encoded_again():
    small, large = bpe.Codec(open(PATH, encoding="utf-8").read(), known_words=5), bpe.Codec(open(PATH, encoding="utf-8").read())
    texts = ["the quick brown fox", "jumps over the lazy dog", "the quick brown fox again and again"]
    assert [small.encode_batch([t]) for t in texts] == [large.encode_batch([t]) for t in texts]


def test_encoding_nothing(spark, empty):
    assert bpe.op6(spark, empty).count() == 0


# nearest neighbours


def vectors(n=1500, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[300:700] = x[300]  # copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * dim), (5040, [float("nan")] + [1.0] * (dim - 1)), (5060, [1.0] * 3), (5080, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim)]
    return x.astype(np.float64), rows + odd


def test_neighbours_are_near_brute_force(spark):
    x, rows = vectors()
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)
    got = additive_ann.neighbours(df, shortlist=200).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    for q, rows_ in by.items():
        assert [r.rank for r in rows_] == list(range(1, 21)) and q not in [r.vec_id for r in rows_]
        s = x @ x[q]
        assert np.allclose([r.score for r in rows_], [s[r.vec_id] for r in rows_], atol=1e-12)
        assert [(-r.score, r.vec_id) for r in rows_] == sorted((-r.score, r.vec_id) for r in rows_)
        hits += len({r.vec_id for r in rows_} & {j for _, j in sorted((-a, j) for j, a in enumerate(s) if j != q)[:20]})
    assert hits / (20 * len(by)) >= 0.9
    # of many copies of the nearest vector the smallest ids are returned
    assert [r.vec_id for r in by[320]] == list(range(300, 320))


def test_few_vectors_and_groups_of_queries(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (7, [1.0, 1.0])], "id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in additive_ann.neighbours(df).collect())
    assert got == [(0, 1, 20, 4.0), (0, 2, 7, 3.0), (20, 1, 0, 4.0), (20, 2, 7, 3.0)]
    assert additive_ann.neighbours(df.where("false")).count() == 0
    x, rows = vectors(400)
    v = additive_ann.usable(spark.createDataFrame(rows, "id long, embedding array<float>")).cache()
    c = additive_ann.train(v, 4, 32, 1000)
    index = additive_ann.build(v, c, 5, 2, 30)
    q = v.where("id % 20 = 0")
    once, grouped = ({tuple(r) for r in additive_ann.search(index, q, c, 5, 400, group=g).collect()} for g in (4096, 4))
    assert {r[:3] for r in once} == {r[:3] for r in grouped}


def test_columns_of_any_name_and_repeated_rows(spark):
    rows = [(0, [1.0, 2.0], 3, "v"), (0, [1.0, 2.0], 3, "v"), (20, [2.0, 1.0], 4, "w"), (7, [1.0, 1.0], 5, "x")]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, ids int, vector string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in additive_ann.neighbours(df).collect())
    assert got == [(0, 1, 20, 4.0), (0, 2, 7, 3.0), (20, 1, 0, 4.0), (20, 2, 7, 3.0)]


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12))
    books = additive_ann.residual_codebooks(x, 4, 16)
    error = lambda beam: ((x - sum(books[m][additive_ann.beam_encode(x, books, beam)[:, m]] for m in range(4))) ** 2).sum()
    assert error(8) <= error(1)


# pages


def text_of(page):
    return html_extract.extract(html_extract.parse(page))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:">"}</style><script>var a="<p>no</p>";</script></head><body class="home"><header>Site</header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">Accept</div><main><article class="post"><h1>Caf&eacute; &amp; Bar</h1><p>One <b>bold</b>
 word<br>and<!-- no --> more &lt;3<p>Two <span class="ad-slot">Buy!</span>done<ul><li>x<li>y</ul><form><input value=1>Mail</form></article>
<section id="comments"><article class="comment">Nice!</article></section></main><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_article_without_furniture():
    assert text_of(PAGE) == "Café & Bar One bold word and more <3 Two done x y"


def test_broken_pages():
    assert text_of("") == "" and text_of("<") == "<" and text_of("just text &am") == "just text &am"
    assert text_of("<article><p>a<p>b &amp") == "a b &" and text_of("<article>a<script>x") == "a" and text_of("<article>a <b>c</article>d") == "a c"
    assert text_of("<article>a<!-- b") == "a" and text_of("<article>x</p>y</div>z<p") in ("xyz", "x yz", "xy z", "x y z")
    assert text_of("<body><div><p>no article</p><ul><li><a>1</a><li><a>2</a><li><a>3</a></ul></div>") == "no article"


def test_matching_of_trees():
    (a, x), (b, y) = (html_extract.skeleton(html_extract.parse(x)) for x in ("<div><p>same</p><p>one</p><ul><li>k</li></ul></div>", "<div><h1>new</h1><p>same</p><p>two</p><p>three</p><ul><li>k</li></ul></div>"))
    _, pairs = match(a, b)
    words = {("".join(n.text for n in x[u]), "".join(n.text for n in y[v])) for u, v in pairs if x[u] and y[v]}
    assert {("same", "same"), ("k", "k")} < words and len(words) == 3


def pages(n, host="h.example"):
    return [(i, f"https://{host}/{i}", f"<html><body><div><p>Welcome to our site</p><h1>Title {i}</h1><p>Body number {i} {'x' * i}</p><p>All rights reserved</p></div></body></html>") for i in range(n)]


def test_constant_nodes_are_template(spark):
    same = [(100 + i, "http://two.example/", "<body><p>Menu</p><p>The same article</p></body>") for i in range(6)]
    rows = pages(12) + same + [(200, None, "<article>No host</article>"), (201, "x", None), (202, "http://h.example/z", ""), (0, "https://h.example/0", pages(1)[0][2]), (None, "https://h.example/9", "<article>q</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url): r for r in html_extract.main_text(df).collect()}
    assert html_extract.main_text(df).count() == len(rows)
    assert got[5, "https://h.example/5"].text == "Title 5 Body number 5 xxxxx"
    assert got[100, "http://two.example/"].text == "Menu The same article"  # like pages show no template
    assert got[200, None].text == "No host" and got[201, "x"].text == "" and got[201, "x"].n_chars == 0 and got[202, "http://h.example/z"].text == ""
    assert html_extract.main_text(df.where("false")).count() == 0
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_content_that_some_pages_share_stays(spark):
    rows = [(i, f"https://h.example/{i}", f"<article><p>Title {i}</p>{'<p>Shared passage</p>' if i % 3 == 0 else ''}<p>End {i}</p></article>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert got[3] == "Title 3 Shared passage End 3"
