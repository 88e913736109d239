"""Operators 1 and 2."""

import random

import numpy as np
import pytest

from apiforge.llm import pages, topk


def plain(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors[i, tuple(int(np.floor(64 * float(x))) for x in v)] = 1
    out = set()
    for q, a in vectors:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(a) == len(b))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("blocks", [(8_192, 1_024), (40, 3)])
def test_top_k(spark, blocks):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(20)]) for i in range(120)]
    rows += [(i, rows[5][1]) for i in range(200, 230)]                       # ties
    rows += [rows[7], rows[7], (300, None), (301, [1.0] * 19 + [None]), (302, [float("nan")] * 20),
             (303, [float("inf")] * 20), (None, [1.0] * 20), (305, [1.0, 2.0]), (320, [2.0, 1.0]), (340, []), (360, [])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, id string, score int")
    got = topk.exact_top_k(df, lambda i: i % 20 == 0, k=7, row_block=blocks[0], query_block=blocks[1])
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == plain(rows, 7, 20) and got.count() == len(plain(rows, 7, 20))


def test_top_k_of_huge_numbers_and_nothing(spark):
    rows = [(0, [1e9, -3.0]), (1, [1e5, 2.0]), (2, [1e5, 1.0]), (3, [3e18, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.exact_top_k(df, lambda i: i == 0, k=3).collect()}
    assert got == {1: 64 * 64 * (10 ** 14 - 6), 2: 64 * 64 * (10 ** 14 - 3), 3: 2 ** 63 - 1}
    assert topk.exact_top_k(df.limit(0), lambda i: i == 0).collect() == []


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(5)
    m = np.floor(64 * rng.normal(size=(200, 64)))
    exact, last = m @ m.T, None
    for n in topk.LEVELS:
        f = topk.summaries(m, n)
        bound = f @ f.T
        assert (bound >= exact - 1e-6).all()
        assert last is None or (bound <= last + 1e-6).all()
        last = bound


@pytest.mark.parametrize("html, text", [
    ("", ""), ("   ", ""), ("plain  words &amp; more", "plain words & more"),
    ("<p>a<p>b", "a\n\nb"), ("a<b", "a"), ("<a href='x", ""), ("<!-- x", ""), ("<p title=\"a>b</p>c", "b\n\nc"),
    ("<script>x</scrip", ""), ("<script>var t='</p>';</script><p>y</p>", "y"), ("<ul><li>a<li>b</ul>c", "a\n\nb\n\nc"),
    ("<nav>n</nav><article><header><h1>T</h1></header><p>x <b>y</b><br>z</p><div class='comments'>c</div></article><p>o</p>",
     "T\n\nx y z"),
    ("<main><p>m</p><aside>s</aside></main><p>o</p>", "m"),
    ("<body class='with-sidebar'><div id=sidebar>s</div><div role=navigation>n</div><p>k</p></body>", "k"),
    ("<p>1 &lt; 2&nbsp;3 &#228;</p><form>f</form>", "1 < 2 3 ä"),
    ("<article><p>q<p>r</article><footer>f", "q\n\nr"), ("<table><tr><td>a<td>b</table>", "a\n\nb"),
    ("<article class='comment'><p>c</p></article><p>t</p>", "t"),
    ("<body><form id=aspnet><input><nav>n</nav><article><p>a</p></article><p>f</p></form></body>", "a"),
    ("<div class='page no-sidebar'><article><p>a</p></article></div>", "a"),
    ("<article class='post comments-open'><p>a</p></article>", "a"),
    ("<div class='has-menu wrapper'><article><p>a</p></article></div>", "a"),
    ("<article><p>a</p><p class='notice-period'>b</p><p class='cookie-notice'>c</p></article>", "a\n\nb"),
    ("<article><p>t</p></article><div><p>the whole story stands here</p></div>", "t\n\nthe whole story stands here"),
    ("<main><header><h1>T</h1></header><p>m</p></main><p>o</p>", "T\n\nm"),
    ("<div class='comments-area'><article><p>c</p></article></div><div id='main-nav'>n</div><p>t</p>", "t"),
    ("<div class='site-footer-2'>f</div><div class=widget_list>w</div><form><p>f</p></form><p>t</p>", "t"),
])
def test_pages(html, text):
    assert pages.Page(html).text() == text


def test_long_and_deep_pages_take_linear_time():
    assert pages.Page("<div>" * 20_000 + "x" + "</div>" * 20_000).text() == "x"
    assert pages.Page("<p>a" * 20_000).text().count("a") == 20_000
    assert pages.Page("<" * 200_000).text() == "<" * 200_000


def test_style_tree_removes_what_a_site_repeats(spark):
    rnd = random.Random(1)
    word = lambda: "w" + str(rnd.randint(0, 10 ** 6))
    rows = []
    for site, n in (("http://Big.example/", 30), ("http://small.example/", 3)):
        for i in range(n):
            body = "".join(f"<p>{word()} {word()}</p>" for _ in range(3))
            rows.append((len(rows), f"{site}{i}", f"<body><div class=x9><span>Our shop</span><p>All offers</p></div>"
                                                  f"<div class=k2>{body}</div></body>", 1, "h"))
    rows += [(100, None, None, 1, "h"), (101, "no host", "<p>t</p>", 1, "h"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host int, h string")
    got = pages.main_text(df).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"} and len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id < 30:
            assert "shop" not in r.text and "offers" not in r.text and r.text.count("\n\n") == 2
        elif r.page_id < 33:
            assert r.text.startswith("Our shop\n\nAll offers\n\nw")       # too few pages to tell
    assert {r.page_id: r.text for r in got if r.page_id >= 100} == {100: "", 101: "t"}
    assert pages.main_text(df.limit(0)).collect() == []


def test_style_tree_keeps_articles_that_are_copied(spark):
    rnd = random.Random(2)
    word = lambda: "w" + str(rnd.randint(0, 10 ** 6))
    unmarked = lambda p: f"<body><div class=x9>All offers</div><div class=k2><p>{p}</p></div></body>"
    marked = lambda i, p: f"<body><div class=w>Welcome<article><h2>In brief</h2><p>{p} {i}</p></article></div></body>"
    rows = [(f"http://copies.example/{i}", unmarked("the one article")) for i in range(10)]
    rows += [(f"http://most.example/{i}", unmarked("copied article" if i < 85 else f"own {word()} {i}")) for i in range(100)]
    rows += [(f"http://marked.example/{i}", marked(i, word())) for i in range(20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert {got[i] for i in range(10)} == {"All offers\n\nthe one article"}        # one page tells nothing of the site
    assert {got[i] for i in range(10, 95)} == {"copied article"}
    assert all(got[i].startswith("own w") for i in range(95, 110))
    assert all(got[i].startswith("In brief\n\nw") for i in range(110, 130))
