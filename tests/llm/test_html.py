from __future__ import annotations

import pytest

from corpusmill.llm import html_extract as hx

PAGE = """<!doctype html><html><head><title>T &amp; U</title><style>p { color: red }</style><script>var x = "<p>no</p>";</script></head>
<body><header><a href="/">Home</a></header><nav><ul><li><a>One</a></li></ul></nav>
<div class="cookie-banner">We use cookies</div>
<main><article><h1>Fish &amp; chips</h1><p>First   para&shy;graph
with <b>bold</b> and <a href="x">a link</a>.</p><p>Second &lt;one&gt; &#233;&#x4e2d;</p><div class="ad">Buy now</div>
<aside>Related</aside><ul><li>alpha</li><li>beta</li></ul><form><input><button>Send</button></form></article></main>
<section class="comments"><p>Great post!</p></section><footer>(c) 2020</footer></body></html>"""


def test_article_without_chrome():
    assert hx.main_text(PAGE).split("\n\n") == ["Fish & chips", "First para­graph with bold and a link.", "Second <one> é中", "alpha", "beta"]


@pytest.mark.parametrize("page", [None, "", "<p>", "<html><body></body></html>", "<!-- only -->", "<nav>a</nav>"])
def test_pages_without_text(page):
    assert hx.main_text(page) == ""


@pytest.mark.parametrize("page, text", [
    ("plain text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<div>a<br>b</div>", "a b"), ("<div><p>cut off at the e", "cut off at the e"),
    ("<p>a<!-- x --></p><p>b</p>", "a\n\nb"), ("<table><tr><td>1<td>2</table>", "1\n\n2"), ("<P CLASS=x>A</P>", "A"), ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
])
def test_markup(page, text):
    assert hx.main_text(page) == text


def test_long_and_deep_pages():
    assert hx.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    text = hx.main_text("<article>" + "".join(f"<p>paragraph {i} of a long page</p>" for i in range(20000)) + "</article>")
    assert text.count("\n\n") == 19999 and text.endswith("paragraph 19999 of a long page")


def test_wrappers_are_union_free_expressions():
    a = hx.parse("<div><h1>A</h1><p>x</p></div>")[1]
    b = hx.parse("<div><h1>B</h1><p>y</p><p>z</p><em>t</em></div>")[1]
    assert hx.expression(hx.merge(a, b)) == "<div><h1>#</h1>(<p>#</p>)+(<em>#</em>)?</div>"
    assert hx.expression(hx.merge(b, a)) == hx.expression(hx.merge(a, b))


def test_texts_that_a_host_repeats_are_template(spark):
    rows = [(i, f"http://h.example/{i}", f"<div><p>Sign in to read more stories</p></div><div><p>Story {i} has a text of its own</p></div>") for i in range(12)]
    rows += [(100, "http://other.example/1", "<div><p>Sign in to read more stories</p></div>"), (101, None, None), (102, "no host", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'no' AS HTML")
    got = {r["page_id"]: r["text"] for r in hx.extract(pages).collect()}
    assert all(got[i] == f"Story {i} has a text of its own" for i in range(12))
    assert got[100] == "Sign in to read more stories" and got[101] == "" and got[102] == "x"
    assert hx.extract(pages.where("false")).collect() == []


def test_wrappers_of_hosts(spark):
    pages = spark.createDataFrame([(f"http://h{i % 2}.example/", f"<div><p>{i}</p>{'<b>z</b>' if i > 3 else ''}</div>") for i in range(6)], "url string, html string").repartition(3)
    got = {r["host"]: (r["n_pages"], r["wrapper"]) for r in hx.infer_wrappers(pages).collect()}
    assert got == {h: (3, "<div><p>#</p>(<b>#</b>)?</div>") for h in ("h0.example", "h1.example")}


def test_query(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = hx.op7_html(spark, small).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
        assert "<" not in r["text"] or "&lt;" in pages[r["page_id"]]["html"]
    assert sum(bool(r["text"]) for r in got) > 0.8 * len(got)


@pytest.mark.parametrize("page, text", [
    ('<div class="layout no-sidebar"><article><p>a long text</p></article></div>', "a long text"), ('<div class="share-price"><p>The price is up</p></div>', "The price is up"),
    ('<div id="login-news"><p>News</p></div>', "News"), ('<p title="a>hello</p>', "hello"), ("<p title=it's>hello</p>", "hello"), ('<p title=\'x > "y"\'>a</p>', "a"),
    ("<p>a<svg viewBox=x/>b</p><p>c</p>", "ab\n\nc"), ("<form><div><p>abc</p></div></form>", "abc"), ('<p>one <span class="ad">buy</span> two</p>', "one two"),
    ("<body><nav><a>m</a></nav><h1>T</h1><div><p>x y z</p><p>q</p></div><div>z</div><footer>f</footer></body>", "T\n\nx y z\n\nq"),
    ("<article><header><h1>T</h1></header><p>x</p><footer>by me</footer></article>", "T\n\nx"), ("<script>a</script><p>b</p><script>c", "b"),
])
def test_regions_and_attributes(page, text):
    assert hx.main_text(page) == text


#: A host without telling tags or classes: menu, a notice that never changes, a short teaser that does, the article, and links.
PLAIN = "<body><div><a>Home {0}</a><a>Other</a></div><div>We use files to remember who you are and what you read here, as told elsewhere at length</div><div>Teaser {0}</div><div><div>Title {0}</div>{1}</div><div><ul><li><a>x {0}</a></li><li><a>y</a></li></ul></div></body>"


def host_pages(n: int) -> list[tuple[int, str, str]]:
    return [(i, f"http://plain.example/{i}", PLAIN.format(i, "".join(f"<p>Paragraph {k} of story {i}</p>" for k in range(1 + i % 4)))) for i in range(n)]


def test_the_wrapper_decides(spark):
    rows = host_pages(24)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in hx.extract(pages).collect()}
    for i, _, page in rows:
        assert got[i] == "\n\n".join([f"Title {i}", *(f"Paragraph {k} of story {i}" for k in range(1 + i % 4))])
    # a page alone says less: the long notice wins where the article is short
    assert hx.main_text(rows[0][2]) != got[0]


def one_by_one(rows: list[tuple[int, str, str]]) -> str:
    """Brute force: the pages of a host aligned one after the other."""
    tree = hx.parse(rows[0][2])[1]
    for _, _, page in rows[1:]:
        tree = hx.merge(tree, hx.parse(page)[1])
    return hx.expression(tree)


def test_wrappers_equal_brute_force_however_pages_are_dealt(spark):
    rows = host_pages(24) + [(100 + i, "http://b.example/", f"<main><h1>{i}</h1>{'<p>q</p>' * (i % 3)}{'<dl><dt>a<dd>b<dt>c<dd>d</dl>' * (i % 2)}</main>") for i in range(12)]
    wanted = {"plain.example": one_by_one(rows[:24]), "b.example": one_by_one(rows[24:])}
    assert wanted["b.example"] == "<main><h1>#</h1>(<p>#</p>)*(<dl>(<dt>#</dt><dd>#</dd>)+</dl>)?</main>"
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for parts in (1, 7):
        dealt = pages.repartition(parts, "page_id")
        assert {r["host"]: r["wrapper"] for r in hx.infer_wrappers(dealt).collect()} == wanted


def test_cold_hosts_and_repeated_rows(spark, monkeypatch):
    rows = host_pages(12) + host_pages(3) + [(50, "http://tiny.example/", "<p>alone</p>"), (51, "http://tiny.example/", "<p>alone</p>"), (52, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    wanted = sorted(map(tuple, hx.extract(pages).collect()), key=str)
    assert len(wanted) == len(rows)
    monkeypatch.setattr(hx, "HOT_SHARE", 0.5)
    assert sorted(map(tuple, hx.extract(pages).collect()), key=str) == wanted


def test_class_names_without_end():
    trees = [hx.parse(f"<div>{''.join(f'<div class=c{i}-{k}><p>t</p></div>' for k in range(40))}<div class=body><p>x</p></div></div>")[1] for i in range(30)]
    tree = trees[0]
    for t in trees[1:]:
        tree = hx.merge(tree, t)
    assert len(hx.expression(tree)) < 5000
    deep = hx.parse("<div><dl><dt>" * 500 + "x")
    assert hx.main_text("<div><dl><dt>" * 500 + "x") == "x" and len(deep[0]) == 1
