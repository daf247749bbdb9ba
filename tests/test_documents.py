"""Page fixtures in both cleaning modes."""

import pytest
from pyspark.sql import functions as F

from pageloom.operators.document import content_type, extract_documents, visible_text

URL = "https://h.example.org/d/p"
PAGES = {
    1: '<div class="ad">x<div>y</div>z</div><p>k</p>',
    2: "<header><main><p>k</p></main></header><header>n</header>",
    3: '<div class="content ad">n</div>',
    4: '<div class="advert-x">k</div><div class="big ad">n</div>',
    5: '<base href="/z/"><a href="q">t</a>',
    6: '<img src="a.png" srcset="s.png 1x, l.png 2x"><img src="data:image/png;base64,AA">',
    7: '<form>n<input></form><button>n</button><iframe>n</iframe><p onclick="x()">k</p>',
    8: '<p>a<script>var t="</p>";</script>b</p>',
    9: "<h2>T</h2><ul><li>a<ul><li>b</li></ul></li></ul><ol><li>x</li><li>y</li></ol>",
    10: "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>",
    11: "<blockquote>q</blockquote><pre>a  b</pre><hr><b>s</b><em>e</em><code>c</code>",
    12: '<a href="/x">l1<br>l2</a><a href="#m">Skip to main content</a>',
    13: "<p>a &lt; b &amp;lt; c &#39;d&#x41;</p>",
    14: "<p>a < b</p>",
    15: '<a title="x > y" href="/q">t</a>',
    16: '<nav><a href="/n">n</a></nav>',
    17: "",
    18: None,
    19: '<a href="javascript:x()">j</a> <a href="https://h.example.org/u">https://h.example.org/u</a>',
    20: "<ol><li><p>a</p></li><li>b<ol><li>c</li></ol></li><li>d</li></ol><p>e <b> f </b><i>g</i> *</p>",
    21: "<p><b>one<br><p>two</p><p>three</p>",
    22: "<title>T</title><nav>menu</nav><p>body</p>",
    24: '<p>first</p><section><div class="ad">x</section><p>keep me</p>',
    25: '<p>first</p><ul><li class="menu">m<li>keep</ul><p>after</p>',
    26: '<p>first</p><table><tr><td class="side">s<td>keep</table><p>after</p>',
    27: "<table><tr><td>a<td>b<tr><td>c<td>d</table>",
    28: '<nav><a href="/n">menu</a></nav><article><p>&nbsp;</p></article>',
    29: "<p>&copy 2024 &notit; &NotEqualTilde; &#99999999999999999999; &#x1F600 &amp</p>",
    30: "<div><p>a<div>b</p></div></div></section>c<p>d</p>",
    23: '<ul class="menu"><li>n</li></ul><section id="nav">n</section><div role="main">k</div>',
}
SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, URL, h) for i, h in PAGES.items()], SCHEMA)


@pytest.fixture(scope="module")
def declared(pages):
    return {r.page_id: r for r in extract_documents(pages).collect()}


@pytest.fixture(scope="module")
def sanitized(pages):
    return {r.page_id: r for r in extract_documents(pages, "sanitize_first").collect()}


@pytest.mark.parametrize("page,markdown", [
    (1, "k"), (2, "k"), (3, "n"), (4, "k"), (5, "[t](https://h.example.org/z/q)"),
    (6, "![](https://h.example.org/d/l.png)"), (7, "k"), (8, "ab"),
    (9, "## T\n\n- a\n  - b\n\n1. x\n2. y"),
    (10, "| A | B |\n| --- | --- |\n| 1 | 2 |"),
    (11, "> q\n\n```\na  b\n```\n\n---\n\n**s***e*`c`"),
    (12, "[l1\\\\\nl2](https://h.example.org/x)[Skip to main content](https://h.example.org/d/p#m)"),
    (13, "a < b &lt; c 'dA"), (14, "a < b"), (15, "[t](https://h.example.org/q)"),
    (16, "[n](https://h.example.org/n)"), (17, ""), (18, ""),
    (24, "first\n\nkeep me"), (25, "first\n\n- keep\n\nafter"), (26, "first\n\n| keep |\n| --- |\n\nafter"),
    (27, "| a | b |\n| --- | --- |\n| c | d |"), (28, "[menu](https://h.example.org/n)"),
    (29, "© 2024 &notit; ≂̸ \ufffd 😀 &"), (30, "a\n\nb\n\nc\n\nd"),
    (19, "j <https://h.example.org/u>"),
    (20, "1. a\n\n2. b\n   1. c\n3. d\n\ne  **f** *g* \\*"),
    (21, "**one**\\\n\n**two**\n\n**three**"), (22, "body"), (23, "k"),
])
def test_declared_markdown(declared, page, markdown):
    assert declared[page].markdown == markdown


def test_declared_html_links_images(declared):
    assert declared[5].links == ["https://h.example.org/z/q"]
    assert declared[6].images == ["https://h.example.org/d/l.png"]
    assert declared[7].html == "<p>k</p>"
    assert declared[13].html == PAGES[13]
    assert declared[19].links == ["https://h.example.org/u"]
    assert declared[16].links == ["https://h.example.org/n"]


@pytest.mark.parametrize("page,words", [
    (1, "x y z k"), (2, "k n"), (3, "n"), (4, "k n"), (16, "[n](https://h.example.org/n)"), (22, "Tmenu body"),
])
def test_sanitize_first_keeps_text(sanitized, page, words):
    assert " ".join(sanitized[page].markdown.split()) == words


def test_sanitize_first_has_no_images_and_no_base(sanitized):
    assert sanitized[6].images == [] and sanitized[6].markdown == ""
    assert sanitized[5].links == ["https://h.example.org/d/q"]


def test_metadata(spark):
    html = (
        '<html lang="de"><head><title> </title><meta name="twitter:title" content="TW">'
        '<meta property="og:title" content="OG"><meta name="Description" content="d1">'
        '<meta name="description" content="d2"><meta name="dc.date" content="2020">'
        '<meta name="dcterms.created" content="2021"><meta name="x" content="1"><meta name="x" content="2">'
        '<meta name="x" content="3"><meta name="y" content=" "><meta content="noname">'
        '<link rel="apple-touch-icon" href="/i.png"></head></html>')
    row = extract_documents(spark.createDataFrame([(1, URL, html)], SCHEMA)).first().metadata
    assert (row.title, row.og_title, row.description, row.language) == ("TW", "OG", "d2", "de")
    assert (row.dc_date, row.extra, row.favicon) == ("2021", {"x": ["1", "2", "3"]}, "https://h.example.org/i.png")
    assert row.keywords is None and row.robots is None
    assert row.url == URL and row.source_url == URL and row.status_code == 0


def test_description_falls_back_to_twitter_and_title_to_og(spark):
    html = ('<meta name="twitter:description" content="td"><meta property="og:title" content="OG">'
            '<meta itemprop="article:tag" content="a&amp;b">')
    row = extract_documents(spark.createDataFrame([(1, URL, html)], SCHEMA)).first().metadata
    assert (row.title, row.description, row.article_tag) == ("OG", "td", "a&b")


def test_content_type_chain(spark):
    rows = spark.createDataFrame([({"content-type": ["a/b"]}, "c/d"), ({"content-type": [""]}, "c/d"),
                                  ({}, ""), ({}, None)], "e map<string,array<string>>, d string")
    got = rows.select(content_type(F.col("e"), F.col("d")).alias("x")).collect()
    assert [r.x for r in got] == ["a/b", "c/d", "text/html", "text/html"]


def test_partitioning_does_not_change_documents(pages, declared):
    moved = extract_documents(pages.repartition(5)).select("page_id", "markdown", "html", "links").collect()
    assert {r.page_id: (r.markdown, r.html, r.links) for r in moved} == {
        i: (d.markdown, d.html, d.links) for i, d in declared.items()}


def test_extraction_of_clean_html_changes_nothing(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    first = extract_documents(pages).select("page_id", "url", "html", "markdown").cache()
    again = extract_documents(first.drop("markdown")).select("page_id", F.col("markdown").alias("again"))
    assert first.join(again, "page_id").filter("markdown <> again").count() == 0


def test_long_runs_of_breaks_and_tags(spark):
    html = "<div></div>" * 20000 + "<p>k</p>" + "<b>" * 3000 + "x"
    row = extract_documents(spark.createDataFrame([(1, URL, html)], SCHEMA)).first()
    assert row.markdown == "k\n\n**x**"


def test_one_shuffle_and_one_scan(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for frame in (extract_documents(pages), visible_text(pages)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
        assert "Python" not in plan and "BatchEval" not in plan
