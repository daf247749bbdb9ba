"""Crawls over documents, directories, references, cleaning modes and the term index, on small fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions.text import decode_entities, decode_sql, let
from pageloom.operators.document import extract_documents, visible_text, visible_texts
from pageloom.operators.graph import crawl, crawl_documents, site_map
from pageloom.operators.harvest import directory_seeds, flat_directories, hierarchical_seeds, search_queries
from pageloom.operators.links import link_edges, page_adjacency
from pageloom.operators.rank import expand_query, indexed_relevance, relevance, term_index
from pageloom.operators.sets import fallback_to
from pageloom.operators.telemetry import compare_texts, token_similarity

TRUSTED = (".example.org", ".example.net")
URL = r"https?://[a-z0-9.-]+\.example\.(?:com|net|org)[^\s\"<>]*"


def page(i, url, links=(), text="p"):
    return i, url, f"<html><body><article><p>{text}</p>" + "".join(f'<a href="{u}">{t}</a>' for u, t in links) + "</article></body></html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def web(rng, n):
    names = [f"https://{'ab'[k % 2]}.example.org/{k}" for k in range(n)] + ["https://c.example.org/out", "javascript:x", "ftp://a.example.org/1"]
    return [page(k, names[k], [(rng.choice(names + [f"/{rng.randrange(n)}"]), "t") for _ in range(rng.randrange(6))]) for k in range(n)]


def brute_crawl(rows, seeds, depth, cap, scope):
    by = {}
    for _, url, html in sorted(rows):
        by.setdefault(url, html)
    found, seen = [], set()
    frontier = [(u, 0) for u in seeds]
    while frontier and len(found) < cap:
        url, level = frontier.pop(0)
        if url in seen:
            continue
        seen.add(url)
        if url not in by:
            continue
        found.append((url, level))
        if level < depth:
            root = url.split("/", 3)[0] + "//" + url.split("/", 3)[2]
            for href in [x.split('"')[0] for x in by[url].split('<a href="')[1:]]:
                link = root + href if href.startswith("/") else href
                if link.startswith("https://") and link.split("/")[2].endswith(TRUSTED) and (not scope or link.split("/")[2] in scope):
                    frontier.append((link, level + 1))
    return found


@pytest.mark.parametrize("cap,scope", [(50, None), (7, None), (50, ["a.example.org"])])
def test_crawl_over_documents_is_that_of_a_queue(spark, cap, scope):
    rng = random.Random(cap)
    rows = web(rng, 24)
    rows += [(99, rows[3][1], rows[5][2])]  # a second capture of an address
    starts = {"x": [rows[0][1], "https://missing.example.org/", rows[7][1]], "y": [rows[3][1]], "z": ["https://missing.example.org/"]}
    seeds = spark.createDataFrame([(c, u, k) for c, us in starts.items() for k, u in enumerate(us)],
                                  "crawl_id string, url string, ordinal int")
    found = crawl_documents(pages(spark, rows), seeds, 2, cap, rf"^({'|'.join(scope)})$" if scope else None, TRUSTED)
    got = {}
    for r in found.orderBy("crawl_id", "ordinal").collect():
        got.setdefault(r.crawl_id, []).append((r.url, r.depth))
        assert r.ordinal == len(got[r.crawl_id])
    expected = {c: brute_crawl(rows, us, 2, cap, scope) for c, us in starts.items()}
    assert got == {c: f for c, f in expected.items() if f}


def test_rows_of_links_and_edges_give_the_same_map(spark):
    rows = pages(spark, web(random.Random(4), 20))
    seeds = rows.select(F.col("url").alias("seed"))
    for cap in (2, 100):
        by_edge = site_map(link_edges(rows, TRUSTED), seeds, 2, cap).collect()
        by_page = site_map(page_adjacency(rows, TRUSTED, cap), seeds, 2, cap).collect()
        assert sorted(by_edge) == sorted(by_page) and len(by_edge) > 10
    plan = page_adjacency(rows, TRUSTED, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_hub_gives_only_its_first_links(spark):
    edges = spark.range(5000).select(F.lit("hub").alias("src"), F.col("id").alias("pos"), F.concat(F.lit("t"), F.col("id") % 4000).alias("dst"),
                                     F.lit("").alias("anchor"))
    rows = site_map(edges, spark.createDataFrame([("hub",), ("none",)], "seed string"), 1, 5).collect()
    assert [r.url for r in sorted(rows, key=lambda r: r.ordinal)] == ["t0", "t1", "t2", "t3", "t4"]
    captures = spark.createDataFrame([("hub",), ("t7",), ("t4500",), ("t3999",)], "url string")
    seeds = spark.createDataFrame([("c", "hub", 0)], "crawl_id string, url string, ordinal int")
    assert [r.url for r in crawl(edges.drop("anchor"), captures, seeds, 1, 3).orderBy("ordinal").collect()] == ["hub", "t7", "t3999"]


def test_directories_flat_and_hierarchical(spark):
    host = "https://dir.example.org"
    directories = pages(spark, [
        page(1, f"{host}/", [(f"/c{k}", w) for k, w in enumerate(("news", "games", "news", "more", "art", "old"))]),
        page(2, "https://flat.example.org/", [("https://s1.example.net/a", "x"), ("https://s2.example.net/b", "y" * 80)]),
        page(3, "https://other.example.org/", [("/d", "games <b>and</b><i>news</i>")], text="https://s9.example.net/"),
    ])
    captures = pages(spark, [
        page(10, f"{host}/c0", text="https://s3.example.net/1 https://dir.example.org/own"), page(11, f"{host}/c2", text="https://s4.example.net/ https://s3.example.net/1"),
        page(12, f"{host}/c5", text="https://s5.example.net/"), page(13, f"{host}/c0", text="https://later.example.net/"),
    ])
    assert [r.page_id for r in flat_directories(directories).collect()] == [2]
    found = hierarchical_seeds(directories, captures, ["news"], URL, TRUSTED, n=2).orderBy("page_id", "rank", "pos").collect()
    assert [(r.page_id, r.rank, r.category, r.url) for r in found] == [
        (1, 1, f"{host}/c0", "https://s3.example.net/1"), (1, 2, f"{host}/c2", "https://s4.example.net/"), (1, 2, f"{host}/c2", "https://s3.example.net/1")]
    every = directory_seeds(directories, captures, ["news"], URL, TRUSTED, n=2).orderBy("page_id", "rank", "pos").collect()
    assert [r.url for r in every] == ["https://s3.example.net/1", "https://s4.example.net/", "https://s1.example.net/a", "https://s2.example.net/b"]


def test_searches_of_several_queries(spark):
    answers = spark.createDataFrame([
        (1, "https://e1.example.org/", "q1", "https://a.example.net/x https://b.example.net/"), (2, "https://e1.example.org/", "q2", "https://b.example.net https://c.example.net/"),
        (3, "https://e2.example.org/", "q2", "https://d.example.net/"), (4, "https://e1.example.org/", "q3", "https://z.example.net/"),
        (5, "https://e1.example.org/", "q1", None)], "capture_id long, source string, query string, body string")
    queries = spark.createDataFrame([(1, "q2"), (2, "q1"), (3, "q9")], "query_no int, query string")
    sources = spark.createDataFrame([("https://e1.example.org/", "x", 0), ("https://e2.example.org/", "", 1)],
                                    "source string, base string, source_ordinal int")
    rows = search_queries(queries, answers, sources, URL, 10, TRUSTED).orderBy("query_no", "source_ordinal", "capture_id", "pos").collect()
    assert [(r.url, r.query_no) for r in rows] == [("https://b.example.net", 1), ("https://c.example.net", 1), ("https://a.example.net/x", 2)]


def test_references_without_semicolon(spark):
    cases = {  # text: in text, in an attribute value
        "&amp=1": ("&=1", "&amp=1"), "a&copy=3": ("a©=3", "a&copy=3"), "&section=2": ("§ion=2", "&section=2"), "&copy;=3": ("©=3", "©=3"),
        "x &lt y": ("x < y", "x < y"), "&lt": ("<", "<"), "&notit;": ("&notit;", "&notit;"), "&notin;": ("∉", "∉"), "&#65;&#66b": ("ABb", "ABb"),
        "&nosuch; &": ("&nosuch; &", "&nosuch; &"), "&AMP&amp;&quot": ('&&"', '&&"'), "&frac12x": ("½x", "&frac12x"), "&times;&timesbar;": ("×⨱", "×⨱"),
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    rows = frame.select("t", decode_entities(F.col("t")).alias("a"), let(F.col("t"), f"v -> {decode_sql('v', attribute=True)}").alias("b"))
    assert {r.t: (r.a, r.b) for r in rows.collect()} == cases
    html = '<a href="/p?id=1&section=2&region=eu&copy=3&timestamp=4&amp;x=&lt;">t</a>'
    doc = extract_documents(pages(spark, [(1, "https://h.example.org/", html)])).first()
    assert doc.links == ["https://h.example.org/p?id=1&section=2&region=eu&copy=3&timestamp=4&x=<"]


def test_one_relation_gives_the_texts_of_every_cleaning(spark, small):
    odd = ["<nav>n <form>f<b>x</b></form></nav><p>k", "", "text only", "<script>s</script><header><main>m</main>h</header>", "<iframe>i</iframe><aside>a</aside>",
           "<html><head><title>t</title></head><body><p>b<form>f</form></body></html>", "<div class='ad'>x<input>y</div>"]
    rows = pages(spark, [(1000 + k, "https://h.example.org/", h) for k, h in enumerate(odd)]).unionByName(
        spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html"))
    found = {r.page_id: r for r in visible_texts(rows).collect()}
    for name, args in {"declared": {}, "full": {"only_main": False}, "sanitize_first": {"mode": "sanitize_first"}}.items():
        assert {i: r[name] for i, r in found.items()} == {r.page_id: r.visible_text for r in visible_text(rows, **args).collect()}
    compared = {(r.page_id, r.extractor): r for r in compare_texts(visible_texts(rows), "declared").collect()}
    pairs = token_similarity(visible_text(rows), visible_text(rows, "sanitize_first"), "visible_text", "page_id")
    assert {r.page_id: r.similarity for r in pairs.collect()} == {
        i: r.similarity for (i, name), r in compared.items() if name == "sanitize_first"}
    assert all(r.similarity == 1.0 for (_, name), r in compared.items() if name == "declared")
    assert all(r.chars == len(found[i][name]) for (i, name), r in compared.items())


def test_index_scores_are_those_of_the_texts(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["alpha", "beta", "gamma", "Delta", "eps"], [1, 2, 8, 4, 16], k=rng.randrange(30)))) for k in range(200)]
    rows += [(200, None), (201, ""), (202, "zeta zeta alpha")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = term_index(docs)
    for terms in (["alpha", "delta"], ["zeta"], ["none"], []):
        direct = {r.doc_id: round(r.score, 9) for r in relevance(docs, "text", terms).collect() if r.score > 0}
        assert {r.key: round(r.score, 9) for r in indexed_relevance(index, terms).collect()} == direct
    assert expand_query(docs, "alpha", 2, index=index).collect() == expand_query(docs, "alpha", 2).collect()
    assert [r.query for r in expand_query(docs.limit(0), "alpha beta").collect()] == ["alpha beta"]


def test_fallback_runs_its_rows_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = spark.range(10).coalesce(1)
    other = spark.range(5)
    assert fallback_to(rows.mapInArrow(count, rows.schema), other).count() == 10 and runs.value == 10
    assert fallback_to(rows.filter("id < 0"), other).count() == 5


def test_compared_texts_are_measured_before_their_tokens_are_listed(spark):
    """A token's row holds no text: else the work grows with the square of a page's size."""
    texts = spark.createDataFrame([(1, "a b a", "a b"), (2, "", None)], "page_id long, declared string, other string")
    rows = compare_texts(texts, "declared")
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    listing = next(k for k, line in enumerate(plan) if "Generate inline" in line and "_sides" in line)
    assert not any("length(" in line for line in plan[:listing + 1])
    got = {(r.page_id, r.extractor): (r.chars, round(r.similarity, 6)) for r in rows.collect()}
    assert got == {(1, "declared"): (5, 1.0), (1, "other"): (3, 0.8), (2, "declared"): (0, 1.0), (2, "other"): (None, 1.0)}


def test_a_page_is_worked_through_once_for_its_adjacency(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    plan = page_adjacency(rows, TRUSTED, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(regexp_replace(html") == 1


def test_query_expansion_of_one_goal_writes_no_index(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)] + ["alpha", "beta"]
    rows = [(k % 40 if k % 7 else None, " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for k in range(120)]
    rows += [(200, None), (201, ""), *rows[:20]]  # repeated and absent keys, as in the index
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = term_index(docs)
    wanted = {goal: expand_query(docs, goal, 8, 3, index=index).collect() for goal in ("alpha beta", "alpha w3", "none", "")}
    monkeypatch.setattr("pageloom.operators.rank.term_index", None)
    for goal, queries in wanted.items():
        assert expand_query(docs, goal, 8, 3).collect() == queries
