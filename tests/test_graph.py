"""Traversal, harvesting and ranking on small fixtures, some against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators.graph import _children, crawl, site_map
from pageloom.operators.harvest import harvest, search_all, seed_union
from pageloom.operators.links import link_edges, page_links
from pageloom.operators.rank import (
    domain_cap, expand_query, query_terms, relevance, repeatable_sample, top_relevant,
)
from pageloom.operators.sets import fallback_to, first_per_group, ordered_distinct

EDGES = [("s", 1, "a", "A"), ("s", 2, "b", "B"), ("a", 1, "c", "C"), ("a", 2, "b", "B2"),
         ("b", 1, "d", "D"), ("c", 1, "s", "S"), ("d", 1, "e", "E")]
SCHEMA = "src string, pos long, dst string, anchor string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def mapped(spark, edges, seeds, **kw):
    rows = site_map(edges, spark.createDataFrame([(s,) for s in seeds], "seed string"), **kw)
    return [(r.url, r.anchor) for r in rows.orderBy("seed", "ordinal").collect()]


@pytest.mark.parametrize("depth,cap,urls", [
    (0, 200, "ab"), (1, 200, "abcd"), (2, 200, "abcdse"), (2, 3, "abc"),
])
def test_site_map(spark, edges, depth, cap, urls):
    got = mapped(spark, edges, ["s"], depth=depth, max_urls=cap)
    assert [u for u, _ in got] == list(urls)
    assert dict(got)["b"] == "B"


def crawled(spark, edges, captures, seeds, **kw):
    seeds = spark.createDataFrame([("c", u, i) for i, u in enumerate(seeds)], "crawl_id string, url string, ordinal long")
    captures = spark.createDataFrame([(u,) for u in captures], "url string")
    return [r.url for r in crawl(edges, captures, seeds, **kw).orderBy("ordinal").collect()]


@pytest.mark.parametrize("seeds,depth,cap,urls", [
    ("s", 2, 50, "sabd"), ("s", 2, 3, "sab"), ("bs", 1, 50, "bsda"), ("s", 0, 50, "s"), ("c", 2, 50, ""),
])
def test_crawl(spark, edges, seeds, depth, cap, urls):
    assert crawled(spark, edges, "sabde", seeds, depth=depth, max_pages=cap) == list(urls)


def test_walks_without_edges_or_seeds_are_empty(spark, edges):
    none = edges.filter("false")
    assert mapped(spark, none, ["s"], depth=2) == [] and mapped(spark, none, ["s"], depth=0) == []
    assert site_map(edges, edges.select("src").withColumnRenamed("src", "seed").filter("false")).count() == 0
    assert crawled(spark, none, "s", "s", depth=2) == ["s"] and crawled(spark, edges, "a", "s", depth=2) == []


def brute_map(graph, start, depth, cap):
    """Queue-based walk: expand pages in order, first discovery wins."""
    found, seen, queue = [], set(), [(start, 0)]
    while queue and len(found) < cap:
        url, d = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        for dst in graph.get(url, []):
            if dst not in found:
                found.append(dst)
        if d < depth:
            queue += [(u, d + 1) for u in found if u not in seen]
    return found[:cap]


def brute_crawl(graph, captures, seeds, depth, cap):
    results, seen, queue = [], set(), [(u, 0) for u in seeds]
    while queue and len(results) < cap:
        url, d = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        if url not in captures:
            continue
        results.append(url)
        if d < depth:
            queue += [(u, d + 1) for u in graph.get(url, []) if u not in seen]
    return results


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_with_hubs_match_a_queue(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(30)]
    graph = {n: [rng.choice(nodes) for _ in range(rng.choice([0, 2, 5, 40]))] for n in nodes}
    rows = [(s, i, d, d.upper()) for s, ds in graph.items() for i, d in enumerate(ds)]
    edges = spark.createDataFrame(rows, SCHEMA)
    captures = [n for n in nodes if rng.random() < 0.7]
    for depth, cap in ((1, 4), (2, 7), (2, 100)):
        got = site_map(edges, spark.createDataFrame([(n,) for n in nodes], "seed string"), depth, cap)
        by_seed = {}
        for r in got.orderBy("seed", "ordinal").collect():
            by_seed.setdefault(r.seed, []).append(r.url)
        for n in nodes:
            assert by_seed.get(n, []) == brute_map(graph, n, depth, cap), (n, depth, cap)
        seeds = nodes[:3]
        assert crawled(spark, edges, captures, seeds, depth=depth, max_pages=cap) == brute_crawl(
            graph, set(captures), seeds, depth, cap)


def test_links_ignore_base_comments_and_scripts(spark):
    html = ('<base href="/z/"><script>"<a href=/no>x</a>"</script><!-- <a href=/no>x</a> -->'
            '<a href="q"> one <b>two</b>\n</a><a>none</a><a href="https://o.example.net/">far</a>'
            '<a href="r">' + "x" * 60)
    pages = spark.createDataFrame([(1, "https://h.example.org/d/p", html)], "page_id long, url string, html string")
    rows = page_links(pages).orderBy("pos").collect()
    assert [(r.dst, r.text[:8]) for r in rows] == [
        ("https://h.example.org/d/q", "one two"), ("https://o.example.net/", "far"),
        ("https://h.example.org/d/r", "xxxxxxxx")]
    edges = link_edges(pages, (".example.org", ".example.net")).orderBy("pos").collect()
    assert [(r.dst[-1], len(r.anchor)) for r in edges] == [("q", 7), ("r", 40)]
    assert link_edges(pages).count() == 0


def test_harvest_rules(spark):
    onion = "http://" + "a" * 16 + ".onion"
    body = (f'{onion}/x/ "{onion}/x" <{onion}/banners/1> {onion}/i.png \'{onion}/y\' http://{"b" * 16}.onion/z '
            f'http://short.onion/ {onion}/w')
    rows = spark.createDataFrame([(1, f"http://{'b' * 16}.onion/s", body)], "capture_id long, source string, body string")
    found = [r.url for r in harvest(rows, limit=2, trusted=(".onion",)).orderBy("pos").collect()]
    assert found == [f"{onion}/x", f"{onion}/y"]
    assert harvest(rows).count() == 0
    hosts = spark.createDataFrame([("a" * 16 + ".onion", "8.8.8.8")], "host string, ipv4 string")
    looked_up = harvest(rows, limit=2, hosts=hosts).orderBy("pos").collect()
    assert [r.url for r in looked_up] == found


def test_search_all_skips_failures_and_unconfigured(spark):
    onion = "http://" + "a" * 16 + ".onion/"
    captures = spark.createDataFrame(
        [(1, "http://e1/", onion + "1 " + onion + "2"), (2, "http://e2/", onion + "3"), (3, "http://e3/", None),
         (4, "http://e3/", onion + "2 " + onion + "4")], "capture_id long, source string, body string")
    sources = spark.createDataFrame([("http://e3/", "http://e3/", 0), ("http://e1/", "http://e1/", 1),
                                     ("http://e2/", "", 2)], "source string, base string, source_ordinal int")
    rows = search_all(captures, sources, r"http://a+\.onion/\d", 20, (".onion",))
    got = [r.url[-1] for r in rows.orderBy("source_ordinal", "capture_id", "pos").collect()]
    assert got == ["2", "4", "1"]


def test_ordered_sets(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, o long")
    assert [(r.k, r.o) for r in ordered_distinct(rows, ["k"], ["o"]).orderBy("o").collect()] == [
        ("b", 1), ("a", 2), ("c", 4)]
    assert first_per_group(rows, ["k"], ["o"], 1).count() == 3
    assert fallback_to(rows.filter("o > 9"), rows).count() == 4
    assert fallback_to(rows.filter("o = 1"), rows).count() == 1
    union = seed_union([("x", rows.withColumnRenamed("k", "url"), ["o"]),
                        ("y", rows.select(F.col("k").alias("url"), "o"), ["o"])])
    assert {r.origin for r in union.collect()} == {"x"}


def test_domain_cap_order_with_one_hot_domain(spark):
    rows = [(i, "hot" if i % 3 else f"d{i}") for i in range(300)]
    capped = domain_cap(spark.createDataFrame(rows, "o long, domain string"), "domain", ["o"], 5)
    got = [r.o for r in capped.orderBy("domain_first", "domain_rank").collect()]
    by_domain = {}
    for o, d in rows:
        if len(by_domain.setdefault(d, [])) < 5:
            by_domain[d].append(o)
    assert got == [o for items in by_domain.values() for o in items]
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # cut before and after the shuffle


def test_relevance_and_fallback(spark):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish"), (3, "dog"), (4, "cat")], "id long, t string")
    assert [r.id for r in top_relevant(docs, "t", query_terms("Fish, blue?"), 3, ["id"]).collect()] == [2, 1, 3]
    assert [r.id for r in top_relevant(docs, "t", ["zebra"], 2, ["id"]).collect()] == [1, 2]
    assert relevance(docs, "t", []).filter("score <> 0").count() == 0


def test_query_expansion_falls_back_to_the_goal(spark):
    docs = spark.createDataFrame([(1, "red fish swims"), (2, "blue dog")], "doc_id long, text string")
    assert [r["query"] for r in expand_query(docs, "zebra").collect()] == ["zebra"]
    near = [r["query"] for r in expand_query(docs, "fish", 2).orderBy("query_no").collect()]
    assert near == ["fish red", "fish swims"]


def test_sample_is_repeatable_and_sized(spark):
    rows = spark.range(100).select((F.col("id") % 4).cast("string").alias("run"), F.col("id").cast("string").alias("k"))
    one = {(r.run, r.k) for r in repeatable_sample(rows, "run", "k", 5).collect()}
    two = {(r.run, r.k) for r in repeatable_sample(rows.repartition(7), "run", "k", 5).collect()}
    assert one == two and len(one) == 20


def test_rows_found_through_few_links_are_dealt_out_by_group(spark):
    """The links of a hub are few bytes; the rows they give must not stay in one task."""
    frontier = spark.range(400).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("seed"), F.lit("hub").alias("url"),
                                       F.array(F.lit(1).cast("long")).alias("key"), F.lit(5).cast("long").alias("left"))
    links = spark.createDataFrame([("hub", k, f"t{k}", "") for k in range(5)], SCHEMA)
    found = _children(frontier, links, "seed", anchor=True)
    tasks = found.select("seed", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({t.task for t in tasks}) == 8 and len(tasks) == 400  # a seed lies in one task
    assert found.count() == 2000
