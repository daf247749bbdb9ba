"""Queries over link graphs, harvested URLs and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.html import html_lang
from pageloom.functions.text import decode_entities
from pageloom.functions.url import netloc, search_url
from pageloom.operators.document import extract_documents
from pageloom.operators.graph import crawl, crawl_documents, lookup, missing_captures, site_map
from pageloom.operators.harvest import (
    ONION_URL, category_pages, external_seeds, flat_directories, harvest, hierarchical_seeds, queries_on_sources,
    search_all, seed_union,
)
from pageloom.operators.links import (
    link_edges, map_items, page_adjacency, page_links, short_anchor_items,
)
from pageloom.operators.rank import domain_cap, query_terms
from pageloom.operators.sets import difference, fallback_to, first_per_group, ordered_distinct
from pageloom.plans.registry import (
    LINKS, TRUSTED, q, query, sql_decode, sql_netloc, sql_root, table,
)

RESULT_URL = EXAMPLE_URL = r"""https?://[a-z0-9.-]+\.example\.(?:com|net|org)[^\s"<>']*"""
NOISE_SQL = r"/banners/|[?&]bads=|banner-click|/advertising/|\.(gif|png|jpg|webp|css|js)([?#]|$)"


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


# ---- site maps of captured pages ---------------------------------------------------------

_HOP = f"""{LINKS}, hop AS (
    SELECT src AS seed, dst AS url, min(pos) AS pos, arg_min(substr(text, 1, 40), pos) AS anchor
    FROM links WHERE {sql_netloc('src')} = {sql_netloc('dst')} GROUP BY 1, 2),
  mapped AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY pos) AS ordinal,
    1 AS depth, url, anchor FROM hop)"""


def _map(spark: SparkSession, folder: str, max_urls: int) -> DataFrame:
    pages = _pages(spark, folder)
    seeds = pages.select(F.col("url").alias("seed"))
    return site_map(page_adjacency(pages, TRUSTED, max_urls), seeds, depth=1, max_urls=max_urls)


@query("site_map_hop1", f"WITH {_HOP} SELECT * FROM mapped WHERE ordinal <= 200")
def site_map_hop1(spark: SparkSession, folder: str) -> DataFrame:
    return _map(spark, folder, 200)


@query("site_map_capped", f"WITH {_HOP} SELECT * FROM mapped WHERE ordinal <= 3")
def site_map_capped(spark: SparkSession, folder: str) -> DataFrame:
    return _map(spark, folder, 3)


@query("map_anchor_format", f"""
    WITH {_HOP} SELECT seed, ordinal, CASE WHEN anchor <> '' THEN anchor || ' | ' || url ELSE url END AS item
    FROM mapped WHERE ordinal <= 100""")
def map_anchor_format(spark: SparkSession, folder: str) -> DataFrame:
    return map_items(_map(spark, folder, 100)).select("seed", "ordinal", "item")


# ---- multi-hop graphs from the relational tables -------------------------------------------

_TREE = """edges AS (
    SELECT 'region/' || n_regionkey AS src, n_nationkey::BIGINT AS pos, 'nation/' || n_nationkey AS dst,
      n_name AS anchor FROM nation
    UNION ALL SELECT 'nation/' || c_nationkey, c_custkey, 'customer/' || c_custkey, c_name FROM customer
    UNION ALL SELECT 'customer/' || o_custkey, o_orderkey, 'order/' || o_orderkey, '' FROM orders)"""


def tree_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Regions link to nations, nations to customers, customers to orders."""
    def edges(name: str, parent: str, parent_key: str, child: str, key: str, anchor: Column) -> DataFrame:
        return table(spark, folder, name).select(
            F.concat(F.lit(f"{parent}/"), F.col(parent_key).cast("string")).alias("src"),
            F.col(key).cast("bigint").alias("pos"),
            F.concat(F.lit(f"{child}/"), F.col(key).cast("string")).alias("dst"), anchor.alias("anchor"))

    return (edges("nation", "region", "n_regionkey", "nation", "n_nationkey", F.col("n_name"))
            .unionByName(edges("customer", "nation", "c_nationkey", "customer", "c_custkey", F.col("c_name")))
            .unionByName(edges("orders", "customer", "o_custkey", "order", "o_orderkey", F.lit(""))))


def _regions(spark: SparkSession, folder: str, column: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias(column),
        F.col("r_regionkey").cast("bigint").alias("ordinal"), F.col("r_name").alias("crawl_id"))


def _levels(seeds: str, levels: int, keep: str = "") -> str:
    """Common table expressions l0…ln of a tree walk; ``keep`` filters targets."""
    parts = [f"l0 AS (SELECT {seeds})"]
    for n in range(1, levels + 1):
        parts.append(
            f"l{n} AS (SELECT p.seed, e.dst AS url, list_append(p.k, e.pos) AS k, {n} AS depth, e.anchor "
            f"FROM l{n - 1} p JOIN edges e ON p.url = e.src {keep})")
    return ", ".join(parts)


@query("graph_map_hops", f"""
    WITH {_TREE}, {_levels("'region/' || r_regionkey AS seed, 'region/' || r_regionkey AS url, []::BIGINT[] AS k, 0 AS depth, '' AS anchor FROM region", 3)},
    found AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
    SELECT * FROM (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY depth, k) AS ordinal,
      depth, url, anchor FROM found) WHERE ordinal <= 200""")
def graph_map_hops(spark: SparkSession, folder: str) -> DataFrame:
    return site_map(tree_edges(spark, folder), _regions(spark, folder, "seed"), depth=2, max_urls=200)


_WEB = f"""{LINKS}, edges AS (
    SELECT 'p' || page_id AS src, min(pos) AS pos, 'w/' || lower(text) AS dst FROM links GROUP BY page_id, lower(text)
    UNION ALL SELECT 'w/' || lower(text), page_id, 'p' || page_id FROM links GROUP BY page_id, lower(text))"""


def word_web(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and the words they link with, in both directions: a graph with cycles and hubs."""
    pairs = page_links(_pages(spark, folder)).groupBy("page_id", F.lower("text").alias("w")).agg(
        F.min("pos").cast("bigint").alias("pos"))
    page = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    word = F.concat(F.lit("w/"), F.col("w"))
    there = pairs.select(page.alias("src"), "pos", word.alias("dst"), F.col("w").alias("anchor"))
    back = pairs.select(word.alias("src"), F.col("page_id").alias("pos"), page.alias("dst"), F.lit("").alias("anchor"))
    return there.unionByName(back)


@query("graph_map_cycles", f"""
    WITH {_WEB}, seeds AS (SELECT 'p' || page_id AS seed FROM pages),
    a AS (SELECT seed, dst AS url, min(pos) AS k1 FROM seeds JOIN edges ON src = seed GROUP BY 1, 2),
    a10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY k1) AS rn FROM a) WHERE rn <= 10),
    b AS (SELECT a10.seed, e.dst AS url, min([k1, e.pos]) AS k FROM a10 JOIN edges e ON e.src = a10.url
      WHERE (a10.seed, e.dst) NOT IN (SELECT seed, url FROM a10) GROUP BY 1, 2),
    f AS (SELECT seed, url, 1 AS depth, [k1] AS k FROM a10 UNION ALL SELECT seed, url, 2, k FROM b)
    SELECT * FROM (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY depth, k) AS ordinal, depth, url
      FROM f) WHERE ordinal <= 10""")
def graph_map_cycles(spark: SparkSession, folder: str) -> DataFrame:
    seeds = _pages(spark, folder).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("seed"))
    return site_map(word_web(spark, folder), seeds, depth=1, max_urls=10).drop("anchor")


_CAPTURED = """captured AS (
    SELECT 'region/' || r_regionkey AS url FROM region UNION ALL SELECT 'nation/' || n_nationkey FROM nation
    UNION ALL SELECT 'customer/' || c_custkey FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT 'order/' || o_orderkey FROM orders)"""
_KEEP = "AND e.dst IN (SELECT url FROM captured)"


def tree_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Everything is captured but customers with a negative balance."""
    def named(name: str, prefix: str, key: str) -> DataFrame:
        return table(spark, folder, name).select(
            F.concat(F.lit(f"{prefix}/"), F.col(key).cast("string")).alias("url"))

    customers = table(spark, folder, "customer").filter("c_acctbal >= 0").select(
        F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("url"))
    return (named("region", "region", "r_regionkey").unionByName(named("nation", "nation", "n_nationkey"))
            .unionByName(customers).unionByName(named("orders", "order", "o_orderkey")))


@query("graph_crawl_capped", f"""
    WITH {_TREE}, {_CAPTURED},
    {_levels("r_name AS seed, 'region/' || r_regionkey AS url, [r_regionkey::BIGINT] AS k, 0 AS depth, '' AS anchor FROM region", 3, _KEEP)},
    found AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
    SELECT * FROM (SELECT seed AS crawl_id, row_number() OVER (PARTITION BY seed ORDER BY depth, k) AS ordinal,
      depth, url FROM found) WHERE ordinal <= 100""")
def graph_crawl_capped(spark: SparkSession, folder: str) -> DataFrame:
    return crawl(tree_edges(spark, folder), tree_captures(spark, folder),
                 _regions(spark, folder, "url"), depth=3, max_pages=100)


@query("crawl_missing_pages", f"""
    WITH {_TREE}, {_CAPTURED} SELECT DISTINCT dst AS url FROM edges WHERE dst NOT IN (SELECT url FROM captured)""")
def crawl_missing_pages(spark: SparkSession, folder: str) -> DataFrame:
    wanted = tree_edges(spark, folder).select(F.col("dst").alias("url")).distinct()
    return missing_captures(wanted, tree_captures(spark, folder))


@query("targeted_lookup", f"""
    WITH t AS (SELECT url FROM (SELECT url, row_number() OVER (
      PARTITION BY {sql_netloc('url')} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1)
    SELECT page_id, url, length(html) AS chars FROM pages WHERE url IN (SELECT url FROM t)""")
def targeted_lookup(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    targets = domain_cap(pages.select("page_id", "url", netloc(F.col("url")).alias("domain")),
                         "domain", ["page_id"], 1)
    return lookup(pages, targets).select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query("seed_search_crawl", """
    SELECT * FROM (SELECT lang AS crawl_id, row_number() OVER (PARTITION BY lang ORDER BY page_id) AS ordinal,
      0 AS depth, url FROM (SELECT page_id, url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang
      FROM pages)) WHERE ordinal <= 20""")
def seed_search_crawl(spark: SparkSession, folder: str) -> DataFrame:
    """One crawl per language; the pages found for it are its seeds."""
    pages = _pages(spark, folder)
    seeds = pages.select(html_lang(F.col("html")).alias("crawl_id"), "url", F.col("page_id").alias("ordinal"))
    return crawl(link_edges(pages, TRUSTED), pages, seeds, depth=1, max_pages=20)


# ---- search results to crawl, over links of documents ------------------------------------------

# Pages stand for captures of three sites: links are cut to their first letter, so that many pages share a target, and
# each page is captured at the target of one of its own links.
_SITE_ROOT = "'https://' || regexp_extract(url, '\\.example\\.(com|net|org)', 1) || '.site.example.com'"
_SCOPE = r"^(com|net)\.site\.example\.com$"
_SEEDS, _CRAWL_CAP = 2, 40


def site_captures(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, url, html, query)``: pages under the addresses of three sites that link among themselves."""
    html = F.regexp_replace("html", '<a href="(/[^"]?)[^"]*"', '<a href="$1"')
    links = F.regexp_extract_all(html, F.lit('<a href="(/[^"]*)"'), F.lit(1))
    root = F.concat(F.lit("https://"), F.regexp_extract("url", r"\.example\.(com|net|org)", 1), F.lit(".site.example.com"))
    one = decode_entities(F.get(links, (F.col("page_id") % 6).cast("int")))
    return _pages(spark, folder).select("page_id", F.concat(root, one).alias("url"), html.alias("html"),
                                        html_lang(F.col("html")).alias("query")).filter("url IS NOT NULL")


def _crawl_levels_sql(levels: int, cap: int) -> str:
    """CTEs c0…cn of crawls over ``edges`` and ``site`` from ``seeds`` (crawl_id, url, k); ``crawled`` is their union."""
    parts, found = [], ""
    for n in range(levels + 1):
        if n == 0:
            new = "SELECT crawl_id, url, min(k) AS k FROM seeds WHERE url IN (SELECT url FROM site) GROUP BY 1, 2"
            left = str(cap)
        else:
            new = (f"SELECT p.crawl_id, e.dst AS url, min(list_append(p.k, e.pos)) AS k FROM c{n - 1} p JOIN edges e ON e.src = p.url "
                   f"WHERE (p.crawl_id, e.dst) NOT IN (SELECT crawl_id, url FROM f{n - 1}) GROUP BY 1, 2")
            left = f"{cap} - (SELECT count(*) FROM f{n - 1} f WHERE f.crawl_id = x.crawl_id)"
        parts.append(f"c{n} AS (SELECT crawl_id, url, k, {n} AS depth FROM (SELECT *, row_number() OVER ("
                     f"PARTITION BY crawl_id ORDER BY k) AS rn FROM ({new})) x WHERE rn <= {left})")
        found = (found + " UNION ALL " if found else "") + f"SELECT * FROM c{n}"
        parts.append(f"f{n} AS ({found})")
    return ", ".join(parts)


@query("search_hits_crawl", f"""
    WITH own AS (SELECT *, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS h FROM (
      SELECT page_id, {_SITE_ROOT} AS root, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
        regexp_replace(html, '<a href="(/[^"]?)[^"]*"', '<a href="\\1"', 'g') AS html FROM pages)),
    site AS (SELECT url, min(page_id) AS page_id FROM (
      SELECT page_id, root || {sql_decode('h[(page_id % 6)::INTEGER + 1]')} AS url FROM own) WHERE url IS NOT NULL GROUP BY 1),
    edges AS (SELECT src, min(pos) AS pos, dst FROM (
      SELECT site.url AS src, unnest(range(len(h))) AS pos, root || {sql_decode('unnest(h)')} AS dst FROM site JOIN own USING (page_id)
      WHERE root NOT LIKE 'https://org.%') WHERE dst IN (SELECT url FROM site) GROUP BY 1, 3),
    hits AS (SELECT page_id, lang, min(i) AS i, rtrim(u, '/') AS url FROM (
      SELECT page_id, lang, unnest(range(len(m))) AS i, unnest(m) AS u FROM (SELECT page_id, lang,
        regexp_extract_all(replace(html, 'href="/', 'href="' || root || '/'), {q(EXAMPLE_URL)}) AS m FROM own))
      WHERE NOT regexp_matches(u, {q(NOISE_SQL)}) GROUP BY ALL),
    seeds AS (SELECT lang AS crawl_id, url, [o] AS k FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY page_id, i) AS o
      FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, url ORDER BY page_id, i) AS r FROM hits) WHERE r = 1))
      WHERE o <= {_SEEDS}),
    {_crawl_levels_sql(2, _CRAWL_CAP)}
    SELECT crawl_id, row_number() OVER (PARTITION BY crawl_id ORDER BY depth, k) AS ordinal, depth, url FROM f2""")
def search_hits_crawl(spark: SparkSession, folder: str) -> DataFrame:
    """The first results of each query are crawled to depth 2, over the links of documents on two of the three sites."""
    pages = site_captures(spark, folder)
    full = F.concat(F.lit('href="'), F.regexp_extract("url", r"^[a-z]+://[^/]*", 0), F.lit("/"))
    answers = pages.select(F.col("page_id").alias("capture_id"), F.lit("https://find.example.org/").alias("source"), "query",
                           F.replace(F.col("html"), F.lit('href="/'), full).alias("body"))
    hits = harvest(answers, EXAMPLE_URL, 1000, TRUSTED, keep=["query"])
    results = ordered_distinct(hits.select("query", "url", "capture_id", "pos"), ["query", "url"], ["capture_id", "pos"])
    by = Window.partitionBy("query").orderBy("capture_id", "pos")
    seeds = results.withColumn("ordinal", F.row_number().over(by)).filter(F.col("ordinal") <= _SEEDS).select(
        F.col("query").alias("crawl_id"), "url", "ordinal")
    return crawl_documents(pages.select("page_id", "url", "html"), seeds, depth=2, max_pages=_CRAWL_CAP, host_pattern=_SCOPE,
                           trusted=TRUSTED, only_main=False)


@query("query_string_links", r"""
    SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || '/p?id=' || page_id
      || '&section=2&region=eu&copy=3&timestamp=4&a=1<2' AS url FROM pages""")
def query_string_links(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses with query strings whose parameters begin like names of characters, in links of documents."""
    address = F.concat(F.lit('<html><body><a href="/p?id='), F.col("page_id").cast("string"),
                       F.lit('&section=2&region=eu&copy=3&amp;timestamp=4&amp;a=1&lt;2">x &copy 3</a>'))
    pages = _pages(spark, folder).select("page_id", "url", address.alias("html"))
    return extract_documents(pages, only_main=False).select("page_id", F.explode("links").alias("url"))


@query("known_difference", f"""
    WITH {LINKS} SELECT DISTINCT dst AS url FROM links WHERE dst NOT IN (SELECT url FROM pages)""")
def known_difference(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    return difference(page_links(pages).select(F.col("dst").alias("url")).distinct(), pages, ["url"])


# ---- harvesting ------------------------------------------------------------------------------

_BODY = f"regexp_replace(html, 'href=\"/', 'href=\"' || {sql_root('url')} || '/', 'g')"
_ENGINE = "'https://' || regexp_extract(url, '\\.example\\.(com|net|org)', 1) || '.find.example.com/'"


def _captures(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as answers of search sources, their links written out in full.

    The source is one per host suffix; the query is the page's language; plain
    HTTP pages stand for failed requests and have no body.
    """
    root = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    suffix = F.regexp_extract("url", r"\.example\.(com|net|org)", 1)
    body = F.replace(F.col("html"), F.lit('href="/'), F.concat(F.lit('href="'), root, F.lit("/")))
    return _pages(spark, folder).select(
        F.col("page_id").alias("capture_id"), "url", html_lang(F.col("html")).alias("query"),
        F.concat(F.lit("https://"), suffix, F.lit(".find.example.com/")).alias("source"), body.alias("body"))


def search_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Answered searches: ``(capture_id, source, query, body)``; failed ones have no body."""
    return _answered(_captures(spark, folder)).drop("url")


def _answered(captures: DataFrame) -> DataFrame:
    failed = F.startswith(F.col("url"), F.lit("http:"))
    return captures.withColumn("body", F.when(~failed, F.col("body")))


def _harvest_sql(own: str, where: str = "true", extra: str = "") -> str:
    return f"""raw AS (SELECT page_id{extra}, unnest(range(len(m))) AS i, unnest(m) AS u FROM (
      SELECT page_id{extra}, regexp_extract_all({_BODY}, {q(EXAMPLE_URL)}) AS m FROM pages WHERE {where})),
    hits AS (SELECT page_id{extra}, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, url FROM (
      SELECT page_id{extra}, min(i) AS i, rtrim(u, '/') AS url FROM raw
      WHERE NOT contains(u, substr({own}, 1, 12)) AND NOT regexp_matches(u, {q(NOISE_SQL)})
      GROUP BY ALL))"""


@query("harvest_urls", f"""
    WITH {_harvest_sql("'www.ththen.example.com'")} SELECT page_id, pos, url FROM hits WHERE pos < 20""")
def harvest_urls(spark: SparkSession, folder: str) -> DataFrame:
    captures = _captures(spark, folder).withColumn("source", F.lit("https://www.ththen.example.com/find"))
    hits = harvest(captures, EXAMPLE_URL, 20, TRUSTED)
    return hits.select(F.col("capture_id").alias("page_id"), F.col("pos").cast("bigint").alias("pos"), "url")


@query("harvest_limit", f"""
    WITH {_harvest_sql("'www.ththen.example.com'")} SELECT page_id, count(*) AS urls FROM hits
    WHERE pos < 4 GROUP BY 1""")
def harvest_limit(spark: SparkSession, folder: str) -> DataFrame:
    captures = _captures(spark, folder).withColumn("source", F.lit("https://www.ththen.example.com/find"))
    hits = harvest(captures, EXAMPLE_URL, 4, TRUSTED)
    return hits.groupBy(F.col("capture_id").alias("page_id")).agg(F.count(F.lit(1)).alias("urls"))


@query("ordered_dedup", f"""
    WITH {LINKS} SELECT text, page_id, pos FROM (SELECT text, page_id, pos, row_number() OVER (
      PARTITION BY text ORDER BY page_id, pos) AS rn FROM links) WHERE rn = 1""")
def ordered_dedup(spark: SparkSession, folder: str) -> DataFrame:
    links = page_links(_pages(spark, folder)).select(
        "text", "page_id", F.col("pos").cast("bigint").alias("pos"))
    return ordered_distinct(links, ["text"], ["page_id", "pos"])


def search_sources(spark: SparkSession) -> DataFrame:
    """Configured search sources; one has no address and is skipped."""
    return spark.createDataFrame(
        [("https://com.find.example.com/", "https://com.find.example.com/", 0),
         ("https://net.find.example.com/", "", 1),
         ("https://org.find.example.com/", "https://org.find.example.com/", 2)],
        "source string, base string, source_ordinal int")


_ORDINAL = "CASE regexp_extract(url, '\\.example\\.(com|net|org)', 1) WHEN 'com' THEN 0 WHEN 'org' THEN 2 END"
_UNION = _harvest_sql("'com.find.exa'", f"NOT starts_with(url, 'http:') AND {_ORDINAL} IS NOT NULL",
                      ", source_ordinal").replace("FROM pages", f"FROM (SELECT *, {_ORDINAL} AS source_ordinal FROM pages)")


@query("engine_union", f"""
    WITH {_UNION} SELECT url, source_ordinal, page_id AS capture_id, pos FROM (SELECT *, row_number() OVER (
      PARTITION BY url ORDER BY source_ordinal, page_id, pos) AS rn FROM hits WHERE pos < 20) WHERE rn = 1""")
def engine_union(spark: SparkSession, folder: str) -> DataFrame:
    captures = _answered(_captures(spark, folder))
    rows = search_all(captures, search_sources(spark), EXAMPLE_URL, 20, TRUSTED)
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("query_engine_fanout", f"""
    SELECT lang AS query, {_ENGINE} AS source, {_ENGINE} || '?q=' || lang AS search_address, count(*) AS captures
    FROM (SELECT url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages)
    WHERE lang IN ('en', 'de') GROUP BY ALL""")
def query_engine_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Every query on every source, joined with the captured answers."""
    planned = queries_on_sources(["en", "de"], search_sources(spark).select("source"),
                                 search_url(F.col("source"), F.lit("q"), F.col("query")))
    answers = _captures(spark, folder).select("source", "query")
    counted = answers.groupBy("source", "query").agg(F.count(F.lit(1)).alias("captures"))
    return planned.join(counted, ["source", "query"]).select("query", "source", "search_address", "captures")


# ---- directories and seeds ---------------------------------------------------------------------


def directory_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as link directories; those captured over plain HTTP list only other sites."""
    flat = F.startswith(F.col("url"), F.lit("http:"))
    other = F.replace(F.col("html"), F.lit('href="/'), F.lit('href="https://other.example.net/'))
    return _pages(spark, folder).withColumn("html", F.when(flat, other).otherwise(F.col("html")))


_FLAT = f"""flat AS (SELECT page_id, i, u FROM (
    SELECT page_id, url, unnest(range(len(m))) AS i, unnest(m) AS u FROM (SELECT page_id, url,
      regexp_extract_all(replace(html, 'href="/', 'href="https://other.example.net/'),
      {q(EXAMPLE_URL.replace("'", ""))}) AS m FROM pages WHERE starts_with(url, 'http:')))
  WHERE NOT contains(u, {sql_netloc('url')})),
  seeds AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, u AS url
    FROM (SELECT page_id, min(i) AS i, u FROM flat GROUP BY 1, 3))"""


def _flat_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return external_seeds(flat_directories(directory_pages(spark, folder)), EXAMPLE_URL.replace("'", ""), TRUSTED)


@query("directory_seeds_flat", f"WITH {_FLAT} SELECT page_id, pos, url FROM seeds")
def directory_seeds_flat(spark: SparkSession, folder: str) -> DataFrame:
    rows = _flat_seeds(spark, folder)
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "url")


CATEGORY_GOAL = "the and of les der una"


def bm25_sql(rows: str, text: str, goal: str, carry: str, group: str = "") -> str:
    """Rows of a table with their BM25 score, by statistics of all or of a group: CTEs ending in ``scored``."""
    terms = query_terms(goal)
    tf = ", ".join(f"len(list_filter(toks, lambda w: w = {q(t)})) AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(
        f"(CASE WHEN tf{i} > 0 THEN ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5))::DOUBLE * tf{i} * 2.2::DOUBLE "
        f"/ (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) ELSE 0.0::DOUBLE END)"
        for i in range(len(terms)))
    stat = (f"SELECT {group}, " if group else "SELECT ") + f"count(*)::DOUBLE AS n, avg(dl) AS a, {dfs} FROM cnt"
    return (f"tok AS (SELECT *, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS toks FROM {rows}), "
            f"cnt AS (SELECT *, len(toks)::DOUBLE AS dl, {tf} FROM tok), "
            f"stat AS ({stat}{f' GROUP BY {group}' if group else ''}), "
            f"scored AS (SELECT {carry}, {score} AS score FROM cnt{f' JOIN stat USING ({group})' if group else ', stat'})")


# Items of a directory, ranked among themselves.
_TOP5 = f"""items AS (SELECT page_id, pos, dst, text || ' | ' || dst AS item FROM links
      WHERE {sql_netloc('src')} = {sql_netloc('dst')} AND length(text) < 50),
    {bm25_sql('items', 'item', CATEGORY_GOAL, 'page_id, pos, dst, item', 'page_id')},
    top5 AS (SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY page_id ORDER BY round(score, 9) DESC, pos)::INTEGER AS rank FROM scored) WHERE rank <= 5)"""


@query("directory_seeds_top5", f"""
    WITH {LINKS}, {_TOP5} SELECT page_id, pos, item, round(score, 6) AS score, rank FROM top5""")
def directory_seeds_top5(spark: SparkSession, folder: str) -> DataFrame:
    categories = short_anchor_items(page_links(_pages(spark, folder), between="")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "item")
    rows = category_pages(categories, query_terms(CATEGORY_GOAL), 5)
    return rows.withColumn("score", F.round("score", 6))


FIRST_LINK = "regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)"
_CATEGORY = f"""category AS (SELECT url, arg_min(html, page_id) AS html FROM (
      SELECT page_id, {sql_root('url')} || {sql_decode(f'{FIRST_LINK}[(page_id % 6)::INTEGER + 1]')} AS url,
        replace(html, 'href="/', 'href="https://cat.example.net/') AS html FROM pages) WHERE url IS NOT NULL GROUP BY url)"""


def category_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of some category pages: the target of one link of each page, with content that lists other sites."""
    links = F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))
    one = F.get(links, (F.col("page_id") % 6).cast("int"))
    root = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return _pages(spark, folder).select(
        "page_id", F.concat(root, decode_entities(one)).alias("url"),
        F.replace(F.col("html"), F.lit('href="/'), F.lit('href="https://cat.example.net/')).alias("html")
    ).filter("url IS NOT NULL")


@query("directory_seeds_hierarchical", f"""
    WITH {LINKS}, {_TOP5}, {_CATEGORY},
    found AS (SELECT page_id, rank, category, unnest(range(len(m))) AS i, unnest(m) AS u FROM (
      SELECT page_id, rank, url AS category, regexp_extract_all(html, {q(EXAMPLE_URL.replace("'", ""))}) AS m
      FROM top5 JOIN category ON dst = url))
    SELECT page_id, rank, category, row_number() OVER (PARTITION BY page_id, rank ORDER BY i) - 1 AS pos, u AS url FROM (
      SELECT page_id, rank, category, u, min(i) AS i FROM found WHERE NOT contains(u, {sql_netloc('category')}) GROUP BY ALL)""")
def directory_seeds_hierarchical(spark: SparkSession, folder: str) -> DataFrame:
    """External URLs on the captured ones of each directory's five best category pages."""
    rows = hierarchical_seeds(_pages(spark, folder), category_captures(spark, folder), query_terms(CATEGORY_GOAL),
                              EXAMPLE_URL.replace("'", ""), TRUSTED)
    return rows.select("page_id", "rank", "category", F.col("pos").cast("bigint").alias("pos"), "url")


@query("directory_list", f"""
    WITH {_harvest_sql("'www.ththen.example.com'", "true", ", lang").replace("FROM pages", "FROM (SELECT *, regexp_extract(html, '<html lang=" + '"([^"]*)"' + "', 1) AS lang FROM pages)")},
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY page_id, pos) AS rn FROM hits
      WHERE pos < 20) WHERE rn <= 2),
    known AS (SELECT 'https://known.example.org' AS url)
    SELECT url, 'known' AS origin FROM known
    UNION ALL SELECT DISTINCT url, 'discovered' FROM firsts WHERE url NOT IN (SELECT url FROM known)""")
def directory_list(spark: SparkSession, folder: str) -> DataFrame:
    """Known directories and the first two results per bootstrap query (here: language)."""
    captures = _captures(spark, folder).withColumn("source", F.lit("https://www.ththen.example.com/find"))
    hits = harvest(captures, EXAMPLE_URL, 20, TRUSTED, keep=["query"])
    found = first_per_group(hits, ["query"], ["capture_id", "pos"], 2)
    known = spark.createDataFrame([("https://known.example.org", 0)], "url string, no int")
    return seed_union([("known", known, ["no"]), ("discovered", found, ["capture_id", "pos"])]).select(
        "url", "origin")


@query("seed_union_provenance", f"""
    WITH {_harvest_sql("'www.ththen.example.com'")}, {_FLAT},
    u AS (SELECT url, 'stored' AS origin, 0 AS no FROM pages UNION ALL SELECT url, 'search', 1 FROM hits
      WHERE pos < 10 UNION ALL SELECT url, 'directory', 2 FROM seeds)
    SELECT origin, count(*) AS urls FROM (SELECT url, arg_min(origin, no) AS origin FROM u GROUP BY url) GROUP BY 1""")
def seed_union_provenance(spark: SparkSession, folder: str) -> DataFrame:
    return all_seeds(spark, folder).groupBy("origin").agg(F.count(F.lit(1)).alias("urls"))


def all_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Stored, searched and directory seeds in one ordered set."""
    captures = _captures(spark, folder).withColumn("source", F.lit("https://www.ththen.example.com/find"))
    found = harvest(captures, EXAMPLE_URL, 10, TRUSTED)
    return seed_union([
        ("stored", _pages(spark, folder).select("url", "page_id"), ["page_id"]),
        ("search", found, ["capture_id", "pos"]),
        ("directory", _flat_seeds(spark, folder), ["page_id", "pos"]),
    ])


@query("inventory_fallback", "SELECT page_id, url FROM pages")
def inventory_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """No page of the tables names a hidden service, so the seeds are returned."""
    pages = _pages(spark, folder)
    captures = pages.select(F.col("page_id").alias("capture_id"), F.col("html").alias("body"),
                            F.lit("https://find.example.org/").alias("source"))
    found = harvest(captures, ONION_URL, 20, (".onion",)).select(
        F.col("capture_id").alias("page_id"), "url")
    return fallback_to(found, pages.select("page_id", "url"))
