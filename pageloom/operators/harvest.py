"""URLs out of captured result and directory pages, and seed unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.url import (
    excludes_self, external_to, is_noise_url, netloc, safe_url, trim_slashes,
)
from pageloom.operators.links import filter_safe, has_category_links, page_links, short_anchor_items
from pageloom.operators.rank import relevance_within
from pageloom.operators.sets import first_per_group, ordered_distinct

# Hidden-service addresses in text; the second form keeps quotes.
ONION_URL = r"""https?://[a-z2-7]{10,56}\.onion[^\s"<>']*"""
ONION_URL_DIRECTORY = r"""https?://[a-z2-7]{10,56}\.onion[^\s"<>]*"""


def harvest(captures: DataFrame, pattern: str = ONION_URL, limit: int = 20,
            trusted: Sequence[str] = (), hosts: DataFrame | None = None,
            key: str = "capture_id", keep: Sequence[str] = ()) -> DataFrame:
    """Result URLs per capture ``(key, source, body)``: ``(key, source, keep…, pos, url)``.

    A URL counts when it is safe, does not name the source's own host and is no
    banner or static file; trailing slashes are dropped for identity and output.
    ``source`` is the address of the page the capture came from. One capture is
    one row, so the list stays inside the row and nothing shuffles, unless host
    addresses have to be looked up.
    """
    matches = F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
    if hosts is None:
        kept = F.filter(matches, lambda u: safe_url(u, trusted)
                        & excludes_self(u, netloc(F.col("source"))) & ~is_noise_url(u))
        urls = F.slice(F.array_distinct(F.transform(kept, trim_slashes)), 1, limit)
        # Not plain posexplode: its test for empty lists would be pushed down and search each capture twice.
        return captures.select(key, "source", *keep, F.posexplode_outer(urls).alias("pos", "url")).where("pos IS NOT NULL")
    rows = captures.select(key, "source", *keep, F.posexplode(matches).alias("pos", "_u"))
    rows = rows.filter(excludes_self(F.col("_u"), netloc(F.col("source")))
                       & ~is_noise_url(F.col("_u")))
    rows = filter_safe(rows, "_u", trusted, hosts)
    unique = rows.groupBy(key, "source", *keep, trim_slashes(F.col("_u")).alias("url")).agg(
        F.min("pos").alias("pos"))
    return first_per_group(unique, [key], ["pos"], limit)


def search_all(captures: DataFrame, sources: DataFrame, pattern: str, limit: int,
               trusted: Sequence[str] = ()) -> DataFrame:
    """Union over search sources: ``(url, source_ordinal, capture_id, pos)``.

    ``sources`` lists ``(source, base, source_ordinal)``; those without a base
    address are skipped. Captures without a body are failed requests and
    contribute nothing.
    """
    usable = sources.filter(F.col("base") != "").select("source", "source_ordinal")
    answered = captures.filter(F.col("body").isNotNull())
    hits = harvest(answered, pattern, limit, trusted)
    ranked = hits.join(usable, "source").select("url", "source_ordinal", "capture_id", "pos")
    return ordered_distinct(ranked, ["url"], ["source_ordinal", "capture_id", "pos"])


def external_urls_in(html: Column, url: Column, pattern: str, trusted: Sequence[str] = ()) -> Column:
    """Distinct safe URLs in a page that do not name its own host, in order; local to the row."""
    urls = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)))
    return F.filter(urls, lambda u: safe_url(u, trusted) & external_to(u, netloc(url)))


def external_seeds(pages: DataFrame, pattern: str, trusted: Sequence[str] = (),
                   key: str = "page_id") -> DataFrame:
    """External URLs in the text of directory pages: ``(key, page_url, pos, url)``."""
    kept = external_urls_in(F.col("html"), F.col("url"), pattern, trusted)
    return pages.select(key, F.col("url").alias("page_url"),
                        F.posexplode_outer(kept).alias("pos", "_u")).where("pos IS NOT NULL").withColumnRenamed("_u", "url")


def flat_directories(directories: DataFrame) -> DataFrame:
    """Directory pages without category links; decided inside each row, so no page is shuffled."""
    return directories.filter(~has_category_links(F.col("html"), F.col("url")))


def category_pages(categories: DataFrame, terms: Sequence[str], n: int = 5,
                   key: str = "page_id") -> DataFrame:
    """The n category items of each directory that are most relevant among its own."""
    scored = relevance_within(categories, "item", terms, [key])
    # Rounded, so that equal scores tie whatever order their terms were added in.
    by = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "pos")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def hierarchical_seeds(directories: DataFrame, captures: DataFrame, terms: Sequence[str], pattern: str,
                       trusted: Sequence[str] = (), n: int = 5, key: str = "page_id") -> DataFrame:
    """External URLs on the category pages of each directory: ``(key, rank, category, pos, url)``.

    The n most relevant categories of a directory are looked up among ``captures`` ``(key, url, html)``; one that was not captured
    contributes nothing, and of several captures of an address the one with the smallest key counts. Captures move
    as lists of URLs, not as HTML.
    """
    chosen = category_pages(short_anchor_items(page_links(directories, key, between="")), terms, n, key).select(
        key, "rank", F.col("dst").alias("category"))
    listed = captures.select(F.col("url").alias("category"), F.col(key).alias("_key"), external_urls_in(
        F.col("html"), F.col("url"), pattern, trusted).alias("_urls"))
    listed = ordered_distinct(listed, ["category"], ["_key"])
    return chosen.join(listed, "category").select(
        key, "rank", "category", F.posexplode("_urls").alias("pos", "url"))


def directory_seeds(directories: DataFrame, captures: DataFrame, terms: Sequence[str], pattern: str,
                    trusted: Sequence[str] = (), n: int = 5, key: str = "page_id") -> DataFrame:
    """Seeds of all directories in one ordered set: ``(url, key, rank, pos)``; flat ones list them themselves (rank 0)."""
    flat = external_seeds(flat_directories(directories), pattern, trusted, key).withColumn("rank", F.lit(0))
    deep = hierarchical_seeds(directories, captures, terms, pattern, trusted, n, key)
    columns = ["url", key, "rank", "pos"]
    return ordered_distinct(flat.select(*columns).unionByName(deep.select(*columns)), ["url"], [key, "rank", "pos"])


def search_queries(queries: DataFrame, captures: DataFrame, sources: DataFrame, pattern: str, limit: int,
                   trusted: Sequence[str] = ()) -> DataFrame:
    """Results of several queries on all sources, in order of query, source and place: ``(url, query_no, source_ordinal, capture_id, pos)``.

    ``queries`` has ``(query_no, query)``; ``captures`` answers ``(capture_id, source, query, body)``. As in :func:`search_all`,
    sources without a base address and answers without a body contribute nothing. Answers are reduced to their URLs before they
    are joined.
    """
    usable = sources.filter(F.col("base") != "").select("source", "source_ordinal")
    answered = captures.filter(F.col("body").isNotNull())
    hits = harvest(answered, pattern, limit, trusted, keep=["query"])
    ranked = hits.join(usable, "source").join(queries, "query").select(
        "url", "query_no", "source_ordinal", "capture_id", "pos")
    return ordered_distinct(ranked, ["url"], ["query_no", "source_ordinal", "capture_id", "pos"])


def seed_union(origins: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Ordered union of seed tables with provenance: ``(url, origin, origin_no, order)``.

    Each origin is ``(name, frame with url, order columns)``; a URL keeps its
    first origin.
    """
    parts = []
    for number, (name, frame, order) in enumerate(origins):
        key = F.array(*[F.col(c).cast("long") for c in order])
        parts.append(frame.select("url", F.lit(name).alias("origin"),
                                  F.lit(number).alias("origin_no"), key.alias("order")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return ordered_distinct(union, ["url"], ["origin_no", "order"])


def queries_on_sources(queries: Sequence[str], sources: DataFrame, build: Column) -> DataFrame:
    """Every query on every source: ``(source, query_no, query, search_address)``."""
    listed = F.array(*[F.lit(q) for q in queries])
    rows = sources.select("*", F.posexplode(listed).alias("query_no", "query"))
    return rows.withColumn("search_address", build)
