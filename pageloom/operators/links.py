"""Links of captured pages as an edge table; no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.html import attr, first_tag, inner_text, without_raw_text
from pageloom.functions.text import let
from pageloom.functions.url import (
    external_to, hostname, item_text, netloc, safe_url, same_host, url_join,
)

ANCHOR_CHARS = 40
SHORT_ANCHOR = 50

_ANCHOR = (
    r"""(?is)<a(?=[\s/>])(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>"""
    r""".*?(?=<a[\s>]|</a[\s>]|$)"""
)


def link_array(html: Column, url: Column, between: str = " ") -> Column:
    """Every ``a[href]`` of a page as captured, in order: ``array<struct<pos, dst, text>>``; ``between`` joins the text's nodes.

    Addresses are joined with the page URL only (no ``<base>``), and nothing of
    the page is removed first, unlike the links of a document.
    """
    def link(anchor: Column, pos: Column) -> Column:
        tag = first_tag(anchor, "a")
        return F.struct(pos.alias("pos"), attr(tag, "href").alias("href"),
                        inner_text(F.substr(anchor, F.length(tag) + 1), between).alias("text"))

    found = F.transform(F.regexp_extract_all(without_raw_text(html), F.lit(_ANCHOR), F.lit(0)), link)
    return F.transform(F.filter(found, lambda x: x["href"].isNotNull()), lambda x: F.struct(
        x["pos"].alias("pos"), url_join(url, x["href"]).alias("dst"), x["text"].alias("text")))


def page_links(pages: DataFrame, key: str = "page_id", between: str = " ") -> DataFrame:
    """Links of the pages as captured, one row each (see :func:`link_array`): ``(key, src, pos, dst, text)``."""
    found = pages.select(
        key, F.col("url").alias("src"),
        F.posexplode(F.regexp_extract_all(
            without_raw_text(F.col("html")), F.lit(_ANCHOR), F.lit(0))).alias("pos", "_a"),
    )
    tag = first_tag(F.col("_a"), "a")
    inner = F.substr(F.col("_a"), F.length(tag) + 1)
    found = found.select(key, "src", "pos", attr(tag, "href").alias("_href"),
                         inner_text(inner, between).alias("text"))
    return found.filter(F.col("_href").isNotNull()).select(
        key, "src", "pos", url_join(F.col("src"), F.col("_href")).alias("dst"), "text")


def with_host_address(df: DataFrame, url: str, hosts: DataFrame | None) -> DataFrame:
    """Add ``_ipv4`` from a ``(host, ipv4)`` table, NULL when unresolved.

    The table may be of any size: the join is planned from its statistics, and
    a host that owns a large share of the rows is split by the skew-join rule.
    """
    if hosts is None:
        return df.withColumn("_ipv4", F.lit(None).cast("string"))
    unique = hosts.groupBy(F.lower("host").alias("_host")).agg(F.min("ipv4").alias("_ipv4"))
    return df.withColumn("_host", hostname(F.col(url))).join(unique, "_host", "left").drop("_host")


def filter_safe(df: DataFrame, url: str, trusted: Sequence[str] = (),
                hosts: DataFrame | None = None) -> DataFrame:
    """Rows whose URL may be followed."""
    if hosts is None:
        return df.filter(safe_url(F.col(url), trusted))
    resolved = with_host_address(df, url, hosts)
    return resolved.filter(safe_url(F.col(url), trusted, F.col("_ipv4"))).drop("_ipv4")


def link_edges(pages: DataFrame, trusted: Sequence[str] = (), hosts: DataFrame | None = None,
               key: str = "page_id") -> DataFrame:
    """Same-host, safe edges ``(src, pos, dst, anchor)`` for site maps."""
    links = page_links(pages, key).filter(same_host(F.col("dst"), F.col("src")))
    return filter_safe(links, "dst", trusted, hosts).select(
        "src", "pos", "dst", F.substring("text", 1, ANCHOR_CHARS).alias("anchor"))


def page_adjacency(pages: DataFrame, trusted: Sequence[str] = (), first: int | None = None) -> DataFrame:
    """Same-host, safe links of each page as one row: ``(src, links: array<struct<pos, dst, anchor>>)``.

    The row-local form of :func:`link_edges`: a target that a page repeats keeps its first place, and at most the ``first``
    targets are kept, so what a page adds to a traversal is bounded before anything is shuffled. Pages without links have
    an empty list: a filter on it would be pushed down and read the page twice.
    """
    def edge(x: Column) -> Column:
        return F.struct(x["pos"].alias("pos"), x["dst"].alias("dst"), F.substring(x["text"], 1, ANCHOR_CHARS).alias("anchor"))

    kept = F.filter(link_array(F.col("html"), F.col("url")),
                    lambda x: same_host(x["dst"], F.col("url")) & safe_url(x["dst"], trusted))

    def once(links: Column, targets: Column) -> Column:
        # The place of each target's first link among the targets tells repeats apart.
        return F.filter(links, lambda x, i: F.array_position(targets, x["dst"]) == i + 1)

    # Bound, so that no lambda and no test on the links works the page through again.
    links = let(F.transform(kept, edge), lambda e: let(F.transform(e, lambda x: x["dst"]), lambda t: once(e, t)))
    return pages.select(F.col("url").alias("src"), (F.slice(links, 1, first) if first else links).alias("links"))


def external_urls(links: DataFrame) -> DataFrame:
    """Links whose URL does not mention the page's own host."""
    return links.filter(external_to(F.col("dst"), netloc(F.col("src"))))


def has_category_links(html: Column, url: Column, limit: int = SHORT_ANCHOR) -> Column:
    """True when a page has a same-host link with a short text (nodes joined without blanks); local to the row."""
    return F.exists(link_array(html, url, ""), lambda x: (F.length(x["text"]) < limit) & same_host(x["dst"], url))


def short_anchor_items(links: DataFrame, limit: int = SHORT_ANCHOR) -> DataFrame:
    """Same-host links with a short text, as ``"text | url"`` items."""
    kept = links.filter((F.length("text") < limit) & same_host(F.col("dst"), F.col("src")))
    return kept.withColumn("item", F.concat(F.col("text"), F.lit(" | "), F.col("dst")))


def in_scope(url: Column, host_pattern: str, match: str = "host") -> Column:
    """True when the host (or, with ``match="url"``, the whole URL) matches."""
    subject = url if match == "url" else hostname(url)
    return F.rlike(subject, F.lit(host_pattern))


def document_links(documents: DataFrame, host_pattern: str | None = None,
                   trusted: Sequence[str] = (), hosts: DataFrame | None = None) -> DataFrame:
    """Edges ``(src, pos, dst)`` from the links of documents, in crawl scope."""
    links = documents.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "dst"))
    if host_pattern is not None:
        links = links.filter(in_scope(F.col("dst"), host_pattern))
    return filter_safe(links, "dst", trusted, hosts)


def map_items(found: DataFrame) -> DataFrame:
    """Add the output form ``"anchor | url"``."""
    return found.withColumn("item", item_text(F.col("anchor"), F.col("url")))
