"""The research flow: queries, seeds, site maps, diverse inventory, ranking, lookup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.url import item_text, netloc
from pageloom.operators.document import extract_documents
from pageloom.operators.graph import site_map
from pageloom.operators.harvest import directory_seeds, search_queries, seed_union
from pageloom.operators.links import page_adjacency
from pageloom.operators.pack import context_pack
from pageloom.operators.rank import domain_cap, expand_query, query_terms, top_relevant
from pageloom.operators.sets import fallback_to, ordered_distinct
from pageloom.session import cut_lineage


@dataclass(frozen=True)
class Limits:
    """Sizes of a research run."""

    queries: int = 6
    per_query: int = 10
    map_depth: int = 1
    map_urls: int = 100
    per_domain: int = 5
    pages: int = 30


def inventory(pages: DataFrame, seeds: DataFrame, trusted: Sequence[str] = (),
              limits: Limits = Limits()) -> DataFrame:
    """Mapped URLs of all seeds, at most a few per domain; the seeds when none.

    ``seeds`` has ``(url, origin, origin_no, order)``. Returns ``(item, url,
    domain, seed_no, seed_order, ordinal)``; the last three give the order.
    """
    mapped = site_map(page_adjacency(pages, trusted, limits.map_urls), seeds.select(F.col("url").alias("seed")),
                      limits.map_depth, limits.map_urls)
    placed = mapped.join(
        seeds.select(F.col("url").alias("seed"), F.col("origin_no").alias("seed_no"),
                     F.col("order").alias("seed_order")), "seed")
    columns = ["item", "url", "seed_no", "seed_order", "ordinal"]
    items = placed.withColumn("item", item_text(F.col("anchor"), F.col("url"))).select(*columns)
    order = ["seed_no", "seed_order", "ordinal"]
    unique = ordered_distinct(items, ["item"], order).withColumn("domain", netloc(F.col("url")))
    # Written once: the fallback asks whether there are any, and scoring reads them twice.
    capped = cut_lineage(domain_cap(unique, "domain", order, limits.per_domain), "inventory")
    bare = seeds.select(
        F.col("url").alias("item"), "url", F.col("origin_no").alias("seed_no"),
        F.col("order").alias("seed_order"), F.lit(0).cast("bigint").alias("ordinal"),
        netloc(F.col("url")).alias("domain"))
    return fallback_to(capped.select(*columns, "domain"), bare)


def targeted(items: DataFrame, goal: str, queries: Sequence[str], n: int) -> DataFrame:
    """The n items most relevant to the goal and its queries, ranked."""
    terms = query_terms(" ".join([goal, *queries]))
    top = top_relevant(items, "item", terms, n, ["seed_no", "seed_order", "ordinal"])
    return top.select("item", "url", "domain", "score", "seed_no", "seed_order", "ordinal")


@dataclass(frozen=True)
class Captured:
    """Tables that a research run reads; all are captured beforehand.

    ``pages`` and ``categories`` have ``(page_id, url, html)``: pages that may be mapped, and pages that directories list by
    category. ``directories`` are pages of links, ``answers`` results of searches ``(capture_id, source, query, body)``,
    ``sources`` the search sources ``(source, base, source_ordinal)``, ``stored`` known URLs ``(url, ordinal)``, and
    ``documents`` the corpus ``(doc_id, text)`` that queries are expanded from.
    """

    pages: DataFrame
    categories: DataFrame
    directories: DataFrame
    answers: DataFrame
    sources: DataFrame
    stored: DataFrame
    documents: DataFrame


def expanded(documents: DataFrame, goal: str, limits: Limits = Limits()) -> DataFrame:
    """Queries of a goal, written: ``(query_no, query)``, at most ``limits.queries``."""
    return cut_lineage(expand_query(documents, goal, limits.queries), "queries")


def research_seeds(captured: Captured, goal: str, queries: DataFrame, pattern: str, trusted: Sequence[str] = (),
                   limits: Limits = Limits()) -> DataFrame:
    """Stored URLs, results of all queries and seeds of flat and hierarchical directories, in one ordered set, written."""
    found = search_queries(queries, captured.answers, captured.sources, pattern, limits.per_query, trusted)
    listed = directory_seeds(captured.directories, captured.categories, query_terms(goal), pattern, trusted)
    return cut_lineage(seed_union([
        ("stored", captured.stored, ["ordinal"]),
        ("search", found, ["query_no", "source_ordinal", "capture_id", "pos"]),
        ("directory", listed, ["page_id", "rank", "pos"]),
    ]), "seeds")


def research(captured: Captured, goal: str, pattern: str, trusted: Sequence[str] = (), limits: Limits = Limits(),
             queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole flow: expanded queries, searches, directories, site maps, diversity cap, ranking, lookup.

    Returns the chosen URLs ``(url, item, domain, score, captured)`` and the documents of those that were captured, as
    pages or as category pages. Queries and chosen URLs are tables of ``limits`` rows; nothing else is gathered.
    ``queries`` may be given (:func:`expanded`).
    """
    queries = expanded(captured.documents, goal, limits) if queries is None else queries
    seeds = research_seeds(captured, goal, queries, pattern, trusted, limits)
    texts = [r["query"] for r in queries.orderBy("query_no").collect()]  # at most ``limits.queries``
    chosen = cut_lineage(targeted(inventory(captured.pages, seeds, trusted, limits), goal, texts, limits.pages), "chosen")
    # ``chosen`` has at most ``limits.pages`` rows, so captures are only scanned; of several of a URL the first counts.
    both = captured.pages.select(F.lit(0).alias("kind"), "page_id", "url", "html").unionByName(
        captured.categories.select(F.lit(1).alias("kind"), "page_id", "url", "html"))
    hits = both.join(F.broadcast(chosen.select("url").distinct()), "url", "left_semi")
    hits = cut_lineage(ordered_distinct(hits, ["url"], ["kind", "page_id"]), "hits")
    report = chosen.join(hits.select("url", F.lit(True).alias("captured")), "url", "left").select(
        "url", "item", "domain", F.round("score", 6).alias("score"),
        F.coalesce("captured", F.lit(False)).alias("captured"))
    keyed = hits.withColumn("page_id", F.struct("kind", "page_id"))  # pages and category pages number alike
    return report, extract_documents(keyed)


def research_context(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """Context text of the selected documents, in rank order."""
    ranked = documents.join(chosen.select("url", "score").distinct(), "url").select(
        (-F.col("score")).alias("rank"), F.col("metadata.title").alias("title"), "url", "markdown")
    return context_pack(ranked, ["rank", "url"])
