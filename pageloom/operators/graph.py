"""Breadth-first traversal as a short loop of joins, one per level.

Discovery order is carried as a key: the positions of the links on the path
from the seed. Comparing two keys of one level compares their discovery order,
so no global numbering and no single-task sort is needed. Each row of a frontier
carries how many rows its seed may still find; later rows can never move earlier
ones, so cutting per level gives the same result as cutting at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.operators.document import extract_documents
from pageloom.operators.links import document_links
from pageloom.operators.sets import first_per_group
from pageloom.session import cut_lineage

NO_PATH = "array<bigint>"

#: From the frontier of a level to the links of its pages: ``(src, pos, dst, …)``.
Expand = Callable[[DataFrame], DataFrame]


def links_from(edges: DataFrame, cap: int | None = None) -> Expand:
    """Links of a frontier out of a table of edges, or of pages with their links in a row (``page_adjacency``).

    Only links of pages in the frontier are read, and with ``cap`` only the first so many targets of a page. That is
    exact: of these, at most as many as the seed has found so far are not new, so the others
    are enough for what it has left. It bounds what a page with very many links contributes to the join.
    """
    def expand(frontier: DataFrame) -> DataFrame:
        wanted = frontier.select(F.col("url").alias("src")).distinct()
        near = edges.join(wanted, "src", "left_semi")
        if "links" in edges.columns:
            links = F.slice("links", 1, cap) if cap else F.col("links")
            return near.select("src", F.inline(links))
        if cap is None:
            return near
        rest = [c for c in edges.columns if c not in ("src", "pos", "dst")]
        unique = near.groupBy("src", "dst").agg(
            F.min("pos").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in rest])
        # Written, so that its size is known: few links, and it is these that are sent to the tasks of a large frontier.
        return cut_lineage(first_per_group(unique, ["src"], ["pos"], cap).select(*edges.columns), "links")

    return expand


def _children(frontier: DataFrame, links: DataFrame, group: str, anchor: bool) -> DataFrame:
    """Targets of the frontier's links, first discovery of each per group."""
    step = frontier.join(links, frontier["url"] == links["src"])
    key = F.array_append("key", F.col("pos").cast("long"))
    step = step.select(group, F.col("dst").alias("url"), key.alias("key"), "left",
                       *(["anchor"] if anchor else []))
    # Few bytes of links may give very many rows, so they are dealt out by group, to a fixed number of partitions, before
    # they are sorted; a group has at most the square of its cap. Its grouping and ranking need no further shuffle.
    step = step.repartition(int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)
    aggs = [F.min("key").alias("key"), F.max("left").alias("left")]
    if anchor:
        aggs.append(F.min_by("anchor", "key").alias("anchor"))
    return step.groupBy(group, "url").agg(*aggs)


def _first_new(new: DataFrame, found: DataFrame | None, group: str, cap: int) -> DataFrame:
    """Rows that their group has not found before, in order of discovery, as many as it has left."""
    if found is not None:
        new = new.join(found.select(group, "url"), [group, "url"], "left_anti")
    place = F.row_number().over(Window.partitionBy(group).orderBy("key"))
    # The fixed bound cuts rows in each task before the shuffle, the second one is the group's own.
    return (new.withColumn("_rn", place).filter(F.col("_rn") <= cap).filter("_rn <= left")
            .withColumn("ordinal", (F.lit(cap) - F.col("left") + F.col("_rn")).cast("long")).drop("_rn"))


def _open(level: DataFrame, group: str) -> DataFrame:
    """Frontier of the next level: rows of groups that may still find more."""
    taken = F.count(F.lit(1)).over(Window.partitionBy(group))
    return level.withColumn("left", F.col("left") - taken).filter(F.col("left") > 0)


def site_map(edges: DataFrame, seeds: DataFrame, depth: int = 2, max_urls: int = 200) -> DataFrame:
    """URLs reachable from each seed: ``(seed, ordinal, depth, url, anchor)``.

    ``edges`` has ``(src, pos, dst, anchor)`` or, from ``page_adjacency``, ``(src, links)``; ``seeds`` has ``seed``. Pages up
    to ``depth`` links away are expanded, so targets up to ``depth + 1`` are
    returned; a seed itself is returned only when something links to it.
    """
    if "links" in edges.columns:
        edges = cut_lineage(edges, "adjacency")  # each page is read once for all levels
    expand = links_from(edges, max_urls)
    # Written: else the rows found from the seeds stay in the few partitions that the seeds need.
    frontier = cut_lineage(seeds.select("seed").distinct().withColumns({
        "url": F.col("seed"), "key": F.array().cast(NO_PATH), "left": F.lit(max_urls).cast("long")}), "map-seeds")
    found: DataFrame | None = None
    for level in range(depth + 1):
        new = _children(frontier, expand(frontier), "seed", anchor=True)
        new = _first_new(new, found, "seed", max_urls).withColumn("depth", F.lit(level + 1))
        if level < depth:
            new = cut_lineage(new, "map-level")
        found = new if found is None else found.unionByName(new)
        if level == depth:
            break
        frontier = cut_lineage(_open(new, "seed").filter(F.col("url") != F.col("seed")).select(
            "seed", "url", "key", "left"), "map-frontier")
        if frontier.isEmpty():
            break
    return found.select("seed", "ordinal", "depth", "url", "anchor")


def _crawl(expand: Expand, captured: DataFrame, seeds: DataFrame, depth: int, max_pages: int) -> DataFrame:
    """Levels of a crawl; ``expand`` gives the links of captured pages, ``captured`` has their distinct ``url``."""
    start = F.array(F.col("ordinal").cast("long"))
    new = seeds.groupBy("crawl_id", "url").agg(F.min(start).alias("key")).withColumn(
        "left", F.lit(max_pages).cast("long"))
    found: DataFrame | None = None
    for level in range(depth + 1):
        hit = _first_new(new.join(captured, "url", "left_semi"), found, "crawl_id", max_pages).select(
            "crawl_id", "ordinal", F.lit(level).alias("depth"), "url", "key", "left")
        if level < depth:
            hit = cut_lineage(hit, "crawl-level")
        found = hit if found is None else found.unionByName(hit)
        if level == depth:
            break
        frontier = cut_lineage(_open(hit, "crawl_id"), "crawl-frontier")
        if frontier.isEmpty():
            break
        new = _children(frontier, expand(frontier), "crawl_id", anchor=False)
    return found.select("crawl_id", "ordinal", "depth", "url")


def crawl(edges: DataFrame, captures: DataFrame, seeds: DataFrame, depth: int = 2,
          max_pages: int = 50) -> DataFrame:
    """Captured pages in crawl order: ``(crawl_id, ordinal, depth, url)``.

    ``seeds`` has ``(crawl_id, url, ordinal)``; every crawl is independent.
    A missing capture does not count and is not expanded, so links to such pages are left out before a page's
    links are cut to the first ones.
    """
    captured = captures.select("url").distinct()
    if depth > 0:
        captured = cut_lineage(captured, "captured")
    near = links_from(edges.select("src", "pos", "dst"))

    def expand(frontier: DataFrame) -> DataFrame:
        reachable = near(frontier).join(captured.withColumnRenamed("url", "dst"), "dst", "left_semi")
        unique = reachable.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
        return first_per_group(unique, ["src"], ["pos"], max_pages)

    return _crawl(expand, captured, seeds, depth, max_pages)


def crawl_documents(captures: DataFrame, seeds: DataFrame, depth: int = 2, max_pages: int = 50,
                    host_pattern: str | None = None, trusted: Sequence[str] = (), hosts: DataFrame | None = None,
                    only_main: bool = True, key: str = "page_id") -> DataFrame:
    """Crawl over the links of documents, which are extracted level by level: ``(crawl_id, ordinal, depth, url)``.

    ``captures`` has ``(key, url, html)``. Only captures that a level expands are turned into documents, each once for all
    crawls: their links in scope (host matches ``host_pattern``, address is safe) go to a written table that
    later levels read. Of several captures of an address the one with the smallest key counts. Seeds are not checked
    for scope. As in :func:`crawl`, missing captures do not count.
    """
    listed = cut_lineage(captures.groupBy("url").agg(F.min(key).alias(key)), "captured")
    captured = listed.select("url")
    read: list[tuple[DataFrame, DataFrame]] = []

    def united(k: int) -> DataFrame:
        out = read[0][k]
        for part in read[1:]:
            out = out.unionAll(part[k])
        return out

    def expand(frontier: DataFrame) -> DataFrame:
        wanted = frontier.select("url").distinct()
        if read:
            wanted = wanted.join(united(0), "url", "left_anti")
        wanted = cut_lineage(wanted.join(listed, "url"), "wanted")
        pages = captures.join(wanted.select(key), key, "left_semi")
        links = document_links(extract_documents(pages, only_main=only_main, key=key), host_pattern, trusted, hosts)
        unique = links.groupBy("src", "dst").agg(F.min("pos").alias("pos")).join(
            captured.withColumnRenamed("url", "dst"), "dst", "left_semi")
        read.append((wanted.select("url"), cut_lineage(
            first_per_group(unique, ["src"], ["pos"], max_pages).select("src", "pos", "dst"), "document-links")))
        return united(1)

    return _crawl(expand, captured, seeds, depth, max_pages)


def missing_captures(urls: DataFrame, captures: DataFrame) -> DataFrame:
    """Requested URLs without a capture."""
    return urls.join(captures.select("url").distinct(), "url", "left_anti")


def lookup(captures: DataFrame, targets: DataFrame) -> DataFrame:
    """Captures of exactly the requested URLs."""
    return captures.join(targets.select("url").distinct(), "url", "left_semi")
