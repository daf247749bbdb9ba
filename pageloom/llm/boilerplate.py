"""Line deduplication by frequency relative to the site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.frames import fresh, table
from pageloom.session import cut_lineage

RATIO, MIN_PAGES = 0.05, 3
#: The list of lines is sent to every task up to this size; an entry takes some 24 bytes.
BROADCAST_LINES = 500_000


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def drop_site_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO,
                    min_pages: int = MIN_PAGES) -> DataFrame:
    """Drop from every text the lines that more than ``ratio`` of its host's pages contain.

    Pages that contain a line are counted per host (a page counts once, whatever the repeats in it) and
    divided by the pages of the host; lines on fewer than ``min_pages`` pages always stay. Counts are
    summed in each task before the shuffle, by host and a 96-bit digest of the line, so neither a hot
    host nor a hot line meets in one task. A host keeps at most (lines per page) / ratio such lines.
    The list of all hosts is sent to every task while it has at most ``BROADCAST_LINES`` entries; a
    longer one is joined by host, one row a host, and a hot host's pages are split by the skew rule.

    All columns are returned, ``text`` changed and ``n_dropped`` added (or replaced); texts keep the order of their
    other lines, and a text whose lines all go is empty. Lines are compared as they are; blank lines
    always stay. Null text stays null and has no lines; a null host is a host of its own; rows
    are treated one by one. An empty table gives no rows.
    """
    site = F.col(host)
    lines = F.split("text", "\n")
    seen = docs.select(site.alias("host"), F.explode(F.array_distinct(lines)).alias("line")).where("trim(line) <> ''")
    pages = docs.groupBy(site.alias("host")).agg(F.count("*").alias("pages"))
    counted = seen.groupBy("host", _key(F.col("line")).alias("key")).agg(F.count("*").alias("n"))
    frequent = counted.where(F.col("n") >= min_pages).alias("c").join(
        pages.alias("p"),
        F.col("c.host").eqNullSafe(F.col("p.host"))).where(F.col("n") > ratio * F.col("pages"))
    by_host = cut_lineage(frequent.groupBy("c.host").agg(F.collect_list("key").alias("known"))
                          .select("host", "known", F.size("known").alias("size")), "lines")
    total = by_host.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    name = fresh(docs, "found")
    listed = by_host.select(F.struct("host", "known").alias(name))
    joined = docs.join(F.broadcast(listed) if total <= BROADCAST_LINES else listed,
                       site.eqNullSafe(F.col(name)["host"]), "left")
    known = F.col(name)["known"]
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(known, _key(x)))
    text = F.when(known.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(known.isNull() | F.col("text").isNull(), 0).otherwise(
        F.size(lines) - F.size(kept)).cast("long")
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "n_dropped"],
                         dropped.alias("n_dropped"))


def site_lines(spark: SparkSession, folder: str) -> DataFrame:
    return drop_site_lines(table(spark, folder, "documents")).select("doc_id", "source", "text", "n_dropped")


SITE_LINES_SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
c AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(ls)) AS line FROM d)
  WHERE trim(line) <> '' GROUP BY source, line),
f AS (SELECT c.source, list(line) AS known FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
  WHERE n >= 3 AND n > 0.05 * pages GROUP BY c.source)
SELECT doc_id, d.source,
  CASE WHEN known IS NULL THEN text ELSE array_to_string(
    list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(known, x)), chr(10)) END AS text,
  CASE WHEN known IS NULL OR text IS NULL THEN 0
    ELSE len(list_filter(ls, lambda x: trim(x) <> '' AND list_contains(known, x))) END AS n_dropped
FROM d LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""
