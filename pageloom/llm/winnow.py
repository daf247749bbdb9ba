"""Benchmark decontamination by winnowing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.frames import small, table
from pageloom.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP)
    return F.filter(parts, lambda w: w != "")


def runs(column: str, k: int, combine) -> Column:
    """Combine every run of ``k`` elements of an array column; empty if there are fewer.

    It takes a column's name: a lambda would work out an expression anew for each element.
    """
    return F.when(F.size(column) >= k, F.transform(
        F.sequence(F.lit(0), F.size(column) - k),
        lambda i: combine(*[F.get(F.col(column), i + j) for j in range(k)]))).otherwise(
        F.array().cast("array<bigint>"))


def with_minima(frame: DataFrame, gram: int, width: int) -> DataFrame:
    """Add ``m``: of word hashes ``h``, the smallest gram hash of every run of ``width`` grams."""
    return frame.withColumn("g", runs("h", gram, F.xxhash64)).withColumn("m", runs("g", width, F.least))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """Words of each document that lie in a passage of an item.

    A passage is a window of ``window`` consecutive item words; an item with fewer words is one window.
    The fingerprint of a text is the set of the smallest ``gram``-word hashes of every ``window - gram +
    1`` grams, so a text that holds a window holds its fingerprint: joining both sides' fingerprints
    finds every document with a shared span of ``window`` words. Windows of these documents
    whose minimum is a shared fingerprint are extended to all their words and compared with
    the item windows word by word. Items shorter than a window are found in the same way by their first
    word and all their words.

    Returns per row: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings),
    ``n_items``, ``contaminated``. Null or empty text has no words. Rows are told apart by ``doc_id``
    and a digest of the text, so repeated rows each get their result. Repeated items count by
    their ``item_id``; items with null id are ignored. Other columns are ignored; an empty table of
    documents gives no rows, one of items gives no hit.
    """
    keep = window - gram + 1
    known = items.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    passages = (known.select("item", "w", F.least(F.lit(window), F.size("w")).alias("n"))
                .select("item", "n", F.explode(F.transform(
                    F.sequence(F.lit(0), F.size("w") - F.col("n")),
                    lambda i: F.slice("w", i + 1, F.col("n")))).alias("span")))
    passages = (passages.groupBy("n", F.concat_ws(" ", "span").alias("passage"))
                .agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("span").alias("span"))
                .withColumn("set", F.xxhash64("items")))
    passages = cut_lineage(passages, "passages")

    hashed = passages.select("n", F.transform("span", lambda w: F.xxhash64(w)).alias("h"))
    prints = cut_lineage(with_minima(hashed, gram, keep).select(
        F.when(F.col("n") == window, F.get("m", F.lit(0))).otherwise(F.get("h", F.lit(0))).alias("hash"),
        (F.col("n") < window).alias("short")).distinct(), "prints")
    short = prints.where("short").limit(1).count() > 0

    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    read = rows.select("doc_id", "digest", words(F.col("text")).alias("w")).select(
        "doc_id", "digest", "w", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    marks = with_minima(read, gram, keep).select("doc_id", "digest", F.explode(F.array_distinct("m")).alias("hash"), F.lit(False).alias("short"))
    if short:
        marks = marks.unionAll(read.select("doc_id", "digest", F.explode(F.array_distinct("h")).alias("hash"),
                                           F.lit(True).alias("short")))
    shared = marks.join(small(prints), ["hash", "short"], "left_semi")
    hits = cut_lineage(shared.groupBy("doc_id", "digest").agg(
        F.collect_set(F.when(~F.col("short"), F.col("hash"))).alias("long_marks"),
        F.collect_set(F.when(F.col("short"), F.col("hash"))).alias("short_marks")), "hits")

    lengths = [r.n for r in passages.where(F.col("n") < window).select("n").distinct().collect()]
    marked = rows.join(hits, rows.doc_id.eqNullSafe(hits.doc_id) & (rows.digest == hits.digest), "left").select(
        rows.doc_id, rows.digest, "long_marks", "short_marks", words(F.col("text")).alias("w")).select(
        "doc_id", "digest", "long_marks", "short_marks", "w",
        F.when(F.col("long_marks").isNull(), F.array().cast("array<bigint>"))
        .otherwise(F.transform("w", lambda w: F.xxhash64(w))).alias("h"))
    minima = with_minima(marked, gram, keep)

    def spans(n: int, chosen: Column) -> Column:
        return F.transform(chosen, lambda i: F.struct(
            i.alias("at"), F.lit(n).alias("n"), F.concat_ws(" ", F.slice("w", i + 1, F.lit(n))).alias("passage")))

    def places(size: Column) -> Column:
        return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))

    found = [spans(window, F.filter(places(F.size("m")), lambda i: F.array_contains("long_marks", F.get(F.col("m"), i))))]
    found += [spans(n, F.filter(places(F.size("h") - n + 1),
                                lambda i: F.array_contains("short_marks", F.get(F.col("h"), i)))) for n in lengths]
    extended = cut_lineage(minima.select("doc_id", "digest", F.size("w").cast("long").alias("n_words"),
                                         F.concat(*found).alias("spans")), "spans")
    once = extended.where("size(spans) > 0").dropDuplicates(["doc_id", "digest"])
    agreed = (once.select("doc_id", "digest", F.inline("spans"))
              .join(small(passages.select("n", "passage", "set")), ["n", "passage"])
              .groupBy("doc_id", "digest")
              .agg(F.collect_list(F.struct("at", "n")).alias("spans"), F.collect_set("set").alias("sets")))
    agreed = cut_lineage(agreed.select(
        "doc_id", "digest", "sets", F.size(F.array_distinct(F.flatten(F.transform(
            "spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))).cast("long").alias("n_hit")), "agreed")
    sets = passages.select("set", "items").dropDuplicates(["set"])
    named = (agreed.select("doc_id", "digest", "n_hit", F.explode("sets").alias("set"))
             .join(small(cut_lineage(sets, "sets")), "set").groupBy("doc_id", "digest", "n_hit")
             .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    left, right = extended.drop("spans").alias("l"), named.alias("r")
    return left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
                     & (F.col("l.digest") == F.col("r.digest")), "left").select(
        "l.doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumns({
            "n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
      lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
      lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
  FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, p)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
