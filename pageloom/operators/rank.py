"""Ranking: relevance, diversity caps, latest state, repeatable samples."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.text import let, listed_words, sql_text, words
from pageloom.operators.sets import fallback_to
from pageloom.session import cut_lineage

K1, B = 1.2, 0.75


def query_terms(goal: str) -> list[str]:
    """Distinct lower-cased words of a goal, in order."""
    out: list[str] = []
    word = ""
    for ch in goal.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            if word not in out:
                out.append(word)
            word = ""
    return out


def _counted(df: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Add ``_tf``, how often each term occurs in the text, and ``_len``, its number of words."""
    listed = ", ".join(sql_text(t) for t in terms)
    counted = df.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))
    counts = let(listed_words("_words", terms),
                 f"hits -> transform(array({listed}), q -> size(filter(hits, w -> w = q)))")
    return counted.withColumns({"_tf": counts, "_len": F.size("_words").cast("double")}).drop("_words")


def relevance(df: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Add a BM25 ``score`` of the text for the terms; no shuffle of rows.

    The corpus statistics are one row of ``len(terms) + 2`` numbers, computed by
    a first aggregation and then used as constants.
    """
    if not terms:
        return df.withColumn("score", F.lit(0.0))
    counted = _counted(df, text, terms)
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"),
        *[F.count_if(F.col("_tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avg = stats["n"], stats["avg"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        seen = stats[f"df{i}"]
        idf = math.log(1.0 + (n - seen + 0.5) / (seen + 0.5))
        tf = F.col("_tf")[i].cast("double")
        norm = tf + K1 * (1 - B + B * F.col("_len") / F.lit(float(avg)))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / norm).otherwise(0.0)
    return counted.withColumn("score", score).drop("_tf", "_len")


def relevance_within(df: DataFrame, text: str, terms: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Add a BM25 ``score`` whose statistics (rows, rows with a term, mean length) are those of the row's group.

    Rows are shuffled once by group, as numbers beside their columns, and a ranking inside the group needs no further shuffle.
    A group has to fit into one task; here it is the links of one page.
    """
    if not terms:
        return df.withColumn("score", F.lit(0.0))
    by = Window.partitionBy(*group)
    score = F.lit(0.0)
    for i in range(len(terms)):
        seen = F.count_if(F.col("_tf")[i] > 0).over(by)
        idf = F.log(F.lit(1.0) + (F.col("_n") - seen + 0.5) / (seen + 0.5))
        tf = F.col("_tf")[i].cast("double")
        norm = tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg"))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / norm).otherwise(0.0)
    sized = _counted(df, text, terms).withColumns({
        "_n": F.count(F.lit(1)).over(by).cast("double"), "_avg": F.avg("_len").over(by)})
    return sized.withColumn("score", score).drop("_tf", "_len", "_n", "_avg")


def top_relevant(df: DataFrame, text: str, terms: Sequence[str], n: int,
                 order: Sequence[str]) -> DataFrame:
    """The n most relevant rows; rows without any term follow in their own order."""
    scored = relevance(df, text, terms)
    # Rounded, so that equal scores tie whatever order their terms were added in.
    return scored.orderBy(F.desc(F.round("score", 9)), *order).limit(n)


def candidate_window(df: DataFrame, text: str, order: Sequence[str], max_items: int = 80,
                     max_chars: int = 100) -> DataFrame:
    """First items, each cut to a length, as a ranker with bounded input sees them."""
    return df.orderBy(*order).limit(max_items).withColumn(text, F.substring(text, 1, max_chars))


def domain_cap(df: DataFrame, domain: str, order: Sequence[str], cap: int = 5) -> DataFrame:
    """At most ``cap`` rows per domain, with the keys of the output order.

    Adds ``domain_first`` (where the domain was first seen) and ``domain_rank``;
    sort by these two to list domains in first-seen order. A domain with a large
    share of the rows is cut to ``cap`` rows in each task before the shuffle.
    """
    by = Window.partitionBy(domain).orderBy(*order)
    capped = df.withColumn("domain_rank", F.row_number().over(by)).filter(
        F.col("domain_rank") <= cap)
    return capped.withColumn("domain_first", F.min(F.struct(*order)).over(Window.partitionBy(domain)))


def latest_state(events: DataFrame, group: Sequence[str], time: str, state: Sequence[str],
                 condition: Column) -> DataFrame:
    """Newest qualifying state per group; NULLs where no row qualifies."""
    newest = F.max_by(F.struct(*state), F.when(condition, F.struct(time, *state)))
    return events.groupBy(*group).agg(newest.alias("_s")).select(
        *group, *[F.col(f"_s.{c}").alias(c) for c in state])


def repeatable_sample(df: DataFrame, run: str, key: str, n: int = 5) -> DataFrame:
    """n rows per run without replacement; the hash order makes reruns equal."""
    by = Window.partitionBy(run).orderBy(F.md5(F.concat_ws("|", run, key)), key)
    return df.withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= n).drop("_rn")


@dataclass(frozen=True)
class TermIndex:
    """Inverted index of a corpus: ``postings`` (term, key, tf, length), number of documents and mean length in words.

    Rows lie by (term, key), so a common term is spread over all files, and are sorted by term inside of each, so a filter
    on terms skips most pages of a file.
    """

    postings: DataFrame
    documents: int
    average: float


def term_index(documents: DataFrame, text: str = "text", key: str = "doc_id") -> TermIndex:
    """Write the index of a corpus; its texts are read once and shuffled once, as one row a document and word."""
    split = documents.select(F.col(key).alias("key"), words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    tokens = split.select("key", F.size("_words").alias("length"), F.explode("_words").alias("term"))
    postings = cut_lineage(tokens.groupBy("term", "key", "length").agg(F.count(F.lit(1)).alias("tf"))
                           .sortWithinPartitions("term"), "index")
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    count = documents.count()  # from the file footers
    return TermIndex(postings, count, total / count if count else 0.0)


def indexed_relevance(index: TermIndex, terms: Sequence[str]) -> DataFrame:
    """BM25 ``(key, score)`` of the documents that have any of the terms; the others score zero and are left out."""
    hits = index.postings.filter(F.col("term").isin(*terms or [""]))
    seen = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # one row a term
    idf = F.lit(0.0)
    for term, df in seen.items():
        idf = F.when(F.col("term") == term, math.log(1.0 + (index.documents - df + 0.5) / (df + 0.5))).otherwise(idf)
    tf = F.col("tf").cast("double")
    norm = tf + K1 * (1 - B + B * F.col("length") / F.lit(index.average or 1.0))
    return hits.withColumn("_part", idf * tf * (K1 + 1) / norm).groupBy("key").agg(F.sum("_part").alias("score"))


def _best_scored(scored: DataFrame, feedback: int) -> DataFrame:
    """Keys of the best scored documents, written; rounded, so that equal scores tie whatever order their terms were added in."""
    return cut_lineage(scored.orderBy(F.desc(F.round("score", 9)), "key").limit(feedback).select("key"), "feedback")


def _near_in_index(index: TermIndex, terms: Sequence[str], feedback: int) -> tuple[DataFrame, DataFrame, int]:
    """Terms of the feedback documents ``(term, tf)``, in how many documents each occurs ``(term, df)``, and all documents."""
    top = _best_scored(indexed_relevance(index, terms), feedback)
    near = index.postings.join(F.broadcast(top), "key", "left_semi").filter(~F.col("term").isin(*terms or [""]))
    # Terms of the feedback documents only: written once, because it is used twice.
    near = cut_lineage(near.groupBy("term").agg(F.sum("tf").alias("tf")), "near-terms")
    spread = index.postings.select("term").join(near.select("term"), "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))
    return near, spread, index.documents


def _near_in_texts(documents: DataFrame, terms: Sequence[str], feedback: int, text: str,
                   key: str) -> tuple[DataFrame, DataFrame, int]:
    """As :func:`_near_in_index`, from the texts: counted row by row, then once more against the terms of the feedback documents.

    As in an index, rows of one key and number of words are one document.
    """
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    places = range(len(terms))
    counted = _counted(docs, "text", terms) if terms else docs.withColumns({
        "_tf": F.array().cast("array<int>"), "_len": F.lit(0.0)})
    sized = cut_lineage(counted.select("key", "_len", "_tf").groupBy("key", "_len").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_tf")[i]).alias(f"tf{i}") for i in places]), "sized")
    stats = sized.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col("_len") * F.col("n")) / F.sum("n")).alias("avg"),
        F.coalesce(F.max("n"), F.lit(0)).alias("copies"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in places]).first()
    score, found = F.lit(0.0), F.lit(False)
    for i in places:
        tf, df = F.col(f"tf{i}").cast("double"), stats[f"df{i}"]
        idf = math.log(1.0 + (stats["n"] - df + 0.5) / (df + 0.5))
        norm = tf + K1 * (1 - B + B * F.col("_len") / F.lit(stats["avg"] or 1.0))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / norm).otherwise(0.0)
        found = found | (tf > 0)
    top = _best_scored(sized.filter(found).groupBy("key").agg(F.sum(score).alias("score")), feedback)
    split = words(F.coalesce(F.col("text"), F.lit("")))
    near = docs.join(F.broadcast(top), "key", "left_semi").select(F.explode(split).alias("term"))
    near = cut_lineage(near.filter(~F.col("term").isin(*terms or [""])).groupBy("term").agg(
        F.count(F.lit(1)).alias("tf")), "near-terms")
    # Not plain explode: its test for empty lists would be pushed down and split each text once more.
    hits = docs.select("key", split.alias("_words")).select(
        "key", F.size("_words").alias("_len"), F.explode_outer(F.array_distinct("_words")).alias("term"))
    # No more terms than the feedback documents have words.
    hits = hits.join(F.broadcast(near.select("term")), "term", "left_semi")
    if stats["copies"] > 1:
        hits = hits.distinct()
    return near, hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats["n"]


def expand_query(documents: DataFrame, goal: str, n: int = 6, feedback: int = 10,
                 text: str = "text", key: str = "doc_id", index: TermIndex | None = None) -> DataFrame:
    """Search queries from the corpus: goal plus its best co-occurring terms.

    The ``feedback`` most relevant documents, a parameter of pseudo-relevance
    feedback, give candidate terms; each is weighted by its frequency there and its
    rarity in the whole corpus. Returns
    ``(query_no, query)``; the bare goal when nothing matches. All of it is read from the
    ``index`` of the corpus if one is given; for a single goal the texts are gone through instead, and nothing the size of the
    corpus is shuffled or written.
    """
    terms = query_terms(goal)
    if index is None:
        near, spread, count = _near_in_texts(documents, terms, feedback, text, key)
    else:
        near, spread, count = _near_in_index(index, terms, feedback)
    weighted = near.join(spread, "term").withColumn(
        "weight", F.round(F.col("tf") * F.log(F.lit(1.0 + count) / F.col("df")), 6))
    best = cut_lineage(weighted.orderBy(F.desc("weight"), "term").limit(n), "best-terms")
    numbered = best.withColumn("query_no", F.row_number().over(
        Window.orderBy(F.desc("weight"), "term"))).select(
        F.col("query_no").cast("long").alias("query_no"),
        F.concat(F.lit(goal + " "), F.col("term")).alias("query"))
    bare = documents.sparkSession.range(1).select(
        F.lit(1).cast("long").alias("query_no"), F.lit(goal).alias("query"))
    return fallback_to(numbered, bare)
