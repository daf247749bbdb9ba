"""Queries that rank, pack, summarise and store."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.url import item_url, netloc
from pageloom.operators.links import page_links, short_anchor_items
from pageloom.operators.pack import context_pack
from pageloom.operators.rank import (
    candidate_window, domain_cap, expand_query, latest_state, query_terms, repeatable_sample,
    top_relevant,
)
from pageloom.operators.telemetry import (
    as_of, global_summary, of_run, percentile_by, run_summary,
)
from pageloom.plans.graph_queries import (
    FIRST_LINK, RESULT_URL, bm25_sql, category_captures, directory_pages, search_captures, search_sources,
)
from pageloom.plans.registry import (
    LINKS, MARKDOWN, SQL_TITLE, TRUSTED, q, query, sql_decode, sql_netloc, sql_root, table,
)
from pageloom.plans.research import Captured, Limits, expanded, research, research_context
from pageloom.schema import PAGES
from pageloom.sources.store import add_missing_columns, conform, filter_sources, upsert_sources

GOAL = "the attion of onble"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


# ---- ranking -----------------------------------------------------------------------------


@query("domain_cap", f"""
    WITH {LINKS}, c AS (SELECT page_id, pos, dst, {sql_netloc('dst')} AS domain, row_number() OVER (
      PARTITION BY {sql_netloc('dst')} ORDER BY page_id, pos)::INTEGER AS domain_rank FROM links)
    SELECT page_id, pos, dst, domain, domain_rank,
      min(page_id) OVER (PARTITION BY domain) AS domain_first FROM c WHERE domain_rank <= 5""")
def domain_cap_rows(spark: SparkSession, folder: str) -> DataFrame:
    links = page_links(table(spark, folder, "pages")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "dst", netloc(F.col("dst")).alias("domain"))
    rows = domain_cap(links, "domain", ["page_id", "pos"], 5)
    return rows.withColumn("domain_first", F.col("domain_first.page_id"))


@query("relevance_topn", f"""
    WITH {bm25_sql('documents', 'text', GOAL, 'doc_id')}
    SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 20""")
def relevance_topn(spark: SparkSession, folder: str) -> DataFrame:
    rows = top_relevant(_docs(spark, folder), "text", query_terms(GOAL), 20, ["doc_id"])
    return rows.select("doc_id", F.round("score", 6).alias("score"))


@query("relevance_fallback", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 20")
def relevance_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """No document has the term: the first rows in order."""
    rows = top_relevant(_docs(spark, folder), "text", ["zzzzqqqq"], 20, ["doc_id"])
    return rows.select("doc_id", "score")


@query("candidate_window", "SELECT doc_id, substr(text, 1, 100) AS text FROM documents ORDER BY doc_id LIMIT 80")
def candidate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_window(_docs(spark, folder).select("doc_id", "text"), "text", ["doc_id"])


@query("item_url_parse", f"""
    WITH {LINKS} SELECT page_id, pos, dst AS url FROM links WHERE length(text) < 50""")
def item_url_parse(spark: SparkSession, folder: str) -> DataFrame:
    items = short_anchor_items(page_links(table(spark, folder, "pages")))
    return items.select("page_id", F.col("pos").cast("bigint").alias("pos"), item_url(F.col("item")).alias("url"))


@query("latest_state", """
    SELECT user_id, arg_max(event_id, ts) FILTER (event_type = 'signup') AS event_id,
      arg_max(value, ts) FILTER (event_type = 'signup') AS value FROM events GROUP BY user_id""")
def latest_state_rows(spark: SparkSession, folder: str) -> DataFrame:
    return latest_state(table(spark, folder, "events"), ["user_id"], "ts", ["event_id", "value"],
                        F.col("event_type") == "signup")


@query("random_sample", f"""
    SELECT page_id, run FROM (SELECT page_id, {sql_netloc('url')} AS run, row_number() OVER (
      PARTITION BY {sql_netloc('url')} ORDER BY md5({sql_netloc('url')} || '|' || page_id), page_id) AS rn
      FROM pages) WHERE rn <= 5""")
def random_sample(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", netloc(F.col("url")).alias("run"))
    return repeatable_sample(pages, "run", "page_id", 5)


@query("query_expansion", f"""
    WITH {bm25_sql('documents', 'text', GOAL, 'doc_id, text, toks')},
    top AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10),
    near AS (SELECT term, count(*) AS tf FROM (SELECT unnest(toks) AS term FROM top)
      WHERE term NOT IN ({', '.join(q(t) for t in query_terms(GOAL))}) GROUP BY 1),
    spread AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM scored) GROUP BY 1),
    w AS (SELECT term, round(tf * ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / df), 6) AS weight
      FROM near JOIN spread USING (term))
    SELECT row_number() OVER (ORDER BY weight DESC, term) AS query_no, {q(GOAL + ' ')} || term AS query
    FROM w ORDER BY 1 LIMIT 6""")
def query_expansion(spark: SparkSession, folder: str) -> DataFrame:
    return expand_query(_docs(spark, folder), GOAL)


@query("context_pack", """
    SELECT substr(string_agg('[' || coalesce(nullif(source, ''), 'untitled') || '] doc/' || doc_id || chr(10)
      || substr(text, 1, 200), chr(10) || chr(10) ORDER BY doc_id), 1, 6000) AS context FROM documents""")
def context_row(spark: SparkSession, folder: str) -> DataFrame:
    rows = _docs(spark, folder).select(
        "doc_id", F.col("source").alias("title"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("markdown"))
    return context_pack(rows, ["doc_id"])


# ---- telemetry -----------------------------------------------------------------------------


def event_facts(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """Events as page facts: user is the run, value the fetch time."""
    events = table(spark, folder, "events") if events is None else events
    return events.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("run_id"),
        F.floor("value").cast("int").alias("fetch_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("markdown_chars"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
        (F.col("event_type") == "signup").alias("injection_detected"),
        F.col("ts").cast("timestamp").alias("scraped_at"))


_FACTS = """facts AS (SELECT user_id::VARCHAR AS run_id, floor(value)::INTEGER AS fetch_ms,
    json_extract(props, '$.k')::INTEGER AS markdown_chars,
    CASE WHEN event_type = 'error' THEN 'failed' END AS error, event_type = 'signup' AS flagged FROM events)"""
_RUN = """SELECT run_id, count(*) AS total, sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END)::BIGINT AS success,
    avg(fetch_ms)::INTEGER AS avg_ms, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY fetch_ms), 6)::INTEGER AS p95_ms,
    avg(markdown_chars)::INTEGER AS avg_chars, sum(flagged::INTEGER)::BIGINT AS injections FROM facts"""


@query("run_summary", f"WITH {_FACTS} {_RUN} GROUP BY run_id")
def run_summary_rows(spark: SparkSession, folder: str) -> DataFrame:
    return run_summary(event_facts(spark, folder))


@query("run_filter", f"WITH {_FACTS} {_RUN} WHERE run_id = '8' GROUP BY run_id")
def run_filter(spark: SparkSession, folder: str) -> DataFrame:
    return run_summary(of_run(event_facts(spark, folder), "8"))


@query("global_summary", f"""
    WITH {_FACTS} SELECT count(DISTINCT run_id) AS runs, count(*) AS pages,
      round(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) * 100 / count(*), 6) AS success_pct,
      avg(fetch_ms)::INTEGER AS avg_ms, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY fetch_ms), 6)::INTEGER AS p95_ms,
      avg(markdown_chars)::INTEGER AS avg_chars FROM facts""")
def global_summary_row(spark: SparkSession, folder: str) -> DataFrame:
    return global_summary(event_facts(spark, folder))


@query("latency_p95", """
    SELECT event_type, count(*) AS n, round(quantile_cont(floor(value)::INTEGER, 0.95), 6) AS percentile
    FROM events GROUP BY 1""")
def latency_p95(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_type", F.floor("value").cast("int").alias("ms"))
    return percentile_by(rows, ["event_type"], "ms").select(
        "event_type", "n", F.round("percentile", 6).alias("percentile"))


@query("circuit_asof", """
    SELECT p.event_id, s.event_id AS circuit_id, s.user_id AS exit_id FROM
      (SELECT event_id, ts FROM events WHERE event_type = 'view') p ASOF LEFT JOIN
      (SELECT event_id, ts, user_id FROM events WHERE event_type = 'signup') s ON p.ts >= s.ts""")
def circuit_asof(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    probes = events.filter("event_type = 'view'").select("event_id", "ts")
    states = events.filter("event_type = 'signup'").select(
        "ts", F.col("event_id").alias("circuit_id"), F.col("user_id").alias("exit_id"))
    return as_of(probes, states, "ts", "event_id", ["circuit_id", "exit_id"]).drop("ts")


# ---- store -----------------------------------------------------------------------------------


def nation_sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.concat(F.lit("s/"), F.col("n_nationkey").cast("string")).alias("url"), F.col("n_name").alias("name"),
        F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("category"),
        F.lit(datetime(2020, 1, 1, tzinfo=timezone.utc)).alias("added_at"))


@query("source_upsert", """
    WITH cur AS (SELECT 's/' || n_nationkey AS url, n_name AS name, 'c' || n_regionkey AS category,
        '2020-01-01 00:00:00' AS added_at FROM nation),
    upd AS (SELECT 's/' || (s_nationkey * 2) AS url, arg_max(s_name, s_suppkey) AS name,
        'supplier' AS category FROM supplier GROUP BY 1)
    SELECT coalesce(u.url, c.url) AS url, coalesce(u.name, c.name) AS name,
      coalesce(u.category, c.category) AS category, coalesce(c.added_at, '2024-01-01 00:00:00') AS added_at
    FROM cur c FULL OUTER JOIN upd u ON c.url = u.url""")
def source_upsert(spark: SparkSession, folder: str) -> DataFrame:
    updates = table(spark, folder, "supplier").select(
        F.concat(F.lit("s/"), (F.col("s_nationkey") * 2).cast("string")).alias("url"),
        F.col("s_name").alias("name"), F.lit("supplier").alias("category"), "s_suppkey")
    merged = upsert_sources(nation_sources(spark, folder), updates, "s_suppkey",
                            F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)))
    return merged.withColumn("added_at", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss"))


@query("source_by_category", """
    SELECT 's/' || n_nationkey AS url, n_name AS name, 'c' || n_regionkey AS category FROM nation
    WHERE n_regionkey IN (1, 3)""")
def source_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return filter_sources(nation_sources(spark, folder), ["c1", "c3"])


@query("source_all", """
    SELECT 's/' || n_nationkey AS url, n_name AS name, 'c' || n_regionkey AS category FROM nation""")
def source_all(spark: SparkSession, folder: str) -> DataFrame:
    return filter_sources(nation_sources(spark, folder), [])


@query("schema_evolution", """
    SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS run_id, event_type AS title,
      NULL::VARCHAR AS page_type, NULL::VARCHAR AS language FROM events
    UNION ALL SELECT 'd' || doc_id, source, NULL, 'other', lang FROM documents""")
def schema_evolution(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written before and after columns were added, read with one schema."""
    old = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("run_id"),
        F.col("event_type").alias("title"))
    new = _docs(spark, folder).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("run_id"),
        F.lit("other").alias("page_type"), F.col("lang").alias("language"))
    rows = add_missing_columns(old, PAGES).unionByName(new, allowMissingColumns=True)
    return conform(rows, PAGES).select("id", "run_id", "title", "page_type", "language")


# ---- research ----------------------------------------------------------------------------------


_TERMS = query_terms(GOAL)


_CHOSEN = f"""{bm25_sql('documents', 'text', GOAL, 'doc_id, text, toks')},
    top AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10),
    near AS (SELECT term, count(*) AS tf FROM (SELECT unnest(toks) AS term FROM top)
      WHERE term NOT IN ({', '.join(q(t) for t in _TERMS)}) GROUP BY 1),
    spread AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM scored) GROUP BY 1),
    best AS (SELECT term FROM near JOIN spread USING (term)
      ORDER BY round(tf * ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / df), 6) DESC, term LIMIT 6),
    terms AS (SELECT term FROM best UNION ALL SELECT unnest([{', '.join(q(t) for t in _TERMS)}])),
    {LINKS}, hop AS (SELECT page_id, dst AS url, min(pos) AS pos, arg_min(substr(text, 1, 40), pos) AS anchor
      FROM links WHERE {sql_netloc('src')} = {sql_netloc('dst')} GROUP BY 1, 2),
    mapped AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS ordinal,
      CASE WHEN anchor <> '' THEN anchor || ' | ' || url ELSE url END AS item FROM hop),
    uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY page_id, ordinal) AS rn
      FROM mapped WHERE ordinal <= 100) WHERE rn = 1),
    capped AS (SELECT *, regexp_extract_all(lower(item), '[\\p{{L}}\\p{{N}}]+') AS words FROM (
      SELECT page_id, url, ordinal, item, {sql_netloc('url')} AS domain, row_number() OVER (
        PARTITION BY {sql_netloc('url')} ORDER BY page_id, ordinal) AS dr FROM uniq) WHERE dr <= 5),
    cs AS (SELECT count(*)::DOUBLE AS cn, avg(len(words))::DOUBLE AS ca FROM capped),
    hit AS (SELECT item, term, len(list_filter(words, lambda w: w = term)) AS tf, len(words) AS dl
      FROM capped, terms),
    idf AS (SELECT term, ln(1.0 + (any_value(cn) - count_if(tf > 0) + 0.5) / (count_if(tf > 0) + 0.5)) AS idf
      FROM hit, cs GROUP BY term),
    ranked AS (SELECT item, sum(CASE WHEN tf > 0 THEN idf * tf * 2.2::DOUBLE
        / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / ca)) ELSE 0.0::DOUBLE END) AS score
      FROM hit JOIN idf USING (term), cs GROUP BY item),
    category AS (SELECT url, min(page_id) AS page_id FROM (SELECT page_id, {sql_root('url')}
      || {sql_decode(f'{FIRST_LINK}[(page_id % 6)::INTEGER + 1]')} AS url FROM pages) WHERE url IS NOT NULL GROUP BY url),
    chosen AS (SELECT url, item, domain, round(score, 6) AS score, page_id AS seed, ordinal FROM capped JOIN ranked USING (item)
      ORDER BY round(ranked.score, 9) DESC, page_id, ordinal LIMIT 30)"""


def _researched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pages in all roles: captures, directories, answers of searches; an answer is to the queries whose last word it has."""
    pages, docs = table(spark, folder, "pages"), _docs(spark, folder)
    queries = expanded(docs, GOAL)
    words_of = F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    asked = F.broadcast(queries.select("query", F.substring_index("query", " ", -1).alias("word")))
    answers = search_captures(spark, folder).drop("query").withColumn("_words", words_of).join(
        asked, F.expr("array_contains(_words, word)")).drop("_words", "word")
    captured = Captured(pages, category_captures(spark, folder), directory_pages(spark, folder), answers, search_sources(spark),
                        pages.select("url", F.col("page_id").alias("ordinal")), docs)
    return research(captured, GOAL, RESULT_URL, TRUSTED, Limits(), queries)


@query("research_report", f"""
    WITH {_CHOSEN} SELECT url, item, domain, score, url IN (SELECT url FROM pages UNION ALL SELECT url FROM category) AS captured
    FROM chosen""")
def research_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Goal to ranked, diverse URLs: expansion, searches, directories, site maps, cap, relevance, lookup."""
    return _researched(spark, folder)[0]


@query("research_context", f"""
    WITH {_CHOSEN}, {MARKDOWN},
    pieces AS (SELECT score, c.url, '[' || coalesce({SQL_TITLE}, 'untitled') || '] ' || c.url || chr(10) || substr(markdown, 1, 200) AS piece
      FROM (SELECT DISTINCT url, score FROM chosen) c JOIN category USING (url) JOIN md ON md.page_id = category.page_id
      WHERE c.url NOT IN (SELECT url FROM pages))
    SELECT substr(string_agg(piece, chr(10) || chr(10) ORDER BY score DESC, url), 1, 6000) AS context FROM pieces""")
def research_context_row(spark: SparkSession, folder: str) -> DataFrame:
    """Context of the captured ones of the chosen pages."""
    report, documents = _researched(spark, folder)
    return research_context(documents, report)
