"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}

# Host suffixes that count as public in the test data, which has no resolver.
TRUSTED = (".example.com", ".example.net", ".example.org")
TRUSTED_RE = r"\.example\.(com|net|org)$"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with equivalent SQL where there is one."""
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            CHECK_SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- SQL fragments shared by the checks -------------------------------------------------


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_decode(x: str) -> str:
    return (f"replace(replace(replace(replace(replace(replace({x}, '&quot;', chr(34)), '&copy;', '©'), "
            f"'&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")


def sql_netloc(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def sql_root(x: str) -> str:
    return f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"


SQL_SOURCE = (
    "regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g')"
)
SQL_TITLE = f"nullif(trim({sql_decode('regexp_extract(html, $$<title>([^<]*)</title>$$, 1)')}), '')"
SQL_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
SQL_NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"


def sql_flat(x: str) -> str:
    """Text of HTML with tags and white space folded."""
    return (f"trim(regexp_replace({sql_decode(f'''regexp_replace({x}, '<[!/a-zA-Z][^>]*>', ' ', 'g')''')}, "
            "'[ \\t\\r\\n\\f]+', ' ', 'g'))")


# Links of the raw page, in order: page_id, src, pos, dst, text.
LINKS = f"""links AS (
  SELECT page_id, src, pos, {sql_root('src')} || href AS dst, text FROM (
    SELECT page_id, url AS src,
      unnest(range(len(h))) AS pos,
      {sql_decode('unnest(h)')} AS href, trim({sql_decode('unnest(t)')}) AS text
    FROM (SELECT page_id, url,
        regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h,
        regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)))"""

# Markdown of the main content, written for the shape of the test pages.
_ESC = "replace(replace({0}, '*', '\\*'), '_', '\\_')"
MARKDOWN = f"""md_part AS (
  SELECT page_id, i,
    regexp_matches(p, '<b>') AS starts_bold, regexp_matches(p, '<br>') AS has_br,
    {_ESC.format(sql_flat("p"))} AS body
  FROM (SELECT page_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (
    SELECT page_id, string_split(regexp_extract({SQL_ARTICLE}, '(?s)</h1>(.*)$', 1), '<p>') AS ps
    FROM pages))),
md_bold AS (
  SELECT *, max(starts_bold) OVER (PARTITION BY page_id ORDER BY i) AS bold FROM md_part),
md_text AS (
  SELECT page_id, string_agg(piece, chr(10) || chr(10) ORDER BY i) AS body FROM (
    SELECT page_id, i, CASE WHEN body = '' THEN '' WHEN bold THEN '**' || body || '**' ELSE body END
      || CASE WHEN has_br THEN '\\' ELSE '' END AS piece FROM md_bold)
  WHERE piece <> '' GROUP BY page_id),
md AS (
  SELECT pages.page_id, pages.url, pages.html,
    '# ' || {_ESC.format(sql_flat(f"regexp_extract({SQL_ARTICLE}, '<h1>([^<]*)</h1>', 1)"))}
      || coalesce(chr(10) || chr(10) || md_text.body, '') AS markdown
  FROM pages LEFT JOIN md_text USING (page_id))"""
