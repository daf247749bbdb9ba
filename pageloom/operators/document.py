"""Captured pages to documents: cleaned HTML, Markdown, links, images, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.html import attr, attribute_sql, first_tag
from pageloom.functions.text import (
    collapse_space, decode_entities, let, null_if_empty, pystrip,
)
from pageloom.functions.url import url_join
from pageloom.operators.markdown import add_context, finish, fragment
from pageloom.operators.metadata import meta_entries, metadata_struct
from pageloom.operators.tokens import (
    MODE_BITS, Cleaning, by_page, cleaned_tokens, start_attr, tokens_of_all_modes,
)

SPARSE_CHARS = 200

# Tags that may stay in cleaned HTML.
ALLOWED_TAGS = (
    "p", "br", "b", "i", "em", "strong", "a", "ul", "ol", "li",
    "h1", "h2", "h3", "h4", "h5", "h6",
    "table", "thead", "tbody", "tr", "th", "td",
    "blockquote", "code", "pre", "hr", "div", "span",
)

# Address schemes that may stay in links; relative ones always may.
LINK_SCHEMES = (
    "bitcoin", "ftp", "ftps", "geo", "http", "https", "im", "irc", "ircs",
    "magnet", "mailto", "mms", "mx", "news", "nntp", "openpgp4fpr", "sip",
    "sms", "smsto", "ssh", "tel", "url", "webcal", "wtai", "xmpp",
)


def base_url(html: Column, page_url: Column) -> Column:
    """First ``<base href>`` joined with the page URL, else the page URL."""
    href = attr(first_tag(html, "base"), "href")
    return F.when(href.isNull(), page_url).otherwise(url_join(page_url, href))


def _allowed(address: Column, extra: tuple[str, ...] = ()) -> Column:
    """The address, or NULL when its scheme is not allowed."""
    compact = F.regexp_replace(address, r"[\x00-\x20]+", "")
    scheme = F.lower(F.regexp_extract(compact, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when((scheme == "") | scheme.isin(*LINK_SCHEMES, *extra), address)


def last_srcset_url(srcset: Column) -> Column:
    """URL of the last candidate of a ``srcset``."""
    parts = F.filter(F.transform(F.split(srcset, ","), pystrip), lambda p: p != "")
    return null_if_empty(F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"^(\S+)", 1))


def _token_columns(images: bool) -> dict[str, Column]:
    """Link and image addresses of the current token, absolute."""
    raw = F.when(F.expr("kind = 'open' AND tag = 'a'"),
                 let(start_attr("href"), lambda h: _allowed(h)))
    if images:
        src = F.coalesce(let(start_attr("srcset"), last_srcset_url), start_attr("src"))
        raw = raw.when(F.expr("kind = 'void' AND tag = 'img'"),
                       let(src, lambda s: _allowed(F.when(s != "", s), ("data",))))
    address = let(raw, lambda a: F.when(a.isNotNull(), url_join(F.col("_base"), a)))
    return {"address": address, "alt": F.expr(f"CASE WHEN tag = 'img' THEN {attribute_sql('_attrs', 'alt')} END")}


def _quoted(column: str) -> str:
    """SQL: text escaped for a double-quoted attribute."""
    out = column
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, '{plain}', '{escaped}')"
    return out


def html_fragment() -> Column:
    """Cleaned HTML of the current token: allowed tags with allowed attributes."""
    tags = ", ".join(f"'{t}'" for t in ALLOWED_TAGS)
    return F.expr(f"""CASE
        WHEN NOT keep THEN ''
        WHEN kind = 'text' THEN if(tok = '<', '&lt;', tok)
        WHEN NOT coalesce(tag IN ({tags}) OR tag = 'img' AND src IS NOT NULL, false) THEN ''
        WHEN kind = 'close' THEN concat('</', tag, '>')
        WHEN tag = 'a' AND href IS NOT NULL THEN concat('<a href="', {_quoted('href')}, '">')
        WHEN tag = 'img' THEN concat('<img src="', {_quoted('src')}, '"',
            coalesce(concat(' alt="', {_quoted('alt')}, '"'), ''), '>')
        ELSE concat('<', tag, '>') END""")


def _ordered(condition: Column, value: Column) -> Column:
    """Values of the page's tokens in document order."""
    rows = F.collect_list(F.when(condition, F.struct(F.col("pos"), value.alias("value"))))
    return F.transform(F.array_sort(rows), lambda r: r["value"])


def extract_documents(pages: DataFrame, mode: str = "declared", only_main: bool = True,
                      key: str = "page_id", status: str | None = None) -> DataFrame:
    """One document per captured page ``(key, url, html)``.

    Columns that are not selected later are pruned, together with the work
    behind them: pages shuffle once, and metadata is computed before the split
    into tokens and travels on one token row per page.
    """
    cleaning = Cleaning(mode, only_main)
    staged = by_page(pages, key).withColumn("_entries", meta_entries(F.col("_source")))
    carry = {
        "url": F.col("url"),
        "raw_html": F.col("html"),
        "metadata": metadata_struct(F.col("_source"), F.col("url"), "_entries",
                                    F.col(status) if status else None),
    }
    declared = mode == "declared"
    base = base_url(F.col("_source"), F.col("url")) if declared else F.col("url")
    tokens = cleaned_tokens(staged, cleaning, key, carry=carry,
                            repeat={"_base": base}, columns=_token_columns(images=declared))
    tokens = tokens.filter("keep OR pos = 0").selectExpr(
        "*", "CASE WHEN tag = 'a' THEN address END AS href",
        "CASE WHEN tag = 'img' THEN address END AS src", "opened_address AS opened_href")
    tokens = add_context(tokens, key).withColumns({
        "_md": fragment(), "_html": html_fragment(),
    })
    kept = F.col("keep")
    grouped = tokens.groupBy(key).agg(
        F.first("url", ignorenulls=True).alias("url"),
        F.first("raw_html", ignorenulls=True).alias("raw_html"),
        F.first("metadata", ignorenulls=True).alias("metadata"),
        _ordered(F.col("_md") != "", F.col("_md")).alias("_md"),
        _ordered(F.col("_html") != "", F.col("_html")).alias("_html"),
        _ordered(kept & F.col("href").isNotNull(), F.col("href")).alias("links"),
        _ordered(kept & F.col("src").isNotNull(), F.col("src")).alias("_images"),
    )
    return grouped.select(
        key,
        "url",
        finish(F.array_join("_md", "")).alias("markdown"),
        F.array_join("_html", "").alias("html"),
        "raw_html",
        "links",
        F.filter("_images", lambda i: ~F.startswith(i, F.lit("data:"))).alias("images"),
        "metadata",
    )


def visible_text(pages: DataFrame, mode: str = "declared", only_main: bool = True,
                 key: str = "page_id") -> DataFrame:
    """Kept text of each page with white space folded: ``(key, visible_text)``."""
    tokens = cleaned_tokens(by_page(pages, key), Cleaning(mode, only_main), key)
    text = decode_entities(F.col("tok"))
    pieces = _ordered(F.col("keep") & (F.col("kind") == "text"), F.col("_text"))
    return (
        tokens.filter(F.col("keep") | (F.col("pos") == 0))
        .withColumn("_text", text)
        .groupBy(key)
        .agg(pieces.alias("_pieces"))
        .select(key, F.trim(collapse_space(F.array_join("_pieces", " "))).alias("visible_text"))
    )


def visible_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Visible text of each page under every cleaning: ``(key, declared, full, sanitize_first)``.

    As :func:`visible_text` for each of them, from one token relation.
    """
    tokens = tokens_of_all_modes(by_page(pages, key), key)
    piece = F.struct("pos", "modes", decode_entities(F.col("tok")).alias("text"))
    rows = F.array_sort(F.collect_list(F.when((F.col("kind") == "text") & (F.col("modes") > 0), piece)))
    grouped = tokens.filter("modes > 0 OR pos = 0").groupBy(key).agg(rows.alias("_rows"))

    def text(bit: int) -> Column:
        kept = F.transform(F.filter("_rows", lambda r: r["modes"].bitwiseAND(F.lit(bit)) > 0), lambda r: r["text"])
        return F.trim(collapse_space(F.array_join(kept, " ")))

    return grouped.select(key, *[text(bit).alias(name) for name, bit in MODE_BITS.items()])


def is_thin(markdown: Column, limit: int = SPARSE_CHARS) -> Column:
    """Less than ``limit`` characters of stripped Markdown."""
    return F.length(pystrip(F.coalesce(markdown, F.lit("")))) < limit


def needs_render(markdown: Column, force: bool = False, limit: int = SPARSE_CHARS) -> Column:
    """Flag a page for recapture with a renderer: sparse, or forced."""
    return F.lit(force) | is_thin(markdown, limit)


def content_type(extra: Column, declared: Column) -> Column:
    """``content-type`` meta value, else the declared type, else HTML."""
    from_meta = F.get(F.try_element_at(extra, F.lit("content-type")), F.lit(0))
    return F.coalesce(null_if_empty(from_meta), null_if_empty(declared), F.lit("text/html"))


def compression_ratio(markdown: Column, raw_html: Column) -> Column:
    """Markdown characters per captured character."""
    return F.length(F.coalesce(markdown, F.lit(""))) / F.greatest(
        F.length(F.coalesce(raw_html, F.lit(""))), F.lit(1))
