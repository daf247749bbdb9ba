"""Page metadata from the captured HTML, computed inside each row.

A page has few ``meta`` tags, so they stay an array in the row: no explode and
no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.html import (
    all_tags, attribute_sql, attributes_sql, html_lang, title_text,
)
from pageloom.functions.text import let, pystrip, sql_text
from pageloom.functions.url import url_join

# Meta names and the fields they fill; aliases share a field.
FIELD_NAMES = {
    "description": ("description",),
    "keywords": ("keywords",),
    "robots": ("robots",),
    "og_title": ("og:title",),
    "og_description": ("og:description",),
    "og_url": ("og:url",),
    "og_image": ("og:image",),
    "og_site_name": ("og:site_name",),
    "og_locale": ("og:locale",),
    "og_video": ("og:video",),
    "og_audio": ("og:audio",),
    "published_time": ("article:published_time",),
    "modified_time": ("article:modified_time",),
    "article_tag": ("article:tag",),
    "article_section": ("article:section",),
    "dc_date": ("dc.date", "dcterms.created"),
    "dc_description": ("dc.description",),
    "dc_keywords": ("dcterms.keywords",),
    "dc_type": ("dc.type", "dcterms.type"),
}
TWITTER_TITLE, TWITTER_DESCRIPTION = "twitter:title", "twitter:description"

METADATA_FIELDS = (
    "title", "description", "language", "keywords", "robots", "favicon",
    "og_title", "og_description", "og_url", "og_image", "og_site_name",
    "og_locale", "og_video", "og_audio", "published_time", "modified_time",
    "article_tag", "article_section", "dc_date", "dc_description",
    "dc_keywords", "dc_type", "url", "source_url", "status_code",
    "content_type", "extra",
)


def meta_entries(html: Column) -> Column:
    """Named, non-empty meta tags as ``array<struct<name, content>>``, in order."""
    def first(name: str) -> str:
        return f"nullif({attribute_sql('m', name)}, '')"

    parsed = let(all_tags(html, "meta"), f"tags -> transform(tags, t -> {attributes_sql('t')})")
    entries = let(
        parsed,
        "ms -> transform(ms, m -> named_struct('name', lower(coalesce("
        f"{first('name')}, {first('property')}, {first('itemprop')})), "
        f"'content', {attribute_sql('m', 'content')}))")
    stripped = F.transform(entries, lambda e: F.struct(e["name"].alias("name"),
                                                       pystrip(e["content"]).alias("content")))
    return F.filter(stripped, lambda e: (e["content"] != "") & (e["name"] != ""))


def _names(names: Sequence[str]) -> str:
    return ", ".join(sql_text(n) for n in names)


def last_content(names: Sequence[str], entries: str = "_entries") -> Column:
    """Content of the last entry with one of the names, NULL when there is none."""
    return F.expr(f"try_element_at(filter({entries}, e -> e.name IN ({_names(names)})), -1).content")


def extra_map(entries: str = "_entries") -> Column:
    """All other names with their values in document order."""
    known = [n for names in FIELD_NAMES.values() for n in names]
    known += [TWITTER_TITLE, TWITTER_DESCRIPTION]
    other = F.expr(f"filter({entries}, e -> e.name NOT IN ({_names(known)}))")
    return let(
        other,
        "o -> map_from_arrays(array_distinct(transform(o, e -> e.name)), "
        "transform(array_distinct(transform(o, e -> e.name)), "
        "n -> transform(filter(o, e -> e.name = n), e -> e.content)))")


def favicon(html: Column, page_url: Column) -> Column:
    """Address of the first ``link`` whose relation mentions an icon."""
    parsed = let(all_tags(html, "link"), f"tags -> transform(tags, t -> {attributes_sql('t')})")
    href = let(parsed, "ls -> " + attribute_sql(
        f"get(filter(ls, l -> contains({attribute_sql('l', 'rel')}, 'icon')), 0)", "href"))
    return let(href, lambda h: F.when(h != "", url_join(page_url, h)))


def metadata_struct(html: Column, page_url: Column, entries: str = "_entries",
                    status: Column | None = None) -> Column:
    """Metadata record; ``entries`` names a column holding :func:`meta_entries`."""
    twitter_title = last_content((TWITTER_TITLE,), entries)
    twitter_description = last_content((TWITTER_DESCRIPTION,), entries)
    values = {name: last_content(names, entries) for name, names in FIELD_NAMES.items()}
    values["title"] = F.coalesce(title_text(html), twitter_title, values["og_title"])
    values["description"] = F.coalesce(values["description"], twitter_description)
    values["language"] = html_lang(html)
    values["favicon"] = favicon(html, page_url)
    values["url"] = page_url
    values["source_url"] = page_url
    values["status_code"] = F.coalesce(status, F.lit(0)) if status is not None else F.lit(0)
    values["content_type"] = F.lit(None).cast("string")
    values["extra"] = extra_map(entries)
    return F.struct(*[values[name].alias(name) for name in METADATA_FIELDS])
