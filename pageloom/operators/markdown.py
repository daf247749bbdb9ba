"""Kept tokens to Markdown: one fragment per token, then whole-text clean-up.

Fragments use noncharacters (U+FDD0…), which never occur in interchanged text,
for breaks and for the ends of inline spans. After the fragments of a page are
joined, a few linear regular expressions turn them into Markdown. All break
patterns use character classes only, never repeated groups, so very long runs
cannot exhaust the matcher's stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import decode_sql, let, pystrip

# Noncharacters used between token and text form.
PARA = "\uFDD0"
LINE = "\uFDD1"
BOLD = "\uFDD2"
BOLD_END = "\uFDD3"
EM = "\uFDD4"
EM_END = "\uFDD5"
BULLET_END = "\uFDD6"
INDENT = "\uFDD7"
QUOTE = "\uFDD8"
NEWLINE = "\uFDD9"
SPACE = "\uFDDA"
LINK = "\uFDDB"
LINK_MID = "\uFDDC"
LINK_END = "\uFDDD"
CODE = "\uFDDE"
CODE_END = "\uFDDF"
_MARK_CLASS = "[\uFDD0-\uFDEF]"

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = ("p", "div", "table", "blockquote", "hr", *HEADINGS)


def _tags(*tags: str) -> str:
    return ", ".join(f"'{t}'" for t in tags)


def _depth(key: str, *tags: str) -> str:
    """Running count of kept elements of these names that are open here."""
    return (
        f"sum(CASE WHEN keep AND kind = 'open' AND tag IN ({_tags(*tags)}) THEN 1 "
        f"WHEN keep AND kind = 'close' AND ends_open AND tag IN ({_tags(*tags)}) THEN -1 "
        f"ELSE 0 END) OVER ({_running(key)})"
    )


def _running(*keys: str) -> str:
    return (f"PARTITION BY {', '.join(keys)} ORDER BY pos "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")


def _opened(key: str, *tags: str) -> str:
    return (f"sum(CASE WHEN keep AND kind = 'open' AND tag IN ({_tags(*tags)}) "
            f"THEN 1 ELSE 0 END) OVER ({_running(key)})")


def add_context(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Nesting depths, list positions and table counters for each token."""
    running, in_list = _running(key), _running(key, "uls + ols")
    start = "keep AND kind = 'open' AND tag"
    return tokens.selectExpr(
        "*",
        f"{_depth(key, 'b', 'strong')} > 0 AS in_bold",
        f"{_depth(key, 'i', 'em')} > 0 AS in_em",
        f"{_depth(key, 'code')} > 0 AS in_code",
        f"{_depth(key, 'pre')} > 0 AS in_pre",
        f"{_depth(key, *HEADINGS)} > 0 AS in_heading",
        f"{_depth(key, 'blockquote')} AS quotes",
        f"{_depth(key, 'ul')} AS uls",
        f"{_depth(key, 'ol')} AS ols",
        f"{_depth(key, 'td', 'th')} > 0 AS in_cell",
        f"{_opened(key, 'tr')} AS _rows",
        f"{_opened(key, 'td', 'th')} AS _cells",
    ).selectExpr(
        "*",
        f"_rows - coalesce(last(CASE WHEN {start} = 'table' THEN _rows END, true) "
        f"OVER ({running}), 0) AS row_no",
        f"_cells - coalesce(last(CASE WHEN {start} = 'tr' THEN _cells END, true) "
        f"OVER ({running}), 0) AS row_cells",
        # Items are numbered inside the latest list that opened at the same depth.
        f"sum(CASE WHEN {start} = 'li' THEN 1 ELSE 0 END) OVER ({in_list}) AS _items",
    ).selectExpr(
        "*",
        f"_items - coalesce(last(CASE WHEN {start} IN ('ul', 'ol') THEN _items END, true) "
        f"OVER ({in_list}), 0) AS item_no",
        f"last(CASE WHEN {start} IN ('ul', 'ol') THEN tag END, true) OVER ({in_list}) AS list_tag",
    )


def _text_sql() -> str:
    """Text of a text token: decoded, then folded, escaped and marked.

    Preformatted text keeps its white space; code keeps its characters.
    """
    plain = f"regexp_replace(t, '{_MARK_CLASS}', '\ufffd')"
    pre = f"translate(replace({plain}, '\r\n', '\n'), '\n ', '{NEWLINE}{SPACE}')"
    folded = rf"regexp_replace({plain}, r'[ \t\r\n\f]+', ' ')"
    escaped = rf"regexp_replace(regexp_replace({plain}, r'[ \t\r\n\f]+', ' '), '([*_])', r'\\$1')"
    bold = "in_bold AND NOT in_heading"
    return (
        f"CASE WHEN in_pre THEN {pre} ELSE concat("
        f"if({bold}, '{BOLD}', ''), if(in_em, '{EM}', ''), "
        f"if(in_code, concat('{CODE}', {folded}, '{CODE_END}'), {escaped}), "
        f"if(in_em, '{EM_END}', ''), if({bold}, '{BOLD_END}', '')) END"
    )


def fragment() -> Column:
    """Markdown fragment of the current token."""
    quote = f"repeat('{QUOTE}', CAST(quotes AS INT))"
    para = f"if(in_cell, ' ', concat('{PARA}', {quote}))"
    indent = "greatest(uls * 2 + ols * 3 - if(list_tag = 'ol', 3, 2), 0)"
    outer_list = "uls + ols + if(kind = 'close', 1, 0) = 1"
    text = f"get(transform(array(tok), s -> {decode_sql('s')}), 0)"
    return F.expr(f"""CASE
        WHEN NOT keep THEN ''
        WHEN kind = 'text' THEN get(transform(array({text}), t -> {_text_sql()}), 0)
        WHEN kind = 'open' AND tag IN ({_tags(*HEADINGS)})
            THEN concat({para}, repeat('#', CAST(substr(tag, 2, 1) AS INT)), ' {BULLET_END}')
        WHEN kind IN ('open', 'close') AND tag = 'a' THEN concat(
            coalesce(concat('{LINK_MID}', opened_href, '{LINK_END}'), ''),
            if(href IS NOT NULL AND match_pos IS NOT NULL, '{LINK}', ''))
        WHEN tag = 'br' THEN if(in_cell OR in_heading, ' ', concat('\\\\{NEWLINE}', {quote}))
        WHEN tag = 'img' AND src IS NOT NULL THEN concat('![', coalesce(alt, ''), '](', src, ')')
        WHEN tag = 'hr' THEN concat({para}, '---', {para})
        WHEN kind = 'open' AND tag = 'pre' THEN concat({para}, '```{NEWLINE}')
        WHEN kind = 'close' AND tag = 'pre' THEN concat('{NEWLINE}```', {para})
        WHEN kind = 'open' AND tag = 'li' THEN concat(
            '{LINE}', {quote}, repeat('{INDENT}', CAST({indent} AS INT)),
            if(list_tag = 'ol', concat(CAST(item_no AS STRING), '. '), '- '), '{BULLET_END}')
        WHEN tag IN ('ul', 'ol') THEN if({outer_list}, {para}, '')
        WHEN kind = 'open' AND tag = 'tr' THEN concat('{LINE}', {quote}, '|')
        WHEN kind = 'close' AND tag = 'tr' THEN if(row_no = 1, concat(
            '{LINE}', {quote}, '|', repeat(' --- |', CAST(row_cells AS INT))), '')
        WHEN kind = 'open' AND tag IN ('td', 'th') THEN '{SPACE}'
        WHEN kind = 'close' AND tag IN ('td', 'th') THEN '{SPACE}|'
        WHEN tag IN ({_tags(*BLOCKS)}) THEN {para}
        ELSE '' END""")


def _spans(md: Column, start: str, end: str, mark: str) -> Column:
    """Close up one kind of inline span and write its Markdown marks."""
    md = F.regexp_replace(md, rf"{end}(\\{NEWLINE})?{start}", "$1")
    md = F.regexp_replace(md, rf"{start}([ {SPACE}]*){end}", "$1")
    md = F.regexp_replace(md, rf"{start}( +)", rf"$1{start}")
    md = F.regexp_replace(md, rf"( +){end}", rf"{end}$1")
    return F.replace(F.replace(md, F.lit(start), F.lit(mark)), F.lit(end), F.lit(mark))


def escape_bracket_newlines(md: Column) -> Column:
    """Inside ``[...]`` a newline becomes a backslash and a newline."""
    pieces = F.regexp_extract_all(md, F.lit(r"\[[^\]]*\]|[^\[]+|\["), F.lit(0))
    fixed = F.transform(
        pieces,
        lambda p: F.when(F.rlike(p, F.lit(r"^\[[^\]]*\]$")), F.replace(p, F.lit("\n"), F.lit("\\\n")))
        .otherwise(p))
    return F.when(F.rlike(md, F.lit(r"\[[^\]]*\n")), F.array_join(fixed, "")).otherwise(md)


def remove_skip_links(md: Column) -> Column:
    return F.regexp_replace(md, r"(?i)\[skip to (?:main )?content\]\(#[^)]*\)", "")


def collapse_blank_lines(md: Column) -> Column:
    return pystrip(F.regexp_replace(md, r"\n{3,}", "\n\n"))


def remove_data_images(md: Column) -> Column:
    return F.regexp_replace(md, r"!\[[^\]]*\]\(data:[^)]+\)", "")


def post_process(md: Column) -> Column:
    """Whole-text rules after conversion, in their fixed order."""
    md = let(md, escape_bracket_newlines)
    return remove_data_images(collapse_blank_lines(remove_skip_links(md)))


def finish(joined: Column) -> Column:
    """Joined fragments of a page to Markdown text."""
    md = joined
    for start, end, mark in ((CODE, CODE_END, "`"), (EM, EM_END, "*"), (BOLD, BOLD_END, "**")):
        md = _spans(md, start, end, mark)
    # Links: no text, no link; text equal to the address becomes an autolink.
    md = F.regexp_replace(md, rf"{LINK}[ {PARA}{LINE}]*{LINK_MID}[^{LINK_END}]*{LINK_END}", "")
    md = F.regexp_replace(md, rf"{LINK}([^{LINK}{LINK_MID}]+){LINK_MID}\1{LINK_END}", "<$1>")
    md = F.regexp_replace(md, rf"{LINK}([ ]*)", "$1[")
    md = F.replace(F.replace(md, F.lit(LINK_MID), F.lit("](")), F.lit(LINK_END), F.lit(")"))
    # Breaks: nothing directly after a bullet, one break per run, last prefix wins.
    run = f"{PARA}{LINE}{QUOTE}{INDENT} "
    md = F.regexp_replace(md, rf"{BULLET_END}[{PARA}{QUOTE} ]*", "")
    md = F.regexp_replace(
        md, rf"[{LINE}{QUOTE}{INDENT} ]*{PARA}(?:[{run}]*[{PARA}{LINE}])?", PARA)
    md = F.regexp_replace(
        md, rf"[ ]*{LINE}(?:[{LINE}{QUOTE}{INDENT} ]*{LINE})?", LINE)
    md = F.regexp_replace(md, rf"([{PARA}{LINE}{QUOTE}{INDENT}]) +", "$1")
    md = F.regexp_replace(md, rf"{SPACE} +", SPACE)
    md = F.regexp_replace(md, rf" +{SPACE}", SPACE)
    md = F.replace(F.replace(md, F.lit(PARA), F.lit("\n\n")), F.lit(QUOTE), F.lit("> "))
    md = F.translate(md, LINE + INDENT + NEWLINE + SPACE, "\n \n ")
    return post_process(md)
