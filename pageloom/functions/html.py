"""HTML source helpers: raw-text removal, tokens and attributes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import (
    decode_entities, decode_sql, let, null_if_empty, pystrip, sql_text,
)

RAW_TEXT = (
    r"(?is)<!--.*?(?:-->|$)"
    r"|<script\b.*?(?:</script\s*>|$)"
    r"|<style\b.*?(?:</style\s*>|$)"
)

# A quote opens a value only after "="; possessive parts keep matching linear.
TAG = r"""</?[a-zA-Z](?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>"""
TOKEN = TAG + r"|<[!?/][^>]*+>|[^<]++|<"

# Elements without an end tag.
VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr",
)


def without_raw_text(html: Column) -> Column:
    """Drop comments and script/style elements before tokenising."""
    return F.regexp_replace(html, RAW_TEXT, "")


def split_tokens(html: Column) -> Column:
    """Tags, declarations and text runs in document order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


# Elements that style text and stay in force when a block ends before them.
STYLING = ("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u")

# Start tags, the open elements that each of them ends, and what shields elements outside it.
_BLOCKS = tuple(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split())
_SHIELD = ("table", "td", "th", "caption", "button")
_CELLS = ("td", "th")
_ROWS = (*_CELLS, "tr", "thead", "tbody", "tfoot")
ENDED_BY = (
    (("li",), ("li",), ("ul", "ol", "menu", *_SHIELD)),
    (("dt", "dd"), ("dt", "dd"), ("dl", *_SHIELD)),
    (("option",), ("option",), ("select", "datalist")),
    (("optgroup",), ("option", "optgroup"), ("select",)),
    (_CELLS, _CELLS, ("tr", "table")),
    (("tr",), (*_CELLS, "tr"), ("table",)),
    (("tbody", "tfoot", "thead"), _ROWS, ("table",)),
    (("body",), ("head",), ()),
    (_BLOCKS, ("p",), _SHIELD),
)
IN_TABLE = ("table", *_ROWS, "caption")
IN_HEAD = ("head", "title", "meta", "link", "base", "noscript", "template", "script", "style")
_STEPS = 256


def _names(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def closed_sql(html: str) -> str:
    """SQL: HTML with the end tags that one may leave out, and without those that end nothing.

    An element ends at its own end tag, at a start tag that it cannot contain, or with its parent,
    whichever comes first; styling elements are passed on as they are. The tags are gone through once with the
    open elements as the state; only the places where end tags are missing or superfluous are noted, in blocks of
    a few hundred, and the text between two of them is taken over as a whole. So the work grows with the page and not with
    its square.
    """
    # r: open elements, innermost first; the value is how many of them end before the tag.
    cut = "CASE WHEN get(r, 0) = 'head' AND x.n NOT IN (" + _names(IN_HEAD) + ") THEN 1"
    for starts, ended, shields in ENDED_BY:
        shield = f"coalesce(nullif(array_position(transform(r, m -> m IN ({_names(shields)})), true), 0) - 1, size(r))"
        within = f"slice(r, 1, CAST({shield} AS INT))" if shields else "r"
        one_open = " OR ".join(f"array_contains(r, '{n}')" for n in ended)
        cut += (f" WHEN x.n IN ({_names(starts)}) AND ({one_open}) THEN coalesce(array_max(transform({within}, "
                f"(m, i) -> if(m IN ({_names(ended)}), i + 1, 0))), 0)")
    cut += " ELSE 0 END"
    own = "array_position(r, x.n)"
    guard = "array_position(transform(r, m -> m IN ('td', 'th', 'table')), true)"
    found = f"if(x.n IN ({_names(IN_TABLE)}) OR {guard} = 0 OR {own} <= {guard}, {own}, 0)"
    ends = "array_join(transform({0}, m -> concat('</', m, '>')), '')"

    def step(stack: str, ended: str, drop: str) -> str:
        note = f"named_struct('i', x.i, 'ends', {ended}, 'drop', {drop})"
        return (f"named_struct('open', {stack}, 'now', if(size(s.now) < {_STEPS}, array_append(s.now, {note}), array({note})), "
                f"'done', if(size(s.now) < {_STEPS}, s.done, array_append(s.done, s.now)))")

    def plain(stack: str) -> str:
        return f"named_struct('open', {stack}, 'now', s.now, 'done', s.done)"

    rest = "slice(r, CAST(k AS INT) + 1, size(r))"
    opened = f"if(x.n IN ({_names(VOID)}), {{0}}, array_prepend({{0}}, x.n))"
    close = (f"CASE WHEN k = 1 THEN {plain(rest)} WHEN k = 0 THEN {step('r', repr(''), 'true')} "
             f"ELSE {step(rest, ends.format('slice(r, 1, CAST(k AS INT) - 1)'), 'false')} END")
    start = (f"if(k = 0, {plain(opened.format('r'))}, "
             f"{step(opened.format(rest), ends.format('slice(r, 1, CAST(k AS INT))'), 'false')})")
    bound = "get(transform(array(s.open), r -> get(transform(array({0}), k -> {1}), 0)), 0)"
    merge = (f"CASE WHEN x.e THEN {bound.format(f'CAST({found} AS BIGINT)', close)} "
             f"ELSE {bound.format(f'CAST({cut} AS BIGINT)', start)} END")
    tags = (r"filter(transform(tok, (t, i) -> if(startswith(t, '<'), named_struct('i', i, 'e', startswith(t, '</'), "
            r"'n', lower(regexp_extract(t, r'^</?([a-zA-Z][^\s/>]*)', 1))), NULL)), "
            f"x -> x.n != '' AND x.n NOT IN ({_names(STYLING)}))")
    notes = "array<struct<i:int,ends:string,drop:boolean>>"
    zero = (f"named_struct('open', CAST(array() AS array<string>), 'now', CAST(array() AS {notes}), "
            f"'done', CAST(array() AS array<{notes}>))")
    walked = f"aggregate({tags}, {zero}, (s, x) -> {merge}, s -> named_struct('open', s.open, 'at', concat(flatten(s.done), s.now)))"
    # Tokens from behind one noted place up to the next are taken as they are.
    pieces = ("transform(w.at, (a, j) -> concat(array_join(slice(tok, if(j = 0, 0, get(w.at, j - 1).i + 1) + 1, "
              "a.i - if(j = 0, 0, get(w.at, j - 1).i + 1)), ''), a.ends, if(a.drop, '', get(tok, a.i))))")
    tail = "array_join(slice(tok, coalesce(get(w.at, size(w.at) - 1).i + 1, 0) + 1, size(tok)), '')"
    built = f"concat(array_join({pieces}, ''), {tail}, {ends.format('w.open')})"
    return (f"get(transform(array(regexp_extract_all({html}, {sql_text(TOKEN)}, 0)), "
            f"tok -> get(transform(array({walked}), w -> {built}), 0)), 0)")


def close_elements(html: Column) -> Column:
    """HTML whose elements all have their end tags, see :func:`closed_sql`."""
    return let(html, f"h -> {closed_sql('h')}")


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))


def attributes_sql(token: str) -> str:
    """SQL for ``array<struct<name, value>>`` of a start tag, values decoded.

    Attributes are matched one after another, so text inside a quoted value is
    never taken for an attribute. Attributes without a value are left out.
    """
    match = (r"r'[^\s=/>\x22\x27<]+\s*=\s*"
             r"(?:\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s>\x22\x27][^\s>]*)'")
    value = (r"regexp_replace(regexp_extract(a, r'(?s)^[^=]*=\s*(.*)$', 1), "
             r"r'^[\x22\x27]|[\x22\x27]$', '')")
    return (
        f"transform(regexp_extract_all({token}, {match}, 0), a -> named_struct("
        r"'name', lower(regexp_extract(a, r'^([^\s=]+)', 1)), "
        f"'value', get(transform(array({value}), v -> {decode_sql('v', attribute=True)}), 0)))"
    )


def attribute_sql(attributes: str, name: str) -> str:
    """SQL for the first value of an attribute in :func:`attributes_sql`; NULL when absent."""
    return f"get(filter({attributes}, a -> a.name = '{name}'), 0).value"


def attr(token: Column, name: str) -> Column:
    """First value of an attribute of a start tag; NULL when absent."""
    return let(token, f"t -> {attribute_sql(attributes_sql('t'), name)}")


def first_tag(html: Column, name: str) -> Column:
    """First start tag of the given name, or the empty string."""
    return F.regexp_extract(
        html, rf"""(?is)<{name}(?=[\s/>])(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>""", 0)


def all_tags(html: Column, name: str) -> Column:
    """Every start tag of the given name, in order."""
    pattern = rf"""(?is)<{name}(?=[\s/>])(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>"""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def title_text(html: Column) -> Column:
    """Text of the first title element, NULL when empty."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return null_if_empty(pystrip(decode_entities(raw)))


def html_lang(html: Column) -> Column:
    return null_if_empty(attr(first_tag(html, "html"), "lang"))


def inner_text(fragment: Column, between: str = " ") -> Column:
    """Text nodes of a fragment, each stripped, joined by ``between``."""
    nodes = F.split(fragment, r"<[!?/a-zA-Z][^>]*>")
    texts = F.transform(nodes, lambda n: pystrip(decode_entities(n)))
    return F.array_join(F.filter(texts, lambda t: t != ""), between)
