"""Text helpers as Column expressions (no Python in the data path)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip`` treats as white space.
PY_SPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# Zero-width, soft-hyphen and control characters that hide text.
INVISIBLE = (
    r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}"
    r"\x00-\x08\x0B\x0C\x0E-\x1F]"
)

WORD = r"[\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column] | str) -> Column:
    """Bind a value once inside an expression.

    Column functions are macros: naming an argument three times repeats its
    whole tree three times. Binding keeps plans and generated code small. The
    body is a Python function or, for long bodies, a SQL lambda ``"x -> …"``,
    which reaches the JVM in one call.
    """
    if isinstance(body, str):
        bound = F.call_function("transform", F.array(value), F.expr(body))
    else:
        bound = F.transform(F.array(value), body)
    return F.get(bound, F.lit(0))


def sql_text(value: str) -> str:
    """SQL literal for a string."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def pystrip(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(text, f"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")


def collapse_space(text: Column) -> Column:
    """Fold HTML white space runs to one space."""
    return F.regexp_replace(text, r"[ \t\r\n\f]+", " ")


def null_if_empty(text: Column) -> Column:
    return let(text, "t -> CASE WHEN t != '' THEN t END")


def words(text: Column) -> Column:
    """Lower-cased letter/digit tokens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def listed_words(tokens: str, listed: Sequence[str]) -> Column:
    """The tokens (a column by name) that are on a list.

    Counting several words or groups of words starts from this short array, so
    the full array is read once.
    """
    names = ", ".join(sql_text(w) for w in listed)
    return F.expr(f"filter({tokens}, w -> w IN ({names}))")


def listed_count(hits: str, listed: Sequence[str]) -> Column:
    """How many of the tokens are on a list."""
    return F.size(listed_words(hits, listed))


def space_tokens(text: Column) -> Column:
    """Tokens between white space, in order (Python ``split()``)."""
    return F.regexp_extract_all(text, F.lit(f"[^{PY_SPACE}]+"), F.lit(0))


def has_invisible(text: Column) -> Column:
    """True when any hiding character occurs anywhere in the text."""
    return F.coalesce(F.rlike(text, F.lit(INVISIBLE)), F.lit(False))


def round_to_int(value: Column) -> Column:
    """Half-even rounding to INT, as a SQL ``::INTEGER`` cast does in the store.

    Noise of interpolation far below the unit is removed first, so 167.5 does
    not depend on the order of floating-point operations.
    """
    return F.bround(F.round(value, 6), 0).cast("int")


# Separators of the table below; control characters cannot be part of a reference.
_KEY, _END, _NEXT = "\x02", "\x03", "\x04"
_BUCKETS = 1024


@lru_cache(maxsize=1)
def _reference_table() -> str:
    """All named references as a literal hash table: buckets of ``KEY &name; END value KEY``, by crc32.

    Splitting it is constant, so a look-up reads the two or three names of one bucket. A map literal would add
    thousands of nodes to every expression that decodes text.
    """
    buckets = [""] * _BUCKETS
    for name, value in sorted(html5.items()):
        buckets[crc32(f"&{name}".encode()) % _BUCKETS] += f"{_KEY}&{name}{_END}{value}"
    return _NEXT.join(b + _KEY for b in buckets)


@lru_cache(maxsize=1)
def _bare_names() -> str:
    """Names that HTML decodes without a semicolon, longest first, as an alternation."""
    return "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def decode_sql(x: str, attribute: bool = False) -> str:
    """SQL that decodes character references in the bound name ``x``.

    The longest name that fits counts, with its semicolon or, for the names that allow it, without; a name with a semicolon that is
    not known stays as it is. In an attribute value
    (``attribute``) a name without semicolon in front of ``=``, a letter or a digit is no reference, so addresses with query strings
    stay as they are. Text without references and text whose only reference is ``&amp;`` stay on plain string
    functions; only the rest is cut into pieces.
    """
    key, end = sql_text(_KEY), sql_text(_END)
    table = f"split({sql_text(_reference_table())}, {sql_text(_NEXT)})"

    def value(name: str) -> str:
        """Value of a reference, NULL if there is none of that name."""
        marker = f"concat({key}, {name}, {end})"
        bucket = f"get({table}, CAST(crc32(CAST({name} AS BINARY)) % {_BUCKETS} AS INT))"
        return (f"get(transform(array({bucket}), b -> CASE WHEN contains(b, {marker}) THEN "
                f"substring_index(substring_index(b, {marker}, -1), {key}, 1) END), 0)")

    digits = "trim(LEADING '0' FROM translate(p, '&#xX;', ''))"
    number = (
        f"CAST(CASE WHEN NOT p RLIKE '^&#([0-9]+|[xX][0-9a-fA-F]+);?$' THEN NULL WHEN length({digits}) > 8 THEN '-1' "
        f"WHEN p RLIKE '^&#[0-9]' THEN conv(concat('0', {digits}), 10, 10) "
        f"ELSE conv(concat('0', {digits}), 16, 10) END AS BIGINT)"
    )
    character = (
        "CASE WHEN n > 0 AND n <= 1114111 AND n NOT BETWEEN 55296 AND 57343 "
        "THEN decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') "
        "WHEN n IS NOT NULL THEN '\ufffd' END"
    )
    named = value("p")
    piece = (
        "CASE WHEN NOT startswith(p, '&') THEN p "
        f"WHEN startswith(p, '&#') THEN coalesce(get(transform(array({number}), n -> {character}), 0), p) "
        f"ELSE coalesce({named}, p) END"
    )
    behind = "(?![=0-9a-zA-Z])" if attribute else ""
    return (
        f"CASE WHEN NOT contains({x}, '&') THEN {x} "
        f"WHEN NOT contains(replace({x}, '&amp;', ''), '&') THEN replace({x}, '&amp;', '&') "
        f"ELSE array_join(transform(regexp_extract_all({x}, "
        f"'&(?:[0-9a-zA-Z]+;|#[0-9]+;?|#[xX][0-9a-fA-F]+;?|(?:{_bare_names()}){behind})|[^&]+|&', 0), p -> {piece}), '') END"
    )


def decode_entities(text: Column) -> Column:
    """Decode character references once (``&amp;lt;`` gives ``&lt;``)."""
    return let(text, f"t -> {decode_sql('t')}")
