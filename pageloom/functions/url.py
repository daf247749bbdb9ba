"""URL parsing, joining and safety tests as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import let

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"

# Address ranges that must never be followed (first, last).
BLOCKED_IPV4 = (
    ("10.0.0.0", "10.255.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
)

# Banner, advertising and static-file addresses.
NOISE_URL = (
    r"/banners/|[?&]bads=|banner-click|/advertising/"
    r"|\.(gif|png|jpg|webp|css|js)([?#]|$)"
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    """Authority part as written (user info, port and case kept)."""
    return F.regexp_extract(url, NETLOC, 1)


def hostname(url: Column) -> Column:
    """Lower-cased host without user info, port or IPv6 brackets."""
    host = F.regexp_extract(
        url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(F.translate(host, "[]", ""))


def same_host(url: Column, other: Column) -> Column:
    return netloc(url) == netloc(other)


def external_to(url: Column, host: Column) -> Column:
    """True when ``host`` does not occur anywhere in the URL."""
    return ~F.contains(url, host)


def is_noise_url(url: Column) -> Column:
    return F.rlike(url, F.lit(NOISE_URL))


def excludes_self(url: Column, source_host: Column) -> Column:
    """True when the first 12 characters of the source's host are absent."""
    return ~F.contains(url, F.substring(source_host, 1, 12))


def trim_slashes(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


_NUM = r"(?:0[xX][0-9a-fA-F]+|[0-9]+)"


def _ipv4_part(part: Column) -> Column:
    low = F.lower(part)
    return (
        F.when(F.rlike(low, F.lit(r"^0x[0-9a-f]{1,8}$")),
               F.conv(F.substring(low, 3, 8), 16, 10).cast("long"))
        .when(F.rlike(low, F.lit(r"^0[0-7]{0,11}$")), F.conv(low, 8, 10).cast("long"))
        .when(F.rlike(low, F.lit(r"^[1-9][0-9]{0,9}$")), low.try_cast("long"))
    )


def _ipv4_from_parts(values: Column) -> Column:
    """Address from 1 to 4 parsed parts; the last part fills the remaining bytes."""
    size = F.size(values)
    leading = F.slice(values, 1, size - 1)
    high = F.aggregate(leading, F.lit(0).cast("long"),
                       lambda acc, v: F.when(v.between(0, 255), acc * 256 + v))
    room = F.pow(F.lit(256), 5 - size).cast("long")
    last = F.element_at(values, -1)
    return F.when(last < room, high * room + last)


def ipv4_number(host: Column) -> Column:
    """IPv4 literal (dotted, short, hex, octal or plain number) as BIGINT, else NULL."""
    looks_numeric = F.rlike(host, F.lit(rf"^{_NUM}(\.{_NUM}){{0,3}}$"))
    return F.when(looks_numeric,
                  let(F.transform(F.split(host, r"\."), _ipv4_part), _ipv4_from_parts))


def _as_number(dotted: str) -> int:
    a, b, c, d = (int(x) for x in dotted.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def is_blocked_ipv4(number: Column) -> Column:
    """True for an address inside a private, loopback or link-local range."""
    hit = F.lit(False)
    for first, last in BLOCKED_IPV4:
        hit = hit | number.between(_as_number(first), _as_number(last))
    return hit


def has_web_scheme(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https"), F.lit(False))


def has_trusted_suffix(url: Column, suffixes: Sequence[str]) -> Column:
    if not suffixes:
        return F.lit(False)
    ends = "|".join(re.escape(s) for s in suffixes)
    return F.coalesce(F.rlike(hostname(url), F.lit(rf"(?:{ends})\z")), F.lit(False))


def safe_url(url: Column, trusted: Sequence[str] = (), resolved: Column | None = None) -> Column:
    """Web scheme and either a trusted suffix or a public IPv4 address.

    ``resolved`` is the host's address as text from a lookup table; without it
    only literals can be judged and every other host counts as unresolved.
    """
    host = hostname(url)
    address = ipv4_number(host)
    if resolved is not None:
        address = F.coalesce(address, ipv4_number(resolved))
    public = F.coalesce(let(address, lambda n: ~is_blocked_ipv4(n)), F.lit(False))
    return F.coalesce(
        has_web_scheme(url) & (host != "") & (has_trusted_suffix(url, trusted) | public),
        F.lit(False),
    )


_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_ROOT = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?"


# Remove "." and ".." segments from the absolute path ``p``.
_FOLD_DOTS = r"""CASE WHEN NOT p RLIKE r'(^|/)\.\.?(/|$)' THEN p ELSE regexp_replace(concat(
    aggregate(split(p, '/'), CAST(array() AS ARRAY<STRING>), (acc, s) -> CASE
        WHEN s = '.' THEN acc
        WHEN s = '..' THEN if(size(acc) > 1, slice(acc, 1, size(acc) - 1), acc)
        ELSE array_append(acc, s) END, acc -> array_join(acc, '/')),
    if(p RLIKE r'(^|/)\.\.?$', '/', '')), r'^(?!/)', '/') END"""

# Reference parts laid over base parts (struct ``u``).
_MERGE = rf"""u -> CASE
    WHEN u.path = '' THEN concat(u.root, u.base_path, if(u.query != '', u.query, u.base_query), u.fragment)
    ELSE concat(u.root, get(transform(array(CASE
        WHEN startswith(u.path, '/') THEN u.path
        ELSE regexp_replace(concat(
            coalesce(nullif(regexp_replace(u.base_path, r'[^/]*$', ''), ''), '/'), u.path), r'/{{2,}}', '/')
        END), p -> {_FOLD_DOTS}), 0), u.query, u.fragment) END"""


def url_join(base: Column, ref: Column) -> Column:
    """Resolve a reference against a base URL (RFC 3986)."""
    def part(col: Column, i: int) -> Column:
        return F.regexp_extract(col, _SPLIT, i)

    parts = F.struct(
        F.regexp_extract(base, _ROOT, 0).alias("root"),
        part(base, 3).alias("base_path"), part(base, 4).alias("base_query"),
        part(ref, 3).alias("path"), part(ref, 4).alias("query"), part(ref, 5).alias("fragment"),
    )
    ref_scheme = F.regexp_extract(ref, SCHEME, 0)
    same_scheme = F.lower(ref_scheme) == F.lower(F.regexp_extract(base, SCHEME, 0))
    lowered = F.concat(F.lower(ref_scheme), F.substr(ref, F.length(ref_scheme) + 1))
    return (
        F.when(F.coalesce(base, F.lit("")) == "", ref)
        .when(ref == "", base)
        .when(F.rlike(ref, F.lit(r"^/(?!/)[^./?#]*$")),
              F.concat(F.regexp_extract(base, _ROOT, 0), ref))
        .when(ref_scheme != "", F.when(same_scheme, lowered).otherwise(ref))
        .when(F.startswith(ref, F.lit("//")),
              F.concat(F.regexp_extract(base, SCHEME, 0), ref))
        .otherwise(let(parts, _MERGE))
    )


def search_url(base: Column, param: Column, query: Column) -> Column:
    """Search address with one form-encoded parameter."""
    return F.concat(base, F.lit("?"), F.url_encode(param), F.lit("="), F.url_encode(query))


def plus_search_url(base: Column, query: Column) -> Column:
    """Search address in which only spaces are encoded (as ``+``)."""
    return F.concat(base, F.lit("?q="), F.replace(query, F.lit(" "), F.lit("+")))


def item_text(anchor: Column, url: Column) -> Column:
    """``anchor | url``, or the bare URL when there is no anchor text."""
    return F.when(F.coalesce(anchor, F.lit("")) != "",
                  F.concat(anchor, F.lit(" | "), url)).otherwise(url)


def item_url(item: Column) -> Column:
    """URL after the last ``" | "``; the whole item when there is none."""
    return F.substring_index(item, " | ", -1)
