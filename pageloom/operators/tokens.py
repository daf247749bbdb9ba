"""Pages as a token relation: one row per tag or text run, with matched blocks.

Pages are shuffled once by their key, before they are cut into tokens. Every
later window starts with the key, so it reuses that partitioning and only sorts
inside partitions. A group is one page, so its size is bounded by one row of
the input, however the pages are spread over hosts. ``key`` must identify a
page capture.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.html import (
    VOID, attribute_sql, attributes_sql, close_elements, split_tokens, tag_name, without_raw_text,
)
from pageloom.functions.text import PY_SPACE

# Elements dropped with their content because they are active.
ACTIVE = ("script", "style", "iframe", "form", "input", "button")

# Elements dropped with their content in every cleaning.
ALWAYS_STRIPPED = ("head", "meta", "noscript", "style", "script")

# The 42 noise selectors, by tag, class and id.
NOISE_TAGS = ("header", "footer", "nav", "aside")
NOISE_CLASSES = (
    "header", "top", "navbar", "footer", "bottom", "sidebar", "side", "aside",
    "modal", "popup", "overlay", "ad", "ads", "advert", "lang-selector",
    "language", "social", "social-media", "social-links", "menu", "navigation",
    "breadcrumbs", "share", "widget", "cookie", "fc-decoration",
)
NOISE_IDS = (
    "header", "footer", "sidebar", "modal", "ad", "language-selector", "social",
    "nav", "breadcrumbs", "share", "widget", "cookie",
)

# Landmarks that keep an otherwise excluded ancestor.
FORCE_TAGS = ("main", "article")
FORCE_IDS = ("main",)
FORCE_CLASSES = ("main-content", "content", "post", "entry")
FORCE_ROLES = ("main",)

# References to white space, so that text of nothing else counts as blank.
BLANK_REFERENCE = r"&(?:nbsp|ensp|emsp|thinsp|Tab|NewLine|#0*(?:9|10|12|13|32|160|8192|8193|8194|8195|8201)|#[xX]0*(?:9|[aA]|[cC]|[dD]|20|[aA]0|2003|2009));?"

# Elements that cannot contain themselves: a new one ends the one before.
FLAT = ("p", "a", "dt", "dd", "option")

MODES = ("declared", "sanitize_first")


@dataclass(frozen=True)
class Cleaning:
    """What a cleaning removes.

    ``declared`` applies the noise selectors to the page as captured, then the
    tag allowlist. ``sanitize_first`` applies the allowlist first, so class and
    landmark information is gone before selectors could match.
    """

    mode: str = "declared"
    only_main: bool = True

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown cleaning mode {self.mode!r}")

    @property
    def stripped(self) -> tuple[str, ...]:
        if self.mode == "sanitize_first":
            return ACTIVE
        # A title belongs to the head, also where the head's own tags are left out.
        return tuple(dict.fromkeys((*ACTIVE, *ALWAYS_STRIPPED, "title")))

    @property
    def selects_main(self) -> bool:
        return self.only_main and self.mode == "declared"


def by_page(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Shuffle pages to the partitions of their key, with ``_source``: their HTML without comments,
    scripts and styles, and with the end tags that were left out.

    Raw text is removed before the shuffle; the page as captured is shuffled only where it is asked for.
    The partition count is fixed to ``spark.sql.shuffle.partitions``: tokens take
    several times the space of the page, so partitions must not be merged by
    the size of the captured text.
    """
    count = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = close_elements(without_raw_text(F.col("html")))
    return pages.withColumn("_source", source).repartition(count, key)


def tokenize(pages: DataFrame, key: str = "page_id",
             carry: dict[str, Column] | None = None,
             repeat: dict[str, Column] | None = None) -> DataFrame:
    """Token rows of pages partitioned by :func:`by_page`: ``(key, pos, tok, kind, tag, has_body, carried…, repeated…)``.

    Carried columns are page-level values; they ride on the row with ``pos = 0``
    only, so they are not repeated per token and no later join is needed.
    Repeated columns are short page-level values that every token needs.
    """
    carry, repeat = carry or {}, repeat or {}
    prepared = pages.select(
        key,
        *[c.alias(name) for name, c in {**carry, **repeat}.items()],
        F.col("_source").alias("_html"),
    ).select(
        key, *carry, *repeat,
        F.rlike("_html", F.lit(r"(?i)<body[\s>]")).alias("has_body"),
        split_tokens(F.col("_html")).alias("_tokens"),
    )
    rows = prepared.select(
        key, *carry, *repeat, "has_body", F.posexplode_outer("_tokens").alias("pos", "tok"),
    ).withColumn("pos", F.coalesce("pos", F.lit(0)))
    tok = F.col("tok")
    is_close = F.rlike(tok, F.lit(r"^</[a-zA-Z]"))
    is_start = F.rlike(tok, F.lit(r"^<[a-zA-Z]"))
    rows = rows.select(
        key,
        *[F.when(F.col("pos") == 0, F.col(name)).alias(name) for name in carry],
        *repeat,
        F.coalesce("has_body", F.lit(False)).alias("has_body"),
        "pos",
        "tok",
        F.when(is_close | is_start, tag_name(tok)).alias("tag"),
    )
    kind = (
        F.when(F.col("tag").isNull(),
               F.when((tok == "<") | ~F.startswith(tok, F.lit("<")), "text").otherwise("decl"))
        .when(F.startswith(tok, F.lit("</")), "close")
        .when(F.col("tag").isin(*VOID), "void")
        .otherwise("open")
    )
    return rows.withColumn("kind", kind)


def with_attributes(tokens: DataFrame) -> DataFrame:
    """Add ``_attrs``: attributes of start tags, parsed once per tag that has any."""
    return tokens.withColumn("_attrs", F.expr(
        f"CASE WHEN kind IN ('open', 'void') AND contains(tok, '=') THEN {attributes_sql('tok')} END"))


def start_attr(name: str) -> Column:
    """Attribute of the current token from :func:`with_attributes`."""
    return F.expr(attribute_sql("_attrs", name))


def _listed(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _selected(tags: Sequence[str], classes: Sequence[str], ids: Sequence[str],
              roles: Sequence[str] = ()) -> str:
    """SQL: the current start tag matches one of the simple selectors."""
    tests = [
        f"tag IN ({_listed(tags)})",
        f"coalesce(arrays_overlap(_class, array({_listed(classes)})), false)",
        f"coalesce(_id IN ({_listed(ids)}), false)",
    ]
    if roles:
        tests.append(f"coalesce(_role IN ({_listed(roles)}), false)")
    return f"kind IN ('open', 'void') AND ({' OR '.join(tests)})"


def mark_selectors(tokens: DataFrame, cleaning: Cleaning) -> DataFrame:
    """Add flags ``strip`` (always dropped), ``noise`` and ``force`` to start tags."""
    strip = f"kind IN ('open', 'void') AND tag IN ({_listed(cleaning.stripped)}) AS strip"
    if not cleaning.selects_main:
        return tokens.selectExpr("*", strip, "false AS noise", "false AS force")
    named = tokens.selectExpr(
        "*", strip,
        rf"split(trim({attribute_sql('_attrs', 'class')}), r'[ \t\r\n\f]+') AS _class",
        f"{attribute_sql('_attrs', 'id')} AS _id",
        f"{attribute_sql('_attrs', 'role')} AS _role",
    )
    return named.selectExpr(
        "*",
        f"{_selected(NOISE_TAGS, NOISE_CLASSES, NOISE_IDS)} AS noise",
        f"{_selected(FORCE_TAGS, FORCE_CLASSES, FORCE_IDS, FORCE_ROLES)} AS force",
    ).drop("_class", "_id", "_role")


def match_blocks(tokens: DataFrame, key: str = "page_id",
                 lag_columns: Sequence[str] = ()) -> DataFrame:
    """Pair start and end tags without recursion.

    Tags of one name are numbered by nesting level; inside one level the next
    row after a start tag is where the element ends: its end tag, or a later
    start tag when it was never closed, or nothing (end of the page).

    Adds ``match_pos`` and ``within_force`` to start tags, and ``ends_open``
    plus ``opened_<column>`` to the rows that end an element.
    """
    by_pos = Window.partitionBy(key).orderBy("pos")
    running = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    force = F.col("force").cast("int")
    out = tokens.withColumns({
        "_force_cum": F.sum(force).over(running),
        "_force_all": F.sum(force).over(whole),
    })
    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"
    delta = F.when(is_open, 1).when(is_close, -1).otherwise(0)
    by_tag = Window.partitionBy(key, "tag").orderBy("pos")
    out = out.withColumn("_after", F.sum(delta).over(
        by_tag.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn(
        "_level",
        F.when(F.coalesce(F.col("tag").isin(*FLAT), F.lit(False)) & (is_open | is_close), F.lit(0))
        .when(is_open, F.col("_after"))
        .when(is_close, F.col("_after") + 1)
        .otherwise(F.lit(-1_000_000)),
    )
    by_level = Window.partitionBy(key, "tag", "_level").orderBy("pos")
    before = F.col("_force_cum") - force
    ends_open = F.coalesce(F.lag("kind").over(by_level) == "open", F.lit(False))
    paired = is_open | is_close
    out = out.withColumns({
        "match_pos": F.when(is_open, F.lead("pos").over(by_level)),
        "_force_end": F.lead(before).over(by_level),
        "ends_open": paired & ends_open,
        **{f"opened_{c}": F.when(paired & ends_open, F.lag(c).over(by_level))
           for c in lag_columns},
    })
    inside = F.coalesce("_force_end", "_force_all") - F.col("_force_cum")
    out = out.withColumn("within_force", is_open & (inside > 0))
    return out.drop("_after", "_force_all", "_force_end")


#: Bits of ``modes``: the cleanings that keep a token.
MODE_BITS = {"declared": 1, "full": 2, "sanitize_first": 4}


def keep_content(tokens: DataFrame, key: str = "page_id", modes: bool = False) -> DataFrame:
    """Decide which tokens survive cleaning; adds the flag ``keep``.

    Elements to drop become +1 at their start and -1 after their end; a token
    is dropped while the running sum is above zero. When nothing visible is
    left of the main content, the whole content of the page is kept instead,
    in the same pass. With ``modes``, tokens have the flag ``active`` too, and a bit mask ``modes`` tells
    which of all cleanings (``MODE_BITS``) keep them.
    """
    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"
    by_level = Window.partitionBy(key, "tag", "_level").orderBy("pos")
    out = tokens.withColumn("drop_noise", F.col("noise") & ~F.col("within_force"))
    out = out.withColumns({
        "_strip_end": F.col("ends_open") & F.lag("strip").over(by_level),
        "_noise_end": F.col("ends_open") & F.lag("drop_noise").over(by_level),
    })
    by_pos = Window.partitionBy(key).orderBy("pos")
    running = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_pos.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def depth(start: Column, end: Column) -> Column:
        change = (is_open & start).cast("int") - F.coalesce(end, F.lit(False)).cast("int")
        inclusive = (is_close & F.coalesce(end, F.lit(False))).cast("int")
        return F.sum(change).over(running) + inclusive

    is_body = F.col("kind").isin("open") & (F.col("tag") == "body")
    if modes:
        out = out.withColumn("_active_end", F.col("ends_open") & F.lag("active").over(by_level))
        out = out.withColumn("_active_depth", depth(F.col("active"), F.col("_active_end")))
    out = out.withColumns({
        "_strip_depth": depth(F.col("strip"), F.col("_strip_end")),
        "_noise_depth": depth(F.col("drop_noise"), F.col("_noise_end")),
        "_in_body": F.sum(F.coalesce(is_body, F.lit(False)).cast("int")).over(running) > 0,
    })
    is_void = F.col("kind") == "void"
    content = (F.col("_strip_depth") == 0) & ~(is_void & F.col("strip")) & (
        F.col("_in_body") | ~F.col("has_body"))
    out = out.withColumn("_content", content)
    out = out.withColumn(
        "_main",
        F.col("_content") & (F.col("_noise_depth") == 0) & ~(is_void & F.col("drop_noise")))
    text = F.regexp_replace("tok", BLANK_REFERENCE, " ")
    visible = F.when(F.col("kind") == "text", F.rlike(text, F.lit(f"[^{PY_SPACE}]"))).otherwise(
        F.col("kind").isin("open", "void") & F.col("tag").isin("img", "hr", "br", "li", "td", "th"))
    out = out.withColumn("_has_main", F.max(F.col("_main") & visible).over(whole))
    keep = F.col("_content") & (F.col("_main") | ~F.col("_has_main"))
    if modes:
        kept = {"declared": keep, "full": F.col("_content"),
                "sanitize_first": (F.col("_active_depth") == 0) & ~(is_void & F.col("active"))}
        mask = sum((F.when(kept[name], bit).otherwise(0) for name, bit in MODE_BITS.items()), F.lit(0))
        out = out.withColumn("modes", mask).drop("_active_end", "_active_depth", "active")
    return out.withColumn("keep", F.coalesce(keep, F.lit(False))).drop(
        "_strip_end", "_noise_end", "_strip_depth", "_noise_depth", "_in_body",
        "_content", "_has_main", "_level", "_force_cum", "within_force", "force", "strip",
        "noise", "drop_noise")


def cleaned_tokens(pages: DataFrame, cleaning: Cleaning = Cleaning(), key: str = "page_id",
                   carry: dict[str, Column] | None = None,
                   repeat: dict[str, Column] | None = None,
                   columns: dict[str, Column] | None = None) -> DataFrame:
    """Tokens with the flag ``keep``; ``columns`` adds per-token values whose
    counterpart on the end tag is available as ``opened_<name>``."""
    tokens = tokenize(pages, key, carry, repeat)
    if cleaning.mode == "sanitize_first":
        tokens = tokens.withColumn("has_body", F.lit(False))
    tokens = mark_selectors(with_attributes(tokens), cleaning)
    if columns:
        tokens = tokens.withColumns(columns)
    tokens = tokens.drop("_attrs", *(repeat or {}))
    tokens = match_blocks(tokens, key, lag_columns=list(columns or {}))
    return keep_content(tokens, key)


def tokens_of_all_modes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Tokens with the bit mask ``modes`` of the cleanings that keep them: one scan, one shuffle, one set of windows."""
    tokens = mark_selectors(with_attributes(tokenize(pages, key)), Cleaning())
    tokens = tokens.selectExpr("*", f"kind IN ('open', 'void') AND tag IN ({_listed(ACTIVE)}) AS active").drop("_attrs")
    return keep_content(match_blocks(tokens, key), key, modes=True)
