"""Page type and language by lexical votes; contract for any other classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import listed_count, listed_words, words
from pageloom.operators.document import is_thin

# Page types, in the order that breaks ties.
PAGE_TYPES = ("blog", "blog_index", "forum", "market", "docs", "index", "phishing", "other")

DEFAULT_TYPE, DEFAULT_LANGUAGE = "other", "und"

# Words and phrases that vote for a page type (in lower-cased text).
TYPE_WORDS = {
    "blog": ("posted", "author", "article", "published", "comment", "comments"),
    "blog_index": ("archives",),
    "forum": ("thread", "threads", "reply", "replies", "forum", "member", "members", "topic", "topics"),
    "market": ("price", "cart", "buy", "vendor", "vendors", "checkout", "shipping", "listing", "listings"),
    "docs": ("documentation", "install", "version", "api", "configuration", "status"),
    "index": ("directory", "link", "links", "categories"),
    "phishing": (),
}
TYPE_PHRASES = {
    "blog_index": ("read more", "older posts", "newer posts", "latest posts"),
    "index": ("index of",),
    "phishing": ("verify your", "account suspended", "confirm your password", "login now"),
}

# Frequent function words per language.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "von", "zu", "den"),
    "en": ("the", "of", "and", "to", "is", "that", "it", "with", "for", "was", "this", "are"),
    "es": ("el", "los", "las", "que", "y", "en", "por", "con", "una", "para", "del", "no"),
    "fr": ("le", "les", "des", "et", "est", "une", "dans", "pour", "qui", "du", "au", "la"),
}


def phrase_count(low: Column, phrase: str) -> Column:
    """How often a phrase occurs in lower-cased text."""
    lost = F.octet_length(low) - F.octet_length(F.replace(low, F.lit(phrase), F.lit("")))
    return (lost / len(phrase)).cast("int")


def type_votes(low: Column, hits: str) -> dict[str, Column]:
    """Votes per page type: all of its words and phrases."""
    votes = {}
    for name, listed in TYPE_WORDS.items():
        total = listed_count(hits, listed) if listed else F.lit(0)
        for phrase in TYPE_PHRASES.get(name, ()):
            total = total + phrase_count(low, phrase)
        votes[name] = total
    return votes


def page_type(votes: dict[str, Column]) -> Column:
    """Type with the most votes; earlier types win ties, no votes give the default."""
    best = F.greatest(*votes.values())
    choice = F.when(best == 0, F.lit(DEFAULT_TYPE))
    for name in PAGE_TYPES:
        if name in votes:
            choice = choice.when(votes[name] == best, F.lit(name))
    return choice


def _language(hits: str) -> dict[str, Column]:
    return {code: listed_count(hits, stop) for code, stop in STOP_WORDS.items()}


def _choose_language(counts: dict[str, str]) -> Column:
    """Code with the most stop words; alphabetical on ties, ``und`` without any."""
    best = F.greatest(*[F.col(c) for c in counts.values()])
    choice = F.when(best == 0, F.lit(DEFAULT_LANGUAGE))
    for code, column in counts.items():
        choice = choice.when(F.col(column) == best, F.lit(code))
    return choice


def identify_language(df: DataFrame, text: str) -> DataFrame:
    """Add ``language`` from the whole text."""
    every = [w for stop in STOP_WORDS.values() for w in stop]
    counts = {code: f"_n_{code}" for code in STOP_WORDS}
    out = df.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("_hits", listed_words("_words", every))
    out = out.withColumns({counts[c]: n for c, n in _language("_hits").items()})
    return out.withColumn("language", _choose_language(counts)).drop("_words", "_hits", *counts.values())


def triage(df: DataFrame, markdown: str = "markdown", title: str = "title") -> DataFrame:
    """Add ``page_type``, ``language`` and ``thin`` from title and whole text."""
    text = F.concat_ws("\n", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(markdown), F.lit("")))
    groups = [*STOP_WORDS.values(), *TYPE_WORDS.values()]
    every = list(dict.fromkeys(w for listed in groups for w in listed))
    counts = {code: f"_n_{code}" for code in STOP_WORDS}
    names = {name: f"_v_{name}" for name in TYPE_WORDS}
    out = df.withColumn("_low", F.lower(text)).withColumn("_words", words(F.col("_low")))
    out = out.withColumn("_hits", listed_words("_words", every))
    out = out.withColumns({
        **{counts[c]: n for c, n in _language("_hits").items()},
        **{names[n]: v for n, v in type_votes(F.col("_low"), "_hits").items()}})
    return out.withColumns({
        "page_type": page_type({n: F.col(c) for n, c in names.items()}),
        "language": _choose_language(counts),
        "thin": is_thin(F.col(markdown)),
    }).drop("_low", "_words", "_hits", *counts.values(), *names.values())


def checked_triage(answer: Column) -> Column:
    """Classifier answer (JSON text) to ``struct<page_type, language>``.

    Text that is not JSON, an unknown type or a malformed code gives the default.
    """
    parsed = F.from_json(answer, "page_type STRING, language STRING")
    valid = F.try_parse_json(answer).isNotNull()
    kind = F.when(valid & parsed["page_type"].isin(*PAGE_TYPES), parsed["page_type"])
    code = F.when(valid & F.rlike(parsed["language"], F.lit("^[a-z]{2}$")), parsed["language"])
    return F.struct(
        F.coalesce(kind, F.lit(DEFAULT_TYPE)).alias("page_type"),
        F.coalesce(code, F.lit(DEFAULT_LANGUAGE)).alias("language"),
    )


def ask_model(df: DataFrame, text: str, load: Callable[[], Callable[[pd.Series], pd.Series]],
              answer: str = "answer") -> DataFrame:
    """Add a JSON answer per row from a batch model, loaded once per worker task."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.withColumn(answer, run(F.col(text)))
