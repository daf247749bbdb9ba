"""Content guard: hidden characters, injection score, decision, boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import has_invisible

THRESHOLD = 0.75

# The boundary around untrusted text.
WRAP_OPEN, WRAP_CLOSE = "<untrusted_source>\n", "\n</untrusted_source>"


@dataclass(frozen=True)
class Rule:
    """A pattern over lower-cased text and how strongly it suggests injection.

    A text can only match when it contains one of ``needs``; this plain search
    keeps the pattern away from nearly all text.
    """

    pattern: str
    weight: float
    needs: tuple[str, ...]

    def matches(self, text: Column) -> Column:
        possible = F.lit(False)
        for word in self.needs:
            possible = possible | F.contains(text, F.lit(word))
        return possible & F.rlike(text, F.lit(self.pattern))


RULES = (
    Rule(r"(?s)\b(ignore|disregard|forget)\b.{0,60}\b(previous|prior|before|earlier|above)\b", 0.85,
         ("ignore", "disregard", "forget")),
    Rule(r"\bnew instructions\b", 0.6, ("new instructions",)),
    Rule(r"(?s)\b(reveal|print|output|show|repeat)\b.{0,30}\b(instructions|system (prompt|message))", 0.7,
         ("instructions", "system prompt", "system message")),
    Rule(r"\b(developer|debug|god|jailbreak) mode\b", 0.6, (" mode",)),
    Rule(r"\b(no|without) (any )?(restrictions|limits|rules)\b", 0.6,
         ("restrictions", "limits", "rules")),
    Rule(r"\bunrestricted\b", 0.6, ("unrestricted",)),
    Rule(r"\byou are now\b", 0.4, ("you are now",)),
    Rule(r"\bact as\b", 0.4, ("act as",)),
    Rule(r"\bfor this task only\b", 0.4, ("for this task only",)),
)


def injection_score(text: Column, rules: tuple[Rule, ...] = RULES,
                    max_chars: int | None = None) -> Column:
    """Noisy-or of the rules that match: ``1 - product(1 - weight)``.

    The whole text is read. ``max_chars`` limits it to the head, for scorers
    with a bounded input.
    """
    seen = F.lower(F.coalesce(text, F.lit("")))
    if max_chars is not None:
        seen = F.substring(seen, 1, max_chars)
    clear = F.lit(1.0)
    for rule in rules:
        clear = clear * F.when(rule.matches(seen), 1.0 - rule.weight).otherwise(1.0)
    return F.lit(1.0) - clear


def has_injection(text: Column, threshold: float = THRESHOLD, rules: tuple[Rule, ...] = RULES,
                  max_chars: int | None = None) -> Column:
    """Hidden characters anywhere, or a score at or above the threshold."""
    return has_invisible(text) | (injection_score(text, rules, max_chars) >= threshold)


def wrap(text: Column) -> Column:
    """Mark text as untrusted for downstream readers."""
    return F.concat(F.lit(WRAP_OPEN), text, F.lit(WRAP_CLOSE))


def guard(df: DataFrame, text: str = "markdown", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``invisible_text``, ``injection_score``, ``injection_detected``, ``wrapped``."""
    col = F.col(text)
    out = df.withColumns({
        "invisible_text": has_invisible(col),
        "injection_score": injection_score(col),
    })
    return out.withColumns({
        "injection_detected": F.col("invisible_text") | (F.col("injection_score") >= threshold),
        "wrapped": wrap(col),
    })


Scorer = Callable[[pd.Series], pd.Series]


def score_with_model(df: DataFrame, text: str, load: Callable[[], Scorer],
                     threshold: float = THRESHOLD) -> DataFrame:
    """Guard with a batch scorer instead of the rules.

    ``load`` runs once per Python worker task and returns a function from a
    batch of texts to scores. Rows with hidden characters are decided without
    the model; they are split off first, because Spark may evaluate a Python
    function before a cheaper condition in the same expression.
    """
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for batch in batches:
            yield scorer(batch)

    marked = df.withColumn("invisible_text", has_invisible(F.col(text)))
    hidden = marked.filter("invisible_text").withColumns({
        "injection_score": F.lit(0.0), "injection_detected": F.lit(True)})
    scored = marked.filter("NOT invisible_text").withColumn("injection_score", score(F.col(text)))
    scored = scored.withColumn("injection_detected", F.col("injection_score") >= threshold)
    return hidden.unionByName(scored)


def detector_accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Confusion counts and accuracy of a boolean prediction, as one row."""
    actual, flagged = F.col(label), F.col(predicted)
    return df.agg(
        F.count_if(actual & flagged).alias("tp"),
        F.count_if(~actual & flagged).alias("fp"),
        F.count_if(actual & ~flagged).alias("fn"),
        F.count_if(~actual & ~flagged).alias("tn"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.col("total")))
