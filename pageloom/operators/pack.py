"""Context packing: short page excerpts in order, up to a size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCERPT_CHARS = 200
CONTEXT_CHARS = 6000


def excerpt(title: Column, url: Column, markdown: Column) -> Column:
    """``[title] url`` and the head of the text."""
    return F.concat(
        F.lit("["), F.coalesce(F.when(title != "", title), F.lit("untitled")), F.lit("] "), url,
        F.lit("\n"), F.substring(F.coalesce(markdown, F.lit("")), 1, EXCERPT_CHARS))


def context_pack(df: DataFrame, order: Sequence[str], max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """One ``context`` text from ``(title, url, markdown)`` rows.

    Every excerpt and its separator take at least six characters, so the first
    ``max_chars / 6`` rows always fill the context: the exact result needs a
    top-n over the table and only those rows are gathered.
    """
    needed = max_chars // 6 + 1
    pieces = df.select(F.struct(*order).alias("_order"),
                       excerpt(F.col("title"), F.col("url"), F.col("markdown")).alias("_piece"))
    head = pieces.orderBy("_order").limit(needed)
    rows = F.array_sort(F.collect_list(F.struct("_order", "_piece")))
    joined = F.array_join(F.transform(rows, lambda r: r["_piece"]), "\n\n")
    return head.agg(F.substring(joined, 1, max_chars).alias("context"))
