"""Ordered set operations on distributed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.session import cut_lineage


def ordered_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First occurrence of each key; reduced before the shuffle, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First n rows of each group, cut per task before the shuffle."""
    by = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= n).drop("_rn")


def fallback_to(primary: DataFrame, other: DataFrame) -> DataFrame:
    """The primary rows, or the other rows when there are no primary rows; the primary ones are worked out once and written."""
    found = cut_lineage(primary, "primary")
    return other.select(*found.columns) if found.isEmpty() else found


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")
