"""Readers of captured pages and target lists, batch and streaming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pageloom.schema import PAGE_CAPTURES

FORMATS = ("parquet", "orc", "json")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False,
               schema: T.StructType = PAGE_CAPTURES) -> DataFrame:
    """Captured pages ``(page_id, url, html)``; the schema is given, never inferred.

    ``page_id`` identifies a capture. Files that appear in the folder later are
    picked up when ``streaming`` is set.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).format(fmt).load(path)


def target_pool(spark: SparkSession, targets: Iterable[tuple[str, str]]) -> DataFrame:
    """Labelled target URLs in their given order: ``(ordinal, label, url)``."""
    rows = [(i, label, url) for i, (label, url) in enumerate(targets)]
    return spark.createDataFrame(rows, "ordinal bigint, label string, url string")
