"""Schema-typed JSON: record schemas per page type, parsing, input caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Record fields per page type, and the fields that must be there.
SCHEMAS = {
    "blog": "title STRING, author STRING, published STRING, summary STRING, tags ARRAY<STRING>",
    "blog_index": "title STRING, posts ARRAY<STRUCT<title: STRING, published: STRING, summary: STRING>>",
    "forum": "name STRING, category_count BIGINT, subforums ARRAY<STRING>, recent_thread_titles ARRAY<STRING>",
    "market": "name STRING, currency STRING, categories ARRAY<STRING>, "
              "listings ARRAY<STRUCT<title: STRING, price: STRING, vendor: STRING>>",
    "docs": "title STRING, project STRING, summary STRING, sections ARRAY<STRING>",
    "index": "title STRING, entries ARRAY<STRUCT<name: STRING, kind: STRING, modified: STRING>>",
    "phishing": "impersonating STRING, indicators ARRAY<STRING>, summary STRING",
    "other": "title STRING, summary STRING, entities ARRAY<STRING>",
}
REQUIRED = {
    "blog": ("title", "summary"), "blog_index": ("posts",), "forum": ("name",),
    "market": ("name",), "docs": ("title", "summary"), "index": ("entries",),
    "phishing": ("summary",), "other": ("summary",),
}
INPUT_CAPS = {"index": 4000, "blog_index": 10000}
DEFAULT_CAP = 12000


def input_cap(page_type: Column) -> Column:
    """Largest model input for a page type, in characters."""
    cap = F.when(page_type.isNull(), F.lit(DEFAULT_CAP))
    for name, size in INPUT_CAPS.items():
        cap = cap.when(page_type == name, F.lit(size))
    return cap.otherwise(F.lit(DEFAULT_CAP))


def capped_input(content: Column, page_type: Column) -> Column:
    return F.substring(content, F.lit(1), input_cap(page_type))


def json_or(text: Column, default: str) -> Column:
    """The text when it parses as JSON, else the default JSON text."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.lit(default))


def typed_record(answer: Column, page_type: str) -> Column:
    """JSON answer as the record of one page type; all NULL when unparsable."""
    schema = SCHEMAS.get(page_type, SCHEMAS["other"])
    return F.from_json(json_or(answer, "{}"), schema)


def missing_required(record: Column, page_type: str) -> Column:
    """How many required fields of the record are NULL."""
    total = F.lit(0)
    for name in REQUIRED.get(page_type, REQUIRED["other"]):
        total = total + record[name].isNull().cast("int")
    return total


def enrich(df: DataFrame, answer: str = "answer", page_type: str = "page_type") -> DataFrame:
    """Add one nullable record column per page type, filled for the row's type.

    Unknown types use the schema of ``other``. ``missing_required`` counts
    required fields that are absent.
    """
    kind = F.when(F.col(page_type).isin(*SCHEMAS), F.col(page_type)).otherwise(F.lit("other"))
    out = df.withColumn("_kind", kind)
    out = out.withColumns({
        f"record_{name}": F.when(F.col("_kind") == name, typed_record(F.col(answer), name))
        for name in SCHEMAS})
    missing = F.lit(None).cast("int")
    for name in SCHEMAS:
        missing = F.when(F.col("_kind") == name,
                         missing_required(F.col(f"record_{name}"), name)).otherwise(missing)
    return out.withColumn("missing_required", missing).drop("_kind")
