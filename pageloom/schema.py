"""Schemas of the stored tables and of typed records."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B, _TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


PAGE_CAPTURES = _struct(page_id=T.LongType(), url=_S, html=_S)

RUNS = _struct(id=_S, started_at=_TS, ended_at=_TS, config=_S)

PAGES_BASE = _struct(
    id=_S, run_id=_S, url=_S, status_code=_I, fetch_ms=_I, html_bytes=_I,
    markdown_chars=_I, link_count=_I, image_count=_I, title=_S, error=_S,
    injection_detected=_B, injection_score=T.FloatType(), invisible_text=_B, scraped_at=_TS,
)
PAGES_ADDED = _struct(
    circuit_id=_S, exit_fingerprint=_S, exit_nickname=_S, content_type=_S,
    page_type=_S, language=_S,
)
PAGES = T.StructType(PAGES_BASE.fields + PAGES_ADDED.fields)

SOURCES = _struct(url=_S, name=_S, category=_S, added_at=_TS)

TABLES = {"runs": RUNS, "pages": PAGES, "sources": SOURCES}
