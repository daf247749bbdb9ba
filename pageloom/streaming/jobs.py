"""Incremental forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pageloom.functions.html import html_lang, title_text, without_raw_text
from pageloom.functions.text import has_invisible
from pageloom.operators.document import extract_documents
from pageloom.operators.guard import has_injection, injection_score
from pageloom.sources.store import Store


def page_signals(pages: DataFrame) -> DataFrame:
    """Row-local facts of captured pages; works on batch and streaming frames."""
    source = without_raw_text(F.col("html"))
    return pages.select(
        "page_id", "url", title_text(source).alias("title"), html_lang(source).alias("language"),
        has_invisible(F.col("html")).alias("invisible_text"),
        injection_score(F.col("html")).alias("injection_score"),
        has_injection(F.col("html")).alias("injection_detected"))


def _start(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str,
           available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_documents(pages: DataFrame, out: str, checkpoint: str, mode: str = "declared",
                     available_now: bool = True) -> StreamingQuery:
    """Documents of newly captured pages, one folder per batch.

    Token windows are ordered by row, which streams do not support, so each
    batch is extracted as a table. A batch that is run again overwrites its own
    folder, so restarts leave no duplicates.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        extract_documents(batch, mode).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(pages, run, checkpoint, available_now)


def stream_sources(updates: DataFrame, store: Store, order: str, checkpoint: str,
                   now: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
                   available_now: bool = True) -> StreamingQuery:
    """Upsert source updates batch by batch; a batch that is run again after a restart writes nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        store.upsert_sources(batch, order, now(), (checkpoint, batch_id))

    return _start(updates, run, checkpoint, available_now)


def stream_page_facts(facts: DataFrame, store: Store, checkpoint: str,
                      lateness: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    """Append page facts once per id.

    Repeats within the watermark are dropped by state; later ones, and batches
    that are run again, by the stored ids.
    """
    unique = facts.withWatermark("scraped_at", lateness).dropDuplicatesWithinWatermark(["id"])

    def run(batch: DataFrame, batch_id: int) -> None:
        store.append_new("pages", batch, (checkpoint, batch_id))

    return _start(unique, run, checkpoint, available_now)


#: Size of the latency sketches; a quantile's rank is off by less than ``RANK_ERROR`` (with 99 % confidence).
SKETCH_K, RANK_ERROR = 800, 0.005


def _quantile(sketch: str, rank: float) -> Column:
    """Quantile of a latency sketch; NULL when it has no values."""
    return F.when(F.kll_sketch_get_n_bigint(sketch) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(rank)))


def rolling_telemetry(facts: DataFrame, width: str = "10 minutes",
                      lateness: str = "1 hour") -> DataFrame:
    """Telemetry per tumbling window, for append mode: a window is given out once the watermark has passed its end.

    Rows that come later than that are dropped. State is one row per window, combined before the shuffle; its latencies are a
    quantile sketch of bounded size (exact up to ``SKETCH_K`` values), so windows can be merged later (:func:`merged_telemetry`).
    """
    timed = facts.withWatermark("scraped_at", lateness)
    grouped = timed.groupBy(F.window("scraped_at", width)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNull()).alias("success"),
        F.count("fetch_ms").alias("timed"),
        F.sum("fetch_ms").alias("sum_ms"),
        F.kll_sketch_agg_bigint(F.col("fetch_ms").cast("bigint"), F.lit(SKETCH_K)).alias("latency_sketch"),
        F.count_if(F.col("injection_detected")).alias("injections"))
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "total", "success",
        F.try_divide("sum_ms", "timed").alias("avg_ms"), _quantile("latency_sketch", 0.95).alias("p95_ms"), "injections",
        "timed", "sum_ms", "latency_sketch")


def merged_telemetry(windows: DataFrame, width: str) -> DataFrame:
    """Wider windows from those of :func:`rolling_telemetry`: counts are summed and sketches merged, no fact is read again."""
    grouped = windows.groupBy(F.window("window_start", width)).agg(
        *[F.sum(c).alias(c) for c in ("total", "success", "timed", "sum_ms", "injections")],
        F.kll_merge_agg_bigint("latency_sketch", F.lit(SKETCH_K)).alias("latency_sketch"))
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "total", "success",
        F.try_divide("sum_ms", "timed").alias("avg_ms"), _quantile("latency_sketch", 0.95).alias("p95_ms"), "injections",
        "timed", "sum_ms", "latency_sketch")
