"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has few rows and, unless one row alone has more, few bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() * n / batch.num_rows > chars * 4 \
                    and batch.slice(at, n).nbytes > chars:
                n //= 2
            yield batch.slice(at, n)
            at += n


def release() -> None:
    """Give memory that a finished task freed back to the system: Python workers live on, and so would their peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # the C library may lack it


BROADCAST_BYTES = 32 << 20


def small(frame: DataFrame) -> DataFrame:
    """Broadcast a written table of flat columns that takes at most ``BROADCAST_BYTES``; join a larger one by shuffle."""
    texts = [F.octet_length(f"`{f.name}`") for f in frame.schema if isinstance(f.dataType, StringType)]
    row = F.lit(16 * len(frame.columns)).cast("long")
    size = frame.agg(F.coalesce(F.sum(sum([F.coalesce(t, F.lit(0)) for t in texts], row)), F.lit(0))).first()[0]
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame


def fresh(frame: DataFrame, name: str) -> str:
    """A name for a working column that the frame does not use."""
    used = {c.lower() for c in frame.columns}
    return next(n for k in range(len(used) + 1) if (n := f"{name}_{k}") not in used)
