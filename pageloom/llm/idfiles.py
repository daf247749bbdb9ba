"""Token-id files: Parquet lists in document order, read back whole or by column."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.encoder import encoder, word_bpe_path
from pageloom.llm.frames import release, slices, table
from pageloom.session import scratch_dir

FILE_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
                      row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10) -> None:
    """Write the ids of every whole text as Parquet, in ascending ``doc_id`` order.

    Each file holds one range of ids (``shard``) in order, and each row its place among the ids of its
    file. ``ids`` is a dictionary-encoded list; the other columns are delta-encoded, so they cost a few
    bits a row. Row groups and pages are small enough for page indexes to skip most of a file when rows
    are picked by ``doc_id``.

    Null text is empty, an empty text has the end id alone, rows with a null ``doc_id`` come first,
    rows with equal ``doc_id`` are ordered by a digest of their text, and other columns are ignored.
    An empty table gives files without rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer, end_id)
        shard, before = TaskContext.get().partitionId(), 0
        for part in slices(batches, rows=2000, chars=1_500_000):
            ids, ends = known.encode_array(part.column("text"))
            n = np.diff(ends, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(before + ends - n),
                pa.array(n), lists], schema=schema)
            before += int(ends[-1])
        known.forget()
        release()

    ordered = (docs.select("doc_id", "text").withColumn("digest", F.xxhash64("text"))
               .repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest"))
    (ordered.mapInArrow(ids_of, FILE_SCHEMA).write
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#shard", "false").option("parquet.enable.dictionary#shard_start", "false")
     .option("parquet.enable.dictionary#n_tokens", "false")
     .parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with ``start``, the number of ids of all documents before each one.

    The totals of the files come from the small columns alone. There is one total a file, so they are
    summed up in one task and sent to all.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = totals.selectExpr("shard", "sum(total) over (order by shard) - total AS base")
    return (files.join(F.broadcast(base), "shard")
            .select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids"))


def with_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by the crc32 of their little-endian unsigned 32-bit form."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def crc_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lists = part.column("ids")
            ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").view("<u4")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("start"), part.column("n_tokens"),
                pa.array(crc, pa.int64())], schema=schema)

    return (rows.select("doc_id", "start", "n_tokens", "ids")
            .mapInArrow(crc_of, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, folder, "documents"), path, word_bpe_path())
    return with_crc32(read_token_files(spark, path))
