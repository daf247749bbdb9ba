"""Sequences of neighbouring documents along a Hilbert curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.encoder import encoder, word_bpe_path
from pageloom.llm.frames import release, slices, table
from pageloom.session import cut_lineage

BUCKETS, DIMENSIONS, BITS = 512, 3, 8
PIECES = ("sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, "
          "ids binary")


def _projection(vocabulary: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of every token id, and directions in which hashed vectors are projected."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, BUCKETS, vocabulary), rng.choice([-1.0, 1.0], vocabulary),
            np.linalg.qr(rng.normal(size=(BUCKETS, DIMENSIONS)))[0])


def encode_and_project(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """Chunks of at most ``length`` ids, with coordinates of their document's hashed token vector."""
    names = [f"x{i}" for i in range(DIMENSIONS)]
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("doc_tokens", pa.int64()),
                        ("start", pa.int64()), ("ids", pa.binary()), *[(x, pa.float32()) for x in names]])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer, end_id)
        width = "<u2" if known.vocabulary <= 1 << 16 else "<u4"
        bucket, sign, onto = _projection(max(known.vocabulary, end_id + 1))
        for part in slices(batches, rows=2000, chars=1_000_000):
            ids, ends = known.encode_array(part.column("text"))
            sizes = np.diff(ends, prepend=0)
            of = np.repeat(np.arange(len(ends)) * BUCKETS, sizes)
            vectors = np.bincount(of + bucket[ids], sign[ids], len(ends) * BUCKETS).reshape(-1, BUCKETS)
            vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            times = -(-sizes // length)
            row = np.repeat(np.arange(len(ends)), times)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)) * length
            cuts = np.append(start + (ends - sizes)[row], len(ids)) * np.dtype(width).itemsize
            pieces = pa.BinaryArray.from_buffers(pa.binary(), len(row), [
                None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids.astype(width))])
            at = (vectors @ onto).astype(np.float32)[row]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(row)), part.column("digest").take(pa.array(row)), pa.array(sizes[row]),
                pa.array(start), pieces, *[pa.array(x) for x in at.T]], schema=schema)
        known.forget()
        release()

    return (docs.select("doc_id", "text").withColumn("digest", F.xxhash64("text"))
            .mapInArrow(chunks, "doc_id long, digest long, doc_tokens long, start long, ids binary, "
                        + ", ".join(f"{x} float" for x in names)))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells, one row each.

    The transposed index is found by undoing rotations and reflections from the highest bit down, and
    its bits are then interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def hilbert_key(cuts: list[list[float]]) -> Column:
    """Key of the coordinate columns; ``cuts`` part each axis into cells that hold as many documents."""
    edges = [np.array(c, np.float32) for c in cuts]

    @F.pandas_udf("long")
    def key(x, y, z):
        import pandas as pd  # only where it is needed: it takes memory in every worker

        axes = (x, y, z)
        cells = np.stack([np.searchsorted(e, a.to_numpy(np.float32), "right") for e, a in zip(edges, axes)], 1)
        return pd.Series(hilbert_index(cells, BITS))

    return key(*[f"x{i}" for i in range(DIMENSIONS)])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096) -> DataFrame:
    """Pack the ids of all documents into sequences of at most ``length`` ids.

    Documents are encoded, and their hashed token vectors projected to a few dimensions, once; the
    result is written. Each axis is parted at its quantiles over all documents, the cells are numbered
    along a Hilbert curve, and chunks of documents are range-sorted by that number, then by document.
    Equal keys, as of copies, are thus split between tasks. Each task fills sequences one after the
    other; what is left in its last one becomes sequences whose lengths are powers of two, which need
    no padding. Tasks hold one sequence at a time.

    Null text is empty; an empty document is its end id. Rows with equal ``doc_id`` are packed one by
    one, other columns are ignored, and an empty table gives no sequence. ``ids`` are little-endian
    unsigned 32-bit.
    """
    written = cut_lineage(encode_and_project(docs, tokenizer, end_id, length), "packing")
    cells = 1 << BITS
    ranks = [i / cells for i in range(1, cells)]
    cuts = written.where("start = 0").agg(
        *[F.percentile_approx(f"x{i}", ranks, 10_000).alias(f"x{i}") for i in range(DIMENSIONS)]).first()
    keyed = written.withColumn("key", hilbert_key([c or [] for c in cuts])).drop(
        *[f"x{i}" for i in range(DIMENSIONS)])
    along = ["key", "doc_id", "digest", "start"]
    narrow = "<u2" if encoder(tokenizer, end_id).vocabulary <= 1 << 16 else "<u4"
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()),
                        ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                        ("ids", pa.binary())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # pieces of the sequence that is being filled: doc_id, start, doc_tokens, ids
        used = 0
        done: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal number
            at = 0
            for doc, start, total, ids in pieces:
                done.append((number, at, doc, start, len(ids), total, ids.astype("<u4").tobytes()))
                at += len(ids)
            number += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done.clear()
            return out

        for part in slices(batches):
            for doc, start, total, raw in zip(*[part.column(c).to_pylist()
                                                for c in ("doc_id", "start", "doc_tokens", "ids")]):
                ids = np.frombuffer(raw, narrow)
                while len(ids):
                    take = ids[:length - used]
                    held.append((doc, start, total, take))
                    used += len(take)
                    start += len(take)
                    ids = ids[len(take):]
                    if used == length:
                        close(held)
                        held, used = [], 0
            if done:
                yield batch()
        while used:
            size, mine = 1 << (used.bit_length() - 1), []
            used -= size
            while size:
                doc, start, total, ids = held.pop(0)
                mine.append((doc, start, total, ids[:size]))
                if len(ids) > size:
                    held.insert(0, (doc, start + size, total, ids[size:]))
                size -= len(mine[-1][3])
            close(mine)
        if done:
            yield batch()

    return (keyed.repartitionByRange(*along).sortWithinPartitions(*along)
            .select("doc_id", "start", "doc_tokens", "ids").mapInArrow(fill, PIECES))


def packed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), word_bpe_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
