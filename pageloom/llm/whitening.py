"""Embedding whitening with an exact scatter matrix from bit-sliced vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.frames import table
from pageloom.session import cut_lineage

SCALE, COMPONENTS = 256, 4
#: Rows that are sliced together; 64 to a word.
BLOCK = 4096
_LIMBS, _LIMB = 4, 32


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat doubles of a list column, its offsets, and which rows hold only finite numbers."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    good = np.concatenate([[0], np.cumsum(np.isfinite(flat))])
    sizes = np.diff(offsets)
    whole = good[offsets[1:]] - good[offsets[:-1]] == sizes
    return flat, offsets, whole & column.is_valid().to_numpy(zero_copy_only=False)


def fixed_point(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * value) as longs, at the ends of their range beyond it."""
    scaled = np.floor(np.clip(values * float(scale), -(2.0 ** 63), 2.0 ** 63))
    out = np.full(scaled.shape, np.iinfo(np.int64).max)
    inside = scaled < 2.0 ** 63
    out[inside] = scaled[inside].astype(np.int64)
    return out


def _narrow(x: np.ndarray) -> bytes:
    """Longs as bytes of the smallest width that holds them, without zeros at the end; equal vectors, equal bytes."""
    used = np.flatnonzero(x)
    x = x[:used[-1] + 1] if len(used) else x[:0]
    for width in ("<i1", "<i2", "<i4"):
        info = np.iinfo(width)
        if not len(x) or (x.min() >= info.min and x.max() <= info.max):
            return width[-1].encode() + x.astype(width).tobytes()
    return b"8" + x.astype("<i8").tobytes()


def _wide(column: pa.Array, dimensions: int) -> np.ndarray:
    """The longs of a column of ``_narrow`` bytes, one row each, zeros at the end put back."""
    out = np.zeros((len(column), dimensions), np.int64)
    for k, raw in enumerate(column.to_pylist()):
        x = np.frombuffer(raw, f"<i{chr(raw[0])}", offset=1)
        out[k, :len(x)] = x
    return out


def fixed_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``dims`` and ``x`` (bytes of fixed-point longs) of the rows whose vector is whole and finite."""
    schema = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("x", pa.binary())])

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets, whole = _lists(batch.column("embedding"))
            with np.errstate(invalid="ignore", over="ignore"):
                x = fixed_point(np.where(np.isfinite(flat), flat, 0.0), scale)
            rows = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(rows)), pa.array(np.diff(offsets)[rows].astype(np.int32)),
                pa.array([_narrow(x[offsets[k]:offsets[k + 1]]) for k in rows.tolist()], pa.binary())], schema=schema)

    return (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
            .mapInArrow(fix, "vec_id long, dims int, x binary"))


def sliced_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (objects) over the rows of ``x``: of each column, and of the products of each two columns.

    Every column is shifted to start at zero. Bit b of its values over 64 rows is one word; the number of rows in
    which bit b of one column and bit c of another are set is the popcount of the AND of their words, and counts 2^(b+c).
    The shifts are then taken out again in whole numbers.
    """
    rows, dims = x.shape
    low = x.min(0)
    shifted = (x.view(np.uint64) - low.view(np.uint64)).astype(np.uint64)
    bits = max(1, int(shifted.max()).bit_length())
    planes = np.empty((dims, bits, -(-rows // 64)), np.uint64)
    octets = np.zeros((dims, planes.shape[2] * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(bool).T, axis=1)
        octets[:, :packed.shape[1]] = packed
        planes[:, b] = octets.view(np.uint64)
    small = 2 * bits + rows.bit_length() < 62
    kind = np.int64 if small else object
    weights = np.array([1 << b for b in range(bits)], kind)
    products = np.zeros((dims, dims), kind)
    for d in range(dims):
        after = planes[d:].reshape(-1, planes.shape[2])
        counts = np.stack([np.bitwise_count(after & planes[d, b]).sum(1, dtype=np.int64) for b in range(bits)])
        counts = counts.reshape(bits, dims - d, bits).astype(kind)
        products[d, d:] = (counts * weights).sum(2).T @ weights
    sums = (np.bitwise_count(planes).sum(2, dtype=np.int64).astype(kind) * weights).sum(1).astype(object)
    products = products.astype(object)
    products = np.triu(products) + np.triu(products, 1).T
    low = low.astype(object)
    products = products + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)
    return sums + rows * low, products


def scatter(fit: DataFrame, dimensions: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, exact sums and exact sums of products of the vectors ``x``.

    A task adds up its blocks and gives one row for each pair of dimensions, as limbs of 32 bits; these are summed
    with partial aggregation, so the driver gets as many rows as there are pairs, whatever the number of vectors.
    """
    upper = [(i, j) for i in range(-1, dimensions) for j in range(max(i, 0), dimensions)]
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), *[(f"l{k}", pa.int64()) for k in range(_LIMBS)]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products, n = np.zeros(dimensions, object), np.zeros((dimensions, dimensions), object), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                s, p = sliced_products(_wide(part.column("x"), dimensions))
                sums, products, n = sums + s, products + p, n + part.num_rows
        if n:
            totals = [n, *[int(sums[j] if i < 0 else products[i, j]) for i, j in upper]]
            mask = (1 << _LIMB) - 1
            limbs = [[t >> _LIMB * k & mask if k < _LIMBS - 1 else t >> _LIMB * k for t in totals] for k in range(_LIMBS)]
            yield pa.RecordBatch.from_arrays([
                pa.array([-2, *[i for i, _ in upper]], pa.int32()), pa.array([0, *[j for _, j in upper]], pa.int32()),
                *[pa.array(x, pa.int64()) for x in limbs]], schema=schema)

    found = (fit.select("x").mapInArrow(add, "i int, j int, " + ", ".join(f"l{k} long" for k in range(_LIMBS)))
             .groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)]).collect())
    n, sums, products = 0, [0] * dimensions, np.zeros((dimensions, dimensions), object)
    for i, j, *limbs in found:
        total = sum(x << _LIMB * k for k, x in enumerate(limbs))
        if i == -2:
            n = total
        elif i == -1:
            sums[j] = total
        else:
            products[i, j] = products[j, i] = total
    return n, sums, products


def principal(n: int, sums: list[int], products: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors (columns) of the covariance, largest first, and its trace.

    n times the products less the products of the sums is centred in whole numbers; only the quotient is rounded.
    """
    s = np.array(sums, object)
    centred = n * products - np.outer(s, s)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in centred], float)
    trace = sum(int(centred[k, k]) for k in range(len(s))) / (n * n)
    top = float(np.abs(covariance).max()) or 1.0
    values, vectors = np.linalg.eigh(covariance / top)
    values, vectors = values[::-1][:components] * top, vectors[:, ::-1][:, :components]
    flip = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * flip, trace


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - sum)^2 of each row, exact; None where a long cannot hold it.

    Whole numbers modulo 2^64 give the result wherever it is below 2^63, which an estimate in doubles tells; rows
    near that bound are worked out in numbers of any size.
    """
    def wrapped(v: int) -> np.int64:
        return np.int64((v + (1 << 63)) % (1 << 64) - (1 << 63))

    with np.errstate(over="ignore"):
        apart = x * wrapped(n) - np.array([wrapped(v) for v in sums], np.int64)
        exact = (apart * apart).sum(1)
    estimate = ((float(n) * (x - np.array([v / n for v in sums]))) ** 2).sum(1)
    out: list[int | None] = exact.tolist()
    for k in np.flatnonzero(estimate > 2.0 ** 62).tolist():
        total = sum((n * int(v) - s) ** 2 for v, s in zip(x[k], sums)) if estimate[k] < 2.0 ** 64 else 1 << 64
        out[k] = total if total < 1 << 63 else None
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Whitened coordinates of every vector on the leading principal components.

    Entries become longs x = floor(``scale`` * entry). The components are unit eigenvectors of the covariance of the
    distinct x vectors, each counted once, which is worked out exactly from bit slices (``sliced_products``).
    A row for each vector and component: ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n`` (distinct vectors),
    ``deviation`` (sum of the squares of n * x - sum, exact; null beyond a long), ``whitened``, ``explained`` (share of the
    variance) and ``identity_error``, the largest entry by which the covariance of the whitened distinct vectors, measured on
    them, differs from the identity. The largest entry of a component is positive.

    Rows with a null vector or with entries that are null or not finite are dropped. Entries beyond a long count as its
    ends. Shorter vectors have zeros at the end. Repeated rows and ids give a result each, a null id too. A component
    without variance (one distinct vector, fewer than four dimensions of variance) has null ``whitened`` and is left out of the error;
    without any variance ``explained`` is null. Other columns are ignored; an empty table, or vectors without entries, gives no rows.
    """
    spark = vectors.sparkSession
    fixed = cut_lineage(fixed_vectors(vectors, scale), "vectors")
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dimensions = fixed.agg(F.max("dims")).first()[0] or 0
    if not dimensions:
        return spark.createDataFrame([], names)
    fit = cut_lineage(fixed.select("x").distinct(), "vectors")
    n, sums, products = scatter(fit, dimensions)
    values, directions, trace = principal(n, sums, products, components)
    real = values > 1e-12 * trace / dimensions if trace > 0 else np.zeros(len(values), bool)
    onto = directions / np.sqrt(np.where(real, values, 1.0))
    mean = np.array([v / n for v in sums])
    axes = [f"w{k}" for k in np.flatnonzero(real)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = (_wide(batch.column("x"), dimensions) - mean) @ onto[:, real]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], names=axes)

    error = 0.0
    if axes:
        measured = fit.mapInArrow(project, ", ".join(f"{a} double" for a in axes)).agg(*[
            F.abs(F.covar_pop(a, b) - float(a == b)) for i, a in enumerate(axes) for b in axes[i:]]).first()
        error = max(measured)
    count = len(values)
    shares = [float(v) / trace if trace > 0 else None for v in values]
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, k = _wide(batch.column("x"), dimensions), batch.num_rows
            w = (x - mean) @ onto
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(k), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), k)), pa.array(np.full(k * count, n)),
                pa.array(np.repeat(np.array(deviations(x, n, sums), object), count).tolist(), pa.int64()),
                pa.array(w.ravel(), mask=np.tile(~real, k)), pa.array(shares * k, pa.float64()),
                pa.array(np.full(k * count, float(error)))], schema=schema)

    return fixed.select("vec_id", "x").mapInArrow(rows, names)


def whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
