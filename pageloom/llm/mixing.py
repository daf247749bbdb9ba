"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.frames import small, table
from pageloom.session import cut_lineage

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Quality weights of labelled documents; others weigh 1.
GOOD, POOR = 2.0, 0.5
_WORD = r"[^\x20\x09-\x0D]+"


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add to each row the totals of columns over all rows before it in a total order.

    ``sums`` names for each new column the one that it adds up (nonnegative longs). Rows are range-sorted and
    written with the totals inside their partition; the totals of the partitions, one row each, are then summed
    up and sent to all. No group and no table meets in one task.
    """
    local = [f"_{name}" for name in sums]
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()),
                           *[T.StructField(name, T.LongType()) for name in local]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            new = [pa.array(np.full(batch.num_rows, part, np.int32))]
            for name, value in sums.items():
                ends = before[name] + np.cumsum(batch.column(value).to_numpy(zero_copy_only=False), dtype=np.int64)
                new.append(pa.array(np.concatenate([[before[name]], ends[:-1]]).astype(np.int64)[:len(ends)]))
                before[name] = int(ends[-1]) if len(ends) else before[name]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), "running")
    totals = placed.groupBy("_part").agg(*[
        F.max(F.col(f"_{name}") + F.col(value)).alias(name) for name, value in sums.items()])
    base = totals.selectExpr("_part", *[f"sum({name}) OVER (ORDER BY _part) - {name} AS {name}_base" for name in sums])
    return placed.join(F.broadcast(base), "_part").select(
        *rows.columns, *[(F.col(f"_{name}") + F.col(f"{name}_base")).alias(name) for name in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``start`` (sizes of the sources before it) and ``target`` of each source.

    ``sizes`` has one row (source, source_size) a source. Sources by code point, null last, weigh ``weights``, repeating,
    and share ``share`` times all sizes; a target stops at ``most`` times its source's size, and the excess goes to
    the others by weight until none is above. Every round is one aggregate over the sources; the level that they are
    filled to only rises, so there are at most as many rounds as sources, and few in practice.
    """
    rank = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()],
                   {"start": "source_size", "rank": "one"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(rank.select("source", "source_size", "start", weight.alias("weight"),
                                     (F.col("source_size") * float(most)).alias("cap")), "sources")
    total, weighed = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, held = (share * total / weighed if weighed else 0.0), 0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        n, caps, free = ranked.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("cap"))),
                                   F.sum(F.when(~above, F.col("weight")))).first()
        if n == held:
            break
        held, level = n, ((share * total - caps) / free if free else float("inf"))
    return ranked.select("source", "source_size", "start",
                         F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def exponential_key(doc_id: Column, weight: Column) -> Column:
    """Exponential variate of rate ``weight``, fixed by the id: 52 bits of its MD5 are the uniform number.

    Ascending keys draw without replacement, each next document with a probability in proportion to its weight.
    A weight that is not positive comes last, a null weight is 1.
    """
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    weight = F.coalesce(weight.cast("double"), F.lit(1.0))
    uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.when(weight > 0, -F.ln(uniform) / weight).otherwise(F.lit(float("inf")))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        most: float = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words of every document a mix of the sources takes: ``taken``, repeats counted.

    Every source's target (``source_targets``) is met by whole epochs first: as often as its documents fit in it as a
    whole, all are taken. What is left of it is sampled: documents are sorted by exponential keys scaled by their quality,
    sizes are summed along that order, and documents are taken while they fit; the one at the edge in part, so a
    source misses its target by less than a word. ``quality`` (doc_id, weight) may give some documents a weight.

    Returned are ``doc_id``, ``source``, ``size`` (words between ASCII white space), ``source_size``, ``target``,
    ``epochs`` (of the source), ``taken`` and the columns named by ``carry``, as one struct ``carried``. Keys follow from ids, so
    reruns agree. Null text has size 0; a null source is one source, a null ``doc_id`` an id like any other. Rows
    with one ``doc_id`` have one key and stand in the order of size and text digest; equal rows share in any order.
    Other columns are ignored; an empty table gives no rows.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64("text").alias("digest"), *carried)
    weight = F.lit(1.0)
    if quality is not None:
        known = quality.groupBy(F.col("doc_id").alias("weighed")).agg(F.max("weight").alias("weight"))
        rows, weight = rows.join(known, F.col("doc_id") == F.col("weighed"), "left"), F.col("weight")
    rows = cut_lineage(rows.select(
        "doc_id", "source", "size", "digest", exponential_key(F.col("doc_id"), weight).alias("key"),
        F.monotonically_increasing_id().alias("place"), *[F.col("carried")] * len(carried)), "mixing")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = cut_lineage(targets.withColumn("epochs", epochs).withColumn(
        "rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "targets")
    drawn = running(rows, [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("digest"),
                           F.col("place")], {"before": "size"}).alias("d")
    given = small(targets).alias("t")
    left = F.col("rest") - (F.col("before") - F.col("start"))
    return drawn.join(given, F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "doc_id", "d.source", "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).alias("taken"),
        *[F.col("carried")] * len(carried))


def mixed_texts(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The mix itself: ``doc_id``, ``source``, ``epoch`` (from 0) and ``text``, once for each time a document is taken.

    A document that is taken in part gives its first words, joined by blanks. Documents without words are in no epoch.
    """
    taken = mix(docs, quality, carry=("text",), **options).withColumn("text", F.col("carried.text"))
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    times = taken.where("taken > 0").withColumn("epoch", F.explode(F.sequence(
        F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")) - 1)))
    first = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, part.cast("int")), " ")
    return times.select("doc_id", "source", "epoch", F.when(F.col("epoch") < whole, F.col("text")).otherwise(first).alias("text"))


def label_quality(labels: DataFrame) -> DataFrame:
    """Quality weights (doc_id, weight) of labelled documents."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, POOR).alias("weight"))


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    quality = label_quality(table(spark, folder, "labels"))
    return mix(table(spark, folder, "documents"), quality).select("doc_id", "size", "source_size", "target", "taken")


SOURCE_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE))
      / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
q AS (SELECT doc_id AS weighed, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END)::DOUBLE AS quality FROM labels GROUP BY doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
    1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
v AS (SELECT (total - held) / free AS filled FROM r WHERE weight * ((total - held) / free) <= cap ORDER BY cap / weight, place LIMIT 1),
t AS (SELECT source, source_size, least(weight * filled, cap) AS target FROM w, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
b AS (SELECT d.doc_id, d.source, d.size, coalesce(sum(d.size) OVER (PARTITION BY d.source
    ORDER BY -ln(u) / coalesce(quality, 1.0), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d LEFT JOIN q ON d.doc_id = q.weighed)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken
FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source
"""
