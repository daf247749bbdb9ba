"""SimHash links through an inverted index of byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.components import components
from pageloom.llm.frames import fresh, release, slices, small, table
from pageloom.session import cut_lineage

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
BYTES = 8


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words joined by blanks; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    spans = zip(starts[:len(words) - size + 1].tolist(), (ends[size - 1:] - 1).tolist())
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, BYTES)
    if len(hashes) < 64:
        sums = np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    else:
        sums = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(BYTES)])
    return int.from_bytes(np.packbits(sums * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``digest`` of the text and signed 64-bit ``fingerprint`` of every row; zero without words (null or empty text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("fingerprint", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [majority(shingle_hashes(words_of(t), shingle)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("digest"), pa.array(found, pa.int64())], schema=schema)
        release()

    return (docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
            .mapInArrow(of, "doc_id long, digest long, fingerprint long"))


# ---- exact links of 64-bit fingerprints ------------------------------------------------------------------


def link_list(members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (member, smallest reachable member) of one posting list of distinct fingerprints."""
    n = len(members)
    if n < 2:
        return members[:0], members[:0]
    values = np.sort(members)
    u = values.view(np.uint64)
    if n <= 256:
        a, b = np.triu_indices(n, 1)
        apart = u[a] ^ u[b]
        octets = apart[:, None].view(np.uint8).reshape(len(apart), BYTES)
        shared = (octets == 0).sum(1)  # the tally of bytes that both have at the same position
        keep = shared >= BYTES - max_bits
        keep &= np.bitwise_count(apart) <= max_bits
        a, b = a[keep], b[keep]
    else:
        # All members share six bytes, so a partner differs in the other two: look up each such partner.
        free = np.uint64(np.bitwise_or.reduce(u ^ u[0]))
        ones = [np.uint64(1) << np.uint64(k) for k in range(64) if int(free) >> k & 1]
        masks = [m for r in range(1, max_bits + 1) for m in map(np.bitwise_or.reduce, combinations(ones, r))]
        order = np.argsort(u)
        found_a, found_b = [], []
        for m in masks:
            want = u ^ m
            at = np.minimum(np.searchsorted(u[order], want), n - 1)
            hit = u[order][at] == want
            found_a.append(np.flatnonzero(hit))
            found_b.append(order[at[hit]])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = root != np.arange(n)
    return values[linked], values[root[linked]]


def position_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (src, dst) that join the same distinct ``fingerprint`` values as all links of at most ``max_bits``.

    Fingerprints that differ in two bits share at least six of their eight bytes in place. A posting
    list for one byte in place would hold a 256th of all fingerprints, and tallying its pairs would grow
    with their square. So the index is kept by every choice of as many positions as the tally must
    reach: two fingerprints reach it if and only if they meet in one of those 28 lists. Members of a
    list differ in the other two bytes only, hence a list has at most 65,536 distinct members, and most
    have one. Within a list pairs are tallied and verified; a list gives a spanning forest of its links,
    so at most one row for each member.
    """
    kept = list(combinations(range(BYTES), BYTES - max_bits))
    # Few rows become many here, so they are dealt out first.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = prints.select("fingerprint").repartition(parts, "fingerprint")
    masks = []
    for k, positions in enumerate(kept):
        mask = sum(0xFF << 8 * p for p in positions)
        masks.append(F.struct(F.lit(k).cast("tinyint").alias("positions"), F.col("fingerprint").bitwiseAND(
            F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("octets")))
    lists = (prints.select("fingerprint", F.inline(F.array(*masks)))
             .groupBy("positions", "octets").agg(F.collect_list("fingerprint").alias("members"))
             .where("size(members) > 1").select("members"))
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=2000):
            found = [link_list(np.array(m, np.int64), max_bits) for m in part.column("members").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], schema=schema)
        release()

    return lists.mapInArrow(links, "src long, dst long")


def _rooted(each: DataFrame, max_bits: int) -> DataFrame:
    """Every distinct fingerprint with the ``root`` of its component, written."""
    distinct = cut_lineage(each.select("fingerprint").distinct(), "fingerprints")
    roots = components(position_links(distinct, max_bits))
    return cut_lineage(distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root")), "fingerprints")


def similar_fingerprints(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``max_bits`` differing bits reach.
    Equal fingerprints are one node, whatever their number; only links between different ones are
    searched for. Texts without words (null, empty) have fingerprint zero and are linked like any other. Rows
    with equal ``doc_id`` are linked each by its own text, a null ``doc_id`` counts last, other columns
    are ignored, and an empty table gives no rows.
    """
    each = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(each, max_bits)
    first = each.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    rooted = cut_lineage(rooted.join(first, "fingerprint"), "fingerprints")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut_lineage(rooted.join(smallest, "root").select("fingerprint", "component_id"), "fingerprints")
    return each.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The documents, one row of each component of similar fingerprints: that with the smallest ``doc_id``.

    All columns are returned as they are. A null ``doc_id`` counts last; rows with one ``doc_id`` are told apart by a digest
    of their text, the smaller stays, and of rows equal in both any one. Texts without words are one component. An empty table
    gives no rows.
    """
    each = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(each, max_bits)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    first = each.groupBy("fingerprint").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    rooted = cut_lineage(rooted.join(first, "fingerprint"), "fingerprints")
    best = rooted.groupBy("root").agg(F.min("place").alias("best"), F.sum("n").alias("n")).where("n > 1")
    crowded = cut_lineage(rooted.join(best, "root").select(
        "fingerprint", F.col("best.doc_id").alias("best_id"), F.col("best.digest").alias("best_digest")), "fingerprints")
    rows = each.join(small(crowded), "fingerprint")
    is_best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("digest") == F.col("best_digest"))
    dropped = cut_lineage(rows.where(~is_best).select("doc_id", "digest").distinct(), "copies")
    repeated = cut_lineage(rows.where(is_best).groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
                           .select("doc_id", "digest"), "copies")

    def matching(found: DataFrame) -> DataFrame:
        return small(found.select(F.struct("doc_id", "digest").alias(there)))

    here, there = fresh(docs, "own"), fresh(docs, "other")
    kept = docs.withColumn(here, F.struct(F.col("doc_id"), F.xxhash64("text").alias("digest")))
    kept = kept.join(matching(dropped), F.col(here).eqNullSafe(F.col(there)), "left_anti")
    twice = kept.join(matching(repeated), F.col(here).eqNullSafe(F.col(there)), "left_semi").dropDuplicates([here])
    alone = kept.join(matching(repeated), F.col(here).eqNullSafe(F.col(there)), "left_anti")
    return alone.unionByName(twice).drop(here)


def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return similar_fingerprints(table(spark, folder, "documents"))
