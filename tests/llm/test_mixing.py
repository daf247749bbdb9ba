"""Source mixing against plain Python, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pageloom.llm import mixing

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, target string, key string, "
          "taken string, place string, weight string, carried string, rank string, start string, before string, _part string")


def table_rows():
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), ["a", "b", "ä", "𝒳", "z", None][i * i % 6]) for i in range(240)]
    rows += [(1000, None, "b"), (1001, "", "b"), (1002, " \t\n", "none at all"), (None, "x y", "a"), (None, "x y", "a"),
             (7, "same id other text", "a"), (7, "same id other text", "a"), (1003, "l " * 20_000, "long"), (1004, "", None),
             (1005, "v w x\x1fy　z", "ä")]
    return rows


def plain(rows, quality, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by repeated sharing of the excess, then documents one after the other."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, sizes):
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = {}
    while True:
        free = [s for s in order if s not in target]
        left = share * sum(total.values()) - sum(target.values())
        part = {s: weight[s] * left / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if part[s] > most * total[s]]
        target |= {s: most * total[s] for s in over} if over else part
        if not over:
            break

    def key(doc):
        u = (int(hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        w = quality.get(doc, 1.0)
        return -math.log(u) / w if w > 0 else math.inf

    members = defaultdict(list)
    for k, (doc, _, s) in enumerate(rows):
        members[s].append((key(doc), doc is not None, doc or 0, sizes[k], k))
    out = []
    for s, found in members.items():
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest = math.floor(target[s] - epochs * total[s])
        for *_, n, k in sorted(found):
            out.append((rows[k][0], n, total[s], target[s], epochs * n + min(n, rest)))
            rest -= min(n, rest)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *[x or 0 for x in r]))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", s, None, *["clash"] * 11) for d, t, s in table_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_mix_is_that_of_plain_sampling(spark, docs):
    quality = spark.createDataFrame([(d, w) for d in range(0, 240, 3) for w in (0.5, 2.0 if d % 2 else 0.25)],
                                    "doc_id long, weight double")
    weights = {d: 2.0 if d % 2 else 0.5 for d in range(0, 240, 3)}
    for given, known in ((None, {}), (quality, weights)):
        found = mixing.mix(docs, given).select("doc_id", "size", "source_size", "target", "taken").collect()
        expected = plain(table_rows(), known)
        for a, b in zip(ordered(map(tuple, found)), ordered(expected), strict=True):
            assert (*a[:3], a[4]) == (*b[:3], b[4]) and a[3] == pytest.approx(b[3], rel=1e-12)


def test_sources_come_near_their_targets(docs):
    by = docs.sparkSession.createDataFrame(mixing.mix(docs).collect()).groupBy("source").agg(
        F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"),
        F.max("source_size").alias("size")).collect()
    assert all(0 <= r.target - r.taken < 1 and r.over <= 0 for r in by)
    assert sum(r.target for r in by) == pytest.approx(1.5 * sum(r.size for r in by))
    assert sorted(map(str, mixing.mix(docs.repartition(2)).collect())) == sorted(map(str, mixing.mix(docs).collect()))


def test_better_documents_are_drawn_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"),
                                    F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    quality = docs.where("doc_id % 8 < 2").select("doc_id", F.lit(4.0).alias("weight"))
    never = docs.where("doc_id % 8 = 5").select("doc_id", F.lit(0.0).alias("weight"))
    found = mixing.mix(docs, quality.unionAll(never), share=0.5).where("source = 'b'").groupBy(
        (F.col("doc_id") % 8).alias("c")).agg(F.avg("taken").alias("t")).collect()
    mean = {r.c: r.t for r in found}
    assert mean[1] > 1.5 * mean[2] and mean[5] == 0


def test_texts_of_the_mix(docs):
    rows = mixing.mix(docs).where("doc_id IS NOT NULL AND doc_id <> 7").collect()
    texts = defaultdict(list)
    for r in mixing.mixed_texts(docs).collect():
        texts[r.doc_id].append((r.epoch, r.text))
    whole = {d: t for d, t, _ in table_rows()}
    for r in rows:
        mine = sorted(texts[r.doc_id])
        assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in mine) == r.taken
        assert [e for e, _ in mine] == list(range(len(mine))) and all(t == whole[r.doc_id] for _, t in mine[:r.taken // (r.size or 1)])


def test_running_totals_over_many_partitions(spark):
    rows = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 5).alias("v"))
    found = mixing.running(rows, [F.col("k")], {"t": "v"}).orderBy("k").collect()
    total = 0
    for r in found:
        assert r.t == total
        total += r.v


def test_empty_and_wordless_tables(spark, docs):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0
    blank = mixing.mix(docs.where("doc_id IN (1000, 1001, 1004)")).collect()
    assert [(r.source_size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 3
    assert mixing.mixed_texts(docs.where("doc_id IN (1000, 1001)")).count() == 0


def test_query_and_sql_agree_on_awkward_rows(spark, docs, tmp_path):
    docs.where("doc_id IS NOT NULL").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 0, None), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"
                          ).write.parquet(str(tmp_path / "labels.parquet"))
    base = duckdb.connect()
    for name in ("documents", "labels"):
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    expected = ordered(base.sql(mixing.SOURCE_MIX_SQL).fetchall())
    assert ordered(map(tuple, mixing.source_mix(spark, str(tmp_path)).collect())) == expected
