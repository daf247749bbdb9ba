"""Commits of the store: repeated and concurrent batches, files that a check reads, merging and expiry."""

from __future__ import annotations

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pageloom.schema import PAGES
from pageloom.sources import store as store_module
from pageloom.sources.store import BUCKETS, DuplicateKeyError, Store

NOW = datetime(2024, 5, 1, 12, 0, tzinfo=timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def facts(spark, ids, run="r1"):
    rows = spark.createDataFrame([(str(i), run, i) for i in ids], "id string, run_id string, fetch_ms int")
    return store_module.conform(rows, PAGES)


def sources(spark, rows):
    return spark.createDataFrame(rows, "url string, name string, category string, o long")


def files(store, table):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(f"{store.root}/{table}") for f in names if f.endswith(".parquet"))


def test_append_reads_only_files_that_can_hold_its_keys(spark, store):
    store.append("pages", facts(spark, range(1000, 1400)))
    store.append("pages", facts(spark, range(5000, 5400)))
    entry = store._write("pages", facts(spark, [1200]))
    (bucket,) = entry["buckets"]
    held = store._may_hold("pages", store._state("pages")["batches"], entry)
    assert len(held) == 1 and held[0].endswith(f"bucket={bucket}")
    read = store._known("pages", store._state("pages")["batches"], entry).inputFiles()
    assert len(read) == 1 and len(files(store, "pages")) >= 2 * BUCKETS
    assert store._known("pages", store._state("pages")["batches"], store._write("pages", facts(spark, [9]))) is None
    with pytest.raises(DuplicateKeyError):
        store.append("pages", facts(spark, [1200]))


def test_refused_batches_leave_no_files(spark, store):
    store.append("pages", facts(spark, [1, 2]))
    before = files(store, "pages")
    for ids in ([2, 3], [4, 4]):
        with pytest.raises(DuplicateKeyError):
            store.append("pages", facts(spark, ids))
    assert files(store, "pages") == before


def test_the_rows_of_a_batch_are_worked_out_once(spark, store):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = facts(spark, range(50))
    store.append("pages", rows.mapInArrow(count, rows.schema))
    assert runs.value == 50


def test_a_repeated_batch_writes_nothing(spark, store):
    updates = sources(spark, [("u1", "n", "c", 1)])
    store.upsert_sources(updates, "o", NOW, ("s", 0))
    store.append_new("pages", facts(spark, [1]), ("s", 4))
    store.append("runs", spark.createDataFrame([("a",)], "id string"), ("s", 1))
    before = {t: files(store, t) for t in ("runs", "pages", "sources")}, store._versions("sources")
    store.upsert_sources(sources(spark, [("u2", "n", "c", 1)]), "o", NOW, ("s", 0))
    store.append_new("pages", facts(spark, [2]), ("s", 3))
    store.append("runs", spark.createDataFrame([("a",)], "id string"), ("s", 1))
    assert ({t: files(store, t) for t in ("runs", "pages", "sources")}, store._versions("sources")) == before
    store.append_new("pages", facts(spark, [2]), ("s", 5))
    assert store.read("pages").count() == 2


def test_an_upsert_writes_only_its_own_buckets(spark, store):
    store.upsert_sources(sources(spark, [(f"u{i}", "n", "c", 1) for i in range(200)]), "o", NOW)
    before = set(files(store, "sources"))
    store.upsert_sources(sources(spark, [("u7", "new", "c2", 2)]), "o", NOW)
    added = set(files(store, "sources")) - before
    assert len(added) == 1 and before < set(files(store, "sources"))
    assert store.read("sources").count() == 200
    assert [r.url for r in store.get_sources(["c2"]).collect()] == ["u7"]


def test_two_writers_of_one_key(spark, store, monkeypatch):
    other = Store(spark, store.root)
    store.append("pages", facts(spark, [1]))
    real = Store._publish

    def first_the_other(self, table, state):
        monkeypatch.setattr(Store, "_publish", real)
        other.append("pages", facts(spark, [7, 8]))
        return real(self, table, state)

    monkeypatch.setattr(Store, "_publish", first_the_other)
    with pytest.raises(DuplicateKeyError):
        store.append("pages", facts(spark, [8, 9]))
    assert sorted(r.id for r in store.read("pages").collect()) == ["1", "7", "8"]
    monkeypatch.setattr(Store, "_publish", first_the_other)
    other_ids = facts(spark, [8, 9])
    monkeypatch.setattr(other, "append", lambda *a: other.append_new("pages", facts(spark, [20])))
    store.append_new("pages", other_ids)
    assert sorted(int(r.id) for r in store.read("pages").collect()) == [1, 7, 8, 9, 20]


def test_batches_are_merged_and_old_versions_expire(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "MERGE_AT", 3)
    monkeypatch.setattr(store_module, "KEEP_VERSIONS", 2)
    for n in range(10):
        when = datetime(2020 + n, 1, 1, tzinfo=timezone.utc)
        store.upsert_sources(sources(spark, [("all", f"n{n}", f"c{n}", n), (f"u{n}", "x", "c", n)]), "o", when, ("s", n))
    rows = {r.url: r for r in store.read("sources").collect()}
    assert len(rows) == 11 and (rows["all"].name, rows["all"].category, rows["all"].added_at.year) == ("n9", "c9", 2020)
    assert [rows[f"u{n}"].added_at.year for n in range(10)] == [2020 + n for n in range(10)]
    listed = {b["folder"] for v in store._versions("sources") for b in store._state("sources", v)["batches"]}
    assert len(store._versions("sources")) <= 3 and {p.split("/sources/")[1].split("/")[0] for p in files(store, "sources")} == listed
    assert len(store._state("sources")["batches"]) <= 4
    with pytest.raises(Exception):
        store._state("sources", 1)


def test_empty_batches(spark, store):
    store.append("pages", facts(spark, [1]).where("false"))
    store.append_new("pages", facts(spark, [1]).where("false"))
    store.upsert_sources(sources(spark, [("u", "n", "c", 1)]).where("false"), "o", NOW)
    assert store.read("pages").count() == 0 and store.read("sources").count() == 0
    assert store.read("pages").columns == PAGES.fieldNames()
    store.append("pages", facts(spark, [1]).withColumn("title", F.lit("t")))
    assert store.read("pages").first().title == "t"
