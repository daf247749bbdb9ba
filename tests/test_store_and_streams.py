"""Store, telemetry and incremental jobs."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pageloom.operators.document import extract_documents
from pageloom.operators.telemetry import as_of, page_facts, percentile_by, run_summary, token_similarity
from pageloom.schema import PAGES, PAGES_BASE
from pageloom.sources.captures import read_pages, target_pool
from pageloom.sources.store import DuplicateKeyError, Store, add_missing_columns, conform, export_json
from pageloom.streaming.jobs import (
    RANK_ERROR, merged_telemetry, page_signals, rolling_telemetry, stream_documents, stream_page_facts, stream_sources,
)

NOW = datetime(2024, 5, 1, 12, 0, tzinfo=timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.init()
    made.init()
    return made


def fact(i, run="r1", **kw):
    base = dict.fromkeys(PAGES.fieldNames())
    return {**base, "id": str(i), "run_id": run, "fetch_ms": i, "scraped_at": NOW, **kw}


def facts(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in PAGES.fieldNames()) for r in rows], PAGES)


def test_empty_tables_have_their_schema(store):
    for name, columns in (("runs", 4), ("pages", 21), ("sources", 4)):
        assert store.read(name).count() == 0 and len(store.read(name).columns) == columns


def test_runs_keep_config_as_json(store):
    store.insert_run("r1", NOW, None, F.create_map(F.lit("a"), F.lit(1)))
    row = store.read("runs").first()
    assert row.id == "r1" and row.ended_at is None and json.loads(row.config) == {"a": 1}
    with pytest.raises(DuplicateKeyError):
        store.insert_run("r1", NOW, None, F.create_map(F.lit("a"), F.lit(1)))


def test_page_append_refuses_duplicates(spark, store):
    store.append("pages", facts(spark, [fact(1), fact(2, "r2")]))
    for rows in ([fact(3), fact(1)], [fact(4), fact(4)]):
        with pytest.raises(DuplicateKeyError):
            store.append("pages", facts(spark, rows))
    assert {r.id for r in store.read("pages").collect()} == {"1", "2"}
    store.append_new("pages", facts(spark, [fact(2, "r2"), fact(5)]))
    assert sorted(r.id for r in store.read("pages").collect()) == ["1", "2", "5"]
    plan = store.read("pages").filter("run_id = 'r2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_old_files_read_with_added_columns(spark, store):
    old = facts(spark, [fact(1)]).select(*PAGES_BASE.fieldNames())
    old.write.partitionBy("run_id").mode("append").parquet(f"{store.root}/pages")
    store.append("pages", facts(spark, [fact(2, language="en")]))
    assert {(r.id, r.language) for r in store.read("pages").collect()} == {("1", None), ("2", "en")}
    grown = add_missing_columns(old, PAGES)
    assert sorted(grown.columns) == sorted(PAGES.fieldNames())
    assert add_missing_columns(grown, PAGES).columns == grown.columns
    assert conform(old, PAGES).schema == PAGES


def test_source_upsert(spark, store):
    first = spark.createDataFrame([("u1", "n", "c", 1)], "url string, name string, category string, o long")
    store.upsert_sources(first, "o", datetime(2020, 1, 1, tzinfo=timezone.utc))
    more = spark.createDataFrame([("u1", "n2", "c2", 1), ("u2", "m", "c", 2), ("u2", "m2", "c", 3)],
                                 "url string, name string, category string, o long")
    for _ in range(2):
        store.upsert_sources(more, "o", NOW)
    rows = {r.url: r for r in store.read("sources").collect()}
    assert (rows["u1"].name, rows["u1"].category, rows["u1"].added_at.year) == ("n2", "c2", 2020)
    assert (rows["u2"].name, rows["u2"].added_at.year) == ("m2", 2024) and len(rows) == 2
    assert store.get_sources(None).count() == 2 and store.get_sources([]).count() == 2
    assert [r.url for r in store.get_sources(["c2"]).collect()] == ["u1"]


def test_export_and_targets(spark, small, tmp_path):
    docs = extract_documents(read_pages(spark, f"{small}/pages.parquet"))
    export_json(docs, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == docs.count() and {"markdown", "raw_html", "metadata"} <= set(lines[0])
    assert [r.label for r in target_pool(spark, [("b", "u1"), ("a", "u2")]).orderBy("ordinal").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        read_pages(spark, "x", fmt="csv")


def test_page_facts_of_failed_fetch(spark):
    pages = spark.createDataFrame([(1, "http://h/a", None), (2, "http://h/b", "<p>k</p>")],
                                  "page_id long, url string, html string")
    rows = {r.id: r for r in page_facts(extract_documents(pages), F.lit("r"), F.lit(NOW), F.lit(7),
                                        F.lit("timeout")).collect()}
    assert (rows["1"].status_code, rows["1"].html_bytes, rows["1"].error) == (0, 0, "timeout")
    assert (rows["2"].error, rows["2"].markdown_chars, rows["2"].content_type) == (None, 1, "text/html")
    assert list(rows["1"].asDict()) == PAGES.fieldNames()


def test_percentile_interpolates_like_sql(spark):
    rows = spark.createDataFrame([("a", v) for v in [1, 2, 3, 10]] + [("b", 5)], "g string, v int")
    got = {r.g: r.percentile for r in percentile_by(rows, ["g"], "v").collect()}
    assert got["a"] == pytest.approx(8.95) and got["b"] == 5
    one = run_summary(facts(spark, [fact(1), fact(3, error="x"), fact(None, fetch_ms=None)])).first()
    assert (one.total, one.success, one.avg_ms) == (3, 2, 2)


def test_as_of_with_many_rows_at_one_instant(spark):
    probes = [(i, NOW + timedelta(minutes=5 if i < 60 else i)) for i in range(100)]
    states = [(NOW + timedelta(minutes=m), f"c{m}") for m in (4, 5, 70)]
    got = as_of(spark.createDataFrame(probes, "id long, ts timestamp"),
                spark.createDataFrame(states, "ts timestamp, circuit string"), "ts", "id", ["circuit"])
    want = {i: max(((s, c) for s, c in states if s <= t), default=(None, None))[1] for i, t in probes}
    assert {r.id: r.circuit for r in got.collect()} == want
    early = as_of(spark.createDataFrame([(1, NOW)], "id long, ts timestamp"),
                  spark.createDataFrame(states, "ts timestamp, circuit string"), "ts", "id", ["circuit"])
    assert early.first().circuit is None


def test_token_similarity(spark):
    one = spark.createDataFrame([(1, "a b c d"), (2, "a a b"), (3, "")], "k long, t string")
    two = spark.createDataFrame([(1, "a c b d"), (2, "a c"), (3, "")], "k long, t string")
    got = {r.k: r.similarity for r in token_similarity(one, two, "t", "k").collect()}
    assert got == {1: 1.0, 2: pytest.approx(0.4), 3: 1.0}


def test_document_stream_equals_batch(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    inbox, out = str(tmp_path / "in"), str(tmp_path / "docs")
    for part in (pages.filter("page_id < 20"), pages.filter("page_id >= 20")):
        part.write.mode("append").parquet(inbox)
        stream = read_pages(spark, inbox, streaming=True)
        stream_documents(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = {(r.page_id, r.markdown) for r in spark.read.parquet(out).collect()}
    assert got == {(r.page_id, r.markdown) for r in extract_documents(pages).collect()}


def test_signal_stream_equals_batch(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    pages.write.parquet(str(tmp_path / "in"))
    query = (page_signals(read_pages(spark, str(tmp_path / "in"), streaming=True)).writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in page_signals(pages).collect()}


def test_source_stream_is_idempotent(spark, store, tmp_path):
    inbox = str(tmp_path / "in")
    rows = spark.createDataFrame([("u1", "n", "c", 1), ("u1", "n2", "c", 2)],
                                 "url string, name string, category string, o long")
    rows.write.parquet(inbox)
    for checkpoint in ("a", "b"):
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        stream_sources(stream, store, "o", str(tmp_path / checkpoint), now=lambda: NOW).awaitTermination()
    assert [(r.url, r.name) for r in store.read("sources").collect()] == [("u1", "n2")]


def test_fact_stream_appends_once(spark, store, tmp_path):
    inbox = str(tmp_path / "in")
    facts(spark, [fact(1), fact(2), fact(1)]).write.parquet(inbox)
    for checkpoint in ("a", "b"):
        stream = spark.readStream.schema(PAGES).parquet(inbox)
        stream_page_facts(stream, store, str(tmp_path / checkpoint)).awaitTermination()
    assert sorted(r.id for r in store.read("pages").collect()) == ["1", "2"]


def test_rolling_telemetry_stream_equals_batch(spark, tmp_path):
    rows = [fact(i, scraped_at=NOW + timedelta(minutes=i), error="x" if i % 4 == 0 else None,
                 injection_detected=i % 5 == 0) for i in range(200)]
    facts(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = rolling_telemetry(spark.readStream.schema(PAGES).parquet(str(tmp_path / "in")))
    query = (stream.writeStream.format("memory").queryName("telemetry").outputMode("complete")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    shown = ["window_start", "window_end", "total", "success", "avg_ms", "p95_ms", "injections"]
    got = {tuple(r) for r in spark.table("telemetry").select(shown).collect()}
    want = {tuple(r) for r in rolling_telemetry(facts(spark, rows)).select(shown).collect()}
    assert got == want and len(got) == 20


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    def at(minutes, i):
        return fact(i, scraped_at=NOW + timedelta(minutes=minutes))

    # Rows are late by the watermark of the batch before the last one.
    steps = [[at(0, 1), at(5, 3)], [at(300, 5)], [at(310, 8)], [at(1, 7), at(290, 9)], [at(5000, 11)]]
    for k, rows in enumerate(steps):
        facts(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (rolling_telemetry(stream).writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).start())
    query.awaitTermination()
    got = {(r.window_start.hour, r.total, r.p95_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 4 and {(n, p) for _, n, p in got} == {(1, 9), (2, 3), (1, 5), (1, 8)}


def test_merged_windows_are_those_of_all_facts(spark):
    rows = [fact(i, scraped_at=NOW + timedelta(seconds=17 * i), fetch_ms=None if i % 7 == 0 else i * 7919 % 10_007,
                 error="x" if i % 4 == 0 else None) for i in range(9000)]
    rows += [fact("n", scraped_at=NOW + timedelta(days=9), fetch_ms=None)]
    frame = facts(spark, rows)
    merged = {r.window_start: r for r in merged_telemetry(rolling_telemetry(frame), "1 day").collect()}
    direct = {r.window_start: r for r in rolling_telemetry(frame, "1 day").collect()}
    assert merged.keys() == direct.keys()
    for day, r in merged.items():
        assert (r.total, r.success, r.avg_ms, r.timed) == (direct[day].total, direct[day].success, direct[day].avg_ms, direct[day].timed)
        own = sorted(x["fetch_ms"] for x in rows if x["fetch_ms"] is not None and x["scraped_at"].date() == day.date())
        if own:
            rank = sum(v <= r.p95_ms for v in own) / len(own)
            assert abs(rank - 0.95) < 2 * RANK_ERROR
        else:
            assert r.p95_ms is None and r.avg_ms is None
