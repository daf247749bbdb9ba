"""The relational store: runs, pages and sources as Parquet tables in one folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.schema import RUNS, TABLES


class DuplicateKeyError(ValueError):
    """Rows with an id that the table, or the batch itself, already has."""


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema, in order and type; missing ones become NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive evolution: columns the frame lacks are appended as NULL."""
    missing = [f for f in schema.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def upsert_sources(current: DataFrame, updates: DataFrame, order: str, now: Column) -> DataFrame:
    """Replace by URL; the last update wins and a known URL keeps its ``added_at``.

    Updates are reduced to one row per URL before the join, so repeated URLs
    cost no skew.
    """
    latest = updates.groupBy("url").agg(
        F.max_by(F.struct("name", "category"), order).alias("_new"))
    joined = current.withColumn("_known", F.lit(True)).join(latest, "url", "full_outer")
    changed = F.col("_new").isNotNull()
    return joined.select(
        "url",
        F.when(changed, F.col("_new.name")).otherwise(F.col("name")).alias("name"),
        F.when(changed, F.col("_new.category")).otherwise(F.col("category")).alias("category"),
        F.when(F.col("_known"), F.col("added_at")).otherwise(now).alias("added_at"))


def filter_sources(sources: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """``(url, name, category)``; no categories, or an empty list, means all."""
    if categories:
        sources = sources.filter(F.col("category").isin(*categories))
    return sources.select("url", "name", "category")


#: Hash buckets of a table's key, small batches that are merged into one, and versions that readers may still use.
BUCKETS, MERGE_AT, KEEP_VERSIONS = 16, 8, 10
KEYS = {"runs": "id", "pages": "id", "sources": "url"}


class Store:
    """Tables under a folder that every executor can reach, with one commit per batch.

    Each batch is a folder of its own, parted by hash bucket of the key (pages also by run). A version is a small JSON file
    in ``_log`` that lists the folders, and the range of keys in each bucket. Publishing the next version
    is one atomic rename that fails when another writer was first; that writer's batch is then looked at and the
    commit tried again. So a check and its write are one step, readers see whole batches only, and a batch that was
    committed under the same id before writes nothing. Eight batches of like size are merged into one, in the
    background of a commit; folders that no recent version lists are deleted.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # ---- files and versions ----

    def _fs(self, path: str):  # noqa: ANN202 - JVM handle
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, fs.makeQualified(target)

    def _folder(self, table: str, name: str) -> str:
        return f"{self.root}/{table}/{name}"

    def _versions(self, table: str) -> list[int]:
        fs, path = self._fs(self._folder(table, "_log"))
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _state(self, table: str, version: int | None = None) -> dict:
        """What a version lists: its batches, oldest first, and the last batch number of each stream."""
        versions = self._versions(table)
        if not versions:
            return {"version": 0, "batches": [], "streams": {}}
        fs, path = self._fs(self._folder(table, f"_log/{version or versions[-1]:012d}.json"))
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, table: str, state: dict) -> bool:
        """Write a version; False when that version exists already."""
        jvm = self.spark._jvm
        fs, temp = self._fs(self._folder(table, f"_log/.{uuid.uuid4().hex}"))
        _, final = self._fs(self._folder(table, f"_log/{state['version']:012d}.json"))
        stream = fs.create(temp)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, final, none)
        except Py4JJavaError as error:
            fs.delete(temp, False)
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def _expire(self, table: str) -> None:
        """Delete old versions, and the folders that only they list."""
        versions = self._versions(table)
        old, kept = versions[:-KEEP_VERSIONS], versions[-KEEP_VERSIONS:]
        if not old:
            return
        needed = {b["folder"] for v in kept for b in self._state(table, v)["batches"]}
        for version in old:
            for folder in {b["folder"] for b in self._state(table, version)["batches"]} - needed:
                fs, path = self._fs(self._folder(table, folder))
                fs.delete(path, True)
            fs, path = self._fs(self._folder(table, f"_log/{version:012d}.json"))
            fs.delete(path, False)

    def init(self) -> None:
        """Create the folders; safe to repeat."""
        for table in TABLES:
            fs, path = self._fs(self._folder(table, "_log"))
            fs.mkdirs(path)

    # ---- batches ----

    def _write(self, table: str, rows: DataFrame) -> dict:
        """Write rows to a folder of their own that no version lists yet: its entry, with the key range of each bucket."""
        key, name = KEYS[table], f"batch={uuid.uuid4().hex}"
        parts = ["run_id", "bucket"] if table == "pages" else ["bucket"]
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        (rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions(*parts, key)
         .write.option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy(*parts).parquet(self._folder(table, name)))
        ranges = self._rows(table, [name]).groupBy("bucket").agg(
            F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).collect()
        return {"folder": name, "level": 0, "rows": sum(r.n for r in ranges),
                "buckets": {str(r.bucket): [r.low, r.high] for r in ranges}}

    def _drop(self, table: str, entry: dict) -> None:
        fs, path = self._fs(self._folder(table, entry["folder"]))
        fs.delete(path, True)

    def _rows(self, table: str, folders: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
        """Rows of batch folders, or of buckets in them, with ``batch`` and ``bucket``; columns that older files lack are NULL."""
        fields = [f for f in TABLES[table].fields if columns is None or f.name in columns or f.name == "run_id"]
        schema = T.StructType([*fields, T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())])
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
        return reader.parquet(*[self._folder(table, f) for f in folders])

    def _may_hold(self, table: str, batches: Sequence[dict], entry: dict) -> list[str]:
        """Folders of the buckets that can hold a key of the batch ``entry``, by their key ranges."""
        found = []
        for batch in batches:
            for bucket, (low, high) in entry["buckets"].items():
                mine = batch["buckets"].get(bucket)
                if mine and mine[0] <= high and low <= mine[1]:
                    runs = "run_id=*/" if table == "pages" else ""
                    found.append(f"{batch['folder']}/{runs}bucket={bucket}")
        return found

    def _known(self, table: str, batches: Sequence[dict], entry: dict) -> DataFrame | None:
        """Keys of stored rows that may equal keys of the batch; None when no file can hold one."""
        key, parts = KEYS[table], self._may_hold(table, batches, entry)
        found = [self._rows(table, parts, [key]).select(key)] if parts else []
        if (loose := self._loose(table)) is not None:
            found.append(loose.select(key))
        return reduce(DataFrame.unionAll, found) if found else None

    def _loose(self, table: str) -> DataFrame | None:
        """Rows of files that were put beside the batches, parted by run, before versions were kept."""
        fs, path = self._fs(f"{self.root}/{table}")
        if not fs.exists(path) or not any(s.getPath().getName().startswith("run_id=") for s in fs.listStatus(path)):
            return None
        rows = self.spark.read.schema(TABLES[table]).option("basePath", f"{self.root}/{table}")
        return conform(rows.parquet(f"{self.root}/{table}/run_id=*"), TABLES[table])

    def _commit(self, table: str, batch: tuple[str, int] | None,
                change: Callable[[dict, list[dict]], dict | None]) -> None:
        """Add the entry that ``change`` gives for the current version; tried again when another writer was first.

        ``change`` is called with the version's state and the batches that were added since it was called last.
        """
        seen = 0
        while True:
            state = self._state(table)
            if batch is not None and state["streams"].get(batch[0], -1) >= batch[1]:
                return
            entry = change(state, [b for b in state["batches"] if b["seq"] > seen])
            if entry is None:
                return
            seen = state["version"]
            number = seen + 1
            streams = {**state["streams"], **({batch[0]: batch[1]} if batch else {})}
            done = {"version": number, "batches": [*state["batches"], {**entry, "seq": number}], "streams": streams}
            if self._publish(table, done):
                self._merge(table)
                self._expire(table)
                return

    def _merge(self, table: str) -> None:
        """Merge the newest batches of one level into one of the next when there are enough; lost to any other writer."""
        state = self._state(table)
        last = state["batches"][-1]["level"]
        group = [b for b in state["batches"] if b["level"] == last]
        if len(group) < MERGE_AT:
            return
        folders = [b["folder"] for b in group]
        rows = self._latest(group) if table == "sources" else self._rows(table, folders).select(*TABLES[table].names)
        entry = {**self._write(table, rows), "level": last + 1, "seq": group[-1]["seq"]}
        rest = [b for b in state["batches"] if b["level"] != last]
        if not self._publish(table, {**state, "version": state["version"] + 1, "batches": [*rest, entry]}):
            self._drop(table, entry)

    # ---- tables ----

    def _latest(self, batches: Sequence[dict]) -> DataFrame:
        """Sources merged over batches: name and category of the newest, ``added_at`` of the oldest."""
        number = F.lit(0)
        for batch in batches:
            number = F.when(F.col("batch") == batch["folder"].removeprefix("batch="), batch["seq"]).otherwise(number)
        rows = self._rows("sources", [b["folder"] for b in batches]).withColumn("_seq", number)
        return rows.groupBy("url").agg(
            F.max_by(F.struct("name", "category"), "_seq").alias("_new"), F.min_by("added_at", "_seq").alias("added_at")
        ).select("url", "_new.name", "_new.category", "added_at")

    def read(self, table: str) -> DataFrame:
        """A table with its current schema; empty when nothing is stored.

        Sources are merged when they are read, newest batch first.
        """
        batches, parts = self._state(table)["batches"], []
        if batches and table == "sources":
            parts.append(self._latest(batches))
        elif batches:
            parts.append(self._rows(table, [b["folder"] for b in batches]))
        if (loose := self._loose(table)) is not None:
            parts.append(loose)
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        return reduce(DataFrame.unionAll, [conform(p, TABLES[table]) for p in parts])

    def append(self, table: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Append rows; fails and writes nothing when a key exists or repeats.

        Rows are written once, and both checks read that copy. Of the stored files only those are read whose bucket
        and key range can hold one of its keys. ``batch`` (stream, number) names a batch that may come again.
        """
        if batch is not None and self._state(table)["streams"].get(batch[0], -1) >= batch[1]:
            return
        entry, key = self._write(table, conform(rows, TABLES[table])), KEYS[table]
        own = self._rows(table, [entry["folder"]]).select(key)

        def change(state: dict, added: list[dict]) -> dict:
            known = self._known(table, added, entry)
            if known is not None and not own.join(known, key, "left_semi").isEmpty():
                raise DuplicateKeyError(f"{table}: duplicate {key}")
            return entry

        try:
            if not own.groupBy(key).count().filter("count > 1").isEmpty():
                raise DuplicateKeyError(f"{table}: duplicate {key}")
            self._commit(table, batch, change)
        except DuplicateKeyError:
            self._drop(table, entry)
            raise

    def append_new(self, table: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Append the rows whose key is not stored yet; repeats are skipped."""
        if batch is not None and self._state(table)["streams"].get(batch[0], -1) >= batch[1]:
            return
        key = KEYS[table]
        staged = self._write(table, conform(rows, TABLES[table]).dropDuplicates([key]))
        current = [staged]

        def change(state: dict, added: list[dict]) -> dict | None:
            known = self._known(table, added, current[0])
            own = self._rows(table, [current[0]["folder"]])
            if known is not None and not own.join(known, key, "left_semi").isEmpty():
                fresh = self._write(table, own.join(known, key, "left_anti").select(*TABLES[table].names))
                self._drop(table, current[0])
                current[0] = fresh
            return current[0]

        self._commit(table, batch, change)

    def insert_run(self, run_id: str, started_at: datetime, ended_at: datetime | None,
                   config: Column) -> None:
        """Append a run; ``config`` is a struct or map, stored as JSON text."""
        row = self.spark.range(1).select(
            F.lit(run_id).alias("id"), F.lit(started_at).alias("started_at"),
            F.lit(ended_at).cast("timestamp").alias("ended_at"), F.to_json(config).alias("config"))
        self.append("runs", conform(row, RUNS))

    def upsert_sources(self, updates: DataFrame, order: str, now: datetime, batch: tuple[str, int] | None = None) -> None:
        """Store updates as a batch of their own, one row per URL; what is stored already is neither read nor written."""
        if batch is not None and self._state("sources")["streams"].get(batch[0], -1) >= batch[1]:
            return
        latest = updates.groupBy("url").agg(F.max_by(F.struct("name", "category"), order).alias("_new"))
        rows = latest.select("url", "_new.name", "_new.category", F.lit(now).cast("timestamp").alias("added_at"))
        entry = self._write("sources", conform(rows, TABLES["sources"]))
        self._commit("sources", batch, lambda state, added: entry)

    def get_sources(self, categories: Sequence[str] | None = None) -> DataFrame:
        return filter_sources(self.read("sources"), categories)


def export_json(documents: DataFrame, path: str) -> None:
    """Whole documents as JSON lines, one per page."""
    documents.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
