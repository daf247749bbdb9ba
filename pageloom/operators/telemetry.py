"""Run telemetry over page facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.text import has_invisible, round_to_int, space_tokens
from pageloom.functions.url import netloc
from pageloom.operators.document import content_type
from pageloom.operators.guard import has_injection, injection_score
from pageloom.operators.triage import triage
from pageloom.session import cut_lineage


def _summaries(counted: DataFrame, group: Sequence[str]) -> DataFrame:
    """Aggregates from rows reduced to one per (group, fetch_ms)."""
    return counted.groupBy(*group).agg(
        F.sum("n").alias("total"),
        F.sum("ok").alias("success"),
        (F.sum(F.col("fetch_ms").cast("double") * F.col("n_ms")) / F.sum("n_ms")).alias("_avg_ms"),
        F.percentile("fetch_ms", 0.95, F.col("n_ms")).alias("_p95"),
        (F.sum("chars") / F.sum("n_chars")).alias("_avg_chars"),
        F.sum("flagged").alias("injections"),
    )


def _reduced(pages: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per (group, fetch_ms), combined before the shuffle.

    ``fetch_ms`` is a whole number below the fetch timeout, so a run keeps a
    bounded number of rows however many pages it has; the exact percentile is
    then taken over counts.
    """
    return pages.groupBy(*group, "fetch_ms").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("fetch_ms").alias("n_ms"),
        F.count_if(F.col("error").isNull()).alias("ok"),
        F.sum(F.col("markdown_chars").cast("double")).alias("chars"),
        F.count("markdown_chars").alias("n_chars"),
        F.count_if(F.col("injection_detected")).alias("flagged"),
    )


def run_summary(pages: DataFrame) -> DataFrame:
    """Per run: pages, successes, average and 95th percentile fetch time, size, flags."""
    rows = _summaries(_reduced(pages, ["run_id"]), ["run_id"])
    return rows.select(
        "run_id", "total", "success",
        round_to_int(F.col("_avg_ms")).alias("avg_ms"), round_to_int(F.col("_p95")).alias("p95_ms"),
        round_to_int(F.col("_avg_chars")).alias("avg_chars"), "injections")


def global_summary(pages: DataFrame) -> DataFrame:
    """Over all runs: runs, pages, success percentage, fetch times, size."""
    rows = _summaries(_reduced(pages, []), [])
    # Distinct runs through a first grouping, then both one-row results side by side.
    runs = pages.groupBy("run_id").agg(F.lit(1).alias("_r")).agg(F.count("run_id").alias("runs"))
    both = rows.unionByName(runs, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return both.select(
        "runs", F.col("total").alias("pages"),
        F.round(F.try_divide(F.col("success") * 100, F.col("total")), 6).alias("success_pct"),
        round_to_int(F.col("_avg_ms")).alias("avg_ms"), round_to_int(F.col("_p95")).alias("p95_ms"),
        round_to_int(F.col("_avg_chars")).alias("avg_chars"))


def percentile_by(df: DataFrame, group: Sequence[str], value: str, q: float = 0.95) -> DataFrame:
    """Exact interpolated percentile of a whole-number column per group."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*group).agg(
        F.sum("_n").alias("n"), F.percentile(value, q, F.col("_n")).alias("percentile"))


def of_run(pages: DataFrame, run_id: str) -> DataFrame:
    """Facts of one run; prunes to its partition when stored by run."""
    return pages.filter(F.col("run_id") == run_id)


def page_facts(documents: DataFrame, run_id: Column, scraped_at: Column, fetch_ms: Column,
               error: Column | None = None, key: str = "page_id") -> DataFrame:
    """Documents as rows of the ``pages`` table.

    A page without captured HTML is a failed fetch: status 0, sizes 0 and its
    error text.
    """
    failed = F.col("raw_html").isNull()
    text = F.coalesce(F.col("markdown"), F.lit(""))
    docs = documents.withColumns({
        "title": F.col("metadata.title"), "_extra": F.col("metadata.extra"),
        "_type": F.col("metadata.content_type"), "_status": F.col("metadata.status_code")})
    docs = triage(docs)
    none = F.lit(None).cast("string")
    zero = lambda c: F.when(failed, 0).otherwise(c).cast("int")
    ok = lambda c: F.when(~failed, c)
    reason = error if error is not None else F.lit("no capture")
    return docs.select(
        F.col(key).cast("string").alias("id"), run_id.alias("run_id"), "url",
        zero(F.col("_status")).alias("status_code"), fetch_ms.cast("int").alias("fetch_ms"),
        zero(F.length("raw_html")).alias("html_bytes"), zero(F.length(text)).alias("markdown_chars"),
        zero(F.size("links")).alias("link_count"), zero(F.size("images")).alias("image_count"),
        ok(F.col("title")).alias("title"), F.when(failed, reason).alias("error"),
        (~failed & has_injection(text)).alias("injection_detected"),
        F.when(failed, 0.0).otherwise(injection_score(text)).cast("float").alias("injection_score"),
        (~failed & has_invisible(text)).alias("invisible_text"),
        scraped_at.alias("scraped_at"),
        none.alias("circuit_id"), none.alias("exit_fingerprint"), none.alias("exit_nickname"),
        ok(content_type(F.col("_extra"), F.col("_type"))).alias("content_type"),
        ok(F.col("page_type")).alias("page_type"), ok(F.col("language")).alias("language"))


def result_report(documents: DataFrame) -> DataFrame:
    """Short table of results: address, status, size, title."""
    return documents.select(
        F.substring("url", 1, 60).alias("url"),
        F.col("metadata.status_code").alias("status"),
        F.length(F.coalesce("markdown", F.lit(""))).alias("chars"),
        F.substring(F.coalesce("metadata.title", F.lit("")), 1, 30).alias("title"))


def as_of(probes: DataFrame, states: DataFrame, time: str, probe_key: str,
          state: Sequence[str]) -> DataFrame:
    """Attach to each probe the newest state at or before its time; NULLs before the first.

    Probes and states have no common key, only time. Rows are range-partitioned
    by time with the probe key as a tie-breaker, so any number of rows at one
    instant still spreads over tasks. Inside a partition the latest state is
    carried forward; the last state of each partition (one row per partition)
    is then carried into the following ones.
    """
    spark = probes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = F.struct(*[F.col(c) for c in state])
    left = probes.withColumns({"_is_probe": F.lit(1), "_tie": F.col(probe_key).cast("string"),
                               "_state": F.lit(None).cast(states.select(packed.alias("s")).schema["s"].dataType)})
    right = states.select(F.col(time), F.lit(0).alias("_is_probe"),
                          F.to_json(packed).alias("_tie"), packed.alias("_state"))
    rows = left.unionByName(right, allowMissingColumns=True)
    rows = rows.repartitionByRange(parts, time, "_is_probe", "_tie").sortWithinPartitions(
        time, "_is_probe", "_tie")
    # The id holds the partition number and the row's place in it.
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = cut_lineage(rows.withColumn("_part", F.shiftright("_at", 33)), "as-of")
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    carried = rows.withColumn("_seen", F.last("_state", ignorenulls=True).over(inside))
    ends = rows.filter(F.col("_is_probe") == 0).groupBy("_part").agg(
        F.max_by("_state", "_at").alias("_end"))
    ends = spark.range(parts).select(F.col("id").alias("_part")).join(ends, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_prior"))
    # One row per partition number.
    joined = carried.filter(F.col("_is_probe") == 1).join(F.broadcast(ends), "_part", "left")
    state_now = F.coalesce("_seen", "_prior")
    return joined.withColumn("_now", state_now).select(
        *probes.columns, *[F.col(f"_now.{c}").alias(c) for c in state])


def token_similarity(left: DataFrame, right: DataFrame, text: str, key: str) -> DataFrame:
    """Multiset Dice similarity of the tokens of two texts per key.

    ``2 * sum(min(count)) / (n + m)``; 1 when both are empty.
    """
    def counts(df: DataFrame, one: int) -> DataFrame:
        tokens = df.select(key, F.explode_outer(space_tokens(F.col(text))).alias("token"))
        present = F.when(F.col("token").isNotNull(), 1).otherwise(0)
        return tokens.select(key, "token", (present * one).alias("a"), (present * (1 - one)).alias("b"))

    both = counts(left, 1).unionByName(counts(right, 0))
    per_token = both.groupBy(key, "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return per_token.groupBy(key).agg(
        F.sum(F.least("a", "b")).alias("_shared"), F.sum(F.col("a") + F.col("b")).alias("_all")
    ).select(key, F.coalesce(F.try_divide(F.col("_shared") * 2, F.col("_all")), F.lit(1.0))
             .alias("similarity"))


def compare_texts(texts: DataFrame, base: str, key: str = "page_id") -> DataFrame:
    """Length of each text column and its similarity to the column ``base``: ``(key, extractor, chars, similarity)``.

    The tokens of all texts of a row are counted together, so texts that are grouped by their key are not shuffled again.
    """
    names = [c for c in texts.columns if c != key]

    def sided(k: int) -> Column:
        return F.transform(space_tokens(F.col(names[k])), lambda t: F.struct(t.alias("token"), F.lit(k).alias("side")))

    sides = F.flatten(F.array(*[sided(k) for k in range(len(names))]))
    lengths = F.struct(*[F.length(n).cast("bigint").alias(n) for n in names])
    # Measured before the tokens are listed: else each token's row has the whole texts, and the work grows with a page's square.
    rows = texts.select(key, lengths.alias("_chars"), sides.alias("_sides")).select(key, "_chars", F.inline_outer("_sides"))
    per_token = rows.groupBy(key, "_chars", "token").agg(*[
        F.count(F.when(F.col("side") == k, 1)).alias(f"_n{k}") for k in range(len(names))])
    own = f"_n{names.index(base)}"
    sums = per_token.groupBy(key, "_chars").agg(*[f for k in range(len(names)) for f in (
        F.sum(F.least(own, f"_n{k}")).alias(f"_shared{k}"), F.sum(F.col(own) + F.col(f"_n{k}")).alias(f"_all{k}"))])
    return sums.select(key, F.inline(F.array(*[F.struct(
        F.lit(n).alias("extractor"), F.col(f"_chars.{n}").alias("chars"),
        F.coalesce(F.try_divide(F.col(f"_shared{k}") * 2, F.col(f"_all{k}")), F.lit(1.0)).alias("similarity"))
        for k, n in enumerate(names)])))


def domain_counts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Number of domains and of URLs, as one row."""
    per_domain = urls.groupBy(netloc(F.col(url)).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return per_domain.agg(F.count(F.lit(1)).alias("domains"), F.sum("n").alias("urls"))
