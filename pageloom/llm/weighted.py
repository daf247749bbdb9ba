"""Document fingerprints by consistent weighted sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.frames import table

SAMPLES, TOGETHER = 32, 8
# Counting the words of a range takes some thirty times the space of its text, so ranges are that much smaller.
FINER = 8
_FINE = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIRST = -(1 << 63)


def _uniform(bits: Column, shift: int) -> Column:
    """A number between 0 and 1 from 21 bits of a hash."""
    return (F.shiftright(bits, shift).bitwiseAND(F.lit((1 << 21) - 1).cast("long")) + 0.5) / float(1 << 21)


def gamma_sample(term: Column, weight: Column, number: Column) -> Column:
    """One consistent weighted sample of a term, as a long whose minimum over the terms is the sample drawn.

    With r and c gamma(2, 1) and b uniform, all fixed by the term and the sample's number, the weight S
    falls in step t = floor(ln S / r + b), and the term with the smallest ln c - r (t - b + 1) is drawn.
    Texts draw the same (term, t) with a probability of their generalised Jaccard similarity. The
    high half of the result orders, the low half names term and step.
    """
    one, two = F.xxhash64(term, number * 2), F.xxhash64(term, number * 2 + 1)
    r = -F.ln(_uniform(one, 0) * _uniform(one, 21))
    c = -F.ln(_uniform(one, 42) * _uniform(two, 0))
    b = _uniform(two, 21)
    t = F.floor(F.ln(weight) / r + b)
    order = F.floor((F.ln(c) - r * (t - b + 1) + 128) * float(1 << 22))
    name = F.xxhash64(one, t).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(order, 32).bitwiseOR(name)


def in_order(docs: DataFrame) -> DataFrame:
    """Every document beside the text of the next by ``doc_id``; the last is followed by the first.

    Ids are cut at their quantiles into ranges of about equal size; a range that follows another lends it its
    first document (``lent``), so that a window over each range sees every successor. One shuffle, into
    ``FINER`` times the session's partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * FINER
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("doc_id", F.lit(_FIRST)).alias("place"))
    found = rows.agg(F.min("place").alias("low"), F.percentile_approx(
        "place", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts")).first()
    cuts = sorted({found.low, *found.cuts}) if found.low is not None else [0]
    blocks = [cuts[i:i + _FINE] for i in range(0, len(cuts), _FINE)]
    coarse = F.array([F.lit(b[0]).cast("long") for b in blocks])
    fine = F.array([F.array([F.lit(x).cast("long") for x in b]) for b in blocks])
    ranged = rows.withColumn("block", F.size(F.filter(coarse, lambda x: x <= F.col("place")))).withColumn(
        "cell", F.size(F.filter(F.element_at(fine, F.col("block")), lambda x: x <= F.col("place"))))
    part = (F.col("block") - 1) * _FINE + F.col("cell") - 1
    own = F.struct(part.alias("part"), F.lit(False).alias("lent"))
    lent = F.struct(((part + len(cuts) - 1) % len(cuts)).alias("part"), F.lit(True).alias("lent"))
    first = F.element_at(F.element_at(fine, F.col("block")), F.col("cell")) == F.col("place")
    spread = ranged.select("doc_id", "text", "place", F.inline(
        F.when(first, F.array(own, lent)).otherwise(F.array(own))))
    along = Window.partitionBy("part").orderBy("lent", "place", F.xxhash64("text"))
    return spread.repartition(parts, "part").select("part", "doc_id", "text", "lent", F.row_number().over(along).alias("row"),
                         F.lead("text", 1, "").over(along).alias("next_text"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without terms are alike, one alone is not."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / float(SAMPLES)
    return F.when(both, same).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by as many first ones of the next document by
    ascending ``doc_id`` (or all of it). Terms are the words between white space, A-Z in lower case, and
    their weights the counts in the text. All steps after the one shuffle keep its partitioning: words
    are counted, samples drawn and fingerprints put together and compared with the next document's inside the
    range of a document, and every one has partial aggregation.

    Null text is empty; a text without words has an empty fingerprint, alike to another such one only.
    Rows with equal ``doc_id`` follow each other by a digest of their text; a null ``doc_id`` comes
    first. A lone document is followed by itself. Other columns are ignored; an empty table gives no rows.
    """
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter),
                      F.substring("next_text", F.lit(1), quarter))
    rows = in_order(docs).withColumn("edited", edited)
    facts = F.struct("doc_id", "lent", F.length("text").cast("long").alias("n_chars"),
                     F.sha2("edited", 256).alias("edited_sha256"))
    nothing = F.lit(None).cast("struct<doc_id:bigint,lent:boolean,n_chars:bigint,edited_sha256:string>")
    views = rows.select("part", "row", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("body"), nothing.alias("facts")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("body"), nothing.alias("facts")),
        F.struct(F.lit(2).alias("side"), F.lit(" x").alias("body"), facts.alias("facts")))))
    words = views.select("part", "row", "side", "facts", F.explode(
        F.split(F.translate("body", _UPPER, _LOWER), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counts = (words.groupBy("part", "row", "side", "facts", F.xxhash64("word").alias("term"))
              .agg(F.count("*").alias("weight")))
    groups = counts.withColumn("block", F.explode(F.array([F.lit(i) for i in range(SAMPLES // TOGETHER)])))
    drawn = groups.groupBy("part", "row", "side", "facts", "block").agg(*[
        F.min(gamma_sample(F.col("term"), F.col("weight"), F.col("block") * TOGETHER + i)).alias(f"s{i}")
        for i in range(TOGETHER)])
    names = F.array(*[F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(TOGETHER)])
    put = drawn.groupBy("part", "row").agg(
        F.max("facts").alias("facts"), F.sort_array(F.collect_list(F.struct("side", "block", names.alias("s")))).alias("all"))

    def side(k: int) -> Column:
        return F.flatten(F.transform(F.filter("all", lambda x: x["side"] == k), lambda x: x["s"]))

    sided = put.select("part", "row", "facts", side(0).alias("own"), side(1).alias("changed"))
    along = Window.partitionBy("part").orderBy("row")
    beside = sided.withColumn("following", F.lead("own").over(along)).where("NOT facts.lent")

    def text(samples: str) -> Column:
        return F.concat_ws("", F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))))

    return beside.select(
        "facts.doc_id", "facts.n_chars", "facts.edited_sha256", text("own").alias("fingerprint"),
        text("changed").alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))


def weighted_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(table(spark, folder, "documents"))
