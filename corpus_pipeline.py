"""Corpus pipeline: five stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.boilerplate import drop_site_lines
from pageloom.llm.encoder import word_bpe_path
from pageloom.llm.frames import small, table
from pageloom.llm.packing import pack
from pageloom.llm.simhash import one_of_each
from pageloom.llm.toxicity import keep_clean, train
from pageloom.llm.winnow import decontaminate
from pageloom.session import configure, cut_lineage, scratch_dir


# All stages: other columns, whatever their names, are passed on; a null text counts as empty; repeated rows are treated
# each by itself unless a stage says otherwise; an empty table gives an empty one. Texts are read whole.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts stay, and all do when a class has no labelled document."""
    configure(spark)
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows the text, null for null."""
    kept = drop_site_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar fingerprints: the one with the smallest ``doc_id``, a null one last.

    Texts without words are one component; of rows with one ``doc_id`` the one with the smaller text digest comes first, and of
    repeated rows any one stays.
    """
    return one_of_each(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows that share a ``doc_id`` with one that has a passage go, too."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = small(cut_lineage(found.where("contaminated").select(F.col("doc_id").alias("bad")).distinct(), "leaks"))
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.bad), "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids; an empty document is its end id."""
    return pack(docs, word_bpe_path())


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("packing", packing),
]

#: The classifier, the index of the near copies and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
