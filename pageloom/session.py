"""Session settings and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows of whole texts: an Arrow batch of the default 10,000 takes tens of MB outside the heap, for each task twice.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings that results depend on (UTC) and AQE."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    A session in one JVM that lacks the setting uses a folder of its warehouse; on a
    cluster a machine-local folder would lose data with the machine, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    # The application's name for itself, so that all of its frames share the folder.
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the frame to a scratch table and read it back.

    The written table survives the loss of executors, keeps plans of iterative
    jobs short, and carries a size, so later joins broadcast it only while it
    is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
