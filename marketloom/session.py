"""Session settings and the shared folder for staged output."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on; cluster sizing (executors, memory, shuffle
# partitions) is left to spark-submit so that it can grow with the data.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str, cpus: int | str = "*", **conf: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**SEMANTIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_settings(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is absent and the
    session is itself local; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = os.path.join(tempfile.gettempdir(), f"marketloom-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read back, so that their size is known and they are worked out once."""
    path = run_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_scan(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the session has cores.

    For CPU-heavy work on small inputs only: a large scan has more splits than
    cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
