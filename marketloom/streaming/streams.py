"""Structured Streaming forms of the idempotent loads."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dml
from ..operators.skew import first_row
from ..sources import tables


def file_stream(spark: SparkSession, folder: str, schema, *, glob: str | None = None, per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


@contextmanager
def _kept(batch: DataFrame) -> Iterator[DataFrame]:
    """The rows of a micro-batch, kept while its changes are worked out."""
    rows = batch.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def ingest_candles(candles: DataFrame, table: tables.Table, checkpoint: str, as_of: Column):
    """Every micro-batch is merged into its days by symbol and time, so a day may
    be spread over any number of batches. Replaying a batch replaces its own
    rows, so a restart after a failure changes nothing."""

    def load(batch: DataFrame, _: int) -> None:
        with _kept(batch) as rows:
            tables.merge_days(rows.sparkSession, rows, table, as_of)

    return (
        candles.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def unique_articles(
    articles: DataFrame, *, ts: str = "extraction_timestamp_utc", delay: str = "1 day", slices: int = 32
) -> DataFrame:
    """First row per ticker and link among rows within the delay of each other.

    Copies are dropped per slice of a key first, so that a link repeated by a
    large part of the stream does not meet one task; at most ``slices`` rows of
    it reach the second step.
    """
    sliced = articles.withColumn("_slice", F.pmod(F.xxhash64(*articles.columns), F.lit(slices)))
    return (
        sliced.withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark(["ticker", "link", "_slice"])
        .dropDuplicatesWithinWatermark(["ticker", "link"])
        .drop("_slice")
    )


def daily_counts(candles: DataFrame, *, ts: str = "timestamp", key: str = "symbol", delay: str = "10 minutes") -> DataFrame:
    """Rows per symbol and UTC day; a day is emitted when the watermark passes
    its end, and later rows are dropped."""
    return (
        candles.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day"), key)
        .agg(F.count("*").alias("actual"))
        .select(key, F.col("window.start").alias("day_start"), "actual")
    )


def upsert_stream(
    incoming: DataFrame, table: tables.Table, keys: Sequence[str], order: Callable[[], Column], checkpoint: str,
    *, only_if_present: Sequence[str] = (), newest: bool = False,
):
    """Upsert of every micro-batch into a table. Tables partitioned by a key
    bucket rewrite only the buckets the batch touches.

    A later batch wins; under ``newest`` the row with the largest ``order`` wins
    whichever batch brings it, so that files may arrive in any order."""

    if not table.partitions:
        raise ValueError("a stream needs a partitioned table: every batch would rewrite the whole one")

    def merge(batch: DataFrame, _: int) -> None:
        with _kept(batch) as rows:
            touched = rows.select(*table.partitions).distinct()
            stored = tables.read(rows.sparkSession, table).join(touched, list(table.partitions), "left_semi")
            if newest:
                merged = first_row(stored.unionByName(rows.select(*stored.columns)), keys, order(), last=True)
            else:
                merged = dml.upsert(stored, rows, keys, order(), only_if_present=only_if_present)
            tables.rewrite(merged, table)

    return (
        incoming.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_to(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append"):
    return (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
