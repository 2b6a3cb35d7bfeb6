"""Streaming queries over the given tables; each runs to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols
from ..session import run_folder
from ..sources import tables
from ..streaming import streams
from .base import Registry
from .views import RAW_SYMBOL, TICKS, show, sql_show

streams_queries = Registry()
add = streams_queries.add


#: Bytes of input files that one landed file takes.
LANDED_BYTES = 32 << 20


def _files(rows):
    """Files to land a table in: three, or more where each would take more than LANDED_BYTES of it."""
    read = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    size = read.agg(F.sum("size").alias("size")).first()["size"] or 0
    return max(3, -(-size // LANDED_BYTES))


def _stream(spark, folder, name):
    """A table landed as three files or more in no order, read in two batches: two thirds of the files, then the others."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    landed, files = run_folder(spark, f"landed-{name}"), _files(rows)
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(landed)
    return streams.file_stream(spark, landed, rows.schema, per_batch=files - files // 3)


def _landed_in_order(spark, folder, name, ts, files=6):
    """A table landed file after file by time, read one file a micro-batch."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    first, last = rows.select(F.unix_micros(F.min(F.col(ts).cast("timestamp"))), F.unix_micros(F.max(F.col(ts).cast("timestamp")))).first()
    part = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - first) * files / (last - first + 1)).cast("int")
    landed = run_folder(spark, f"landed-{name}")
    for i in range(files):  # the file source takes files by their time of change
        rows.filter(part == i).coalesce(1).write.mode("append").parquet(landed)
    return streams.file_stream(spark, landed, rows.schema, per_batch=1)


def _symbol():
    raw = F.lit("GLD")
    for kind, symbol in RAW_SYMBOL.items():
        raw = F.when(F.col("event_type") == kind, symbol).otherwise(raw)
    return symbols.normalize_usdt(symbols.normalize_caret(raw))


def _finish(query):
    query.awaitTermination()


@add(f"""WITH {TICKS} SELECT {sql_show('"timestamp"')} AS "timestamp", symbol, price AS close, '20240201000000' AS date_load_iso_utc FROM ticks""")
def streaming_candle_ingest(spark, folder):
    """Ticks ingested as one-row candles; the load runs twice and stays whole."""
    events = _stream(spark, folder, "events")
    value = F.col("value")
    candles = events.select(
        F.col("ts").cast("timestamp").alias("timestamp"), _symbol().alias("symbol"),
        *[value.alias(c) for c in ("open", "high", "low", "close", "volume")],
    )
    table = tables.candle_table(run_folder(spark, "stream-candles"))
    tables.create(spark, table)
    for _ in range(2):
        _finish(streams.ingest_candles(candles, table, run_folder(spark, "ingest"), F.lit("2024-02-01").cast("timestamp")))
    return tables.read(spark, table).select(show("timestamp").alias("timestamp"), "symbol", "close", "date_load_iso_utc")


@add("""SELECT DISTINCT lang AS ticker, md5("text") AS link FROM documents""")
def streaming_article_dedupe(spark, folder):
    """One row per ticker and link within the watermark."""
    docs = _stream(spark, folder, "documents")
    articles = docs.select(
        F.col("lang").alias("ticker"), F.md5("text").alias("link"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).alias("extraction_timestamp_utc"),
    )
    out = run_folder(spark, "stream-articles")
    _finish(streams.append_to(streams.unique_articles(articles, delay="3650 days"), out, run_folder(spark, "dedupe")))
    return spark.read.schema("ticker string, link string, extraction_timestamp_utc timestamp").parquet(out).select("ticker", "link")


@add(f"""WITH {TICKS}, g AS (SELECT symbol, date_trunc('day', "timestamp") AS d, count(*) AS actual FROM ticks GROUP BY 1, 2)
SELECT symbol, {sql_show('d')} AS day_start, actual FROM g WHERE d + INTERVAL 1 DAY <= (SELECT max("timestamp") FROM ticks) - INTERVAL 10 MINUTE""")
def streaming_daily_counts(spark, folder):
    """Rows per symbol and day, emitted once the watermark passed the day. Counts of a day build up over micro-batches, of
    which there are at least six: files come one by one, each a sixth of the time."""
    ticks = _landed_in_order(spark, folder, "events", "ts").select(F.col("ts").cast("timestamp").alias("timestamp"), _symbol().alias("symbol"))
    out = run_folder(spark, "stream-counts")
    _finish(streams.append_to(streams.daily_counts(ticks), out, run_folder(spark, "counts")))
    rows = spark.read.schema("symbol string, day_start timestamp, actual bigint").parquet(out)
    return rows.select("symbol", show("day_start").alias("day_start"), "actual")


@add("""SELECT 'u' || CAST(user_id AS VARCHAR) AS url, event_type AS asset_id, arg_max(value, ts) AS score FROM events GROUP BY 1, 2""")
def streaming_upsert(spark, folder):
    """Newest value per (url, asset_id), whatever the order of the files; merged batch by batch, run twice."""
    events = _stream(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("asset_id"),
        F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("ts"),
        F.pmod(F.xxhash64("user_id"), F.lit(4)).cast("string").alias("bucket"),
    )
    table = tables.Table(run_folder(spark, "stream-upsert"), "url string, asset_id string, score double, ts timestamp", ("bucket",))
    tables.create(spark, table)
    for _ in range(2):
        _finish(streams.upsert_stream(events, table, ["url", "asset_id"], lambda: F.col("ts"), run_folder(spark, "merge"), newest=True))
    return tables.read(spark, table).select("url", "asset_id", "score")


