"""The given tables seen as market, macro, news and forum feeds, once for Spark
and once as SQL text for the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

from ..functions import symbols
from ..functions.text import asset_or_unknown
from ..operators.aggregates import rollup_ohlcv
from ..session import spread_scan


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table with its times read as instants, which keeps filters on
    them in the scan. The schema is looked up once; every lookup costs a job."""
    path = f"{folder}/{name}.parquet"
    if path not in SCHEMAS:
        found = spark.read.parquet(path).schema
        instant = lambda t: TimestampType() if isinstance(t, TimestampNTZType) else t
        SCHEMAS[path] = StructType([StructField(f.name, instant(f.dataType), f.nullable) for f in found])
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def show(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def sql_show(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def even(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def sql_even(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


# -- ticks and candles from events ------------------------------------------------

RAW_SYMBOL = {"view": "^VIX", "click": "SPY", "purchase": "BTCUSDT", "signup": "FDUSDUSDT"}


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    raw = F.lit(None).cast("string")
    case = None
    for kind, symbol in RAW_SYMBOL.items():
        case = F.when(F.col("event_type") == kind, symbol) if case is None else case.when(F.col("event_type") == kind, symbol)
    raw = case.otherwise("GLD")
    return events.select(
        "event_id", raw.alias("raw_symbol"), F.col("ts").alias("timestamp"), F.col("value").alias("price"),
        "user_id", symbols.normalize_usdt(symbols.normalize_caret(raw)).alias("symbol"),
        F.col("value").alias("volume"),
    )


TICKS = """
ticks AS (
  SELECT *, regexp_replace(regexp_replace(raw_symbol, '^\\^+', ''), 'USDT$', '') AS symbol FROM (
    SELECT event_id, CASE event_type WHEN 'view' THEN '^VIX' WHEN 'click' THEN 'SPY' WHEN 'purchase' THEN 'BTCUSDT'
      WHEN 'signup' THEN 'FDUSDUSDT' ELSE 'GLD' END AS raw_symbol,
      ts AS "timestamp", value AS price, user_id, value AS volume FROM events))"""


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly candles of the ticks."""
    return rollup_ohlcv(ticks(spark, folder), "hour", price="price").withColumnRenamed("bucket", "timestamp")


CANDLES = (
    TICKS
    + """,
candles AS (
  SELECT symbol, date_trunc('hour', "timestamp") AS "timestamp", arg_min(price, "timestamp") AS open,
    max(price) AS high, min(price) AS low, arg_max(price, "timestamp") AS close,
    CAST(sum(CAST(volume AS DECIMAL(28,4))) AS DOUBLE) AS volume
  FROM ticks GROUP BY 1, 2)"""
)


# -- market caps from orders --------------------------------------------------------


def caps(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.groupBy(
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("Date"),
        F.upper("n_name").alias("Symbol"),
        F.col("c_mktsegment").alias("Name"),
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("Market Cap"))


CAPS = """
caps AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, upper(n_name) AS symbol, c_mktsegment AS name,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cap
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""

TODAY = "2001-07-01"

# -- macro observations from orders ---------------------------------------------------

SERIES = {"F": "GDP", "O": "DFF", "P": "UNRATE"}


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per series and date; orders of low priority form an unknown series."""
    orders = table(spark, folder, "orders")
    known = (
        F.when(F.col("o_orderpriority") == "5-LOW", "OTHER")
        .when(F.col("o_orderstatus") == "F", "GDP")
        .when(F.col("o_orderstatus") == "O", "DFF")
        .otherwise("UNRATE")
    )
    return orders.groupBy(known.alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.max("o_totalprice").alias("value")
    )


OBSERVATIONS = """
obs AS (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'OTHER' WHEN o_orderstatus = 'F' THEN 'GDP'
    WHEN o_orderstatus = 'O' THEN 'DFF' ELSE 'UNRATE' END AS series_id,
    CAST(o_orderdate AS DATE) AS "date", max(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""

# -- daily returns from events ------------------------------------------------------------


def returns(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    mean = F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*")
    return events.groupBy(F.col("event_type").alias("portfolio"), F.to_date("ts").alias("date")).agg(
        (F.rint((mean - 50.0) * 10) / 100).alias("daily_return")
    )


RETURNS = """
returns AS (
  SELECT event_type AS portfolio, CAST(ts AS DATE) AS "date",
    round_even((CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) - 50.0) * 10, 0) / 100 AS daily_return
  FROM events GROUP BY 1, 2)"""


def split_returns(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(stored, supplied): stored rows exist for Monday to Wednesday, supplied
    returns for every day."""
    daily = returns(spark, folder)
    stored = daily.filter(F.weekday("date") <= 2).withColumn(
        "stored_cumulative", F.rint(F.col("daily_return") * 300) / 100
    )
    return stored, daily


SPLIT_RETURNS = (
    RETURNS
    + """,
stored AS (SELECT *, round_even(daily_return * 300, 0) / 100 AS stored_cumulative FROM returns WHERE isodow("date") <= 3),
supplied AS (SELECT * FROM returns)"""
)

# -- articles from documents ------------------------------------------------------------------


def articles(spark: SparkSession, folder: str, *, heavy: bool = False) -> DataFrame:
    """``heavy`` spreads a small input over the cores, for work on the texts."""
    docs = table(spark, folder, "documents")
    docs = spread_scan(docs) if heavy else docs
    stamp = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60)
    return docs.select(
        F.col("doc_id").alias("_id"),
        F.substring_index("text", ".", 1).alias("headline"),
        "source",
        F.col("text").alias("description"),
        F.md5("text").alias("link"),
        # Articles of one source have no extraction time.
        F.when(F.col("source") != "src3", stamp).alias("extraction_timestamp_utc"),
        F.col("lang").alias("ticker"),
    )


ARTICLES = """
articles AS (
  SELECT doc_id AS _id, split_part("text", '.', 1) AS headline, source, "text" AS description, md5("text") AS link,
    CASE WHEN source <> 'src3' THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60) END AS extraction_timestamp_utc,
    lang AS ticker FROM documents)"""


def tickers(spark: SparkSession, folder: str) -> DataFrame:
    """The mapped tickers: languages that sort before 'fr'; the rest is unmapped."""
    return table(spark, folder, "documents").filter(F.col("lang") < "fr").select(F.col("lang").alias("ticker")).distinct()


TICKERS = """
tickers AS (SELECT DISTINCT lang AS ticker FROM documents WHERE lang < 'fr')"""

# -- submissions from conversations ---------------------------------------------------------------


def conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return turns.withColumn("created", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60))


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Turn 0 is the post, the three newest later turns are its comments.

    The newest turns are picked before they are collected, so a conversation of
    any length costs three elements.
    """
    from ..operators.skew import top_k

    turns = conversation_turns(spark, folder)
    heads = turns.filter("turn = 0").select(
        "conv_id", "text", F.col("role").alias("author"), F.col("created").alias("created_at_utc")
    )
    replies = turns.filter("turn > 0")
    counts = replies.groupBy("conv_id").agg(F.count("*").alias("num_comments"))
    newest = top_k(replies, ["conv_id"], [F.col("turn").desc()], 3, spread=["turn"])
    comments = newest.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "rank",
                    F.when(F.col("role") != "system", F.col("role")).alias("author"),
                    F.col("text").alias("body"),
                    "created",
                )
            )
        ).alias("comments")
    )
    doc = F.struct(
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("selftext"),
        F.concat(F.lit("r/s"), (F.col("conv_id") % 6).cast("string")).alias("subreddit"),
        asset_or_unknown(F.when(F.col("author") == "user", F.concat(F.lit("A"), (F.col("conv_id") % 18).cast("string"))).otherwise("")).alias("asset_id"),
        F.col("comments"),
    )
    return (
        heads.join(counts, "conv_id", "left")
        .join(comments, "conv_id", "left")
        .select("conv_id", "created_at_utc", "author", F.coalesce("num_comments", F.lit(0).cast("long")).alias("num_comments"), doc.alias("submission_dict"))
    )


POSTS = """
turns AS (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS created FROM conversations),
replies AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WHERE turn > 0),
newest AS (
  SELECT conv_id, max(n) AS n,
    list({'author': coalesce(CASE WHEN role <> 'system' THEN role END, '[deleted]'), 'body': "text"} ORDER BY rn) AS comments
  FROM replies WHERE rn <= 3 GROUP BY 1),
posts AS (
  SELECT t.conv_id, t.created AS created_at_utc, t.role AS author, coalesce(n, 0) AS num_comments,
    split_part(t."text", '.', 1) AS title, t."text" AS selftext,
    'r/s' || CAST(t.conv_id % 6 AS VARCHAR) AS subreddit,
    CASE WHEN t.role = 'user' THEN 'A' || CAST(t.conv_id % 18 AS VARCHAR) ELSE 'Unknown' END AS asset_id,
    coalesce(comments, []) AS comments
  FROM turns t LEFT JOIN newest USING (conv_id) WHERE t.turn = 0)"""

# -- posts with ages from events ---------------------------------------------------------------------


def aged_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as posts of (event_type, user) assets; those of the first
    users have no asset, those of high value no creation time."""
    events = table(spark, folder, "events")
    asset = F.concat("event_type", F.lit("-"), (F.col("user_id") % 60).cast("string"))
    return events.select(
        F.col("event_id").alias("_id"),
        F.when(F.col("user_id") >= 5, asset).alias("asset_id"),
        F.when(F.col("value") < 150, F.col("ts")).alias("created_at_utc"),
        F.col("event_type").alias("subreddit"),
    )


AGED_POSTS = """
aged AS (
  SELECT event_id AS _id,
    CASE WHEN user_id >= 5 THEN event_type || '-' || CAST(user_id % 60 AS VARCHAR) END AS asset_id,
    CASE WHEN value < 150 THEN ts END AS created_at_utc, event_type AS subreddit FROM events)"""

AGED_AS_OF = "2024-01-31 00:00:00"


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """Mapped assets: those of the aged posts outside 'signup'."""
    posts_ = aged_posts(spark, folder)
    return posts_.filter("asset_id IS NOT NULL AND subreddit <> 'signup'").select("asset_id").distinct()


ASSETS = """
assets AS (SELECT DISTINCT asset_id FROM aged WHERE asset_id IS NOT NULL AND subreddit <> 'signup')"""

# -- asset mapping from nation and part --------------------------------------------------------------


def mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Asset per nation: two sources it watches and a query of two terms."""
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("asset_id"),
        F.array(
            F.concat(F.lit("src"), (key % 20).cast("string")),
            F.concat(F.lit("src"), ((key + 7) % 20).cast("string")),
        ).alias("subreddits"),
        F.when(key % 5 == 0, "the OR que").when(key % 5 == 1, "Der OR el").when(key % 5 == 2, "tion OR ing").when(key % 5 == 3, "zzzz OR und").alias("query"),
    )


MAPPING = """
mapping AS (
  SELECT n_name AS asset_id, unnest(['src' || CAST(n_nationkey % 20 AS VARCHAR), 'src' || CAST((n_nationkey + 7) % 20 AS VARCHAR)]) AS subreddit,
    CASE n_nationkey % 5 WHEN 0 THEN 'the OR que' WHEN 1 THEN 'Der OR el' WHEN 2 THEN 'tion OR ing' WHEN 3 THEN 'zzzz OR und' END AS query
  FROM nation)"""
