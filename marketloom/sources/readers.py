"""Landed files to typed rows. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, markup, symbols, text

PRICE_COLUMNS = ("Open", "High", "Low", "Close", "Volume")
KLINE_ARRAY = "array<array<string>>"


def klines(pages: DataFrame, payload: str, symbol: str = "symbol") -> DataFrame:
    """Rows of a kline payload: a JSON array of positional arrays, numbers as
    strings, open time in milliseconds."""
    rows = pages.select(symbol, F.explode(F.from_json(payload, KLINE_ARRAY)).alias("k"))
    k = F.col("k")
    prices = [k[i].cast("double").alias(name) for i, name in enumerate(PRICE_COLUMNS, start=1)]
    return rows.select(
        dates.epoch_millis(k[0]).alias("timestamp"), F.col(symbol).alias("symbol"), *prices
    ).filter(F.col("timestamp").isNotNull())


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """One payload per line, in folders ``symbol=<symbol>``."""
    return klines(spark.read.schema("value string, symbol string").text(path), "value")


def wide_prices(df: DataFrame, time: str = "Datetime", symbol: str = "symbol") -> DataFrame:
    """The five price columns of whatever columns arrived."""
    present = [c for c in PRICE_COLUMNS if c in df.columns]
    return df.select(time, symbol, *[F.col(c).cast("double").alias(c) for c in present])


def read_by_header(spark: SparkSession, path: str, folder: str, names: Iterable[str]) -> DataFrame:
    """The named columns, as text, of CSV files in folders ``folder=<value>``.

    Each file is read by its own header line, which is the one with the first
    name as a field, so files may differ in their columns and in the order of
    them. A column that a file lacks is null; a file without a header is an
    error. Fields hold no line breaks.
    """
    first, *_ = names = list(names)
    lines = spark.read.schema(f"value string, `{folder}` string").text(path)
    lines = lines.select("value", folder, F.col("_metadata.file_path").alias("_file")).filter(F.trim("value") != "")
    fields = F.transform(F.split("value", ","), lambda f: F.trim(F.translate(f, '"\r\ufeff', "")))
    marked = lines.withColumn("_names", F.when(F.col("value").contains(first) & F.array_contains(fields, first), fields))
    headers = marked.filter("_names IS NOT NULL").groupBy("_file").agg(F.max("_names").alias("_header"))
    width = headers.select(F.max(F.size("_header"))).first()[0] or 1
    row = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(width))))
    values = F.array(*[F.col(f"_row.c{i}") for i in range(width)])
    rows = marked.filter("_names IS NULL").join(headers, "_file", "left").withColumn("_row", row)
    header = F.when(F.col("_header").isNull(), F.raise_error(F.concat(F.lit("no header line in "), "_file"))).otherwise(F.col("_header"))
    return rows.select(folder, *[F.get(values, F.array_position(header, n).cast("int") - 1).alias(n) for n in names])


def read_ohlcv(spark: SparkSession, path: str, time: str = "Datetime") -> DataFrame:
    """CSV, each file by its own header, in folders ``symbol=<symbol>``; extra columns drop."""
    return wide_prices(read_by_header(spark, path, "symbol", [time, *PRICE_COLUMNS]), time)


def canonical_candles(wide: DataFrame, time: str, symbol: Column, *, naive: bool) -> DataFrame:
    """Lower-case columns in the fixed order. Naive exchange times are placed in
    their zone; others are UTC already. ``symbol`` is the normalised symbol."""
    lower = wide.toDF(*[c if c == time else c.lower() for c in wide.columns])
    ts = dates.localize_to_utc(F.col(time), symbol) if naive else F.col(time).cast("timestamp")
    return lower.select(
        ts.alias("timestamp"), symbol.alias("symbol"), *[F.col(c) for c in schemas.CANDLE_COLUMNS[2:]]
    )


def observations(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.filter(F.col("date").between(start, end))


def read_observations(spark: SparkSession, path: str, start: Column, end: Column, *, form: str = "csv") -> DataFrame:
    """CSV (each file by its own header) or JSON-lines observations in folders
    ``series_id=<id>``, both bounds included. A value that is no number is null."""
    columns = [c.strip().split() for c in schemas.OBSERVATIONS.split(",")]
    if form == "csv":
        named = read_by_header(spark, path, "series_id", ["date", *[c for c, _ in columns if c != "date"]])
        raw = named.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in columns], "series_id")
    else:
        raw = spark.read.format(form).schema(f"{schemas.OBSERVATIONS}, series_id string").load(path)
    return observations(raw, start, end)


def macro_series(spark: SparkSession, extra: Iterable[tuple] = ()) -> DataFrame:
    return spark.createDataFrame([*schemas.MACRO_SERIES, *extra], schemas.MACRO_SERIES_SCHEMA)


def enrich_macro(raw: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations with their series' names, and the rows of unknown series."""
    columns = [c.split()[0] for c in schemas.MACRO.split(", ")]
    joined = raw.join(series, "series_id", "left")
    known = joined.filter(F.col("title").isNotNull())
    typed = known.withColumn("date", F.col("date").cast("timestamp")).withColumn("value", F.col("value").cast("double"))
    return typed.select(*columns), joined.filter(F.col("title").isNull()).select("series_id", "date", "value")


def market_pages(pages: DataFrame, *, max_pages: int | None = None, page_size: int | None = None) -> DataFrame:
    """Coins of all landed pages of the market list; coins without a market cap
    drop. ``max_pages`` and ``page_size`` repeat the stops of a paged request:
    pages up to the limit, or up to the first one with fewer coins."""
    wanted = F.lit(True) if max_pages is None else F.col("page") <= max_pages
    if page_size is not None:
        last = pages.filter(F.size("coins") < page_size).select(F.min("page")).scalar()
        wanted = wanted & F.coalesce(F.col("page") <= last, F.lit(True))
    coin = F.col("coin")
    return (
        pages.filter(wanted)
        .select("page", F.posexplode("coins").alias("position", "coin"))
        .filter(coin["market_cap"].isNotNull())
        .select(
            coin["id"].alias("ID"),
            F.upper(coin["symbol"]).alias("Symbol"),
            coin["name"].alias("Name"),
            coin["market_cap"].alias("Market Cap"),
            "page",
            "position",
        )
    )


def read_market_pages(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """One file per page, ``page=<n>``, each a JSON array of coins."""
    coin = "struct<id:string,symbol:string,name:string,market_cap:double>"
    raw = spark.read.schema("value string, page int").text(path, wholetext=True)
    return market_pages(raw.select("page", F.from_json("value", f"array<{coin}>").alias("coins")), **limits)


# Markup of a result card. Fixed values.
CARD_START = r"""<div[^>]*class=["'][^"']*\bNewsArticle\b[^"']*["'][^>]*>"""
CARD_FIELDS = {
    "headline": ("h4", "s-title"),
    "source": ("span", "s-source"),
    "posted": ("span", "s-time"),
    "description": ("p", "s-desc"),
}
LINK = r"""(?s)<a\b[^>]*?href=["']([^"']*)["']"""


def article_cards(
    pages: DataFrame, html: str, ticker: str, as_of: Column,
    *, start: str = CARD_START, fields: dict[str, tuple[str, str | None]] = CARD_FIELDS, link: str | None = LINK,
) -> DataFrame:
    """One row per card of every result page; ``complete`` is false when the
    card lacks an element or its link cannot be unwrapped.

    The selectors are parameters: ``start`` is the pattern a card begins with,
    ``fields`` the tag and class of each field, ``link`` the pattern whose group
    is the redirect address (None for cards without one)."""
    cards = pages.select(
        *[c for c in pages.columns if c != html],
        F.posexplode(F.slice(F.split(html, start), F.lit(2), F.size(F.split(html, start)))).alias("card_no", "card"),
    )
    card = F.col("card")
    cleaned = {"posted": text.clean_posted, "description": text.strip}
    found = {name: cleaned.get(name, lambda c: c)(markup.first_element(card, *where)) for name, where in fields.items()}
    if link is not None:
        found["link"] = text.unwrap_link(markup.decode_references(F.regexp_extract(card, link, 1)))
    parsed = cards.select(
        *[c for c in pages.columns if c not in (html, ticker)],
        "card_no",
        *[c.alias(name) for name, c in found.items()],
        F.lit(False).alias("synced"),
        as_of.alias("extraction_timestamp_utc"),
        F.col(ticker).alias("ticker"),
    )
    complete = F.lit(True)
    for name in found:
        complete = complete & F.col(name).isNotNull()
    return parsed.withColumn("complete", complete)


def accepted_cards(cards: DataFrame) -> DataFrame:
    """Cards of tickers whose cards were all complete: one broken card fails
    its ticker's whole fetch."""
    broken = cards.filter(~F.col("complete")).select("ticker").distinct()
    return cards.join(broken, "ticker", "left_anti").drop("complete")


def submissions(
    raw: DataFrame, as_of: Column, *, body_size: int | None = None, selftext_size: int | None = None, comment_count: int | None = None
) -> DataFrame:
    """Landed submissions (with nested comments, newest first) in the table's
    shape; the sizes cut comment bodies and the nested selftext, the count the
    list of comments."""
    from ..operators.windows import newest_comments

    comments = F.transform(
        F.coalesce("comments", F.array().cast(f"array<{schemas.RAW_COMMENT}>")),
        lambda c: F.struct(
            c["id"].alias("id"),
            text.author_or_deleted(c["author"]).alias("author"),
            text.clip(c["body"], body_size).alias("body"),
            c["score"].alias("score"),
            dates.epoch_seconds(c["created_utc"]).alias("created_at_utc"),
        ),
    )
    named = raw.withColumn("comments", newest_comments(comments, comment_count))
    doc = F.struct(
        F.col("title"),
        text.clip(F.col("selftext"), selftext_size).alias("selftext"),
        F.concat(F.lit("r/"), "searched_subreddit").alias("subreddit"),
        F.col("url"),
        text.asset_or_unknown(F.col("asset_id")).alias("asset_id"),
        F.col("query"),
        F.transform(
            "comments", lambda c: F.struct(c["author"].alias("author"), c["body"].alias("body"), c["created_at_utc"].alias("created_at_utc"))
        ).alias("comments"),
    )
    return named.select(
        F.sha2(F.concat_ws("\u0001", "url", "asset_id"), 256).alias("_id"),
        "subreddit", "title", "author", "author_fullname", "author_premium", "author_is_blocked",
        dates.epoch_seconds(F.col("created")).cast("timestamp_ntz").alias("created_at"),
        dates.epoch_seconds(F.col("created_utc")).alias("created_at_utc"),
        "domain", "name", "score", "url", "selftext", "num_comments", "ups", "downs",
        doc.alias("submission_dict"),
        as_of.alias("extraction_timestamp_utc"),
        "asset_id", "query", "comments",
        F.nullif("asset_binance", F.lit("")).alias("binance_asset"),
        F.nullif("asset_yfinance", F.lit("")).alias("asset_yfinance"),
        F.lit(None).cast("array<float>").alias("submission_embeddings"),
        F.lit(None).cast(schemas.SENTIMENT).alias("sentiment_score"),
    )


def read_submissions(spark: SparkSession, path: str, as_of: Column, **sizes: int | None) -> DataFrame:
    """``sizes`` are those of ``submissions``."""
    return submissions(spark.read.schema(schemas.RAW_SUBMISSION).json(path), as_of, **sizes)


def extended_candles(payload: Column) -> Column:
    """Array of candles from an extended-JSON text (``{"$date": …}`` times)."""
    element = (
        "struct<timestamp:struct<`$date`:timestamp>,symbol:string,open:double,high:double,"
        "low:double,close:double,volume:double>"
    )
    return F.transform(
        F.from_json(payload, f"array<{element}>"),
        lambda r: F.struct(
            r["timestamp"]["$date"].alias("timestamp"), *[r[c].alias(c) for c in schemas.CANDLE_COLUMNS[1:]]
        ),
    )


def read_extended_candles(spark: SparkSession, path: str) -> DataFrame:
    """Backup files, one array of candles per file. A file holds one symbol's
    day, so its size is bounded by the day's candles."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(extended_candles(F.col("value"))).alias("r")).select("r.*")


def universe(spark: SparkSession, config: dict[str, str] | None = None) -> DataFrame:
    """(asset_class, raw_symbol) from whitespace-separated symbol lists."""
    rows = list((config or schemas.UNIVERSE).items())
    lists = spark.createDataFrame(rows, "asset_class string, listed string")
    return lists.select("asset_class", F.explode(text.words(F.col("listed"))).alias("raw_symbol"))


def traded_symbols(universe_df: DataFrame, *, crypto: bool) -> DataFrame:
    """Normalised symbols of the exchange or of the crypto part."""
    if crypto:
        part = universe_df.filter("asset_class = 'BINANCE_ASSETS'")
        return part.select(symbols.normalize_usdt(F.col("raw_symbol")).alias("symbol")).distinct()
    part = universe_df.filter(F.col("asset_class").isin(*schemas.EXCHANGE_CLASSES))
    return part.select(symbols.normalize_caret(F.col("raw_symbol")).alias("symbol")).distinct()


def read_dimension(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.DIMENSIONS[name]).option("multiLine", True).json(path)


def request_plan(symbols_df: DataFrame, start: Column, end: Column, *, page_size: int = 1000) -> DataFrame:
    """Pages to request for every symbol and day of an inclusive range: minute
    candles, ``page_size`` per page; a later page starts one millisecond after
    the last open time of the page before."""
    minutes = 1440
    day = symbols_df.withColumn("day", F.explode(F.sequence(start.cast("date"), end.cast("date"))))
    paged = day.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit((minutes - 1) // page_size))))
    midnight = F.unix_millis(F.col("day").cast("timestamp"))
    last_open = (F.col("page") * page_size - 1) * F.lit(60_000)
    return paged.withColumn(
        "start_ms", F.when(F.col("page") == 0, midnight).otherwise(midnight + last_open + 1)
    ).withColumn("end_ms", midnight + F.lit(86_399_999))

