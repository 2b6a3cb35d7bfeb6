"""Schemas of the tables and of the landed files."""

from __future__ import annotations

CANDLE_COLUMNS = ("timestamp", "symbol", "open", "high", "low", "close", "volume")

CANDLES = (
    "timestamp timestamp, symbol string, open double, high double, low double, close double, "
    "volume double, date_load_iso_utc string"
)
OBSERVATIONS = "realtime_start date, realtime_end date, date date, value double"
MACRO = (
    "title string, series_id string, frequency string, frequency_short string, units string, "
    "units_short string, date timestamp, value double"
)
MARKET_CAPS = (
    "Date date, Symbol string, Name string, `Market Cap` double, `Trend (%)` double, `Trend direction` string"
)
PORTFOLIO = (
    "portfolio string, date date, percentage_of_daily_return double, percentage_of_cumulative_return double"
)
SENTIMENT = "struct<positive:double,negative:double,neutral:double>"
ARTICLES = (
    "_id string, headline string, source string, posted string, description string, link string, "
    "synced boolean, extraction_timestamp_utc timestamp, ticker string, article_string string, "
    f"article_embedding array<float>, sentiment_score {SENTIMENT}"
)
COMMENT = "struct<id:string,author:string,body:string,score:bigint,created_at_utc:timestamp>"
DOC_COMMENT = "struct<author:string,body:string,created_at_utc:timestamp>"
SUBMISSION_DOC = (
    "struct<title:string,selftext:string,subreddit:string,url:string,asset_id:string,query:string,"
    f"comments:array<{DOC_COMMENT}>>"
)
SUBMISSIONS = (
    "_id string, subreddit string, title string, author string, author_fullname string, author_premium boolean, "
    "author_is_blocked boolean, created_at timestamp_ntz, created_at_utc timestamp, domain string, "
    "name string, score bigint, url string, selftext string, num_comments bigint, ups bigint, "
    f"downs bigint, submission_dict {SUBMISSION_DOC}, extraction_timestamp_utc timestamp, "
    f"asset_id string, query string, comments array<{COMMENT}>, binance_asset string, "
    f"asset_yfinance string, submission_embeddings array<float>, sentiment_score {SENTIMENT}"
)
RAW_COMMENT = "struct<id:string,author:string,body:string,score:bigint,created_utc:double>"
RAW_SUBMISSION = (
    "subreddit string, title string, author string, author_fullname string, author_premium boolean, "
    "author_is_blocked boolean, created double, created_utc double, domain string, name string, "
    "score bigint, url string, selftext string, num_comments bigint, ups bigint, downs bigint, "
    f"comments array<{RAW_COMMENT}>, searched_subreddit string, asset_id string, query string, "
    "asset_binance string, asset_yfinance string"
)
MARKET_PAGE = "page int, coins array<struct<id:string,symbol:string,name:string,market_cap:double>>"

# Dimension files, by name.
DIMENSIONS = {
    "asset_mappings": "asset_id string, asset_binance string, asset_yfinance string, asset_type string, "
    "subreddits array<string>, query string",
    "portfolio_allocation": "symbol string, allocation_percentage string, allocation_number int, "
    "allocation_decimal double, description string, asset_type string",
    "chart_mappings": "symbol string, charts struct<day:string,week:string,month:string>",
    "risk_profiles": "risk_id string, short_description string, active boolean",
    "agent_profiles": "agent_id string, profile string, role string, kind_of_data string, motive string, "
    "instructions string, rules string, goals string",
}

# Names, frequencies and units of the macro series.
MACRO_SERIES = (
    ("GDP", "Gross Domestic Product", "Quarterly", "Q", "Billions of Dollars", "Bil. of $"),
    ("DFF", "Federal Funds Effective Rate", "Daily", "D", "Percent", "%"),
    ("UNRATE", "Unemployment Rate", "Monthly", "M", "Percent", "%"),
)
MACRO_SERIES_SCHEMA = (
    "series_id string, title string, frequency string, frequency_short string, units string, units_short string"
)

# The configured symbols by asset class.
UNIVERSE = {
    "EQUITIES": "SPY QQQ EEM XLE",
    "BONDS": "TLT LQD HYG",
    "REAL_ESTATE": "VNQ",
    "COMMODITIES": "GLD USO",
    "MARKET_VOLATILITY": "^VIX",
    "MACRO_INDICATORS": "GDP DFF UNRATE",
    "BINANCE_ASSETS": "FDUSDUSDT BTCUSDT ETHUSDT USDCUSDT XRPUSDT SOLUSDT DOGEUSDT ADAUSDT",
}
EXCHANGE_CLASSES = ("EQUITIES", "BONDS", "REAL_ESTATE", "COMMODITIES", "MARKET_VOLATILITY")
