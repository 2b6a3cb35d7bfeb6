"""Candle, symbol and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, symbols
from ..operators import aggregates, dml, filters, setops, windows
from ..plans import market
from ..session import run_folder
from ..sources import extended, readers, tables
from .base import Registry
from .views import CANDLES, TICKS, even, hourly, show, sql_even, sql_show, table, ticks

market_queries = Registry()
add = market_queries.add

OHLCV = ["open", "high", "low", "close", "volume"]


def shown(df, *extra: str):
    return df.select(show("timestamp").alias("timestamp"), "symbol", *OHLCV, *extra)


SHOWN = f"""{sql_show('"timestamp"')} AS "timestamp", symbol, open, high, low, close, volume"""


@add(f"""WITH {TICKS}, marked AS (SELECT event_id, repeat('^', CAST(user_id % 3 AS INT)) || raw_symbol || '^' AS marked, raw_symbol FROM ticks)
SELECT event_id, marked, regexp_replace(marked, '^\\^+', '') AS no_leading_caret, replace(marked, '^', '') AS no_caret,
  regexp_replace(raw_symbol, 'USDT$', '') AS no_usdt, CASE WHEN regexp_replace(marked, '^\\^+', '') IN ('VIX', 'VIX-USD') THEN 'US/Central' ELSE 'US/Eastern' END AS zone
FROM marked""")
def symbol_normalisation(spark, folder):
    marks = F.repeat(F.lit("^"), (F.col("user_id") % 3).cast("int"))
    marked = ticks(spark, folder).withColumn("marked", F.concat(marks, "raw_symbol", F.lit("^")))
    c = F.col("marked")
    return marked.select(
        "event_id", "marked", symbols.normalize_caret(c).alias("no_leading_caret"),
        symbols.remove_carets(c).alias("no_caret"), symbols.normalize_usdt(F.col("raw_symbol")).alias("no_usdt"),
        symbols.exchange_zone(c).alias("zone"),
    )


KEY_TEXT = """
keys AS (SELECT o_orderkey, o_orderdate, CASE o_orderpriority
  WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y%m%d') WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y%m%d') || '07'
  WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y%m') || '32'
  ELSE CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y%m%d') || '0000' WHEN 'O' THEN strftime(o_orderdate, '%Y%m%d') END END AS k
  FROM orders)"""


def _date_keys(spark, folder):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", day)
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(day, F.lit("07")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("32")))
        .when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("0000")))
        .when(F.col("o_orderstatus") == "O", day)
    )
    return table(spark, folder, "orders").select("o_orderkey", "o_orderdate", text.alias("k"))


@add(f"""WITH {KEY_TEXT}, parsed AS (SELECT *, CASE WHEN length(k) = 8 THEN try_strptime(k, '%Y%m%d')
    WHEN length(k) = 10 AND regexp_matches(k, '^[0-9]+$') THEN try_strptime(k, '%Y%m%d%H') END AS ts FROM keys)
SELECT o_orderkey, k, {sql_show('ts')} AS ts, CASE WHEN k IS NULL THEN NULL WHEN NOT regexp_matches(k, '^[0-9]+$') THEN 'not a number'
    WHEN length(k) NOT IN (8, 10) THEN 'wrong length' WHEN ts IS NULL THEN 'no such date' END AS error,
  CASE WHEN k IS NULL OR NOT regexp_matches(k, '^[0-9]{{8}}$') THEN 'bad format' WHEN try_strptime(k, '%Y%m%d') IS NULL THEN 'no such date'
    WHEN CAST(try_strptime(k, '%Y%m%d') AS DATE) >= DATE '1999-06-01' THEN 'not in the past' ELSE 'ok' END AS load_status FROM parsed""")
def date_key_parsing(spark, folder):
    parsed = _date_keys(spark, folder).withColumn("p", dates.parse_date_key(F.col("k")))
    status = dates.load_date_status(F.col("k"), F.lit("1999-06-01 10:00:00").cast("timestamp"))
    return parsed.select("o_orderkey", "k", show("p.ts").alias("ts"), "p.error", status.alias("load_status"))


@add(f"""WITH {KEY_TEXT}, ranges AS (SELECT o_orderkey, k AS first_key, strftime(TIMESTAMP '1998-01-01', '%Y%m%d') AS last_key FROM keys)
SELECT o_orderkey, first_key, last_key,
  CASE WHEN first_key IS NULL OR NOT regexp_matches(first_key, '^[0-9]{{8}}$') THEN 'bad format' WHEN try_strptime(first_key, '%Y%m%d') IS NULL THEN 'no such date'
    WHEN last_key < first_key THEN 'reversed range' ELSE 'ok' END AS portfolio_status,
  CASE WHEN first_key IS NULL OR NOT regexp_matches(first_key, '^[0-9]{{8}}$') THEN 'bad format' WHEN try_strptime(first_key, '%Y%m%d') IS NULL THEN 'no such date'
    WHEN last_key < first_key THEN 'empty range' ELSE 'ok' END AS other_status FROM ranges""")
def backfill_range_check(spark, folder):
    ranges = _date_keys(spark, folder).select("o_orderkey", F.col("k").alias("first_key"), F.lit("19980101").alias("last_key"))
    first, last = F.col("first_key"), F.col("last_key")
    return ranges.withColumn("portfolio_status", dates.range_status(first, last, order_matters=True)).withColumn(
        "other_status", dates.range_status(first, last, order_matters=False)
    )


@add(f"""WITH local AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'VIX' ELSE 'SPY' END AS symbol,
    CASE WHEN o_orderstatus = 'F' THEN 'US/Central' ELSE 'US/Eastern' END AS zone,
    o_orderdate + to_minutes(60 + 30 * CAST(o_custkey % 6 AS BIGINT)) AS wall FROM orders),
z AS (SELECT *, timezone('UTC', timezone(zone, wall)) AS t FROM local),
b AS (SELECT *, timezone(zone, timezone('UTC', t)) AS back, timezone(zone, timezone('UTC', t + INTERVAL 1 HOUR)) AS plus1,
    timezone(zone, timezone('UTC', t - INTERVAL 1 HOUR)) AS minus1 FROM z)
SELECT o_orderkey, symbol, {sql_show('wall')} AS wall, {sql_show("CASE WHEN plus1 = wall OR minus1 = wall THEN NULL WHEN back <> wall THEN date_trunc('hour', t) ELSE t END")} AS utc FROM b""")
def exchange_time_to_utc(spark, folder):
    orders = table(spark, folder, "orders")
    symbol = F.when(F.col("o_orderstatus") == "F", "VIX").otherwise("SPY")
    wall = F.timestamp_seconds(F.unix_seconds("o_orderdate") + (60 + 30 * (F.col("o_custkey") % 6)) * 60)
    local = orders.select("o_orderkey", symbol.alias("symbol"), wall.alias("wall"))
    utc = dates.localize_to_utc(F.col("wall"), F.col("symbol"))
    return local.select("o_orderkey", "symbol", show("wall").alias("wall"), show(utc).alias("utc"))


@add(f"""SELECT event_id, epoch_us(ts) // 1000 AS ms, {sql_show('make_timestamp((epoch_us(ts) // 1000) * 1000)')} AS from_millis,
  {sql_show('make_timestamp((epoch_us(ts) // 1000000) * 1000000)')} AS from_seconds,
  {sql_show("date_trunc('day', ts)")} AS day_start, strftime(date_trunc('day', ts) + INTERVAL 86399999 MILLISECOND, '%Y-%m-%d %H:%M:%S.%g') AS day_end,
  strftime(ts, '%Y%m%d%H%M%S') AS load_stamp, strftime(ts - INTERVAL 7 DAY, '%Y%m%d') AS week_before, strftime(ts + INTERVAL 7 DAY, '%Y%m%d') AS week_after,
  strftime(DATE '2025-02-03' + (ts - date_trunc('day', ts)), '%Y-%m-%d %H:%M:%S.%f') AS redated FROM events""")
def epoch_and_day_windows(spark, folder):
    ts = F.col("ts")
    window = dates.day_window(F.to_date(ts), 7, 7)
    return table(spark, folder, "events").select(
        "event_id", F.unix_millis(ts).alias("ms"), show(dates.epoch_millis(F.unix_millis(ts))).alias("from_millis"),
        show(dates.epoch_seconds(F.unix_seconds(ts))).alias("from_seconds"), show(dates.day_start(ts)).alias("day_start"),
        F.date_format(dates.day_end(ts), "yyyy-MM-dd HH:mm:ss.SSS").alias("day_end"),
        dates.load_stamp(ts).alias("load_stamp"), window["start"].alias("week_before"), window["end"].alias("week_after"),
        F.date_format(dates.redate(ts, F.lit("2025-02-03").cast("date")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("redated"),
    )


@add("""WITH days AS (SELECT event_type AS symbol, unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d FROM events GROUP BY 1),
pages AS (SELECT *, unnest([0, 1]) AS page FROM days)
SELECT symbol, strftime(d, '%Y-%m-%d') AS day, CAST(page AS BIGINT) AS page,
  epoch_ms(CAST(d AS TIMESTAMP)) + CASE WHEN page = 0 THEN 0 ELSE 999 * 60000 + 1 END AS start_ms, epoch_ms(CAST(d AS TIMESTAMP)) + 86399999 AS end_ms FROM pages""")
def backfill_request_plan(spark, folder):
    events = table(spark, folder, "events")
    spans = events.groupBy(F.col("event_type").alias("symbol")).agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    plan = readers.request_plan(spans, F.col("a"), F.col("b"))
    return plan.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("page").cast("long").alias("page"), "start_ms", "end_ms")


@add(f"""WITH {TICKS}
SELECT {sql_show('"timestamp" - to_microseconds(CAST(epoch_us("timestamp") % 1000 AS BIGINT))')} AS "timestamp", regexp_replace(raw_symbol, 'USDT$', '') AS symbol,
  price AS open, price + 1 AS high, price AS low, price AS close, CAST(user_id AS DOUBLE) AS volume FROM ticks""")
def kline_payload(spark, folder):
    """Positional JSON payloads to canonical candles."""
    q = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    price = F.col("price")
    fields = [
        F.unix_millis("timestamp").cast("string"), q(price), q(price + 1), q(price), q(price), q(F.col("user_id")),
        F.lit("0"), q(F.lit(0)), F.lit("0"), q(F.lit(0)), q(F.lit(0)), q(F.lit(0)),
    ]
    payload = F.concat(F.lit("[["), F.concat_ws(",", *fields), F.lit("]]"))
    pages = ticks(spark, folder).select(F.col("raw_symbol").alias("symbol"), payload.alias("payload"))
    rows = readers.klines(pages, "payload").withColumn("symbol", symbols.normalize_usdt(F.col("symbol")))
    return shown(rows.toDF(*[c.lower() for c in rows.columns]))


@add(f"""WITH {TICKS}
SELECT {sql_show('''timezone('UTC', timezone(CASE WHEN symbol = 'VIX' THEN 'US/Central' ELSE 'US/Eastern' END, "timestamp"))''')} AS "timestamp",
  regexp_replace(raw_symbol, '^\\^+', '') AS symbol, price AS open, price AS high, price AS low, price AS close, CAST(user_id AS DOUBLE) AS volume FROM ticks""")
def exchange_candles(spark, folder):
    """Wide exchange rows with extra columns to canonical candles."""
    wide = ticks(spark, folder).select(
        F.col("timestamp").alias("Datetime"), F.col("raw_symbol").alias("symbol"), *[F.col("price").alias(c) for c in ("Open", "High", "Low", "Close")],
        F.col("user_id").alias("Volume"), F.lit(0.0).alias("Dividends"), F.lit(0.0).alias("Stock Splits"),
    )
    return shown(market.exchange_candles(readers.wide_prices(wide)))


@add(f"""WITH {TICKS}, r AS (SELECT symbol, unnest(['day', 'week', 'month']) AS unit, * EXCLUDE (symbol) FROM ticks)
SELECT symbol, unit, {sql_show('''CASE unit WHEN 'day' THEN date_trunc('day', "timestamp") WHEN 'week' THEN date_trunc('week', "timestamp") ELSE date_trunc('month', "timestamp") END''')} AS bucket,
  arg_min(price, "timestamp") AS open, max(price) AS high, min(price) AS low, arg_max(price, "timestamp") AS close,
  CAST(sum(CAST(volume AS DECIMAL(28,4))) AS DOUBLE) AS volume FROM r GROUP BY 1, 2, 3""")
def ohlcv_rollup(spark, folder):
    """Day, week and month bars: the ticks become daily bars first, and these
    few rows become all three."""
    daily = aggregates.rollup_ohlcv(ticks(spark, folder), "day", price="price").withColumnRenamed("bucket", "timestamp")
    bars = aggregates.calendar_bars(daily, ["day", "week", "month"])
    return bars.select("symbol", "unit", show("bucket").alias("bucket"), *OHLCV)


@add(f"""WITH {CANDLES}, g AS (SELECT symbol, CAST("timestamp" AS DATE) AS d, count(*) AS actual, min("timestamp") AS f, max("timestamp") AS l FROM candles GROUP BY 1, 2)
SELECT symbol, strftime(d, '%Y-%m-%d') AS day, CAST(24 AS BIGINT) AS expected, actual, 24 - actual AS missing, {sql_show('f')} AS first_ts, {sql_show('l')} AS last_ts,
  actual < 24 AND f > CAST(d AS TIMESTAMP) AS missing_at_start, actual < 24 AND l < CAST(d AS TIMESTAMP) + INTERVAL 23 HOUR AS missing_at_end FROM g""")
def candle_completeness(spark, folder):
    audit = aggregates.completeness(hourly(spark, folder), "symbol", "timestamp", expected=24, step="1 HOUR")
    return audit.select(
        "symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), "expected", "actual", "missing",
        show("first_ts").alias("first_ts"), show("last_ts").alias("last_ts"), "missing_at_start", "missing_at_end",
    )


@add(f"""WITH {TICKS}, days AS (SELECT DISTINCT symbol, CAST("timestamp" AS DATE) AS d FROM ticks),
grid AS (SELECT symbol, d, unnest(range(0, 1440)) AS slot FROM days),
seen AS (SELECT DISTINCT symbol, CAST("timestamp" AS DATE) AS d, hour("timestamp") * 60 + minute("timestamp") AS slot FROM ticks)
SELECT symbol, strftime(d, '%Y-%m-%d') AS day, slot FROM grid ANTI JOIN seen USING (symbol, d, slot)""")
def missing_minutes(spark, folder):
    gaps = aggregates.missing_slots(ticks(spark, folder), "symbol", "timestamp", slot_seconds=60)
    return gaps.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), "slot")


@add(f"""WITH {TICKS} SELECT event_id, symbol, {sql_show('"timestamp"')} AS "timestamp", price FROM ticks
QUALIFY row_number() OVER (PARTITION BY symbol, CAST("timestamp" AS DATE) ORDER BY "timestamp", event_id) <= 50""")
def day_trim(spark, folder):
    """The first rows of every symbol and day, up to the day's limit."""
    rows = windows.trim_day(ticks(spark, folder), limit=50, spread=("timestamp", "event_id"))
    return rows.select("event_id", "symbol", show("timestamp").alias("timestamp"), "price")


@add(f"""WITH {TICKS} SELECT event_id, symbol, {sql_show('"timestamp"')} AS "timestamp", price FROM ticks
WHERE symbol = 'SPY' AND "timestamp" >= TIMESTAMP '2024-01-15' AND "timestamp" < TIMESTAMP '2024-01-16'""")
def symbol_day_rows(spark, folder):
    rows = filters.symbol_day(ticks(spark, folder), "SPY", F.lit("2024-01-15").cast("date"))
    return rows.select("event_id", "symbol", show("timestamp").alias("timestamp"), "price")


LOADS = (
    CANDLES
    + """,
stored AS (SELECT * FROM candles WHERE "timestamp" < TIMESTAMP '2024-01-20'),
incoming AS (SELECT symbol, "timestamp", open + 1 AS open, high + 1 AS high, low + 1 AS low, close + 1 AS close, volume FROM candles
  WHERE "timestamp" >= TIMESTAMP '2024-01-15')"""
)


def _loads(spark, folder):
    """Stored candles before the 20th and re-priced ones from the 15th on."""
    candles = hourly(spark, folder)
    stored = candles.filter(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp"))
    incoming = candles.filter(F.col("timestamp") >= F.lit("2024-01-15").cast("timestamp"))
    return stored, incoming.withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")})


@add(f"""WITH {LOADS}, gone AS (SELECT symbol, CAST(min("timestamp") AS DATE) AS d FROM incoming GROUP BY 1),
merged AS (SELECT s.* FROM stored s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.symbol = s.symbol AND g.d = CAST(s."timestamp" AS DATE))
  UNION ALL BY NAME SELECT * FROM incoming) SELECT {SHOWN} FROM merged""")
def replace_first_day(spark, folder):
    return shown(dml.replace_days(*_loads(spark, folder), days="first"))


@add(f"""WITH {LOADS}, gone AS (SELECT DISTINCT symbol, CAST("timestamp" AS DATE) AS d FROM incoming),
merged AS (SELECT s.* FROM stored s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.symbol = s.symbol AND g.d = CAST(s."timestamp" AS DATE))
  UNION ALL BY NAME SELECT * FROM incoming) SELECT {SHOWN} FROM merged""")
def replace_all_days(spark, folder):
    return shown(dml.replace_days(*_loads(spark, folder), days="all"))


@add(f"""WITH {CANDLES} SELECT {SHOWN} FROM candles
WHERE NOT (symbol IN ('SPY', 'VIX', 'BTC') AND "timestamp" < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY)""")
def candle_retention(spark, folder):
    listed = spark.createDataFrame([("SPY",), ("VIX",), ("BTC",)], "symbol string")
    as_of = F.lit("2024-01-31").cast("timestamp")
    return shown(dml.expire(hourly(spark, folder), listed, as_of, 10))


@add(f"""WITH {CANDLES}, last AS (SELECT symbol, max(CAST("timestamp" AS DATE)) AS d FROM candles GROUP BY 1)
SELECT {SHOWN} FROM candles JOIN last USING (symbol) WHERE CAST("timestamp" AS DATE) = d""")
def last_available_day(spark, folder):
    return shown(windows.last_day_rows(hourly(spark, folder)))


@add(f"""WITH {CANDLES}, universe AS (SELECT DISTINCT symbol FROM candles UNION ALL VALUES ('QQQ'), ('USO')),
incoming AS (SELECT * FROM candles WHERE "timestamp" >= TIMESTAMP '2024-01-30' AND symbol IN ('SPY', 'BTC')),
stored AS (SELECT * FROM candles WHERE "timestamp" < TIMESTAMP '2024-01-30'),
backup AS (SELECT * REPLACE ('QQQ' AS symbol) FROM candles WHERE symbol = 'VIX' AND "timestamp" < TIMESTAMP '2024-01-02'),
missing AS (SELECT symbol FROM universe ANTI JOIN incoming USING (symbol)),
last AS (SELECT symbol, max(CAST("timestamp" AS DATE)) AS d FROM stored SEMI JOIN missing USING (symbol) GROUP BY 1),
rows AS (
  SELECT *, 'incoming' AS source_used FROM incoming
  UNION ALL BY NAME SELECT stored.* REPLACE (DATE '2024-01-30' + ("timestamp" - date_trunc('day', "timestamp")) AS "timestamp"), 'last_day' AS source_used FROM stored JOIN last USING (symbol) WHERE CAST("timestamp" AS DATE) = d
  UNION ALL BY NAME SELECT backup.* REPLACE (DATE '2024-01-30' + ("timestamp" - date_trunc('day', "timestamp")) AS "timestamp"), 'backup' AS source_used FROM backup SEMI JOIN missing USING (symbol) ANTI JOIN last USING (symbol)
  UNION ALL BY NAME SELECT symbol, 'failed' AS source_used FROM missing ANTI JOIN last USING (symbol) ANTI JOIN backup USING (symbol))
SELECT {SHOWN}, source_used FROM rows""")
def missing_symbol_fallback(spark, folder):
    """Incoming rows, else the last stored day, else the backup, else failed."""
    candles = hourly(spark, folder)
    day = F.lit("2024-01-30").cast("date")
    midnight = day.cast("timestamp")
    incoming = candles.filter((F.col("timestamp") >= midnight) & F.col("symbol").isin("SPY", "BTC"))
    stored = candles.filter(F.col("timestamp") < midnight)
    saved = candles.filter((F.col("symbol") == "VIX") & (F.col("timestamp") < F.lit("2024-01-02").cast("timestamp")))
    extra = spark.createDataFrame([("QQQ",), ("USO",)], "symbol string")
    universe = setops.symbol_union(candles.select("symbol"), extra)
    rows, failed = dml.fill_missing_symbols(universe, incoming, stored, saved.withColumn("symbol", F.replace("symbol", F.lit("VIX"), F.lit("QQQ"))), day)
    missing = failed.withColumn("source_used", F.lit("failed"))
    return shown(rows.unionByName(missing, allowMissingColumns=True), "source_used")


# Stored: days before the 20th, and VIX on the 27th; landed: SPY and FDUSD on every day, BTC on every third one.
BACKFILL = f"""
stored AS (SELECT *, CAST("timestamp" AS DATE) AS d FROM candles WHERE CAST("timestamp" AS DATE) < CASE symbol WHEN 'GLD' THEN DATE '2024-01-15' ELSE DATE '2024-01-20' END
  AND symbol NOT IN ('FDUSD', 'VIX') OR symbol = 'VIX' AND CAST("timestamp" AS DATE) = DATE '2024-01-27'),
landed AS (SELECT *, CAST("timestamp" AS DATE) AS d FROM candles WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-29'
  AND (symbol IN ('SPY', 'FDUSD') OR symbol = 'BTC' AND day("timestamp") % 3 = 0)),
backup AS (SELECT 'QQQ' AS symbol, * EXCLUDE symbol FROM candles WHERE symbol = 'SPY' AND CAST("timestamp" AS DATE) = DATE '2024-01-03'),
spine AS (SELECT symbol, CAST(d AS DATE) AS d FROM (SELECT DISTINCT symbol FROM candles UNION ALL VALUES ('QQQ'), ('USO')),
  (SELECT unnest(range(DATE '2024-01-20', DATE '2024-01-30', INTERVAL 1 DAY)) AS d)),
found AS (SELECT s.*, (SELECT max(x.d) FROM stored x WHERE x.symbol = s.symbol) AS newest, (SELECT max(x.d) FROM landed x WHERE x.symbol = s.symbol AND x.d <= s.d) AS came FROM spine s),
picked AS (SELECT *, CASE WHEN came = d THEN 'incoming' WHEN newest >= d THEN 'stored' WHEN came >= coalesce(newest, came) THEN 'incoming'
  WHEN newest IS NOT NULL THEN 'stored' WHEN symbol IN (SELECT symbol FROM backup) THEN 'backup' ELSE 'failed' END AS used FROM found),
loaded AS (
  SELECT l.* REPLACE (p.d + (l."timestamp" - date_trunc('day', l."timestamp")) AS "timestamp", p.d AS d) FROM picked p JOIN landed l ON used = 'incoming' AND l.symbol = p.symbol AND l.d = p.came
  UNION ALL BY NAME SELECT x.* REPLACE (p.d + (x."timestamp" - date_trunc('day', x."timestamp")) AS "timestamp", p.d AS d) FROM picked p JOIN stored x ON used = 'stored' AND x.symbol = p.symbol AND x.d = p.newest
  UNION ALL BY NAME SELECT b.* REPLACE (p.d + (b."timestamp" - date_trunc('day', b."timestamp")) AS "timestamp"), p.d AS d FROM picked p JOIN backup b ON used = 'backup' AND b.symbol = p.symbol),
table_rows AS (
  SELECT *, '20240201000000' AS date_load_iso_utc FROM loaded
  UNION ALL BY NAME SELECT *, '20240101000000' AS date_load_iso_utc FROM stored s WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.symbol = s.symbol AND p.d = s.d AND used <> 'failed'))"""


@add(f"""WITH {CANDLES}, {BACKFILL} SELECT {SHOWN}, date_load_iso_utc FROM table_rows""")
def candle_backfill(spark, folder):
    """Ten days of all symbols: landed rows, days carried forward from landed and stored ones, a backup, and a symbol that
    has nothing."""
    candles = hourly(spark, folder)
    day, symbol = F.to_date("timestamp"), F.col("symbol")
    until = F.when(symbol == "GLD", F.lit("2024-01-15")).otherwise(F.lit("2024-01-20")).cast("date")
    stored = candles.filter(((day < until) & ~symbol.isin("FDUSD", "VIX")) | ((symbol == "VIX") & (day == F.lit("2024-01-27").cast("date"))))
    landed = candles.filter(day.between(F.lit("2024-01-20").cast("date"), F.lit("2024-01-29").cast("date")))
    landed = landed.filter(symbol.isin("SPY", "FDUSD") | ((symbol == "BTC") & (F.day("timestamp") % 3 == 0)))
    saved, day_saved = run_folder(spark, "saved"), F.lit("2024-01-03").cast("date")
    tables.backup_day(candles.filter(symbol == "SPY").withColumn("symbol", F.lit("QQQ")), None, day_saved, saved)
    kept = tables.candle_table(run_folder(spark, "backfilled"))
    tables.create(spark, kept)
    tables.append_stamped(stored, kept, F.lit("2024-01-01").cast("timestamp"))
    universe = setops.symbol_union(candles.select("symbol"), spark.createDataFrame([("QQQ",), ("USO",)], "symbol string"))
    market.backfill_days(spark, landed, kept, universe, "20240120", "20240129", "2024-02-01", backup=saved)
    return shown(tables.read(spark, kept), "date_load_iso_utc")


@add(f"""WITH {CANDLES} SELECT {SHOWN} FROM candles WHERE CAST("timestamp" AS DATE) = DATE '2024-01-21' """)
def day_backup(spark, folder):
    """One UTC day written as JSON per symbol and read back."""
    out = run_folder(spark, "day-backup")
    tables.backup_day(hourly(spark, folder), None, F.lit("2024-01-21").cast("date"), out)
    return shown(tables.read_backup(spark, out))


@add(f"""WITH {LOADS}, gone AS (SELECT DISTINCT symbol, CAST("timestamp" AS DATE) AS d FROM incoming),
merged AS (SELECT s.* FROM stored s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.symbol = s.symbol AND g.d = CAST(s."timestamp" AS DATE))
  UNION ALL BY NAME SELECT * FROM incoming)
SELECT {SHOWN}, '20240201000000' AS date_load_iso_utc FROM merged""")
def candle_table_load(spark, folder):
    """Create the table, append the stored part, replace the incoming days, read."""
    stored, incoming = _loads(spark, folder)
    candle_table = tables.candle_table(run_folder(spark, "candles"))
    as_of = F.lit("2024-02-01").cast("timestamp")
    tables.create(spark, candle_table)
    tables.append_stamped(stored, candle_table, as_of)
    tables.load_days(spark, incoming, candle_table, as_of, days="all")
    return shown(tables.read(spark, candle_table), "date_load_iso_utc")


@add("""SELECT md5(CAST(o_orderkey AS VARCHAR)) AS _id, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS placed, o_totalprice AS total, CAST(l_linenumber AS BIGINT) AS number,
  strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS shipped, CAST(l_quantity AS DOUBLE) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def extended_documents(spark, folder):
    """Orders written as extended JSON, with wrapped ids, numbers and both forms of times in nested arrays, and read by schema."""
    wrap = lambda c, name: F.struct(c.alias(name))
    millis = lambda c: F.unix_millis(c.cast("timestamp")).cast("string")
    iso = lambda c: F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.struct(
        wrap(F.col("l_linenumber").cast("string"), "$numberInt").alias("number"),
        wrap(wrap(millis(F.col("l_shipdate")), "$numberLong"), "$date").alias("shipped"),
        wrap(F.col("l_quantity").cast("double").cast("string"), "$numberDouble").alias("quantity"),
    )
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    orders = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    document = F.to_json(F.struct(
        wrap(F.md5(F.col("o_orderkey").cast("string")), "$oid").alias("_id"), wrap(iso(F.col("o_orderdate")), "$date").alias("placed"),
        F.col("o_totalprice").alias("total"), F.struct("lines").alias("content"),
    ))
    path = run_folder(spark, "extended")
    orders.select(document.alias("value")).write.text(path)
    schema = "_id string, placed timestamp, total double, content struct<lines:array<struct<number:bigint,shipped:timestamp,quantity:double>>>"
    rows = extended.read_ejson(spark, path, schema, lines=True).select("_id", show("placed").alias("placed"), "total", F.explode("content.lines").alias("l"))
    return rows.select("_id", "placed", "total", "l.number", show("l.shipped").alias("shipped"), "l.quantity")


@add(f"""WITH {TICKS}, u AS (SELECT DISTINCT CASE WHEN raw_symbol LIKE '%USDT' THEN 'crypto' ELSE 'exchange' END AS asset_class, symbol FROM ticks)
SELECT * FROM u""")
def symbol_union(spark, folder):
    """Symbols of both asset classes as one set."""
    pairs = ticks(spark, folder).select("raw_symbol", "symbol").distinct()
    crypto = pairs.filter(F.col("raw_symbol").endswith("USDT")).select("symbol")
    exchange = pairs.filter(~F.col("raw_symbol").endswith("USDT")).select("symbol")
    return setops.concat_classes({"crypto": crypto, "exchange": exchange}).select("asset_class", "symbol").distinct()


@add(f"""WITH {TICKS}, u AS (SELECT event_type, regexp_split_to_array(trim(string_agg(raw_symbol, ' ' ORDER BY raw_symbol)), '\\s+') AS l FROM (
  SELECT DISTINCT raw_symbol, CASE WHEN raw_symbol LIKE '%USDT' THEN 'BINANCE_ASSETS' ELSE 'EQUITIES' END AS event_type FROM ticks) GROUP BY 1)
SELECT event_type AS asset_class, unnest(l) AS raw_symbol FROM u""")
def asset_universe(spark, folder):
    """Whitespace-separated symbol lists split into rows. The lists are one per
    asset class and hold distinct symbols."""
    kind = F.when(F.col("raw_symbol").endswith("USDT"), "BINANCE_ASSETS").otherwise("EQUITIES")
    listed = ticks(spark, folder).select(kind.alias("asset_class"), "raw_symbol").distinct()
    lists = listed.groupBy("asset_class").agg(F.concat_ws("  ", F.sort_array(F.collect_set("raw_symbol"))).alias("listed"))
    from ..functions.text import words

    return lists.select("asset_class", F.explode(words(F.col("listed"))).alias("raw_symbol"))


@add(f"""WITH {CANDLES}, last AS (SELECT symbol, arg_max(close, "timestamp") AS close FROM candles GROUP BY 1),
alloc AS (SELECT symbol, CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM ticks) AS DOUBLE) AS weight FROM ticks GROUP BY 1)
SELECT symbol, {sql_even('weight', 6)} AS weight, close, {sql_even('weight * close', 4)} AS weighted FROM alloc JOIN last USING (symbol)""")
def holdings_value(spark, folder):
    """Allocation weight times latest close."""
    rows = ticks(spark, folder)
    total = rows.select(F.count("*").cast("double")).scalar()
    allocation = rows.groupBy("symbol").agg(F.count("*").cast("double").alias("n")).select("symbol", (F.col("n") / total).alias("weight"))
    latest = hourly(spark, folder).groupBy("symbol").agg(F.max_by("close", "timestamp").alias("close"))
    from ..operators.joins import weighted_holdings

    held = weighted_holdings(allocation, latest, "symbol", "weight", "close")
    return held.select("symbol", even(F.col("weight"), 6).alias("weight"), "close", even(F.col("weighted"), 4).alias("weighted"))


