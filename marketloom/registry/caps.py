"""Market-cap, macro and portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import round_cents, trend_direction
from ..operators import aggregates, dml, joins, setops, skew, windows
from ..plans import caps as caps_plan
from ..plans import macro as macro_plan
from ..plans import portfolio as portfolio_plan
from ..session import run_folder
from ..sources import readers, tables
from .base import Registry
from .views import (
    CAPS, OBSERVATIONS, RETURNS, SPLIT_RETURNS, TODAY, caps, even, observations, returns, split_returns, sql_even, table,
)

caps_queries = Registry()
add = caps_queries.add

DAY = lambda c: F.date_format(c, "yyyy-MM-dd")


def _today():
    return F.lit(TODAY).cast("date")


def _history(spark, folder):
    """Stored snapshots before the day; one segment has never been stored."""
    return caps(spark, folder).filter((F.col("Date") < _today()) & (F.col("Name") != "MACHINERY"))


def _fetched(spark, folder):
    return caps(spark, folder).filter(F.col("Date") == _today()).drop("Date")


SNAPSHOT = (
    CAPS
    + f""",
history AS (SELECT * FROM caps WHERE d < DATE '{TODAY}' AND name <> 'MACHINERY'),
fetched AS (SELECT * FROM caps WHERE d = DATE '{TODAY}'),
last AS (SELECT * FROM history WHERE d = (SELECT max(d) FROM history)),
priced AS (SELECT f.symbol, f.name, f.cap, coalesce(l.cap, f.cap) AS before,
  round_even((f.cap - coalesce(l.cap, f.cap)) / nullif(coalesce(l.cap, f.cap), 0) * 100 * 100, 0) / 100 AS trend
  FROM fetched f LEFT JOIN last l ON f.symbol = l.symbol AND f.name = l.name),
sums AS (SELECT CAST(sum(CAST(cap AS DECIMAL(28,2))) AS DOUBLE) AS n, CAST(sum(CAST(before AS DECIMAL(28,2))) AS DOUBLE) AS b FROM priced),
total AS (SELECT n, CASE WHEN b > 0 THEN (n - b) / b * 100 ELSE 0 END AS t FROM sums),
snap AS (
  SELECT 'ALL_STABLECOINS' AS symbol, 'All Stablecoins' AS name, n AS market_cap, round_even(t * 100, 0) / 100 AS trend_pct,
    CASE WHEN t = 0 THEN 'equal' WHEN t > 0 THEN 'up' ELSE 'down' END AS trend_direction FROM total
  UNION ALL
  SELECT symbol, name, cap, trend, CASE WHEN trend IS NULL OR trend = 0 THEN 'equal' WHEN trend > 0 THEN 'up' ELSE 'down' END
  FROM priced WHERE (symbol, name) IN (SELECT symbol, name FROM history))"""
)


def _named(df):
    return df.select(
        DAY("Date").alias("snapshot_date"), F.col("Symbol").alias("symbol"), F.col("Name").alias("name"),
        F.col("Market Cap").alias("market_cap"), F.col("`Trend (%)`").alias("trend_pct"),
        F.col("`Trend direction`").alias("trend_direction"),
    )


@add(f"WITH {SNAPSHOT} SELECT '{TODAY}' AS snapshot_date, * FROM snap ORDER BY market_cap DESC")
def market_cap_snapshot(spark, folder):
    """The day's market caps with trends and the grand total."""
    return _named(caps_plan.snapshot(_fetched(spark, folder), _history(spark, folder), _today()))


@add(f"WITH {SNAPSHOT} SELECT '{TODAY}' AS snapshot_date, * FROM snap UNION ALL SELECT strftime(d, '%Y-%m-%d'), symbol, name, cap, NULL, NULL FROM history")
def market_cap_table_load(spark, folder):
    """Store the history, append the day's snapshot, and try to append it again."""
    stored = tables.Table(run_folder(spark, "caps"), "Date date, Symbol string, Name string, `Market Cap` double, `Trend (%)` double, `Trend direction` string")
    tables.create(spark, stored)
    history = _history(spark, folder).withColumn("Trend (%)", F.lit(None).cast("double")).withColumn("Trend direction", F.lit(None).cast("string"))
    tables.append(history, stored)
    fetched = _fetched(spark, folder)
    caps_plan.store_snapshot(spark, fetched, stored, _today())
    caps_plan.store_snapshot(spark, fetched, stored, _today())
    return _named(tables.read(spark, stored))


@add(f"WITH {CAPS} SELECT symbol, name, strftime(d, '%Y-%m-%d') AS snapshot_date, cap AS market_cap FROM caps WHERE d = (SELECT max(d) FROM caps)")
def latest_market_caps(spark, folder):
    rows = aggregates.latest_snapshot(caps(spark, folder), "Date")
    return rows.select(F.col("Symbol").alias("symbol"), F.col("Name").alias("name"), DAY("Date").alias("snapshot_date"), F.col("Market Cap").alias("market_cap"))


@add(f"WITH {CAPS} SELECT DISTINCT symbol, name FROM caps WHERE symbol IS DISTINCT FROM 'NATION_3'")
def coins_seen(spark, folder):
    pairs = aggregates.distinct_pairs(caps(spark, folder), ("Symbol", "NATION_3"), ["Symbol", "Name"])
    return pairs.select(F.col("Symbol").alias("symbol"), F.col("Name").alias("name"))


@add(f"WITH {CAPS}, base AS (SELECT DISTINCT symbol, name FROM caps WHERE d < DATE '1996-01-01') SELECT caps.symbol, caps.name, strftime(d, '%Y-%m-%d') AS snapshot_date, cap AS market_cap FROM caps SEMI JOIN base USING (symbol, name)")
def known_coins_only(spark, folder):
    rows = caps(spark, folder)
    early = rows.filter(F.col("Date") < F.lit("1996-01-01").cast("date"))
    kept = joins.only_known(rows, early, ["Symbol", "Name"])
    return kept.select(F.col("Symbol").alias("symbol"), F.col("Name").alias("name"), DAY("Date").alias("snapshot_date"), F.col("Market Cap").alias("market_cap"))


@add(f"""WITH {CAPS}, h AS (SELECT *, lag(cap) OVER (PARTITION BY symbol, name ORDER BY d) AS previous FROM caps)
SELECT symbol, name, strftime(d, '%Y-%m-%d') AS snapshot_date, cap AS market_cap, previous, round_even((cap - previous) / nullif(previous, 0) * 100 * 100, 0) / 100 AS trend_pct,
  CASE WHEN previous IS NULL OR previous = 0 OR cap = previous THEN 'equal' WHEN cap > previous THEN 'up' ELSE 'down' END AS trend_direction FROM h""")
def market_cap_history_trend(spark, folder):
    """Change against the previous snapshot over the whole history."""
    rows = windows.snapshot_trend(caps(spark, folder), ["Symbol", "Name"])
    return rows.select(
        F.col("Symbol").alias("symbol"), F.col("Name").alias("name"), DAY("Date").alias("snapshot_date"),
        F.col("Market Cap").alias("market_cap"), "previous", round_cents(F.col("change")).alias("trend_pct"),
        trend_direction(F.col("change")).alias("trend_direction"),
    )


@add(f"WITH {CAPS} SELECT strftime(d, '%Y-%m-%d') AS snapshot_date, symbol, name, cap AS market_cap FROM caps WHERE d NOT IN (SELECT d FROM caps WHERE symbol = 'NATION_3' AND month(d) <= 6)")
def snapshots_if_absent(spark, folder):
    """Snapshots of dates on which nothing was stored."""
    rows = caps(spark, folder)
    stored = rows.filter((F.col("Symbol") == "NATION_3") & (F.month("Date") <= 6))
    new = dml.snapshot_if_absent(stored, rows, "Date")
    return new.select(DAY("Date").alias("snapshot_date"), F.col("Symbol").alias("symbol"), F.col("Name").alias("name"), F.col("Market Cap").alias("market_cap"))


@add("""SELECT CAST(c_custkey // 250 + 1 AS BIGINT) AS page, 'id' || CAST(c_custkey AS VARCHAR) AS id, upper(c_name) AS symbol, c_name AS name, c_acctbal AS market_cap FROM customer
WHERE c_acctbal >= 0""")
def market_pages(spark, folder):
    """All landed pages of the market list. The unique customer key puts at most 250 coins on a page."""
    coin = F.struct(
        F.concat(F.lit("id"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("symbol"),
        F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("market_cap"),
    )
    number = F.floor(F.col("c_custkey") / 250) + 1
    pages = table(spark, folder, "customer").groupBy(number.alias("page")).agg(F.collect_list(coin).alias("coins"))
    rows = readers.market_pages(pages)
    return rows.select(F.col("page").cast("long").alias("page"), F.col("ID").alias("id"), F.col("Symbol").alias("symbol"), F.col("Name").alias("name"), F.col("Market Cap").alias("market_cap"))


@add(f"WITH {CAPS} SELECT symbol, name, strftime(d, '%Y-%m-%d') AS snapshot_date, cap AS market_cap FROM caps ORDER BY cap DESC, symbol, name, d LIMIT 10")
def largest_market_caps(spark, folder):
    rows = windows.latest_rows(caps(spark, folder), [F.col("Market Cap").desc(), F.col("Symbol"), F.col("Name"), F.col("Date")], 10)
    return rows.select(F.col("Symbol").alias("symbol"), F.col("Name").alias("name"), DAY("Date").alias("snapshot_date"), F.col("Market Cap").alias("market_cap"))


@add(f"WITH {CAPS} SELECT symbol, arg_min(name, name) AS name, arg_min(cap, name) AS market_cap, strftime(d, '%Y-%m-%d') AS snapshot_date FROM caps GROUP BY symbol, d")
def first_by_subset(spark, folder):
    """The first row by name of every symbol and date."""
    rows = setops.keep_first(caps(spark, folder), ["Symbol", "Date"], F.col("Name"))
    return rows.select(F.col("Symbol").alias("symbol"), F.col("Name").alias("name"), F.col("Market Cap").alias("market_cap"), DAY("Date").alias("snapshot_date"))


# -- macro ---------------------------------------------------------------------------

SERIES = """
series(series_id, title, frequency, frequency_short, units, units_short) AS (VALUES
  ('GDP', 'Gross Domestic Product', 'Quarterly', 'Q', 'Billions of Dollars', 'Bil. of $'),
  ('DFF', 'Federal Funds Effective Rate', 'Daily', 'D', 'Percent', '%'),
  ('UNRATE', 'Unemployment Rate', 'Monthly', 'M', 'Percent', '%'))"""


@add(f"""WITH {OBSERVATIONS}, {SERIES} SELECT title, series_id, frequency, frequency_short, units, units_short, strftime("date", '%Y-%m-%d') AS obs_date, value
FROM obs JOIN series USING (series_id) WHERE "date" BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def macro_enrichment(spark, folder):
    """Observations of a range with the names of their series."""
    raw = readers.observations(observations(spark, folder), F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    known, _ = readers.enrich_macro(raw, readers.macro_series(spark))
    return known.withColumn("obs_date", DAY("date")).drop("date")


@add(f"""WITH {OBSERVATIONS} SELECT series_id, strftime("date", '%Y-%m-%d') AS obs_date, value FROM obs WHERE series_id = 'OTHER'""")
def macro_unknown_series(spark, folder):
    _, rejected = readers.enrich_macro(observations(spark, folder), readers.macro_series(spark))
    return rejected.select("series_id", DAY("date").alias("obs_date"), "value")


@add("""WITH o AS (SELECT o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS d, o_totalprice AS value, o_orderkey FROM orders)
SELECT series_id, strftime(max(d), '%Y-%m-%d') AS obs_date, first(value ORDER BY d DESC, o_orderkey) AS value FROM o GROUP BY 1""")
def macro_latest(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("series_id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"), "o_orderkey"
    )
    latest = aggregates.latest_per_series(rows, "series_id", "date", "value", "o_orderkey")
    return latest.select("series_id", DAY("date").alias("obs_date"), "value")


NEWER = (
    OBSERVATIONS
    + ","
    + SERIES
    + """,
stored AS (SELECT * FROM obs WHERE (series_id = 'GDP' AND "date" < DATE '1999-01-01') OR (series_id = 'DFF' AND "date" <= DATE '2001-12-31')),
top AS (SELECT series_id, max("date") AS d FROM stored GROUP BY 1),
incoming AS (SELECT * FROM obs SEMI JOIN series USING (series_id)),
newest AS (SELECT i.* FROM incoming i JOIN (SELECT series_id, max("date") AS d FROM incoming GROUP BY 1) m ON i.series_id = m.series_id AND i."date" = m.d)"""
)


@add(f"""WITH {NEWER} SELECT n.series_id, strftime(n."date", '%Y-%m-%d') AS obs_date, n.value, title FROM newest n JOIN series s ON n.series_id = s.series_id LEFT JOIN top t ON n.series_id = t.series_id WHERE t.d IS NULL OR t.d < n."date" """)
def macro_insert_if_newer(spark, folder):
    """GDP has older rows stored, DFF is up to date, UNRATE has none."""
    rows = observations(spark, folder)
    day = lambda text: F.lit(text).cast("date")
    stored = rows.filter(
        ((F.col("series_id") == "GDP") & (F.col("date") < day("1999-01-01"))) | ((F.col("series_id") == "DFF") & (F.col("date") <= day("2001-12-31")))
    ).withColumn("date", F.col("date").cast("timestamp"))
    inserted, _ = macro_plan.newer_observations(rows, readers.macro_series(spark), stored)
    return inserted.select("series_id", DAY("date").alias("obs_date"), "value", "title")


@add(f"""WITH {OBSERVATIONS}, known AS (SELECT * FROM obs WHERE series_id <> 'OTHER' AND "date" BETWEEN DATE '1998-12-25' AND DATE '2001-12-31'),
stored AS (SELECT series_id, max("date") AS s FROM obs WHERE series_id = 'GDP' AND "date" < DATE '1999-06-01' GROUP BY 1),
opening AS (SELECT series_id, max("date") AS o FROM known WHERE "date" <= DATE '1999-01-01' GROUP BY 1)
SELECT series_id, strftime("date", '%Y-%m-%d') AS obs_date, value FROM known LEFT JOIN stored USING (series_id) LEFT JOIN opening USING (series_id)
WHERE (s IS NULL OR "date" > s) AND (o IS NULL OR "date" >= o)""")
def macro_backfill(spark, folder):
    """A range of days loaded in one job, as the daily loads would have."""
    rows = observations(spark, folder)
    first, last = F.lit("1999-01-01").cast("date"), F.lit("2001-12-31").cast("date")
    raw = readers.observations(rows, F.date_sub(first, 7), last)
    known, _ = readers.enrich_macro(raw, readers.macro_series(spark))
    stored = rows.filter((F.col("series_id") == "GDP") & (F.col("date") < F.lit("1999-06-01").cast("date")))
    out = macro_plan.newest_by_day(known, stored.withColumn("date", F.col("date").cast("timestamp")), first)
    return out.select("series_id", DAY("date").alias("obs_date"), "value")


@add(f"""WITH {OBSERVATIONS} SELECT series_id, strftime("date", '%Y-%m-%d') AS obs_date, value FROM obs""")
def series_csv_export(spark, folder):
    """Observations exported as CSV and read back."""
    out = run_folder(spark, "series-csv")
    tables.export_csv(observations(spark, folder).select("series_id", "date", "value"), out)
    back = spark.read.schema("series_id string, date date, value double").option("header", True).csv(out)
    return back.select("series_id", DAY("date").alias("obs_date"), "value")


# -- portfolio -------------------------------------------------------------------------


@add(f"""WITH {RETURNS}, l AS (SELECT *, daily_return >= 0 AS up,
  lag(daily_return >= 0, 1) OVER w AS p1, lag(daily_return >= 0, 2) OVER w AS p2, lag(daily_return >= 0, 3) OVER w AS p3, lag(daily_return >= 0, 4) OVER w AS p4
  FROM returns WINDOW w AS (PARTITION BY portfolio ORDER BY "date")),
s AS (SELECT *, CASE WHEN p1 IS DISTINCT FROM up THEN 1 WHEN p2 IS DISTINCT FROM up THEN 2 WHEN p3 IS DISTINCT FROM up THEN 3 WHEN p4 IS DISTINCT FROM up THEN 4 ELSE 5 END AS streak FROM l)
SELECT portfolio, strftime("date", '%Y-%m-%d') AS day, daily_return, CASE WHEN up THEN 'positive' ELSE 'negative' END AS trend, CAST(streak AS BIGINT) AS streak,
  {sql_even('least(0.15 + 0.05 * streak, 0.5)', 6)} AS reversal_probability, {sql_even('least(0.1 * streak, 0.2)', 6)} AS momentum,
  {sql_even('CASE WHEN up THEN 0.1 ELSE -0.3 - least(0.1 * streak, 0.2) END', 6)} AS continue_low, {sql_even('CASE WHEN up THEN 0.3 + least(0.1 * streak, 0.2) ELSE -0.1 END', 6)} AS continue_high,
  {sql_even('CASE WHEN up THEN CASE WHEN daily_return > 0.3 THEN 0.05 ELSE -0.25 END ELSE CASE WHEN daily_return < -0.3 THEN daily_return * 0.7 ELSE 0.05 END END', 6)} AS reverse_low,
  {sql_even('CASE WHEN up THEN CASE WHEN daily_return > 0.3 THEN daily_return * 0.7 ELSE -0.05 END ELSE CASE WHEN daily_return < -0.3 THEN -0.05 ELSE 0.25 END END', 6)} AS reverse_high FROM s""")
def return_streaks(spark, folder):
    """Trend, streak and the band of the next return as of every day."""
    rows = windows.trend_state(returns(spark, folder), ["portfolio"])
    bands = ["reversal_probability", "momentum", "continue_low", "continue_high", "reverse_low", "reverse_high"]
    return rows.select("portfolio", DAY("date").alias("day"), "daily_return", "trend", "streak", *[even(F.col(c), 6).alias(c) for c in bands])


@add(f"""WITH {SPLIT_RETURNS},
rows AS (SELECT portfolio, "date", daily_return, stored_cumulative, 'stored' AS status FROM stored
  UNION ALL SELECT portfolio, "date", daily_return, NULL, 'inserted' FROM supplied ANTI JOIN stored USING (portfolio, "date")),
lists AS (SELECT *, list({{'d': daily_return, 's': stored_cumulative}}) OVER (PARTITION BY portfolio ORDER BY "date" ROWS UNBOUNDED PRECEDING) AS l FROM rows)
SELECT portfolio, strftime("date", '%Y-%m-%d') AS day, daily_return, status,
  list_reduce(list_transform(l, lambda x: x), lambda a, x: {{'d': 0.0, 's': CASE WHEN x.s IS NOT NULL THEN x.s ELSE round_even((a.s + x.d) * 100, 0) / 100 END}}, {{'d': 0.0, 's': 0.0}}).s AS cumulative_return FROM lists""")
def portfolio_book(spark, folder):
    """New dates added to stored ones, with the running return."""
    stored, supplied = split_returns(spark, folder)
    rows = portfolio_plan.book(stored, supplied)
    return rows.select("portfolio", DAY("date").alias("day"), "daily_return", "status", "cumulative_return")


@add(f"""WITH {SPLIT_RETURNS} SELECT CASE WHEN t."date" IS NULL THEN 'inserted' ELSE 'exists' END AS status, count(*) AS n
FROM supplied s LEFT JOIN stored t ON s.portfolio = t.portfolio AND s."date" = t."date" GROUP BY 1""")
def portfolio_backfill_summary(spark, folder):
    return portfolio_plan.backfill_summary(*split_returns(spark, folder))


@add("""SELECT event_type AS portfolio, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) - 1 AS rows FROM events GROUP BY ALL HAVING count(*) > 1""")
def repeated_dates(spark, folder):
    """The reject frame of operators that take one row per key and date, over events as returns."""
    rows = table(spark, folder, "events").select(F.col("event_type").alias("portfolio"), F.col("ts").alias("date"), "value")
    found = skew.repeated_dates(rows, ["portfolio"], "date")
    return found.select("portfolio", DAY("date").alias("day"), "rows")
