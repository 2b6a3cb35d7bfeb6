"""Readers, table writers, jobs and streams on small files."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators import enrich
from marketloom.plans import caps, forum, macro, market, news, portfolio
from marketloom.sources import readers, tables
from marketloom.streaming import streams

DAY = datetime(2025, 2, 21)
AS_OF = "2025-02-22 05:00:00"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def write(path, name, text):
    target = path / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


# -- readers ---------------------------------------------------------------------------


def test_klines(spark, tmp_path):
    kline = [1740096000000, "1.5", "2.5", "0.5", "2.0", "10.25", 0, "0", 0, "0", "0", "0"]
    write(tmp_path, "symbol=BTCUSDT/p.json", json.dumps([kline, [kline[0] + 60_000, *kline[1:]]]) + "\n")
    got = market.crypto_candles(readers.read_klines(spark, str(tmp_path)))
    assert rows(got) == [
        (datetime(2025, 2, 21, 0, 0), "BTC", 1.5, 2.5, 0.5, 2.0, 10.25),
        (datetime(2025, 2, 21, 0, 1), "BTC", 1.5, 2.5, 0.5, 2.0, 10.25),
    ]


def test_ohlcv_drops_extra_columns_and_localises(spark, tmp_path):
    text = "Datetime,Open,High,Low,Close,Volume,Dividends\n2025-02-18 09:30:00,1,2,0.5,1.5,100,0\n"
    write(tmp_path, "symbol=SPY/a.csv", text)
    write(tmp_path, "symbol=^VIX/a.csv", text)
    got = market.exchange_candles(readers.read_ohlcv(spark, str(tmp_path)))
    assert got.columns == list(schemas.CANDLE_COLUMNS)
    assert rows(got, "symbol", "timestamp") == [("SPY", datetime(2025, 2, 18, 14, 30)), ("VIX", datetime(2025, 2, 18, 15, 30))]


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    write(tmp_path, "symbol=A/a.csv", "Datetime,Open,High,Low,Close,Volume\n2025-02-18 09:30:00,1,2,0.5,4,100\n")
    write(tmp_path, "symbol=A/b.csv", 'Volume,Close,Datetime,"Open",Low\n100,4,2025-02-18 09:31:00,1,"0.5"\n')
    got = readers.read_ohlcv(spark, str(tmp_path))
    assert rows(got, "Datetime", "Open", "High", "Low", "Close", "Volume") == [
        ("2025-02-18 09:30:00", 1.0, 2.0, 0.5, 4.0, 100.0), ("2025-02-18 09:31:00", 1.0, None, 0.5, 4.0, 100.0),
    ]
    write(tmp_path, "symbol=B/c.csv", "2025-02-18 09:30:00,1,2,0.5,4,100\n")
    with pytest.raises(Exception, match="no header line"):
        readers.read_ohlcv(spark, str(tmp_path)).collect()


def test_crypto_days_keep_their_last_minutes(spark):
    minutes = [(DAY + timedelta(minutes=m), "BTCUSDT", float(m), 1.0, 1.0, 1.0, 1.0) for m in range(1440)]
    schema = "timestamp timestamp, symbol string, Open double, High double, Low double, Close double, Volume double"
    got = market.crypto_candles(spark.createDataFrame(minutes + minutes[:700], schema))
    assert got.count() == got.select("timestamp").distinct().count() == 1440


# A small copy of the gross-domestic-product series and its expected rows.
GDP = [("2022-01-01", 25215.491), ("2022-04-01", 25805.791), ("2022-07-01", 26272.011)]


def landed_macro(tmp_path):
    head = "realtime_start,realtime_end,date,value\n"
    body = "".join(f"2025-03-04,2025-03-04,{d},{v}\n" for d, v in GDP)
    write(tmp_path, "landed/series_id=GDP/o.csv", head + body)
    write(tmp_path, "landed/series_id=REAINTRATREARAT10Y/o.csv", head + "2025-03-04,2025-03-04,2022-04-01,0.44\n")
    return str(tmp_path / "landed")


def test_macro_observations_and_names(spark, tmp_path, folder):
    landed = landed_macro(tmp_path)
    bounds = F.lit("2022-01-01").cast("date"), F.lit("2022-04-01").cast("date")
    raw = readers.read_observations(spark, landed, *bounds)
    known, unknown = readers.enrich_macro(raw, readers.macro_series(spark))
    want = [("Gross Domestic Product", "GDP", "Quarterly", "Q", "Billions of Dollars", "Bil. of $", datetime.fromisoformat(d), v) for d, v in GDP[:2]]
    assert rows(known) == want
    assert rows(unknown) == [("REAINTRATREARAT10Y", date(2022, 4, 1), 0.44)]
    extra = [("REAINTRATREARAT10Y", "10-Year Real Interest Rate", "Monthly", "M", "Percent", "%")]
    assert readers.enrich_macro(raw, readers.macro_series(spark, extra))[0].count() == 3
    out = folder("csv")
    tables.export_csv(known.withColumn("date", F.to_date("date")), out)
    back = spark.read.schema(schemas.MACRO.replace("date timestamp", "date date")).option("header", True).csv(out)
    assert rows(back, "date", "value") == [(date.fromisoformat(d), v) for d, v in GDP[:2]]


def test_macro_load_inserts_the_newest_once(spark, tmp_path, folder):
    landed = landed_macro(tmp_path)
    table = tables.Table(folder("macro"), schemas.MACRO)
    assert tables.create(spark, table) == "created" and tables.create(spark, table) == "exists"
    first = macro.load(spark, landed, table, "2022-04-03")
    assert first["inserted"] == 1 and first["rejected"].count() == 1
    assert macro.load(spark, landed, table, "2022-04-03")["inserted"] == 0
    assert macro.load(spark, landed, table, "2022-06-28", scheduled=True, series_id="GDP")["inserted"] == 1
    assert rows(tables.read(spark, table), "date") == [(datetime(2022, 4, 1),), (datetime(2022, 7, 1),)]


def test_macro_backfill_equals_daily_loads(spark, folder):
    series = readers.macro_series(spark)
    days = [date(2024, 1, 1) + timedelta(days=n) for n in (0, 3, 4, 9, 15)]
    raw = spark.createDataFrame([("DFF", d, float(i)) for i, d in enumerate(days)], "series_id string, date date, value double")
    known, _ = readers.enrich_macro(raw, series)
    stored = known.filter("value = 1")
    loop = stored
    for n in range(2, 13):
        day = date(2024, 1, 1) + timedelta(days=n)
        window = raw.filter(F.col("date").between(day - timedelta(days=7), day))
        new = macro.newer_observations(window, series, loop)[0].collect()
        loop = spark.createDataFrame(loop.collect() + new, schemas.MACRO)
    first, last = date(2024, 1, 3), date(2024, 1, 13)
    seen = known.filter(F.to_date("date").between(first - timedelta(days=7), last))
    once = stored.unionByName(macro.newest_by_day(seen, stored, F.lit(first)))
    assert rows(once, "date", "value") == rows(loop, "date", "value")


def test_market_pages_stop_after_a_short_page(spark, tmp_path):
    coin = lambda n, cap: {"id": f"i{n}", "symbol": "usdt", "name": f"N{n}", "market_cap": cap, "other": 1}
    pages = {1: [coin(1, 5.0), coin(2, None)], 2: [coin(3, 7)], 3: [coin(4, 9.0), coin(5, 9.0)]}
    for number, coins in pages.items():
        write(tmp_path, f"page={number}/c.json", json.dumps(coins, indent=1))
    got = readers.read_market_pages(spark, str(tmp_path), page_size=2)
    assert rows(got, "ID", "Symbol", "Name", "Market Cap") == [("i1", "USDT", "N1", 5.0), ("i3", "USDT", "N3", 7.0)]
    assert readers.read_market_pages(spark, str(tmp_path), page_size=1, max_pages=1).count() == 1
    assert readers.read_market_pages(spark, str(tmp_path)).count() == 4


CARD = (
    '<div class="dd {css} x"><h4 class="s-title fz">{head}</h4><span class="s-source c">Src</span>'
    '<span class="fc s-time">· 2 h </span><p class="s-desc">\n {desc} </p><a class="t" href="{href}">x</a></div>'
)


def page(*cards):
    return "<html><div class='top'>menu</div>" + "".join(cards) + "<a class='next' href='n'>next</a></html>"


GOOD_LINK = "https://r.example/RU=https%3a%2f%2fa.example%2f1/RK=2/RS=z"


def test_cards(spark):
    good = CARD.format(css="NewsArticle", head="<a href='q'>A &amp; <b>B</b></a>", desc="D<br>E", href=GOOD_LINK)
    broken = CARD.format(css="NewsArticle", head="H", desc="D", href="https://r.example/none")
    other = CARD.format(css="Sponsored", head="Ad", desc="D", href=GOOD_LINK)
    no_head = good.replace("h4", "h5")
    data = [(1, "BTC", page(other, good, good)), (2, "ETH", page(good, broken)), (3, "XRP", page(no_head)), (4, "ADA", page())]
    pages = spark.createDataFrame(data, "page_id long, ticker string, html string")
    cards = readers.article_cards(pages, "html", "ticker", F.lit(AS_OF).cast("timestamp"))
    assert cards.groupBy("ticker").count().count() == 3
    # The first link of the card is taken, which here is the headline's.
    assert cards.filter("complete").count() == 0
    plain = spark.createDataFrame([(1, "BTC", page(good.replace("<a href='q'>", "").replace("</b></a>", "</b>")))], "page_id long, ticker string, html string")
    card = readers.article_cards(plain, "html", "ticker", F.lit(AS_OF).cast("timestamp")).first()
    assert (card.headline, card.source, card.posted, card.description, card.link, card.synced) == ("A & B", "Src", "2 h", "DE", "https://a.example/1", False)


def test_one_broken_card_fails_its_ticker(spark):
    good = CARD.format(css="NewsArticle", head="H", desc="D", href=GOOD_LINK)
    broken = CARD.format(css="NewsArticle", head="H", desc="D", href="none")
    pages = spark.createDataFrame([(1, "BTC", page(good)), (2, "ETH", page(good)), (3, "ETH", page(broken))], "page_id long, ticker string, html string")
    cards = readers.article_cards(pages, "html", "ticker", F.lit(AS_OF).cast("timestamp"))
    assert rows(readers.accepted_cards(cards), "ticker") == [("BTC",)]


def raw_submission(**changes):
    base = {
        "subreddit": "Bitcoin", "title": "T", "author": None, "created": 1740096000.0, "created_utc": 1740096000.0, "domain": "d", "name": "n",
        "score": 3, "url": "u1", "selftext": "x" * 1001, "num_comments": 4, "ups": 1, "downs": 0, "searched_subreddit": "bitcoin",
        "asset_id": "BTC", "query": "btc", "asset_binance": "BTCUSDT",
        "comments": [{"id": str(i), "author": None if i == 3 else f"a{i}", "body": "y" * (248 + i), "score": 1, "created_utc": 1740096000.0 + i} for i in range(4)],
    }
    return {**base, **changes}


def test_submissions(spark, tmp_path):
    write(tmp_path, "s.json", json.dumps(raw_submission()) + "\n" + json.dumps(raw_submission(url="u2", comments=None, asset_id=None, num_comments=0)))
    sizes = {"body_size": 250, "selftext_size": 1000, "comment_count": 3}
    got = {r.url: r for r in readers.read_submissions(spark, str(tmp_path), F.lit(AS_OF).cast("timestamp"), **sizes).collect()}
    one, two = got["u1"], got["u2"]
    assert [c.id for c in one.comments] == ["3", "2", "1"]
    assert one.comments[0].author == "[deleted]" and [len(c.body) for c in one.comments] == [250, 250, 249]
    assert len(one.submission_dict.selftext) == 1000 and len(one.selftext) == 1001
    assert one.submission_dict.subreddit == "r/bitcoin" and one.binance_asset == "BTCUSDT" and one.asset_yfinance is None
    assert one.created_at_utc == datetime(2025, 2, 21) and one.author is None
    assert two.comments == [] and two.submission_dict.asset_id == "Unknown" and two.asset_id is None


def test_extended_json_backup(spark, tmp_path):
    docs = [
        {"timestamp": {"$date": f"2025-02-21T14:3{i}:00Z"}, "symbol": "AAPL", "low": 45.2, "open": 45.25, "volume": 195654, "close": 45.22, "high": 45.26}
        for i in range(3)
    ]
    write(tmp_path, "b.json", json.dumps(docs, indent=4))
    got = readers.read_extended_candles(spark, str(tmp_path))
    assert got.columns == list(schemas.CANDLE_COLUMNS)
    assert rows(got)[0] == (datetime(2025, 2, 21, 14, 30), "AAPL", 45.25, 45.26, 45.2, 45.22, 195654.0)
    assert got.count() == 3


def test_universe_and_dimensions(spark, tmp_path):
    universe = readers.universe(spark)
    assert universe.count() == 22
    assert rows(readers.traded_symbols(universe, crypto=True))[0] == ("ADA",)
    exchange = {r.symbol for r in readers.traded_symbols(universe, crypto=False).collect()}
    assert len(exchange) == 11 and "VIX" in exchange and "GDP" not in exchange
    docs = [{"_id": {"$oid": "1"}, "asset_id": "ETH", "asset_binance": "ETHUSDT", "asset_type": "crypto", "subreddits": ["investing", "Ethereum"], "query": "ethereum OR eth"}]
    write(tmp_path, "m.json", json.dumps(docs, indent=2))
    got = readers.read_dimension(spark, str(tmp_path / "m.json"), "asset_mappings").first()
    assert got.subreddits == ["investing", "Ethereum"] and got.asset_yfinance is None


@pytest.mark.parametrize(
    "name, doc",
    [
        ("portfolio_allocation", {"symbol": "SPY", "allocation_percentage": "25%", "allocation_number": 25, "allocation_decimal": 0.25}),
        ("chart_mappings", {"symbol": "SPY", "charts": {"day": "d", "week": "w", "month": "m"}}),
        ("risk_profiles", {"risk_id": "HIGH_RISK", "active": False}),
        ("agent_profiles", {"agent_id": "DEFAULT", "role": "Expert"}),
    ],
)
def test_other_dimensions(spark, tmp_path, name, doc):
    write(tmp_path, "d.json", json.dumps([doc]))
    got = readers.read_dimension(spark, str(tmp_path / "d.json"), name).first().asDict(recursive=True)
    assert {k: got[k] for k in doc} == doc


def test_request_plan(spark):
    df = spark.createDataFrame([("BTCUSDT",)], "symbol string")
    day = lambda t: F.lit(t).cast("date")
    plan = readers.request_plan(df, day("2025-02-20"), day("2025-02-21")).orderBy("day", "page").collect()
    assert [(r.page, r.start_ms) for r in plan[:2]] == [(0, 1740009600000), (1, 1740009600000 + 999 * 60_000 + 1)]
    assert len(plan) == 4 and plan[0].end_ms == 1740009600000 + 86_399_999


# -- candle jobs -----------------------------------------------------------------------------


def candles(spark, data):
    return spark.createDataFrame([(t, s, p, p, p, p, 1.0) for s, t, p in data], "timestamp timestamp, symbol string, open double, high double, low double, close double, volume double")


def listed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def test_day_load_falls_back_expires_and_repeats(spark, folder):
    table = tables.candle_table(folder("candles"))
    tables.create(spark, table)
    old = DAY - timedelta(days=60, hours=20)  # before the cutoff day's hour
    cut = DAY - timedelta(days=59) + timedelta(hours=4)  # the cutoff day, before the cutoff
    data = [("SPY", DAY - timedelta(days=1), 1.0), ("QQQ", DAY - timedelta(days=3, hours=-2), 2.0), ("SPY", old, 3.0), ("SPY", cut, 4.0), ("SPY", cut + timedelta(hours=2), 5.0), ("XYZ", old, 6.0)]
    tables.append_stamped(candles(spark, data), table, F.lit("2025-02-20").cast("timestamp"))
    backup = folder("backup")
    assert tables.backup_day(candles(spark, [("USO", datetime(2024, 5, 1, 15), 7.0)]), ["USO"], F.lit("2024-05-01").cast("date"), backup) == 1
    incoming = candles(spark, [("SPY", DAY + timedelta(hours=15), 9.0)])
    universe = listed(spark, "SPY", "QQQ", "USO", "TLT")

    for _ in range(2):
        out = market.load_day(spark, incoming, table, universe, "20250221", AS_OF, backup=backup)
        assert out["failed"] == ["TLT"]
    got = rows(tables.read(spark, table), "symbol", "timestamp", "close")
    assert got == sorted(
        [
            ("SPY", DAY - timedelta(days=1), 1.0), ("QQQ", DAY - timedelta(days=3, hours=-2), 2.0), ("SPY", cut + timedelta(hours=2), 5.0),
            ("XYZ", old, 6.0), ("SPY", DAY + timedelta(hours=15), 9.0), ("QQQ", DAY + timedelta(hours=2), 2.0), ("USO", DAY + timedelta(hours=15), 7.0),
        ], key=repr,
    )
    stamps = tables.read(spark, table).filter("symbol = 'USO'").select("date_load_iso_utc").distinct()
    assert rows(stamps) == [("20250222050000",)]


def test_load_refuses_today(spark, folder):
    table = tables.candle_table(folder("candles"))
    tables.create(spark, table)
    with pytest.raises(ValueError, match="not in the past"):
        market.load_day(spark, candles(spark, []), table, listed(spark, "SPY"), "20250222", AS_OF)


def test_first_day_load_keeps_other_days(spark, folder):
    table = tables.candle_table(folder("candles"))
    tables.create(spark, table)
    as_of = F.lit(AS_OF).cast("timestamp")
    tables.append_stamped(candles(spark, [("A", DAY, 1.0), ("A", DAY + timedelta(days=1), 1.0)]), table, as_of)
    tables.load_days(spark, candles(spark, [("A", DAY, 2.0), ("A", DAY + timedelta(days=1), 2.0)]), table, as_of)
    assert rows(tables.read(spark, table), "close") == [(1.0,), (2.0,), (2.0,)]


def test_backfill_is_one_job_and_repeats(spark, folder):
    table = tables.candle_table(folder("candles"))
    tables.create(spark, table)
    incoming = candles(spark, [("A", DAY + timedelta(days=n), float(n)) for n in range(-3, 3)])
    assert market.backfill(spark, incoming, table, "20250219", "20250221", AS_OF) == 3
    assert market.backfill(spark, incoming, table, "20250219", "20250221", AS_OF) == 3
    assert market.backfill(spark, incoming, table, "20250221", "20250219", AS_OF) == 0
    assert tables.read(spark, table).count() == 3


def test_backup_replaces_only_its_symbols(spark, folder):
    out, day = folder("backup"), F.lit(DAY.date())
    tables.backup_day(candles(spark, [("A", DAY, 1.0), ("B", DAY, 1.0), ("B", DAY + timedelta(days=1), 9.0)]), ["A", "B"], day, out)
    tables.backup_day(candles(spark, [("A", DAY, 2.0)]), ["A"], day, out)
    assert rows(tables.read_backup(spark, out), "symbol", "close") == [("A", 2.0), ("B", 1.0)]


def test_partition_pruning_reaches_the_scan(spark, folder):
    table = tables.candle_table(folder("candles"))
    tables.create(spark, table)
    tables.append_stamped(candles(spark, [("A", DAY, 1.0), ("B", DAY, 1.0)]), table, F.lit(AS_OF).cast("timestamp"))
    wanted = tables.read(spark, table).filter("symbol = 'A' AND event_date = '2025-02-21'")
    files = wanted.select("close").inputFiles()
    assert len(files) == 2 or all("symbol=A" in f for f in files)
    assert "PartitionFilters: [isnotnull(symbol" in wanted._jdf.queryExecution().toString()


def test_exchange_and_crypto_days(spark, tmp_path, folder):
    text = "Datetime,Open,High,Low,Close,Volume\n2025-02-21 09:30:00,1,2,0.5,1.5,100\n2025-02-20 09:30:00,1,2,0.5,1.5,100\n"
    write(tmp_path, "x/symbol=SPY/a.csv", text)
    write(tmp_path, "x/symbol=^VIX/a.csv", text)
    write(tmp_path, "x/symbol=UNLISTED/a.csv", text)
    kline = [1740096000000, "1.5", "2.5", "0.5", "2.0", "10.25", 0, "0", 0, "0", "0", "0"]
    write(tmp_path, "c/symbol=BTCUSDT/p.json", json.dumps([kline]))
    config = {"EQUITIES": "SPY QQQ", "MARKET_VOLATILITY": "^VIX", "BINANCE_ASSETS": "BTCUSDT"}
    exchange, crypto = tables.candle_table(folder("exchange")), tables.candle_table(folder("crypto"))
    tables.create(spark, exchange), tables.create(spark, crypto)
    out = market.load_exchange_day(spark, str(tmp_path / "x"), exchange, "20250221", AS_OF, config=config)
    assert out["inserted"] == 2 and out["failed"] == ["QQQ"]
    one = market.load_exchange_day(spark, str(tmp_path / "x"), exchange, "20250221", AS_OF, symbol="^VIX", config=config)
    assert one["inserted"] == 1 and tables.read(spark, exchange).count() == 2
    assert market.load_crypto_day(spark, str(tmp_path / "c"), crypto, "20250221", AS_OF, config=config)["inserted"] == 1
    assert rows(tables.read(spark, crypto), "symbol", "timestamp") == [("BTC", DAY)]


# -- other jobs --------------------------------------------------------------------------------


def test_cap_job_runs_once_a_day(spark, folder):
    table = tables.Table(folder("caps"), schemas.MARKET_CAPS)
    tables.create(spark, table)
    day = lambda t: F.lit(t).cast("date")
    seed = spark.createDataFrame([(date(2025, 2, 20), "USDT", "Tether", 100.0, None, None)], schemas.MARKET_CAPS)
    tables.append(seed, table)
    fetched = spark.createDataFrame([("USDT", "Tether", 150.0)], "Symbol string, Name string, `Market Cap` double")
    assert caps.store_snapshot(spark, fetched, table, day("2025-02-21")) == 2
    assert caps.store_snapshot(spark, fetched, table, day("2025-02-21")) == 0
    assert tables.read(spark, table).count() == 3


def test_portfolio_job(spark, folder):
    table = tables.Table(folder("portfolio"), schemas.PORTFOLIO)
    tables.create(spark, table)
    supplied = spark.createDataFrame([("p", date(2025, 2, n), n / 100) for n in range(1, 10)], "portfolio string, date date, daily_return double")
    assert portfolio.backfill(spark, supplied, table, "20250203", "20250204") == {"inserted": 2, "skipped": 0}
    assert portfolio.backfill(spark, supplied, table, "20250202", "20250205") == {"inserted": 2, "skipped": 2}
    with pytest.raises(ValueError, match="reversed range"):
        portfolio.backfill(spark, supplied, table, "20250205", "20250202")
    got = tables.read(spark, table).orderBy("date").select("percentage_of_cumulative_return").collect()
    # The second of February came late: stored rows are not computed again.
    assert [r[0] for r in got] == [0.02, 0.03, 0.07, 0.12]


def embedder():
    return enrich.vectorize(lambda: enrich.HashingEmbedder(16))


def test_news_job_repeats(spark, folder):
    table = tables.Table(folder("articles"), schemas.ARTICLES)
    tables.create(spark, table)
    cards = [CARD.format(css="NewsArticle", head=f"gain {i}", desc="D", href=GOOD_LINK.replace("%2f1", f"%2f{i}")) for i in range(5)]
    pages = spark.createDataFrame([(1, "BTC", page(*cards)), (2, "BTC", page(*cards[:2]))], "page_id long, ticker string, html string")
    mapping = listed(spark, "BTC").withColumnRenamed("symbol", "ticker")
    assert news.run(spark, pages, table, mapping, embedder(), AS_OF) == 5
    before = rows(tables.read(spark, table), "_id", "link", "article_string")
    assert news.run(spark, pages, table, mapping, embedder(), "2025-02-23 05:00:00") == 5
    assert rows(tables.read(spark, table), "_id", "link", "article_string") == before
    assert news.run_recreate(spark, table, embedder()) == 5
    done = tables.read(spark, table).filter("size(article_embedding) = 16 AND sentiment_score.positive > sentiment_score.negative")
    assert done.count() == 5


def test_forum_job(spark, tmp_path, folder):
    table = tables.Table(folder("submissions"), schemas.SUBMISSIONS)
    tables.create(spark, table)
    lines = [raw_submission(), raw_submission(title="T2"), raw_submission(url="u2", searched_subreddit="unmapped")]
    write(tmp_path, "landed/s.json", "\n".join(json.dumps(x) for x in lines))
    mapping = spark.createDataFrame([("BTC", ["bitcoin"], "btc")], "asset_id string, subreddits array<string>, query string")
    landed = str(tmp_path / "landed")
    assert forum.run(spark, landed, table, mapping, embedder(), AS_OF) == 1
    row = tables.read(spark, table).first()
    assert len(row.submission_embeddings) == 16 and row.sentiment_score is not None and row.url == "u1"
    # A day later the row is updated and keeps its vector; sixty days later it is
    # old but stays, as the asset has fewer rows than the floor.
    assert forum.run(spark, landed, table, mapping, embedder(), "2025-02-23 05:00:00") == 1
    assert forum.run(spark, landed, table, mapping, embedder(), "2025-06-23 05:00:00") == 1


def test_forum_job_hands_on_whole_texts(spark, tmp_path, folder):
    table = tables.Table(folder("submissions"), schemas.SUBMISSIONS)
    tables.create(spark, table)
    comments = [{"id": str(i), "author": "a", "body": "y" * 400 + f" great{i}", "score": 1, "created_utc": 1740096000.0 + i} for i in range(6)]
    write(tmp_path, "landed/s.json", json.dumps(raw_submission(selftext="x" * 2000 + " tail", comments=comments)))

    def kept(name, answer):
        def call(texts):
            (tmp_path / name).write_text("".join(texts))
            return [answer for _ in texts]

        return lambda: call

    scores = enrich.model_scores(kept("scores", {"positive": 1.0, "negative": 0.0, "neutral": 0.0}))
    mapping = spark.createDataFrame([("BTC", ["bitcoin"], "btc")], "asset_id string, subreddits array<string>, query string")
    assert forum.run(spark, str(tmp_path / "landed"), table, mapping, enrich.vectorize(kept("embed", [1.0, 0.0])), AS_OF) == 1
    assert forum.run_sentiment(spark, table, scores=scores, anew=True) == 1
    for name in ("embed", "scores"):
        text = (tmp_path / name).read_text()
        assert "x" * 2000 + " tail" in text and all("y" * 400 + f" great{i}" in text for i in range(6))


def test_single_phase_jobs(spark, tmp_path, folder):
    table = tables.Table(folder("submissions"), schemas.SUBMISSIONS)
    tables.create(spark, table)
    write(tmp_path, "landed/s.json", "\n".join(json.dumps(raw_submission(url=f"u{i}")) for i in range(5)))
    tables.append(readers.read_submissions(spark, str(tmp_path / "landed"), F.lit(AS_OF).cast("timestamp")), table)
    count = lambda c: tables.read(spark, table).filter(f"{c} IS NOT NULL").count()
    assert forum.run_embeddings(spark, table, embedder(), max_documents=2) == 5 and count("submission_embeddings") == 2
    assert forum.run_embeddings(spark, table, embedder()) == 5 and count("submission_embeddings") == 5
    assert forum.run_embeddings(spark, table, embedder(), max_documents=1, anew=True) == 5 and count("submission_embeddings") == 1
    assert forum.run_sentiment(spark, table, max_documents=3) == 5 and count("sentiment_score") == 3
    mapping = spark.createDataFrame([("BTC",)], "asset_id string")
    assert forum.run_clean(spark, table, mapping, "2025-06-23 05:00:00", floor=2) == 2


# -- streams ------------------------------------------------------------------------------------


def test_candle_stream_restarts_without_repeats(spark, folder):
    landing, table = folder("landing"), tables.candle_table(folder("candles"))
    tables.create(spark, table)
    as_of = F.lit(AS_OF).cast("timestamp")
    for n, price in enumerate((1.0, 2.0)):
        candles(spark, [("A", DAY + timedelta(days=n), price), ("B", DAY, price)]).write.mode("append").parquet(landing)
        stream = streams.file_stream(spark, landing, candles(spark, []).schema)
        streams.ingest_candles(stream, table, folder("ck"), as_of).awaitTermination()
    assert rows(tables.read(spark, table), "symbol", "close") == [("A", 1.0), ("A", 2.0), ("B", 2.0)]


@pytest.mark.parametrize("per_batch", [1, 10])
def test_a_day_may_be_spread_over_batches(spark, folder, per_batch):
    landing, table = folder("landing"), tables.candle_table(folder("candles"))
    tables.create(spark, table)
    for half in range(2):
        day = [("A", DAY + timedelta(minutes=half * 10 + m), float(m)) for m in range(10)]
        candles(spark, day).coalesce(1).write.mode("append").parquet(landing)
    stream = streams.file_stream(spark, landing, candles(spark, []).schema, per_batch=per_batch)
    streams.ingest_candles(stream, table, folder("ck"), F.lit(AS_OF).cast("timestamp")).awaitTermination()
    assert rows(tables.read(spark, table), "close") == sorted([(float(m),) for m in range(10)] * 2)


def test_expiry_finds_escaped_folders(spark, folder):
    table = tables.candle_table(folder("candles"))
    tables.create(spark, table)
    tables.append_stamped(candles(spark, [("EURUSD=X", DAY, 1.0), ("A/B", DAY, 1.0), ("C", DAY, 1.0)]), table, F.lit(AS_OF).cast("timestamp"))
    listed = spark.createDataFrame([("EURUSD=X",), ("A/B",)], "symbol string")
    later = str(DAY + timedelta(days=90))
    assert tables.expire_days(spark, table, listed, later) == 2
    assert rows(tables.read(spark, table), "symbol") == [("C",)]
    assert tables.expire_days(spark, table, listed, later) == 0


def test_daily_counts_drop_late_rows(spark, folder):
    landing, out = folder("landing"), folder("out")
    schema = "timestamp timestamp, symbol string"
    batches = [
        [(DAY + timedelta(hours=h), "A") for h in range(24)],
        [(DAY + timedelta(days=1, hours=1), "A")],
        [(DAY, "A"), (DAY + timedelta(days=2, hours=1), "A")],  # the first one is late
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = streams.file_stream(spark, landing, schema)
        streams.append_to(streams.daily_counts(stream), out, folder("ck")).awaitTermination()
    got = spark.read.schema("symbol string, day_start timestamp, actual bigint").parquet(out)
    assert rows(got) == [("A", DAY, 24), ("A", DAY + timedelta(days=1), 1)]


def test_stream_dedupe_across_batches(spark, folder):
    landing, out = folder("landing"), folder("out")
    schema = "_id long, ticker string, link string, extraction_timestamp_utc timestamp"
    for n in range(2):
        batch = [(100 * n + i, "BTC", f"l{i % 3}", DAY + timedelta(minutes=i)) for i in range(60)]
        spark.createDataFrame(batch, schema).write.mode("append").parquet(landing)
        stream = streams.file_stream(spark, landing, schema)
        streams.append_to(streams.unique_articles(stream), out, folder("ck")).awaitTermination()
    got = spark.read.schema(schema).parquet(out)
    assert rows(got, "ticker", "link") == [("BTC", "l0"), ("BTC", "l1"), ("BTC", "l2")]
