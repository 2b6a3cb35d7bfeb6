"""Backfill with carry-forward against a loop of day loads and against plain Python."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators import carry
from marketloom.plans import market
from marketloom.sources import tables

AS_OF = "2025-03-10 05:00:00"
D0 = date(2025, 3, 1)
SYMBOLS = ["A", "B", "C", "D", "E", "F"]


def candles(spark, data):
    """data: (symbol, day offset, hour, price)"""
    at = lambda n, h: datetime(2025, 3, 1, h) + timedelta(days=n)
    return spark.createDataFrame([(at(n, h), s, p, p, p, p, 1.0) for s, n, h, p in data], schemas.CANDLES.split(", date_load")[0])


def listed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def rows(df):
    return sorted((r.symbol, r.timestamp, r.close) for r in df.collect())


def table_with(spark, path, data):
    table = tables.candle_table(path)
    tables.create(spark, table)
    if data:
        tables.append_stamped(candles(spark, data), table, F.lit("2025-02-01").cast("timestamp"))
    return table


def key(n):
    return (D0 + timedelta(days=n)).strftime("%Y%m%d")


# A: has all days; B: stored before the range; C: stored after the range's first days, and in it; D: only backup;
# E: nothing; F: incoming on some days, stored long before.
STORED = [("B", -4, 9, 1.0), ("B", -4, 10, 1.5), ("B", -9, 9, 0.5), ("C", 2, 9, 2.0), ("F", -20, 9, 3.0)]
INCOMING = [("A", n, 9, 10.0 + n) for n in range(-1, 6)] + [("F", 1, 9, 31.0), ("F", 1, 11, 31.5), ("F", 3, 9, 33.0), ("C", 3, 9, 23.0), ("X", 1, 9, 9.0)]


def backup_of(spark, folder):
    out = folder("backup")
    tables.backup_day(candles(spark, [("D", -100, 9, 7.0), ("D", -100, 10, 7.5), ("B", -100, 9, 8.0)]), None, F.lit(D0 - timedelta(days=100)), out)
    return out


def test_backfill_equals_a_loop_of_day_loads(spark, folder):
    backup, universe = backup_of(spark, folder), listed(spark, *SYMBOLS)
    one, loop = table_with(spark, folder("one"), STORED), table_with(spark, folder("loop"), STORED)
    out = market.backfill_days(spark, candles(spark, INCOMING), one, universe, key(0), key(4), AS_OF, backup=backup)
    for n in range(5):
        day = candles(spark, [r for r in INCOMING if r[1] == n and r[0] != "X"])
        assert market.load_day(spark, day, loop, universe, key(n), AS_OF, backup=backup)["failed"] == ["E"]
    assert rows(tables.read(spark, one)) == rows(tables.read(spark, loop))
    assert out["failed"] == ["E"] and out["days"] == {"incoming": 5 + 4 + 2, "stored": 5 + 1 + 3, "backup": 5, "failed": 5}
    # A second run writes the same rows.
    before = rows(tables.read(spark, one))
    market.backfill_days(spark, candles(spark, INCOMING), one, universe, key(0), key(4), AS_OF, backup=backup)
    assert [r for r in rows(tables.read(spark, one)) if r[0] in "AE"] == [r for r in before if r[0] in "AE"]


def plain_before(incoming, stored, backup, start, end):
    """(symbol, day offset) -> (source, from), by looking back day by day."""
    held = {(s, n) for s, n, _, _ in stored}
    came = {(s, n) for s, n, _, _ in incoming}
    out = {}
    for s in SYMBOLS:
        for n in range(start, end + 1):
            if (s, n) in came:
                out[s, n] = ("incoming", n)
                continue
            if (s, n) in held:
                out[s, n] = ("kept", None)
                continue
            back = [m for m in range(-200, n) if (s, m) in held or ((s, m) in came and m >= start)]
            if back:
                out[s, n] = ("incoming" if (s, back[-1]) in came and back[-1] >= start else "stored", back[-1])
            else:
                out[s, n] = ("backup" if s in backup else "failed", None)
    return out


def plain_newest(incoming, stored, backup, start, end):
    """The loop over the days on sets of days: each takes the last day there is."""
    came = {(s, n) for s, n, _, _ in incoming}
    out = {}
    for s in SYMBOLS:
        origin = {n: ("stored", n) for t, n, _, _ in stored if t == s}
        for n in range(start, end + 1):
            if (s, n) in came:
                origin[n] = out[s, n] = ("incoming", n)
            elif origin:
                origin[n] = out[s, n] = origin[max(origin)]
            elif s in backup:
                origin[n] = out[s, n] = ("backup", None)
            else:
                out[s, n] = ("failed", None)
    return out


@pytest.mark.parametrize("rule, plain", [("newest", plain_newest), ("before", plain_before)])
def test_plan_of_random_tables(spark, rule, plain):
    rng = random.Random(4)
    for _ in range(3):
        pick = lambda p, low, high: [(s, n, 9, 1.0) for s in SYMBOLS[:-1] for n in range(low, high) if rng.random() < p]
        incoming, stored, backup = pick(0.3, -3, 12), pick(0.12, -10, 14), {"D", "E"} if rng.random() < 0.7 else set()
        to_days = lambda data: candles(spark, data).select("symbol", F.to_date("timestamp").alias("day")).distinct()
        saved = spark.createDataFrame([(s,) for s in backup], "symbol string")
        start, end = F.lit(D0), F.lit(D0 + timedelta(days=9))
        plan = carry.plan_days(listed(spark, *SYMBOLS), start, end, to_days(incoming), to_days(stored), saved, carry=rule)
        offset = lambda d: None if d is None else (d - D0).days
        got = {(r.symbol, offset(r.day)): (r.source_used, offset(r.from_day)) for r in plan.collect()}
        assert got == plain(incoming, stored, backup, 0, 9)


def test_before_leaves_stored_days_alone(spark, folder):
    table = table_with(spark, folder("t"), STORED)
    out = market.backfill_days(spark, candles(spark, INCOMING), table, listed(spark, "B", "C"), key(0), key(4), AS_OF, carry="before", clean=False)
    assert out["days"] == {"stored": 5, "kept": 1, "failed": 2, "incoming": 2} and out["failed"] == ["C"]
    got = [(r[1].day, r[2]) for r in rows(tables.read(spark, table)) if r[0] == "C"]
    assert got == [(3, 2.0), (4, 23.0), (5, 23.0)]
    stamps = tables.read(spark, table).filter("symbol = 'C' AND close = 2").first().date_load_iso_utc
    assert stamps == "20250201000000"


def test_both_ends_are_checked(spark, folder):
    table = table_with(spark, folder("t"), [])
    run = lambda a, b: market.backfill_days(spark, candles(spark, []), table, listed(spark, "A"), a, b, AS_OF)
    for a, b in (("20250301", "20259999"), ("20250301", "x"), ("2025-99", "20250301"), ("x", "20250301"), ("20250230", "20250301")):
        with pytest.raises(ValueError, match="bad format|no such date"):
            run(a, b)
        with pytest.raises(ValueError, match="bad format|no such date"):
            market.backfill(spark, candles(spark, []), table, a, b, AS_OF)
    with pytest.raises(ValueError, match="not in the past"):
        run("20250310", "20250311")
    assert run("20250305", "20250301")["inserted"] == 0
    # Days from today on are left out.
    out = market.backfill_days(spark, candles(spark, [("A", n, 9, 1.0) for n in range(6, 14)]), table, listed(spark, "A"), key(6), key(13), AS_OF)
    assert out["inserted"] == 3 and out["days"] == {"incoming": 3}


def test_stored_days_come_from_the_listing(spark, folder):
    table = table_with(spark, folder("t"), [("A=/B", 0, 9, 1.0), ("A=/B", 0, 10, 1.0), ("C", 1, 9, 1.0)])
    days = tables.stored_days(spark, table)
    assert sorted(tuple(r) for r in days.collect()) == [("A=/B", D0), ("C", D0 + timedelta(days=1))]
    empty = table_with(spark, folder("empty"), [])
    assert tables.stored_days(spark, empty).collect() == []


def test_landed_files_of_all_symbols_or_one(spark, tmp_path, folder):
    for symbol in ("SPY", "^VIX"):
        target = tmp_path / f"x/symbol={symbol}/a.csv"
        target.parent.mkdir(parents=True)
        target.write_text("Datetime,Open,High,Low,Close,Volume\n2025-03-01 09:30:00,1,2,0.5,1.5,100\n2025-03-03 09:30:00,1,2,0.5,2.5,100\n")
    config = {"EQUITIES": "SPY QQQ", "MARKET_VOLATILITY": "^VIX"}
    table = table_with(spark, folder("t"), [])
    out = market.backfill_exchange(spark, str(tmp_path / "x"), table, "20250301", "20250304", AS_OF, config=config)
    assert out["days"] == {"incoming": 8, "failed": 4} and out["failed"] == ["QQQ"]
    got = {(r[0], r[1].day): r[2] for r in rows(tables.read(spark, table))}
    assert got == {(s, d): p for s in ("SPY", "VIX") for d, p in ((1, 1.5), (2, 1.5), (3, 2.5), (4, 2.5))}
    alone = market.backfill_exchange(spark, str(tmp_path / "x"), table, "20250303", "20250303", AS_OF, symbol="^VIX", config=config)
    assert alone["inserted"] == 1 and alone["expired_folders"] == 0
    kline = "[[1740787200000,\"1\",\"2\",\"0.5\",\"2.0\",\"3\",0,\"0\",0,\"0\",\"0\",\"0\"]]"
    target = tmp_path / "c/symbol=BTCUSDT/p.json"
    target.parent.mkdir(parents=True)
    target.write_text(kline)
    crypto = table_with(spark, folder("crypto"), [])
    assert market.backfill_crypto(spark, str(tmp_path / "c"), crypto, "20250301", "20250302", AS_OF, config={"BINANCE_ASSETS": "BTCUSDT"})["inserted"] == 2
