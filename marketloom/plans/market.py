"""Candle jobs: exchange and crypto day loads, backfill, clean-up and backup.

``day``/``as_of`` are literals of the caller; a job is the same Spark plan for
one symbol or all of them, one day or a whole range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import symbols
from ..functions.dates import load_date_status, range_status
from ..operators import aggregates, dml
from ..operators.carry import NEWEST, carried_rows, plan_days
from ..operators.filters import in_day
from ..sources import readers, tables


def exchange_candles(wide: DataFrame, time: str = "Datetime", symbol: str = "symbol", *, naive: bool = True) -> DataFrame:
    """Canonical candles of wide exchange rows."""
    return readers.canonical_candles(wide, time, symbols.normalize_caret(F.col(symbol)), naive=naive)


def crypto_candles(klines: DataFrame) -> DataFrame:
    """Canonical candles of klines, one per symbol and open time; of repeated
    ones the smallest by its values."""
    keys = ["symbol", "timestamp"]
    values = F.struct(*[c for c in klines.columns if c not in keys])
    single = klines.groupBy(*keys).agg(F.min(values).alias("_v")).select(*keys, "_v.*")
    return readers.canonical_candles(
        single.withColumnRenamed("timestamp", "Datetime"),
        "Datetime",
        symbols.normalize_usdt(F.col("symbol")),
        naive=False,
    )


def crypto_audit(klines: DataFrame) -> DataFrame:
    return aggregates.completeness(klines, "symbol", "timestamp", expected=1440, step="1 MINUTE")


def load_day(
    spark: SparkSession, incoming: DataFrame, table: tables.Table, universe: DataFrame, day: str, as_of: str,
    *, backup: str | None = None, clean: bool = True, days: str = "first",
) -> dict:
    """Load one day of canonical candles into the table.

    Symbols of ``universe`` without rows fall back to their last stored day or
    their backup. The clean-up belongs to the all-symbols form only. The names
    of symbols nothing was found for are part of the configured universe and
    are read before the table changes.
    """
    moment = F.lit(as_of).cast("timestamp")
    _require_past(spark, day, moment)
    date = F.to_date(F.lit(day), "yyyyMMdd")
    stored = tables.read(spark, table)
    saved = tables.read_backup(spark, backup) if backup else incoming.limit(0)
    rows, failed = dml.fill_missing_symbols(universe, incoming, stored, saved, date, stored_day="event_date")
    missing = sorted(r[0] for r in failed.collect())
    written = tables.load_days(spark, rows.drop("source_used"), table, moment, days=days)
    removed = tables.expire_days(spark, table, universe, as_of) if clean and written else 0
    return {"inserted": written, "expired_folders": removed, "failed": missing}


def load_exchange_day(
    spark: SparkSession, landed: str, table: tables.Table, day: str, as_of: str,
    *, symbol: str | None = None, config: dict[str, str] | None = None, backup: str | None = None,
) -> dict:
    """Landed exchange files of one day: all configured symbols, or one."""
    incoming = exchange_candles(readers.read_ohlcv(spark, landed))
    listed = readers.traded_symbols(readers.universe(spark, config), crypto=False)
    return _load(spark, incoming, table, listed, symbols.normalize_caret, day, as_of, symbol, backup)


def load_crypto_day(
    spark: SparkSession, landed: str, table: tables.Table, day: str, as_of: str,
    *, symbol: str | None = None, config: dict[str, str] | None = None, backup: str | None = None,
) -> dict:
    """Landed kline files of one day: all configured symbols, or one."""
    incoming = crypto_candles(readers.read_klines(spark, landed))
    listed = readers.traded_symbols(readers.universe(spark, config), crypto=True)
    return _load(spark, incoming, table, listed, symbols.normalize_usdt, day, as_of, symbol, backup)


def _load(spark, incoming, table, listed, normalize, day, as_of, symbol, backup) -> dict:
    date = F.to_date(F.lit(day), "yyyyMMdd")
    incoming = incoming.filter(in_day(F.col("timestamp"), date))
    if symbol is not None:
        listed = spark.range(1).select(normalize(F.lit(symbol)).alias("symbol"))
    wanted = incoming.join(listed, "symbol", "left_semi").select(*incoming.columns)
    # All rows are of one day, so replacing every day they bring is the same
    # as replacing the first one, in a single write.
    return load_day(spark, wanted, table, listed, day, as_of, backup=backup, clean=symbol is None, days="all")


def backfill(
    spark: SparkSession, incoming: DataFrame, table: tables.Table, start: str, end: str, as_of: str
) -> int:
    """All days of an inclusive range that have rows, in one job; a reversed range is empty."""
    moment = F.lit(as_of).cast("timestamp")
    if not _checked_range(spark, start, end, moment):
        return 0
    return tables.load_days(spark, _inside(incoming, start, end, moment), table, moment, days="all")


def backfill_days(
    spark: SparkSession, incoming: DataFrame, table: tables.Table, universe: DataFrame, start: str, end: str, as_of: str,
    *, backup: str | None = None, clean: bool = True, carry: str = NEWEST,
) -> dict:
    """Every day of an inclusive range for every symbol of the universe, in one job.

    A symbol's day without incoming rows is filled as ``carry.plan_days`` says; by default the table ends up as after one
    day load after the other. Days that are not in the past are left out. Landed rows are read once; of the stored table
    only the days that are carried are read. Retention is applied once, after the last day. Returns the rows written, the
    (symbol, day) pairs by what filled them, and the symbols that nothing was found for on some day.
    """
    moment = F.lit(as_of).cast("timestamp")
    nothing = {"inserted": 0, "expired_folders": 0, "days": {}, "failed": []}
    if not _checked_range(spark, start, end, moment):
        return nothing
    first = F.to_date(F.lit(start), "yyyyMMdd")
    last = F.least(F.to_date(F.lit(end), "yyyyMMdd"), F.date_sub(F.to_date(moment), 1))
    mapped = universe.select("symbol").distinct()
    wanted = _inside(incoming, start, end, moment).join(mapped, "symbol", "left_semi").select(*incoming.columns)
    saved = tables.read_backup(spark, backup) if backup else incoming.limit(0)
    with tables.staged(wanted, "incoming") as rows, tables.staged(saved, "saved") as kept:
        days = rows.select("symbol", F.to_date("timestamp").alias("day")).distinct()
        planned = plan_days(mapped, first, last, days, tables.stored_days(spark, table), kept.select("symbol").distinct(), carry=carry)
        with tables.staged(planned, "plan") as plan:
            counts = {r.source_used: r["count"] for r in plan.groupBy("source_used").count().collect()}
            # Names of the configured universe, not of rows.
            failed = sorted(r.symbol for r in plan.filter("source_used = 'failed'").select("symbol").distinct().collect())
            moved = carried_rows(plan, rows, tables.read(spark, table), kept, stored_day="event_date")
            written = tables.load_days(spark, moved, table, moment, days="all")
    removed = tables.expire_days(spark, table, universe, as_of) if clean and written else 0
    return {"inserted": written, "expired_folders": removed, "days": counts, "failed": failed}


def backfill_exchange(spark: SparkSession, landed: str, table: tables.Table, start: str, end: str, as_of: str, *, symbol: str | None = None, config: dict[str, str] | None = None, **options) -> dict:
    """Landed exchange files of a range of days: all configured symbols, or one."""
    incoming = exchange_candles(readers.read_ohlcv(spark, landed))
    listed = readers.traded_symbols(readers.universe(spark, config), crypto=False)
    return _backfill(spark, incoming, table, listed, symbols.normalize_caret, start, end, as_of, symbol, options)


def backfill_crypto(spark: SparkSession, landed: str, table: tables.Table, start: str, end: str, as_of: str, *, symbol: str | None = None, config: dict[str, str] | None = None, **options) -> dict:
    """Landed kline files of a range of days: all configured symbols, or one."""
    incoming = crypto_candles(readers.read_klines(spark, landed))
    listed = readers.traded_symbols(readers.universe(spark, config), crypto=True)
    return _backfill(spark, incoming, table, listed, symbols.normalize_usdt, start, end, as_of, symbol, options)


def _backfill(spark, incoming, table, listed, normalize, start, end, as_of, symbol, options) -> dict:
    if symbol is not None:
        listed = spark.range(1).select(normalize(F.lit(symbol)).alias("symbol"))
    # The clean-up belongs to the all-symbols form only.
    return backfill_days(spark, incoming, table, listed, start, end, as_of, **{"clean": symbol is None, **options})


def _inside(incoming: DataFrame, start: str, end: str, as_of: Column) -> DataFrame:
    """Rows of the range's days that are in the past, by bounds on the time itself."""
    after = F.to_date(F.lit(end), "yyyyMMdd") + F.expr("INTERVAL 1 DAY")
    ts = F.col("timestamp")
    return incoming.filter((ts >= F.to_timestamp(F.lit(start), "yyyyMMdd")) & (ts < after.cast("timestamp")) & (ts < F.date_trunc("day", as_of)))


def _checked_range(spark: SparkSession, start: str, end: str, as_of: Column) -> bool:
    """Whether there is a day to load; raises for keys that are no dates and for a start that is not in the past."""
    status = spark.range(1).select(range_status(F.lit(start), F.lit(end), order_matters=False)).first()[0]
    if status not in ("ok", "empty range"):
        raise ValueError(f"backfill range {start} to {end}: {status}")
    _require_past(spark, start, as_of)
    return status == "ok"


def _require_past(spark: SparkSession, day: str, as_of: Column) -> None:
    status = spark.range(1).select(load_date_status(F.lit(day), as_of)).first()[0]
    if status != "ok":
        raise ValueError(f"load date {day}: {status}")
