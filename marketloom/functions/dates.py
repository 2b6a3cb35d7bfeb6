"""Date keys, time zones, epoch conversion and day windows.

No function reads the clock: every "now" is a parameter, so that a retried
task or a re-run gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import exchange_zone


def parse_date_key(text: Column) -> Column:
    """``yyyyMMdd`` or ``yyyyMMddHH`` as struct<ts, error>; NULL stays NULL."""
    digits = text.rlike("^[0-9]+$")
    ts = F.when(digits & (F.length(text) == 8), F.try_to_timestamp(text, F.lit("yyyyMMdd"))).when(
        digits & (F.length(text) == 10), F.try_to_timestamp(text, F.lit("yyyyMMddHH"))
    )
    error = (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(~digits, F.lit("not a number"))
        .when(~F.length(text).isin(8, 10), F.lit("wrong length"))
        .when(ts.isNull(), F.lit("no such date"))
    )
    return F.struct(ts.alias("ts"), error.alias("error"))


def load_date_status(text: Column, as_of: Column) -> Column:
    """``ok`` when the key is eight digits, a real date and before ``as_of``'s day."""
    day = F.try_to_timestamp(text, F.lit("yyyyMMdd"))
    return (
        F.when(text.isNull() | ~text.rlike("^[0-9]{8}$"), F.lit("bad format"))
        .when(day.isNull(), F.lit("no such date"))
        .when(F.to_date(day) >= F.to_date(as_of), F.lit("not in the past"))
        .otherwise(F.lit("ok"))
    )


def range_status(start: Column, end: Column, *, order_matters: bool) -> Column:
    """Backfill range check. A reversed range is an error for portfolio rows
    only; elsewhere it is an empty range."""
    eight = start.rlike("^[0-9]{8}$") & end.rlike("^[0-9]{8}$")
    first = F.try_to_timestamp(start, F.lit("yyyyMMdd"))
    last = F.try_to_timestamp(end, F.lit("yyyyMMdd"))
    reversed_range = F.lit("reversed range" if order_matters else "empty range")
    return (
        F.when(~F.coalesce(eight, F.lit(False)), F.lit("bad format"))
        .when(first.isNull() | last.isNull(), F.lit("no such date"))
        .when(last < first, reversed_range)
        .otherwise(F.lit("ok"))
    )


def localize_to_utc(local: Column, symbol: Column) -> Column:
    """Naive exchange time to UTC.

    A time inside the spring gap moves to the first valid instant; a time that
    occurs twice in autumn becomes NULL.
    """
    zone = exchange_zone(symbol)
    wall = local.cast("timestamp")
    instant = F.to_utc_timestamp(wall, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(instant + hour, zone) == wall) | (
        F.from_utc_timestamp(instant - hour, zone) == wall
    )
    in_gap = F.from_utc_timestamp(instant, zone) != wall
    return (
        F.when(twice, F.lit(None).cast("timestamp"))
        .when(in_gap, F.date_trunc("hour", instant))
        .otherwise(instant)
    )


def epoch_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def day_end(ts: Column) -> Column:
    """Last millisecond of the UTC day."""
    return F.date_trunc("day", ts) + F.expr("INTERVAL '0 23:59:59.999' DAY TO SECOND")


def redate(ts: Column, new_day: Column) -> Column:
    """Same time of day on another date."""
    return new_day.cast("timestamp") + (ts - F.date_trunc("day", ts))


def load_stamp(as_of: Column) -> Column:
    return F.date_format(as_of, "yyyyMMddHHmmss")


def day_window(day: Column, before: int, after: int) -> Column:
    """struct<start, end> of ``yyyyMMdd`` keys around a day."""
    return F.struct(
        F.date_format(F.date_sub(day, before), "yyyyMMdd").alias("start"),
        F.date_format(F.date_add(day, after), "yyyyMMdd").alias("end"),
    )
