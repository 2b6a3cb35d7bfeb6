"""Aggregations; all of them combine on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_change, round_cents, trend_direction
from ..functions.text import token_estimate
from .filters import differs


def distinct_pairs(df: DataFrame, exclude: tuple[str, object], columns: Sequence[str]) -> DataFrame:
    name, value = exclude
    return df.filter(differs(F.col(name), value)).select(*columns).distinct()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def counts_by(df: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """Total and conditional row counts per key."""
    return df.groupBy(key).agg(
        F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()]
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Every row of a key that occurs more than once: group size, the id that
    stays, and the row's own id. One row per copy, so no group is collected."""
    groups = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("copies"), F.min(row_id).alias("kept_id"))
        .filter("copies > 1")
    )
    return df.select(*keys, row_id).join(groups, list(keys)).select(*keys, "copies", "kept_id", row_id)


def latest_snapshot(df: DataFrame, date: str) -> DataFrame:
    """All rows of the largest date; the date reaches the scan as a subquery."""
    return df.filter(F.col(date) == df.select(F.max(date)).scalar())


def details_with_total(priced: DataFrame, keys: Sequence[str], rank: Column, date: Column) -> DataFrame:
    """Selected detail rows plus one grand total over *all* priced rows.

    ``priced`` has Market Cap, Market Cap_Yesterday, the trend columns and
    ``selected``. One pass: grouping sets give the first row of each coin (by
    ``rank``) and the total together. Sums run over decimals; the total's
    direction follows the unrounded trend.
    """
    exact = "decimal(28,2)"
    now, before = F.col("Market Cap"), F.col("Market Cap_Yesterday")
    row = F.struct(now.alias("cap"), F.col("`Trend (%)`").alias("pct"), F.col("`Trend direction`").alias("word"))
    sets = priced.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(
        F.grouping(keys[0]).alias("_total"),
        F.min_by(row, rank).alias("_row"),
        F.bool_or("selected").alias("_selected"),
        F.coalesce(F.sum(now.cast(exact)), F.lit(0)).cast("double").alias("_now"),
        F.coalesce(F.sum(before.cast(exact)), F.lit(0)).cast("double").alias("_before"),
    )
    total = F.col("_total") == 1
    change = F.when(F.col("_before") > 0, percent_change(F.col("_now"), F.col("_before"))).otherwise(F.lit(0.0))
    return sets.filter(total | F.col("_selected")).select(
        date.alias("Date"),
        F.when(total, "ALL_STABLECOINS").otherwise(F.col(keys[0])).alias(keys[0]),
        F.when(total, "All Stablecoins").otherwise(F.col(keys[1])).alias(keys[1]),
        F.when(total, F.col("_now")).otherwise(F.col("_row.cap")).alias("Market Cap"),
        F.when(total, round_cents(change)).otherwise(F.col("_row.pct")).alias("Trend (%)"),
        F.when(total, trend_direction(change)).otherwise(F.col("_row.word")).alias("Trend direction"),
    )


def completeness(df: DataFrame, key: str, ts: str, *, expected: int, step: str) -> DataFrame:
    """Expected and actual rows per key and UTC day, and whether the day's
    start or end is missing. ``step`` is the candle interval."""
    day = F.to_date(ts)
    first_slot = F.col("day").cast("timestamp")
    last_slot = first_slot + F.expr("INTERVAL 1 DAY") - F.expr(f"INTERVAL {step}")
    return (
        df.groupBy(key, day.alias("day"))
        .agg(F.count("*").alias("actual"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .withColumn("expected", F.lit(expected).cast("long"))
        .withColumn("missing", F.greatest(F.col("expected") - F.col("actual"), F.lit(0).cast("long")))
        .withColumn("missing_at_start", (F.col("missing") > 0) & (F.col("first_ts") > first_slot))
        .withColumn("missing_at_end", (F.col("missing") > 0) & (F.col("last_ts") < last_slot))
    )


def missing_slots(df: DataFrame, key: str, ts: str, *, slot_seconds: int) -> DataFrame:
    """The missing slots of every (key, day) that has rows.

    A day has a fixed number of slots, so the collected set is bounded by it
    (1,440 for minutes) whatever the number of rows.
    """
    slots = 86_400 // slot_seconds
    day = F.to_date(ts)
    index = F.floor((F.unix_timestamp(ts) - F.unix_timestamp(F.date_trunc("day", ts))) / slot_seconds)
    return (
        df.groupBy(key, day.alias("day"))
        .agg(F.collect_set(index.cast("int")).alias("present"))
        .withColumn("slot", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(slots - 1)), "present")))
        .select(key, "day", F.col("slot").cast("long").alias("slot"))
    )


def latest_per_series(df: DataFrame, series: str, date: str, value: str, tie: str) -> DataFrame:
    """Newest date of each series and its value; the smallest tie wins."""
    order = F.struct(F.col(date), -F.col(tie))
    return df.groupBy(series).agg(F.max(date).alias(date), F.max_by(value, order).alias(value))


def batch_statistics(df: DataFrame, text: str, result: str) -> DataFrame:
    """Processed, successful and failed rows, scorer calls and estimated tokens."""
    has_text = F.coalesce(F.col(text) != "", F.lit(False))
    done = F.col(result).isNotNull()
    return df.agg(
        F.count("*").alias("processed"),
        F.count_if(done).alias("successful"),
        F.count_if(~done).alias("failed"),
        F.count_if(has_text).alias("requests"),
        F.coalesce(F.sum(F.when(has_text, token_estimate(F.col(text)))), F.lit(0)).cast("long").alias("tokens"),
    )


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def upsert_counts(incoming_keys: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many incoming keys are new and how many update a stored row."""
    stored = existing.select(*keys, F.lit(True).alias("_stored"))
    joined = incoming_keys.select(*keys).distinct().join(stored, list(keys), "left")
    return joined.agg(
        F.count_if(F.col("_stored").isNull()).alias("inserted"),
        F.count_if(F.col("_stored").isNotNull()).alias("updated"),
    )


def average_sentiment(scored: DataFrame, key: str, score: str = "sentiment_score") -> DataFrame:
    """Mean of the three scores per key over scored rows."""
    exact = "decimal(18,12)"
    means = [
        F.round((F.sum(F.col(f"{score}.{c}").cast(exact)) / F.count("*")).cast("double"), 6).alias(c)
        for c in ("positive", "negative", "neutral")
    ]
    return (
        scored.filter(F.col(score).isNotNull()).groupBy(key).agg(F.count("*").alias("articles"), *means)
    )


def fetch_summary(df: DataFrame, asset: str) -> DataFrame:
    """Submissions per asset."""
    return df.groupBy(asset).agg(F.count("*").alias("submissions"))


def rollup_ohlcv(
    df: DataFrame, unit: str, *, key: str = "symbol", ts: str = "timestamp", price: str | None = None
) -> DataFrame:
    """Open, high, low, close and volume per key and calendar unit, from ticks
    (``price``) or from finer candles. The earliest and latest rows of a bucket
    need distinct times for open and close to be determined."""
    o, h, l, c = (price,) * 4 if price else ("open", "high", "low", "close")
    return df.groupBy(key, F.date_trunc(unit, ts).alias("bucket")).agg(
        F.min_by(o, ts).alias("open"),
        F.max(h).alias("high"),
        F.min(l).alias("low"),
        F.max_by(c, ts).alias("close"),
        F.sum(F.col("volume").cast("decimal(28,4)")).cast("double").alias("volume"),
    )


def calendar_bars(bars: DataFrame, units: Sequence[str], *, key: str = "symbol", ts: str = "timestamp") -> DataFrame:
    """Bars of several calendar units from finer bars in one aggregate."""
    unit = F.explode(F.array(*[F.lit(u) for u in units]))
    bucket = F.lit(None).cast("timestamp")
    for name in units:
        bucket = F.when(F.col("unit") == name, F.date_trunc(name, ts)).otherwise(bucket)
    return bars.withColumn("unit", unit).groupBy(key, "unit", bucket.alias("bucket")).agg(
        F.min_by("open", ts).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", ts).alias("close"),
        F.sum(F.col("volume").cast("decimal(28,4)")).cast("double").alias("volume"),
    )
