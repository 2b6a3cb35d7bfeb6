"""Top-N, keep-first, streak, running return and last-day operators.

Groups of unknown size go through ``skew``; nothing collects a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import momentum, next_return_band, percent_change, reversal_probability
from .skew import keep_one_id, newest_edge, one_per_date, top_k

LOOKBACK = 5


def cap_newest(
    df: DataFrame, mapping: DataFrame, *, key: str = "ticker", ts: str = "extraction_timestamp_utc",
    row_id: str = "_id", keep: int = 100,
) -> DataFrame:
    """Keep the newest rows of every mapped key; other keys are left alone.

    Finds each key's oldest surviving row from narrow columns, then filters the
    wide table against that one row per key.
    """
    mapped = mapping.select(key).distinct()
    edges = newest_edge(df.select(key, ts, row_id).join(mapped, key, "left_semi"), key, [ts, row_id], keep)
    joined = df.join(edges, key, "left")
    alive = F.col("_edge").isNull() | (F.struct(ts, row_id) >= F.col("_edge"))
    return joined.filter(alive).select(*df.columns)


def dedupe_and_cap(
    df: DataFrame, mapping: DataFrame, *, key: str = "ticker", link: str = "link",
    ts: str = "extraction_timestamp_utc", row_id: str = "_id", keep: int = 100,
) -> DataFrame:
    """Keep-first per (key, link), then the newest rows of every mapped key.

    Both rules are decided on ids and times alone; the wide rows are read once
    and picked by a semi join on the unique id.
    """
    unique = df.groupBy(key, link).agg(F.min_by(ts, row_id).alias(ts), F.min(row_id).alias(row_id))
    mapped = mapping.select(key).distinct().withColumn("_mapped", F.lit(True))
    # Rows of unmapped keys each form a group of their own and so all survive.
    own_group = F.when(F.col("_mapped").isNull(), F.col(row_id))
    ranked = unique.join(mapped, key, "left").withColumn("_own", own_group)
    newest = [F.col(ts).desc_nulls_last(), F.col(row_id).desc()]
    kept = top_k(ranked, [key, "_own"], newest, keep, spread=[row_id])
    return df.join(kept.select(row_id), row_id, "left_semi")


def retention_with_floor(
    df: DataFrame, mapping: DataFrame, cutoff: Column, *, key: str = "asset_id",
    ts: str = "created_at_utc", row_id: str = "_id", floor: int = 40,
) -> DataFrame:
    """Drop rows older than the cutoff, but leave every mapped key at least
    ``floor`` rows when it has them, preferring the newest of the old ones."""
    old = F.coalesce(F.col(ts) < cutoff, F.lit(False))
    mapped = mapping.select(key).distinct()
    known = df.select(key, ts, row_id).join(mapped, key, "left_semi")
    counts = (
        known.groupBy(key)
        .agg(F.count("*").alias("_total"), F.count_if(old).alias("_old"))
        .withColumn("_spare", F.greatest(F.lit(0).cast("long"), F.lit(floor) - (F.col("_total") - F.col("_old"))))
    )
    newest = [F.col(ts).desc(), F.col(row_id).desc()]
    # At most ``floor`` rows per key are ranked and listed; the last one that is
    # spared is the edge between the old rows that stay and those that go.
    ranked = top_k(known.filter(old), [key], newest, floor, spread=[row_id], rank="_rank")
    listed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rank", ts, row_id))).alias("_listed"))
    last = F.get("_listed", F.least(F.col("_spare"), F.size("_listed")).cast("int") - 1)
    per_key = counts.join(listed, key, "left").select(
        key, "_spare", F.when((F.col("_spare") > 0) & last.isNotNull(), F.struct(last[ts].alias(ts), last[row_id].alias(row_id))).alias("_edge")
    )
    joined = df.join(per_key, key, "left")
    # _spare is NULL for unmapped keys; without an edge no old row is spared.
    spared = F.col("_edge").isNotNull() & (F.struct(ts, row_id) >= F.col("_edge"))
    drop = old & F.col("_spare").isNotNull() & ~spared
    return joined.filter(~drop).select(*df.columns)


def dedupe_keep_first(df: DataFrame, keys: Sequence[str] = ("ticker", "link"), row_id: str = "_id") -> DataFrame:
    return keep_one_id(df, list(keys), row_id)


def trim_day(df: DataFrame, *, key: str = "symbol", ts: str = "timestamp", limit: int = 1440, spread: Sequence[str] = ("timestamp",)) -> DataFrame:
    """First ``limit`` rows of every (key, UTC day)."""
    dated = df.withColumn("_day", F.to_date(ts))
    order = [F.col(ts), *[F.col(c) for c in spread if c != ts]]
    return top_k(dated, [key, "_day"], order, limit, spread=list(spread)).select(*df.columns)


def trend_state(df: DataFrame, keys: Sequence[str], *, date: str = "date", value: str = "daily_return") -> DataFrame:
    """Trend sign, run length within the last five rows, and the band of the
    next return, as of every row of a daily series."""
    along = Window.partitionBy(*keys).orderBy(date)
    rows = one_per_date(df, keys, date).withColumn("_up", F.col(value) >= 0)
    run, streak = F.lit(1), F.lit(1)
    for back in range(1, LOOKBACK):
        same = F.coalesce(F.lag("_up", back).over(along) == F.col("_up"), F.lit(False))
        run = F.when(same, run).otherwise(F.lit(0))
        streak = streak + run
    return (
        rows.withColumn("streak", streak.cast("long"))
        .withColumn("trend", F.when(F.col("_up"), "positive").otherwise("negative"))
        .withColumn("reversal_probability", reversal_probability(F.col("streak")))
        .withColumn("momentum", momentum(F.col("streak")))
        .withColumn("band", next_return_band(F.col("trend"), F.col("streak"), F.col(value)))
        .select(*df.columns, "trend", "streak", "reversal_probability", "momentum", "band.*")
    )


# State of a portfolio without rows. Fixed values.
NO_HISTORY = {"trend": "positive", "streak": 0, "last_return": 0.0}


def running_return(
    df: DataFrame, keys: Sequence[str], *, date: str = "date", daily: str = "daily_return",
    stored: str = "stored_cumulative", out: str = "cumulative_return",
) -> DataFrame:
    """Cumulative return along the dates of a daily series, in steps of 0.01.

    Rows with a stored value keep it and restart the sum there; later stored
    rows are not recomputed. Daily returns carry two decimals, so rounding after
    every step equals an exact sum of hundredths.
    """
    along = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    rows = one_per_date(df, keys, date).withColumn(
        "_step", F.when(F.col(stored).isNull(), F.rint(F.col(daily) * 100).cast("long")).otherwise(F.lit(0).cast("long"))
    )
    rows = rows.withColumn("_sum", F.sum("_step").over(along))
    anchor = F.rint(F.col(stored) * 100).cast("long") - F.col("_sum")
    base = F.coalesce(F.last(anchor, ignorenulls=True).over(along), F.lit(0).cast("long"))
    return rows.withColumn(out, (F.col("_sum") + base) / F.lit(100.0)).select(*df.columns, out)


def newest_comments(comments: Column, k: int | None = 3) -> Column:
    """The k newest elements of a nested comment array, or all of them, newest first."""
    order = F.array_sort(
        F.transform(
            comments,
            lambda c, i: F.struct((-F.unix_micros(c["created_at_utc"])).alias("age"), i.alias("i"), c.alias("c")),
        )
    )
    return F.transform(order if k is None else F.slice(order, 1, k), lambda s: s["c"])


def last_day_rows(df: DataFrame, *, key: str = "symbol", ts: str = "timestamp") -> DataFrame:
    """All rows of each key's last UTC day."""
    last = df.groupBy(key).agg(F.max(F.to_date(ts)).alias("_last"))
    return df.join(last, key).filter(F.to_date(ts) == F.col("_last")).select(*df.columns)


def snapshot_trend(df: DataFrame, keys: Sequence[str], *, date: str = "Date", value: str = "Market Cap") -> DataFrame:
    """Previous snapshot value and percent change for every row of a history."""
    along = Window.partitionBy(*keys).orderBy(date)
    return (
        one_per_date(df, keys, date)
        .withColumn("previous", F.lag(value).over(along))
        .withColumn("change", percent_change(F.col(value), F.col("previous")))
        .select(*df.columns, "previous", "change")
    )


def newest_per_pair(
    df: DataFrame, as_of: Column, *, keys: Sequence[str] = ("asset_id", "subreddit"), ts: str = "created_at_utc",
    row_id: str = "_id", within: str = "1 DAY", limit: int = 10,
) -> DataFrame:
    """Newest rows of the last day for every asset and subreddit."""
    recent = df.filter((F.col(ts) > as_of - F.expr(f"INTERVAL {within}")) & (F.col(ts) <= as_of))
    order = [F.col(ts).desc(), F.col(row_id).desc()]
    return top_k(recent, list(keys), order, limit, spread=[row_id]).drop("rank")


def latest_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
