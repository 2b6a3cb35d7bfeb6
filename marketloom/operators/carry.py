"""Carry-forward of daily rows: which day fills each missing (symbol, day), and the rows that do.

The plan has one row per symbol and day of the range, found from the days that
have rows, never from the rows: one summary row per (symbol, day) and input, and
``last`` along the days of a symbol, which are no more than the calendar has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import redate

#: Which stored day may stand in for a missing one.
NEWEST, BEFORE = "newest", "before"


def plan_days(
    universe: DataFrame, start: Column, end: Column, incoming_days: DataFrame, stored_days: DataFrame, backup_symbols: DataFrame,
    *, key: str = "symbol", carry: str = NEWEST,
) -> DataFrame:
    """(key, day, source_used, from_day) for every day of the range and symbol of the universe.

    ``incoming_days`` and ``stored_days`` have one row per (key, day) with rows. A day without incoming rows takes

    * under ``newest`` the last stored day, whatever its date, or a later day of this range that was loaded before it,
      as a loop over the days does, each of which sees what the ones before it stored;
    * under ``before`` the last day, stored or incoming, that is not after it, and nothing when it is stored itself;

    and else the backup (from_day is null); ``failed`` when there is none.
    """
    if carry not in (NEWEST, BEFORE):
        raise ValueError(f"carry must be '{NEWEST}' or '{BEFORE}'")
    days = universe.select(key).distinct().withColumn("day", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))))
    # One aggregate over the tagged days of all inputs.
    tagged = (
        incoming_days.select(key, "day", F.lit("incoming").alias("tag"))
        .unionByName(stored_days.select(key, "day", F.lit("stored").alias("tag")))
        .unionByName(backup_symbols.select(key, F.lit(None).cast("date").alias("day"), F.lit("backup").alias("tag")))
    )
    is_stored = F.col("tag") == "stored"
    symbols = tagged.groupBy(key).agg(
        F.max(F.when(is_stored, F.col("day"))).alias("_newest"),
        F.max(F.when(is_stored & (F.col("day") < start), F.col("day"))).alias("_earlier"),
        F.count_if(F.col("tag") == "backup").alias("_saved"),
    )
    inside = tagged.filter(F.col("day").between(start, end))
    have = inside.groupBy(key, "day").agg(F.count_if(~is_stored).alias("_in"), F.count_if(is_stored).alias("_held"))
    rows = days.join(have, [key, "day"], "left").join(symbols, key, "left")
    along = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    brought = F.col("_in") > 0
    rows = rows.withColumn("_last_in", F.last(F.when(brought, F.col("day")), ignorenulls=True).over(along))
    rows = rows.withColumn("_last_held", F.coalesce(F.last(F.when(F.col("_held") > 0, F.col("day")), ignorenulls=True).over(along), "_earlier"))
    held = F.col("_newest") if carry == NEWEST else F.col("_last_held")
    incoming_later = F.col("_last_in").isNotNull() & (held.isNull() | (F.col("_last_in") >= held))
    used = (
        F.when(brought, "incoming")
        .when(F.lit(carry == NEWEST) & (held >= F.col("day")), "stored")
        .when(F.lit(carry == BEFORE) & (F.col("_held") > 0), "kept")
        .when(incoming_later, "incoming")
        .when(held.isNotNull(), "stored")
        .when(F.col("_saved") > 0, "backup")
        .otherwise("failed")
    )
    rows = rows.withColumn("source_used", used)
    from_day = F.when(brought, F.col("day")).when(F.col("source_used") == "incoming", F.col("_last_in")).when(F.col("source_used") == "stored", held)
    return rows.select(key, "day", "source_used", from_day.alias("from_day"))


def carried_rows(
    plan: DataFrame, incoming: DataFrame, stored: DataFrame, backup: DataFrame,
    *, key: str = "symbol", ts: str = "timestamp", stored_day: str | None = None,
) -> DataFrame:
    """The rows to load: those of ``from_day`` of the source, moved to ``day``. Every input is read once; a stored table is
    pruned to the days that are used when ``stored_day`` names its day partition."""
    columns = incoming.columns

    def wanted(source: str) -> DataFrame:
        own = plan.filter(F.col("source_used") == source)
        return own.select(F.col(key).alias("_key"), F.col("day").alias("_to"), F.col("from_day").alias("_from"), "source_used")

    def of(rows: DataFrame, source: str, day: Column | None) -> DataFrame:
        want = wanted(source)
        on = rows[key] == want["_key"]
        if day is not None:
            on = on & (day == (want["_from"] if stored_day is None or source != "stored" else F.date_format(want["_from"], "yyyy-MM-dd")))
        joined = rows.join(want, on).withColumn(ts, redate(F.col(ts), F.col("_to")))
        carried = F.col("_from").isNull() | (F.col("_from") != F.col("_to"))
        return joined.select(*columns, "source_used", carried.alias("carried"))

    held = F.to_date(stored[ts]) if stored_day is None else stored[stored_day]
    return (
        of(incoming, "incoming", F.to_date(incoming[ts]))
        .unionByName(of(stored, "stored", held))
        .unionByName(of(backup, "backup", None))
    )
