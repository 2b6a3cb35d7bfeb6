"""Macro series load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import insert_if_newer
from ..operators.skew import first_row
from ..sources import readers, tables


def window_bounds(as_of: Column, *, scheduled: bool) -> tuple[Column, Column]:
    """Seven days up to the day; the scheduled form also looks seven days ahead."""
    day = F.to_date(as_of)
    return F.date_sub(day, 7), F.date_add(day, 7) if scheduled else day


def newer_observations(raw: DataFrame, series: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows of unknown series)."""
    known, rejected = readers.enrich_macro(raw, series)
    return insert_if_newer(known, stored, "series_id", "date"), rejected


def load(
    spark: SparkSession, landed: str, table: tables.Table, as_of: str, *, scheduled: bool = False, series_id: str | None = None
) -> dict:
    start, end = window_bounds(F.lit(as_of).cast("timestamp"), scheduled=scheduled)
    raw = readers.read_observations(spark, landed, start, end)
    if series_id is not None:
        raw = raw.filter(F.col("series_id") == series_id)
    rows, rejected = newer_observations(raw, readers.macro_series(spark), tables.read(spark, table))
    return {"inserted": tables.append(rows, table), "rejected": rejected}


def backfill(spark: SparkSession, landed: str, table: tables.Table, start: str, end: str) -> int:
    """One job over an inclusive range of days. The last day's seven-day window
    decides per series, exactly as loading the days one after another would:
    each newer observation of the range is inserted once."""
    first, last = F.to_date(F.lit(start), "yyyyMMdd"), F.to_date(F.lit(end), "yyyyMMdd")
    if start > end:
        return 0
    raw = readers.read_observations(spark, landed, F.date_sub(first, 7), last)
    known, _ = readers.enrich_macro(raw, readers.macro_series(spark))
    rows = newest_by_day(known, tables.read(spark, table), first)
    return tables.append(rows, table)


def newest_by_day(known: DataFrame, stored: DataFrame, first_day: Column) -> DataFrame:
    """Observations that a daily run over the range would insert: those after
    the newest stored date, without the ones that were already superseded by a
    newer observation on the first day."""
    top = stored.groupBy("series_id").agg(F.max("date").alias("_stored"))
    opening = (
        known.filter(F.to_date("date") <= first_day).groupBy("series_id").agg(F.max("date").alias("_opening"))
    )
    once = first_row(known, ["series_id", "date"], F.col("value"))
    return (
        once.join(top, "series_id", "left")
        .join(opening, "series_id", "left")
        .filter(F.col("_stored").isNull() | (F.col("date") > F.col("_stored")))
        .filter(F.col("_opening").isNull() | (F.col("date") >= F.col("_opening")))
        .select(*known.columns)
    )
