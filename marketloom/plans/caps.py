"""Stablecoin market-cap snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import percent_change, round_cents, trend_direction
from ..operators import aggregates
from ..operators.filters import differs
from ..sources import tables

KEYS = ["Symbol", "Name"]


def priced_against_last(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched coins with the value of the latest stored snapshot (their own
    when they were not in it), the trend, and whether they were ever stored.

    One aggregate over the history serves both questions: a coin is known when
    it has a group, and was in the latest snapshot when its last date is the
    table's last. The row's direction follows the rounded trend.
    """
    coins = stored.filter(differs(F.col("Symbol"), "ALL_STABLECOINS"))
    history = coins.groupBy(*KEYS).agg(
        F.max("Date").alias("_seen"),
        F.max_by("Market Cap", F.struct("Date", "Market Cap")).alias("_earlier"),
    )
    newest = stored.select(F.max("Date")).scalar()
    own = F.col("Market Cap")
    change = percent_change(own, F.col("Market Cap_Yesterday"))
    return (
        fetched.join(history, KEYS, "left")
        .withColumn("Market Cap_Yesterday", F.when(F.col("_seen") == newest, F.col("_earlier")).otherwise(own))
        .withColumn("selected", F.col("_seen").isNotNull())
        .drop("_seen", "_earlier")
        .withColumn("Trend (%)", round_cents(change))
        .withColumn("Trend direction", trend_direction(F.col("Trend (%)")))
    )


def snapshot(fetched: DataFrame, stored: DataFrame, date: Column, order: Column | None = None) -> DataFrame:
    """The day's rows, largest market cap first: a total over all fetched coins
    and the coins seen before. ``order`` ranks duplicates of a coin; the first
    fetched one stays."""
    rank = F.struct(F.lit(0) if order is None else order, -F.col("Market Cap"))
    priced = priced_against_last(fetched, stored)
    rows = aggregates.details_with_total(priced, KEYS, rank, date)
    return rows.orderBy(F.col("Market Cap").desc(), *KEYS)


def store_snapshot(
    spark: SparkSession, fetched: DataFrame, table: tables.Table, date: Column, order: Column | None = None
) -> int:
    """Append the day's snapshot unless the day is stored already; rows written."""
    stored = tables.read(spark, table)
    if not stored.filter(F.col("Date") == date).isEmpty():
        return 0
    return tables.append(snapshot(fetched, stored, date, order), table)
