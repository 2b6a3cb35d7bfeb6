"""Lookup, semi, anti and update-by-key joins.

No join here carries a broadcast hint: sides that are small at run time are
broadcast by Spark's own size threshold, larger ones are shuffled and split by
the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import first_row


def lookup_or_own(
    df: DataFrame, earlier: DataFrame, keys: Sequence[str], value: str, out: str, order: Column | None = None
) -> DataFrame:
    """Earlier value of the key, or the row's own value when there is none.
    Duplicate keys on the earlier side collapse to the last one first."""
    order = F.col(value) if order is None else order
    latest = earlier.groupBy(*keys).agg(F.max_by(value, order).alias("_earlier"), F.lit(True).alias("_seen"))
    seen = F.col("_seen").isNotNull()
    return (
        df.join(latest, list(keys), "left")
        .withColumn(out, F.when(seen, F.col("_earlier")).otherwise(F.col(value)))
        .drop("_earlier", "_seen")
    )


def only_known(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(known.select(*keys), list(keys), "left_semi")


def only_new(df: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(stored.select(*keys), list(keys), "left_anti")


def fan_out(mapping: DataFrame) -> DataFrame:
    """One row per asset and subreddit, with the query and the cross ids."""
    return mapping.withColumn("subreddit", F.explode("subreddits")).drop("subreddits")


def not_fetched_today(pairs: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """Asset and subreddit pairs without a row extracted on ``as_of``'s UTC day."""
    start = F.date_trunc("day", as_of)
    today = stored.filter(
        (F.col("extraction_timestamp_utc") >= start)
        & (F.col("extraction_timestamp_utc") < start + F.expr("INTERVAL 1 DAY"))
    )
    return only_new(pairs, today.select("asset_id", "subreddit").distinct(), ["asset_id", "subreddit"])


def update_by_id(df: DataFrame, updates: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Set the given columns from the updates; rows without an update keep theirs.

    Of several updates of one id the largest, compared column by column, counts.
    """
    one = updates.groupBy(row_id).agg(F.max(F.struct(*columns)).alias("_new"))
    fresh = one.select(row_id, *[F.col("_new")[c].alias(f"_new_{c}") for c in columns])
    joined = df.join(fresh, row_id, "left")
    kept = [F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*kept)


def insert_if_newer(incoming: DataFrame, stored: DataFrame, series: str, date: str) -> DataFrame:
    """The newest incoming row of every series that has no stored row of the
    same or a later date."""
    newest = first_row(incoming, [series], F.struct(F.col(date), *_tie(incoming, series, date)), last=True)
    top = stored.groupBy(series).agg(F.max(date).alias("_stored"))
    return (
        newest.join(top, series, "left")
        .filter(F.col("_stored").isNull() | (F.col("_stored") < F.col(date)))
        .drop("_stored")
        .select(*incoming.columns)
    )


def _tie(df: DataFrame, *skip: str) -> list[Column]:
    return [F.col(c) for c in df.columns if c not in skip]


def weighted_holdings(allocation: DataFrame, latest: DataFrame, key: str, weight: str, value: str) -> DataFrame:
    """Allocation weight times the latest value of each holding; null for one without a value."""
    return allocation.join(latest, key, "left").withColumn("weighted", F.col(weight) * F.col(value))
