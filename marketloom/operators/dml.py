"""Idempotent table changes as pure ``(stored, incoming) -> new`` functions.

The writers that make them durable are in ``sources.tables``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import redate
from .filters import missing_or_old, older_than
from .joins import insert_if_newer, only_new
from .skew import first_row

__all__ = ["insert_if_newer"]


def replaced_days(incoming: DataFrame, *, key: str = "symbol", ts: str = "timestamp", days: str = "first") -> DataFrame:
    """The (key, day) pairs a load replaces: the day of each key's first row,
    or every day it brings."""
    if days == "first":
        return incoming.groupBy(key).agg(F.to_date(F.min(ts)).alias("_day"))
    if days == "all":
        return incoming.select(key, F.to_date(ts).alias("_day")).distinct()
    raise ValueError("days must be 'first' or 'all'")


def replace_days(
    stored: DataFrame, incoming: DataFrame, *, key: str = "symbol", ts: str = "timestamp", days: str = "first"
) -> DataFrame:
    gone = replaced_days(incoming, key=key, ts=ts, days=days)
    kept = stored.withColumn("_day", F.to_date(ts)).join(gone, [key, "_day"], "left_anti")
    return kept.select(*stored.columns).unionByName(incoming.select(*stored.columns))


def expire(df: DataFrame, universe: DataFrame, as_of: Column, days: int, *, key: str = "symbol", ts: str = "timestamp") -> DataFrame:
    """Delete rows older than ``days`` of the configured symbols only."""
    listed = universe.select(key).distinct().withColumn("_listed", F.lit(True))
    gone = F.col("_listed").isNotNull() & F.coalesce(older_than(F.col(ts), as_of, days), F.lit(False))
    return df.join(listed, key, "left").filter(~gone).select(*df.columns)


def upsert(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column, *, only_if_present: Sequence[str] = ()
) -> DataFrame:
    """Update stored rows or insert new ones by key.

    Incoming columns win, nulls included; ``only_if_present`` columns change
    only when the incoming value is not null; stored columns the batch does not
    have survive. The last duplicate of a batch (by ``order``) wins. A null in a
    key equals a null. The stored rows are joined once with the batch, which is
    broadcast when Spark measured it small; its new rows are found by keys alone.
    """
    batch = first_row(incoming, keys, order, last=True)
    fresh = batch.select(*[F.col(f"`{c}`").alias(f"_new_{c}") for c in batch.columns], F.lit(True).alias("_in"))

    def merged(c: str) -> Column:
        old = F.col(f"`{c}`")
        if c in keys or c not in incoming.columns:
            return old
        new = F.col(f"`_new_{c}`")
        return F.when(F.col("_in"), F.coalesce(new, old) if c in only_if_present else new).otherwise(old).alias(c)

    kept = stored.join(fresh, _same(keys), "left").select(*[merged(c) for c in stored.columns])
    known = _known(stored, fresh, keys)
    new = batch.join(known, _same(keys, "_known_"), "left_anti")
    return kept.unionByName(new.select(*[c for c in stored.columns if c in incoming.columns]), allowMissingColumns=True)


def _same(keys: Sequence[str], prefix: str = "_new_") -> Column:
    """Keys equal, nulls included, to those of the other side named with a prefix."""
    return reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{prefix}{k}`")) for k in keys])


def _known(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored keys that a batch has, once each."""
    met = stored.select(*keys).join(fresh, _same(keys), "left_semi").distinct()
    return met.select(*[F.col(f"`{k}`").alias(f"_known_{k}") for k in keys])


def unset(df: DataFrame, column: str) -> DataFrame:
    """Clear an enrichment column in all rows."""
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Every incoming row with the status ``exists`` or ``inserted``; one row
    per key is inserted."""
    batch = first_row(incoming, keys, order)
    fresh = batch.select(*[F.col(f"`{k}`").alias(f"_new_{k}") for k in keys])
    known = _known(stored, fresh, keys).withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNull(), "inserted").otherwise("exists").alias("status")
    return batch.join(known, _same(keys, "_known_"), "left").select(*[F.col(f"`{c}`") for c in batch.columns], status)


def snapshot_if_absent(stored: DataFrame, snapshot: DataFrame, date: str) -> DataFrame:
    """Rows of dates that have no stored row at all."""
    return only_new(snapshot, stored.select(date).distinct(), [date])


def purge_unkeyed(df: DataFrame, mapping: DataFrame, cutoff: Column, *, key: str = "asset_id", ts: str = "created_at_utc") -> DataFrame:
    """Delete old rows without a key; does nothing when the mapping is empty."""
    any_mapping = mapping.limit(1).select(F.count("*") > 0).scalar()
    return df.filter(~(missing_or_old(F.col(key), F.col(ts), cutoff) & any_mapping))


def symbol_sources(
    universe: DataFrame, incoming: DataFrame, stored: DataFrame, backup: DataFrame,
    *, key: str = "symbol", ts: str = "timestamp", stored_day: str | None = None,
) -> DataFrame:
    """One row per symbol of the universe: where its rows come from (incoming,
    last_day, backup or failed) and its last stored day.

    ``stored_day`` names the table's day partition; the last days are then found
    from partition values alone.
    """
    day = F.to_date(ts) if stored_day is None else F.col(stored_day)
    tagged = (
        incoming.select(key, F.lit("incoming").alias("_tag"), F.lit(None).cast("string").alias("_on"))
        .unionByName(stored.select(key, F.lit("stored").alias("_tag"), day.cast("string").alias("_on")))
        .unionByName(backup.select(key, F.lit("backup").alias("_tag"), F.lit(None).cast("string").alias("_on")))
    )
    found = tagged.groupBy(key).agg(
        F.count_if(F.col("_tag") == "incoming").alias("_have"), F.max("_on").alias("_day"), F.count_if(F.col("_tag") == "backup").alias("_saved")
    )
    used = (
        F.when(F.col("_have") > 0, "incoming")
        .when(F.col("_day").isNotNull(), "last_day")
        .when(F.col("_saved") > 0, "backup")
        .otherwise("failed")
    )
    known = universe.select(key).distinct().join(found, key, "left")
    return known.select(key, "_day", used.alias("source_used"))


def fill_missing_symbols(
    universe: DataFrame, incoming: DataFrame, stored: DataFrame, backup: DataFrame, day: Column,
    *, key: str = "symbol", ts: str = "timestamp", stored_day: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows to load for one day: the incoming ones, and for symbols of the
    universe that brought none, their last stored day or else their backup,
    moved to ``day``. Also returns the symbols nothing was found for."""
    columns = incoming.columns
    sources = symbol_sources(universe, incoming, stored, backup, key=key, ts=ts, stored_day=stored_day)
    held = F.to_date(ts) if stored_day is None else F.col(stored_day)

    def tagged(df: DataFrame, tag: str, on: Column | None) -> DataFrame:
        return df.select(*columns, F.lit(tag).alias("_tag"), (F.lit(None) if on is None else on).cast("string").alias("_held"))

    # One tagged union, joined once: each input is read for its days and for its rows, whatever fills a symbol.
    rows = tagged(incoming, "incoming", None).unionByName(tagged(stored, "last_day", held)).unionByName(tagged(backup, "backup", None))
    used = sources.select(F.col(key).alias("_key"), F.col("_day").cast("string").alias("_last"), "source_used")
    met = (F.col(key) == F.col("_key")) & (F.col("_tag") == F.col("source_used"))
    met = met & ((F.col("_tag") != "last_day") | (F.col("_held") == F.col("_last")))
    moved = F.when(F.col("_tag") == "incoming", F.col(ts)).otherwise(redate(F.col(ts), day))
    listed = rows.join(used, met).withColumn(ts, moved).select(*columns, "source_used")
    # Incoming rows of symbols outside the universe are loaded as well.
    others = incoming.join(universe.select(key).distinct(), key, "left_anti").select(*columns).withColumn("source_used", F.lit("incoming"))
    return listed.unionByName(others), sources.filter("source_used = 'failed'").select(key)
