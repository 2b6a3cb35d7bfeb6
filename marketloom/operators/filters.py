"""Predicates of the loaders and clean-up jobs, as filters that reach the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_any, query_terms


def symbol_day(df: DataFrame, symbol: str, day: Column, *, key: str = "symbol", ts: str = "timestamp") -> DataFrame:
    """One symbol, one UTC day, half open."""
    start = day.cast("timestamp")
    return df.filter(
        (F.col(key) == symbol) & (F.col(ts) >= start) & (F.col(ts) < start + F.expr("INTERVAL 1 DAY"))
    )


def in_day(ts: Column, day: Column) -> Column:
    start = day.cast("timestamp")
    return (ts >= start) & (ts < start + F.expr("INTERVAL 1 DAY"))


def not_enriched(*columns: str) -> Column:
    """All of the enrichment columns are still missing."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNull()
    return condition


def older_than(ts: Column, as_of: Column, days: int) -> Column:
    return ts < as_of - F.expr(f"INTERVAL {days} DAYS")


def differs(column: Column, value) -> Column:
    """Not equal, keeping rows where the field is missing."""
    return ~column.eqNullSafe(F.lit(value))


def none_of(column: Column, values: Iterable) -> Column:
    """Not in the list, keeping rows where the field is missing."""
    return column.isNull() | ~column.isin(*values)


def missing_or_old(key: Column, ts: Column, cutoff: Column) -> Column:
    """Rows without a key that are older than the cutoff."""
    return key.isNull() & F.coalesce(ts < cutoff, F.lit(False))


def with_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def find(df: DataFrame, condition: Column, *columns: str) -> DataFrame:
    return df.filter(condition).select(*columns)


def matching_query(df: DataFrame, query: str, *texts: str) -> DataFrame:
    """Rows where any OR-term of the row's query occurs in one of the texts."""
    terms = query_terms(F.col(query))
    hit = F.lit(False)
    for text in texts:
        hit = hit | F.coalesce(matches_any(F.col(text), terms), F.lit(False))
    return df.filter(hit)


def split_valid(df: DataFrame, status: Column) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("status", status)
    return checked.filter("status = 'ok'").drop("status"), checked.filter("status <> 'ok'")
