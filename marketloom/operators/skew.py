"""Group operators that stay parallel when one key holds much of the table.

A plain window over a key sends the whole group to one task. The operators here
first reduce every group - in salted slices, or to one row per id or date - and
only combine the small results per key. Results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    *,
    spread: Sequence[str],
    rank: str = "rank",
    slices: int = SLICES,
) -> DataFrame:
    """The first ``k`` rows of every key group, with their rank.

    ``spread`` names columns that vary inside a group (usually the row id); their
    hash cuts a hot group into slices, each slice is limited on its own, and at
    most ``slices * k`` rows per key reach the second step.
    """
    salted = df.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(slices)))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    first = salted.withColumn("_n", F.row_number().over(inner)).filter(F.col("_n") <= k).drop("_n", "_slice")
    return first.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)


def first_row(df: DataFrame, keys: Sequence[str], order: Column, *, last: bool = False) -> DataFrame:
    """One whole row per key by smallest (or largest) ``order``.

    An aggregate, so copies of one key collapse before the shuffle. The order
    must be unique inside a key for the result to be determined.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    grouped = df.withColumn("_order", order).groupBy(*keys).agg(
        pick(F.struct(*rest), F.col("_order")).alias("_row")
    )
    return grouped.select(*keys, "_row.*").select(*df.columns)


def keep_one_id(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Rows whose id is the smallest of their key; wide rows travel once.

    The aggregate sees only keys and ids; the rows are then picked by a semi
    join on the unique id, which cannot be skewed however many copies a key has.
    """
    ids = df.groupBy(*keys).agg(F.min(row_id).alias(row_id)).select(row_id)
    return df.join(ids, row_id, "left_semi")


def newest_edge(
    df: DataFrame, key: str, recency: Sequence[str], k: int, *, edge: str = "_edge"
) -> DataFrame:
    """Per key the recency (a struct) of its k-th newest row, or of its oldest
    row when it has fewer. Reads only the key and the recency columns."""
    narrow = df.select(key, *recency)
    newest = [F.col(c).desc_nulls_last() for c in recency]
    kept = top_k(narrow, [key], newest, k, spread=[recency[-1]])
    return kept.groupBy(key).agg(F.min(F.struct(*recency)).alias(edge))


def one_per_date(df: DataFrame, keys: Sequence[str], date: str, order: Column | None = None) -> DataFrame:
    """One row per key and calendar date (the smallest by ``order``).

    Copies collapse before the shuffle, and afterwards no key has more rows than
    the calendar has days, so a window along the dates of one key is small
    however many rows came in.
    """
    rest = [F.col(c) for c in df.columns if c not in (*keys, date)]
    dated = df.withColumn(date, F.to_date(date))
    return first_row(dated, [*keys, date], F.struct(*rest) if order is None else order)


def repeated_dates(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """What ``one_per_date`` leaves out: (keys, date, rows) with the number of rows beyond the first of a key and calendar
    date. Operators along the dates of a key take one row per date; this is their reject frame."""
    counted = df.groupBy(*keys, F.to_date(date).alias(date)).agg((F.count("*") - 1).alias("rows"))
    return counted.filter("rows > 0")
