"""Unions and keep-first by subset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import first_row


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def concat_classes(frames: dict[str, DataFrame]) -> DataFrame:
    return concat([df.withColumn("asset_class", F.lit(name)) for name, df in frames.items()])


def keep_first(df: DataFrame, subset: Sequence[str], order: Column) -> DataFrame:
    return first_row(df, subset, order)


def symbol_union(*frames: DataFrame) -> DataFrame:
    return concat(list(frames)).distinct()
