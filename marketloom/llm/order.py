"""Positions of rows within groups of any size, by range partitions and one running total per partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import removed, staged


def same(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs))


def positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``position`` (from 0, by ``order``, nulls first) and ``total`` within the group.

    Rows are cut into ranges of (group, order), so a group that holds most rows lies in many partitions; only the number of
    rows of each group in each partition is summed up in order. Rows that tie in ``order`` get positions in any order, so
    ``order`` should end in a column that tells rows apart where a third of all rows may tie.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = staged(dealt.withColumn("_part", F.shiftrightunsigned("_at", 33)), "positions")
    parts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    own = Window.partitionBy(*group)
    parts = staged(
        parts.select(
            *[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_p"), F.sum("n").over(own).alias("total"),
            (F.sum("n").over(own.orderBy("_part")) - F.col("n") - F.col("first")).alias("_base"),
        ),
        "parts",
    )
    on = (F.col("_part") == F.col("_p")) & same([(F.col(c), F.col(f"_{c}")) for c in group])
    found = staged(dealt.join(parts, on).select(*rows.columns, (F.col("_at") + F.col("_base")).alias("position"), "total"), "ranked")
    removed(dealt, parts)
    return found
