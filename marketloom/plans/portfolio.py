"""Portfolio return rows for given dates, over supplied daily returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import range_status
from ..operators import aggregates, dml, windows
from ..operators.skew import one_per_date
from ..sources import tables

KEYS = ["portfolio", "date"]


def book(stored: DataFrame, supplied: DataFrame) -> DataFrame:
    """Stored rows and the supplied rows of dates without one, with status,
    running return and trend state.

    ``stored`` has portfolio, date, daily_return, stored_cumulative; ``supplied``
    portfolio, date, daily_return. One aggregate drops supplied rows of stored
    dates and repeated rows of a date.
    """
    new = supplied.withColumn("stored_cumulative", F.lit(None).cast("double"))
    both = stored.withColumn("status", F.lit("stored")).unionByName(new.withColumn("status", F.lit("inserted")))
    rows = one_per_date(both, ["portfolio"], "date", F.struct(F.col("status") != "stored", F.col("daily_return")))
    return windows.trend_state(windows.running_return(rows, ["portfolio"]), ["portfolio"])


def backfill_summary(stored: DataFrame, supplied: DataFrame) -> DataFrame:
    """Inserted and skipped dates."""
    return aggregates.status_counts(dml.insert_absent(stored, supplied, KEYS, F.col("daily_return")))


def backfill(spark: SparkSession, supplied: DataFrame, table: tables.Table, start: str, end: str) -> dict:
    """Add the supplied returns of an inclusive range of dates (``yyyyMMdd``) to
    the table; dates that are stored are skipped. A reversed range is an error.

    ``supplied`` has portfolio, date and daily_return.
    """
    status = spark.range(1).select(range_status(F.lit(start), F.lit(end), order_matters=True)).first()[0]
    if status != "ok":
        raise ValueError(f"{start} to {end}: {status}")
    wanted = supplied.filter(F.date_format("date", "yyyyMMdd").between(start, end))
    stored = tables.read(spark, table).select(
        "portfolio", "date", F.col("percentage_of_daily_return").alias("daily_return"),
        F.col("percentage_of_cumulative_return").alias("stored_cumulative"),
    )
    asked = wanted.select(*KEYS).distinct().count()
    new = book(stored, wanted).filter("status = 'inserted'").select(
        "portfolio", "date", F.col("daily_return").alias("percentage_of_daily_return"),
        F.col("cumulative_return").alias("percentage_of_cumulative_return"),
    )
    inserted = tables.append(new, table)
    return {"inserted": inserted, "skipped": asked - inserted}
