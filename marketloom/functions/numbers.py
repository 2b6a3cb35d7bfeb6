"""Percent change, trend words and the return band of the portfolio feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_cents(x: Column) -> Column:
    """Two decimals, halves to even on the scaled value."""
    return F.rint(x * 100) / 100


def percent_change(now: Column, before: Column) -> Column:
    """Unrounded; NULL when the earlier value is zero."""
    return F.try_divide(now - before, F.nullif(before, F.lit(0).cast("double"))) * 100


def trend_direction(change: Column) -> Column:
    flat = change.isNull() | F.isnan(change) | (change == 0)
    return F.when(flat, F.lit("equal")).when(change > 0, F.lit("up")).otherwise(F.lit("down"))


def reversal_probability(streak: Column) -> Column:
    return F.least(F.lit(0.15) + F.lit(0.05) * streak, F.lit(0.5))


def momentum(streak: Column) -> Column:
    return F.least(F.lit(0.1) * streak, F.lit(0.2))


def next_return_band(trend: Column, streak: Column, last: Column) -> Column:
    """struct of the ranges the next daily return may fall in, when the trend
    continues and when it reverses."""
    rising = trend == "positive"
    push = momentum(streak)
    strong_up, strong_down = last > 0.3, last < -0.3

    def pick(*cases: tuple[Column, Column], default: Column) -> Column:
        expr = None
        for condition, value in cases:
            expr = F.when(condition, value) if expr is None else expr.when(condition, value)
        return expr.otherwise(default)

    return F.struct(
        F.when(rising, F.lit(0.1)).otherwise(F.lit(-0.3) - push).alias("continue_low"),
        F.when(rising, F.lit(0.3) + push).otherwise(F.lit(-0.1)).alias("continue_high"),
        pick(
            (rising & strong_up, F.lit(0.05)),
            (rising, F.lit(-0.25)),
            (strong_down, last * 0.7),
            default=F.lit(0.05),
        ).alias("reverse_low"),
        pick(
            (rising & strong_up, last * 0.7),
            (rising | strong_down, F.lit(-0.05)),
            default=F.lit(0.25),
        ).alias("reverse_high"),
    )
