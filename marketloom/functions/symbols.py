"""Symbol clean-up. The two caret rules differ on purpose: loading strips the
leading run, the retention job drops every caret."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols quoted in US/Central instead of US/Eastern.
CENTRAL_SYMBOLS = ("VIX", "VIX-USD")


def normalize_caret(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"^\^+", "")


def remove_carets(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("^"), F.lit(""))


def normalize_usdt(symbol: Column) -> Column:
    return F.regexp_replace(symbol, "USDT$", "")


def exchange_zone(symbol: Column) -> Column:
    central = normalize_caret(symbol).isin(*CENTRAL_SYMBOLS)
    return F.when(central, F.lit("US/Central")).otherwise(F.lit("US/Eastern"))
