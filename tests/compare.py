"""Compare a Spark result with DuckDB rows of the same tables, value by value."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str):
    """None when equal, else a short text; also the number of rows."""
    left_cols, left = rows_of(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    n = sum(left.values())
    if left_cols != right_cols:
        return f"columns {left_cols} / {right_cols}", n
    if left == right:
        return None, n
    only_left, only_right = left - right, right - left
    return (
        f"{n} / {sum(right.values())} rows; only Spark {sum(only_left.values())}: {list(only_left)[:3]}; "
        f"only SQL {sum(only_right.values())}: {list(only_right)[:3]}",
        n,
    )
