"""All registered queries and their comparison SQL."""

from __future__ import annotations

from .caps import caps_queries
from .forum import forum_queries
from .market import market_queries
from .news import news_queries
from .streams import streams_queries

ALL = (market_queries, caps_queries, news_queries, forum_queries, streams_queries)


def queries() -> dict:
    return {name: fn for part in ALL for name, fn in part.queries.items()}


def comparison_sql() -> dict[str, str]:
    return {name: sql for part in ALL for name, sql in part.sql.items()}
