"""Plans of the queries: no pair-wise joins, no row-at-a-time Python. Streams and
queries that read back what they wrote are left out."""

import re

import pytest

import __spark_entry__ as entry
from marketloom import schemas
from marketloom.operators import enrich
from marketloom.plans import news

FOLDER = "/root/testdata/sf0.001"
# These run jobs while they are built and return a plain scan of their output.
RUN_WHEN_BUILT = {"article_increments", "candle_backfill", "candle_table_load", "market_cap_table_load", "day_backup", "extended_documents", "series_csv_export"}
NAMES = sorted(n for n in entry.queries() if n not in RUN_WHEN_BUILT and not n.startswith("streaming"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert word not in text, word
    # Only aggregates without a key may meet in one partition.
    for match in re.finditer(r"Exchange SinglePartition.*\n.*?\+- (\w+)", text):
        assert match.group(1) in ("HashAggregate", "ObjectHashAggregate", "LocalLimit"), match.group(0)


def test_model_is_called_once_per_text(spark):
    rows = spark.createDataFrame([], schemas.ARTICLES)
    embed = enrich.vectorize(lambda: enrich.HashingEmbedder(8))
    mapping = spark.createDataFrame([("a",)], "ticker string")
    assert plan(news.refresh(rows, rows, mapping, embed)).count("ArrowEvalPython") == 1
    assert plan(enrich.embed_missing(rows, "article_string", "article_embedding", embed)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["article_embeddings", "news_refresh", "embeddings_recreated"])
def test_default_vectors_need_no_python(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "Python" not in text and "Arrow" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["symbol_day_rows"](spark, FOLDER))
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "props" not in schema
    retention = plan(entry.queries()["article_cap"](spark, FOLDER))
    assert any("text" not in s for s in re.findall(r"ReadSchema: (\S+)", retention))


def test_top_n_is_limited_before_each_shuffle(spark):
    text = plan(entry.queries()["article_cap"](spark, FOLDER))
    assert len(re.findall(r"WindowGroupLimit .*row_number\(\), 100, Partial", text)) == 2
