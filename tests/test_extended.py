"""Extended JSON of any schema."""

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketloom.sources import extended

SCHEMA = (
    "_id string, at timestamp, day date, n int, big long, x double, money decimal(12,2), ok boolean, name string, "
    "nested struct<at:timestamp,deep:struct<ids:array<string>>>, rows array<struct<n:long,at:timestamp>>, tags map<string,double>"
)
MS = 1740130200000
DOCUMENTS = [
    {
        "_id": {"$oid": "685eb5343118883b42674b1f"}, "at": {"$date": "2025-02-21T09:30:00Z"}, "day": {"$date": "2025-02-21T00:00:00.000Z"},
        "n": {"$numberInt": "7"}, "big": {"$numberLong": "9007199254740993"}, "x": {"$numberDouble": "Infinity"}, "money": {"$numberDecimal": "12.34"},
        "ok": True, "name": "plain {\"$oid\"} text", "nested": {"at": {"$date": {"$numberLong": str(MS)}}, "deep": {"ids": [{"$oid": "a"}, "b", None]}},
        "rows": [{"n": {"$numberLong": "1"}, "at": {"$date": MS}}, {"n": 2, "at": None}, None], "tags": {"a": {"$numberDouble": "1.5"}, "b": 2},
    },
    {"_id": "plain", "at": "2025-02-21T09:30:00+01:00", "day": "2025-02-21", "n": 7, "big": 8, "x": 1.25, "money": 3, "ok": False, "name": None, "extra": {"$x": 1}},
    {"_id": {"$oid": "z"}, "at": {"$date": {"$numberLong": "-1"}}, "n": {"$numberInt": "x"}, "big": "no", "at2": 1, "rows": [], "nested": None},
]


@pytest.mark.parametrize("lines", [False, True])
def test_all_forms(spark, tmp_path, lines):
    text = "\n".join(json.dumps(d) for d in DOCUMENTS) if lines else json.dumps(DOCUMENTS, indent=2)
    (tmp_path / "a.json").write_text(text)
    df = extended.read_ejson(spark, str(tmp_path), SCHEMA, lines=lines)
    assert df.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    a, b, c = df.collect()
    at = datetime(2025, 2, 21, 9, 30)
    assert (a._id, a.at, a.day, a.n, a.big, a.x, a.money, a.ok) == ("685eb5343118883b42674b1f", at, date(2025, 2, 21), 7, 9007199254740993, float("inf"), Decimal("12.34"), True)
    assert a.name == 'plain {"$oid"} text' and a.nested.at == at and a.nested.deep.ids == ["a", "b", None]
    assert a.rows[0].n == 1 and a.rows[0].at == at and a.rows[1].n == 2 and a.rows[1].at is None and a.rows[2] is None
    assert a.tags == {"a": 1.5, "b": 2.0}
    assert (b._id, b.at, b.day, b.n, b.big, b.x, b.money, b.ok, b.name) == ("plain", datetime(2025, 2, 21, 8, 30), date(2025, 2, 21), 7, 8, 1.25, Decimal("3.00"), False, None)
    assert b.nested is None and b.rows is None and b.tags is None
    assert (c.at, c.n, c.big, c.rows) == (datetime(1969, 12, 31, 23, 59, 59, 999000), None, None, [])


def test_texts_and_empty_files(spark, tmp_path):
    rows = spark.createDataFrame([(json.dumps(DOCUMENTS[0]),), ("not json",), (None,)], "t string")
    got = rows.select(extended.parse_ejson(F.col("t"), "_id string, n int").alias("d")).collect()
    assert got[0].d._id == "685eb5343118883b42674b1f" and got[0].d.n == 7 and (got[1].d is None or got[1].d._id is None) and got[2].d is None
    (tmp_path / "a.json").write_text("[]")
    assert extended.read_ejson(spark, str(tmp_path), "_id string").collect() == []


def test_given_dimension_shape(spark, tmp_path):
    mapping = [{"_id": {"$oid": "1"}, "asset_id": "ETH", "subreddits": ["a", "b"], "query": "ethereum OR eth"}]
    (tmp_path / "m.json").write_text(json.dumps(mapping, indent=2))
    got = extended.read_ejson(spark, str(tmp_path), "_id string, asset_id string, subreddits array<string>, query string").first()
    assert (got._id, got.asset_id, got.subreddits, got.query) == ("1", "ETH", ["a", "b"], "ethereum OR eth")
