"""Scalar functions on hand-made values, one test per trap."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketloom.functions import dates, numbers, symbols, text


def values(spark, schema, rows, *exprs):
    df = spark.createDataFrame(rows, schema)
    out = [tuple(r) for r in df.select(*exprs).collect()]
    return [r[0] for r in out] if len(exprs) == 1 else out


def test_caret_and_usdt_rules_differ(spark):
    rows = [("^VIX",), ("^^X",), ("A^B",), ("FDUSDUSDT",), ("USDT",), ("BTCUSDTX",)]
    s = F.col("s")
    got = values(spark, "s string", rows, symbols.normalize_caret(s), symbols.remove_carets(s), symbols.normalize_usdt(s))
    assert got == [
        ("VIX", "VIX", "^VIX"), ("X", "X", "^^X"), ("A^B", "AB", "A^B"),
        ("FDUSDUSDT", "FDUSDUSDT", "FDUSD"), ("USDT", "USDT", ""), ("BTCUSDTX", "BTCUSDTX", "BTCUSDTX"),
    ]


def test_parse_date_key(spark):
    rows = [("20240229",), ("2024022907",), ("20230229",), ("2024-2-9",), ("202402",), (None,)]
    got = values(spark, "k string", rows, dates.parse_date_key(F.col("k")))
    assert [(r.ts, r.error) for r in got] == [
        (datetime(2024, 2, 29), None), (datetime(2024, 2, 29, 7), None), (None, "no such date"),
        (None, "not a number"), (None, "wrong length"), (None, None),
    ]


def test_load_date_must_lie_before_the_day(spark):
    as_of = F.lit("2024-03-05 09:00:00").cast("timestamp")
    rows = [("20240304",), ("20240305",), ("20240306",), ("20241301",), ("2024030",), (None,)]
    got = values(spark, "k string", rows, dates.load_date_status(F.col("k"), as_of))
    assert got == ["ok", "not in the past", "not in the past", "no such date", "bad format", "bad format"]


@pytest.mark.parametrize("order_matters, word", [(True, "reversed range"), (False, "empty range")])
def test_range_status(spark, order_matters, word):
    rows = [("20240101", "20240101"), ("20240102", "20240101"), ("x", "20240101"), (None, "20240101")]
    status = dates.range_status(F.col("a"), F.col("b"), order_matters=order_matters)
    assert values(spark, "a string, b string", rows, status) == ["ok", word, "bad format", "bad format"]


def test_localize_gap_overlap_and_zone(spark):
    rows = [
        ("SPY", datetime(2025, 3, 9, 2, 30)),  # gap
        ("SPY", datetime(2025, 11, 2, 1, 30)),  # twice
        ("SPY", datetime(2025, 11, 2, 0, 59)),
        ("SPY", datetime(2025, 11, 2, 2, 0)),
        ("^VIX", datetime(2025, 3, 9, 2, 30)),
        ("^VIX", datetime(2025, 2, 18, 8, 30)),
    ]
    got = values(spark, "s string, t timestamp_ntz", rows, dates.localize_to_utc(F.col("t"), F.col("s")))
    assert got == [
        datetime(2025, 3, 9, 7, 0), None, datetime(2025, 11, 2, 4, 59), datetime(2025, 11, 2, 7, 0),
        datetime(2025, 3, 9, 8, 0), datetime(2025, 2, 18, 14, 30),
    ]


def test_redate_and_day_bounds(spark):
    rows = [(datetime(2025, 2, 21, 14, 31, 5, 7),)]
    t = F.col("t")
    got = values(
        spark, "t timestamp", rows, dates.redate(t, F.lit(date(2025, 3, 1))), dates.day_start(t), dates.day_end(t),
        dates.load_stamp(t),
    )
    assert got == [
        (datetime(2025, 3, 1, 14, 31, 5, 7), datetime(2025, 2, 21), datetime(2025, 2, 21, 23, 59, 59, 999000), "20250221143105")
    ]


def test_percent_change_rounding_and_zero(spark):
    rows = [(1.0, 0.0), (0.0, 5.0), (102.675, 100.0), (5.0, None)]
    change = numbers.percent_change(F.col("a"), F.col("b"))
    got = values(spark, "a double, b double", rows, numbers.round_cents(change))
    assert got[0] is None and got[1] == -100.0 and got[3] is None
    halves = values(spark, "x double", [(0.125,), (2.675,), (-0.125,)], numbers.round_cents(F.col("x")))
    assert halves == [0.12, 2.68, -0.12]


def test_trend_direction(spark):
    rows = [(None,), (0.0,), (0.01,), (-0.01,), (float("nan"),)]
    assert values(spark, "c double", rows, numbers.trend_direction(F.col("c"))) == ["equal", "equal", "up", "down", "equal"]


def test_next_return_band(spark):
    rows = [("positive", 1, 0.5), ("positive", 5, 0.2), ("negative", 2, -0.6), ("negative", 9, -0.1)]
    band = numbers.next_return_band(F.col("t"), F.col("s"), F.col("l"))
    got = values(spark, "t string, s int, l double", rows, band)
    rounded = [tuple(round(v, 9) for v in r) for r in got]
    assert rounded == [
        (0.1, 0.4, 0.05, 0.35), (0.1, 0.5, -0.25, -0.05), (-0.5, -0.1, -0.42, -0.05), (-0.5, -0.1, 0.05, 0.25),
    ]
    odds = values(spark, "s int", [(0,), (3,), (20,)], numbers.reversal_probability(F.col("s")))
    assert [round(o, 9) for o in odds] == [0.15, 0.3, 0.5]


def test_unwrap_link(spark):
    rows = [
        ("https://r.example/RU=https%3a%2f%2fa.example%2fx%3fq%3d1+2%zz/RK=2/RS=9",),
        ("https://a.example/no-target",),
        ("x/RU=a/RK=1/RU=b/RK=2",),
    ]
    got = values(spark, "h string", rows, text.unwrap_link(F.col("h")))
    assert got == ["https://a.example/x?q=1+2%zz", None, "a/RK=1/RU=b"]


def test_clean_posted_strips_wide_space(spark):
    rows = [(" · 3 hours ago  ",), ("· now",)]
    assert values(spark, "p string", rows, text.clean_posted(F.col("p"))) == ["3 hours ago", "now"]


def test_article_string_keeps_separators(spark):
    got = values(
        spark, "h string, d string", [("H", None)],
        text.article_string(F.col("h"), F.col("d"), F.lit("S"), F.lit("T"), F.lit("L")),
    )
    assert got == ["Headline: H\n/n Description: \n/n Source: S\n/n Ticker: T\n/n Link: L"]


DOC = "d struct<title:string,selftext:string,subreddit:string,asset_id:string,comments:array<struct<author:string,body:string>>>"


def test_embedding_text(spark):
    comments = [("a", "1"), (None, "2"), ("c", None), ("d", "4")]
    rows = [(("T", "B", "r/x", "BTC", comments),), (("T", None, "r/x", "BTC", []),), (None,)]
    got = values(spark, DOC, rows, text.embedding_text(F.col("d"), comment_count=3))
    head = "Title: T\nContent: B\nSubreddit: r/x\nAsset: BTC"
    assert got[0] == head + "\nComments: Comment 1 by a: 1 | Comment 2 by [deleted]: 2 | Comment 3 by c: "
    assert got[1] == "Title: T\nContent: \nSubreddit: r/x\nAsset: BTC"
    assert got[2] == ""


def test_sentiment_text_cuts(spark):
    rows = [(("T", "x" * 501, "r/x", "BTC", [("a", "y" * 151), ("b", "z" * 150)]),), (("T", "x" * 500, "r/x", "BTC", None),)]
    got = values(spark, DOC, rows, text.sentiment_text(F.col("d"), content_size=500, comment_size=150, comment_count=3))
    assert got[0] == (
        f"TITLE: T\n\nCONTENT: {'x' * 500}...\n\nSUBREDDIT: r/x\n\nASSET: BTC\n\nCOMMENTS SECTION:\n\n"
        f"COMMENT 1 BY a: {'y' * 150}...\n\nCOMMENT 2 BY b: {'z' * 150}"
    )
    assert got[1] == f"TITLE: T\n\nCONTENT: {'x' * 500}\n\nSUBREDDIT: r/x\n\nASSET: BTC"


def test_scorer_ladder(spark):
    whole = "TITLE: T\n\nCONTENT: " + "x" * 81  # 100 characters
    fit = lambda n: text.fit_for_scorer(F.col("s"), n)
    got = values(spark, "s string", [(whole,)], fit(100), fit(99), fit(60), fit(59))[0]
    half = "TITLE: T\n\n" + whole[:50]
    assert got[:3] == (whole, half, half) and got[3] is None
    longer = whole + "\n\n" + "y" * 300
    assert values(spark, "s string", [(longer,)], fit(150)) == [whole]
    assert values(spark, "s string", [("a" * 10,)], fit(6)) == ["a" * 5]


def test_code_points_and_tokens(spark):
    rows = [("😀" * 3 + "ab",), ("one two  three",), ("",), (None,)]
    t = F.col("t")
    assert values(spark, "t string", rows, text.clip(t, 4)) == ["😀😀😀a", "one ", "", None]
    assert values(spark, "t string", [("a b " * 10,)], text.token_estimate(t)) == [20 + 2]
    assert values(spark, "t string", rows, F.size(text.words(t)))[1] == 3


def test_query_match_is_case_blind(spark):
    rows = [("I like Bitcoin", "bitcoin OR btc"), ("nothing", "bitcoin OR btc"), ("S&P500 up", "SPY OR S&P500")]
    got = values(spark, "t string, q string", rows, text.matches_any(F.col("t"), text.query_terms(F.col("q"))))
    assert got == [True, False, True]


def test_defaults(spark):
    rows = [(None, "", None), ("a", "X", "q")]
    got = values(
        spark, "a string, b string, q string", rows,
        text.author_or_deleted(F.col("a")), text.asset_or_unknown(F.col("b")), text.query_or_asset(F.col("q"), F.col("b")),
    )
    assert got == [("[deleted]", "Unknown", ""), ("a", "X", "q")]


def test_character_references(spark):
    from marketloom.functions import markup

    cases = {
        "a &amp;lt; b": "a &lt; b", "&#233;&#xE9;&#XE9;&eacute;": "éééé", "&nbsp;x&#39;&apos;": " x''", "&unknown; &amp &;": "&unknown; &amp &;",
        "&#128512;&#x1F600;": "😀😀", "&#0;&#xD800;&#1114112;": "���", "": "", "no reference": "no reference", "&euro;&#8364;5&lt;6&gt;4&quot;": '€€5<6>4"',
    }
    rows = spark.createDataFrame([*enumerate(cases), (99, None)], "i int, t string")
    got = {r.i: r.d for r in rows.select("i", markup.decode_references(F.col("t")).alias("d")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] is None
    page = spark.createDataFrame([('<h1 class="x">A <b>&amp;</b> B</h1><h1 class="t y">C</h1>',)], "t string")
    row = page.select(markup.first_element(F.col("t"), "h1").alias("a"), markup.first_element(F.col("t"), "h1", "y").alias("b"), markup.first_element(F.col("t"), "h2").alias("c")).first()
    assert tuple(row) == ("A & B", "C", None)
