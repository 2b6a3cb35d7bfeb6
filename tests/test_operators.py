"""Operators against hand-made rows and brute force, and their repeat properties."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import aggregates, dml, enrich, filters, joins, setops, skew, vectors, windows
from marketloom.plans import caps, forum, news, portfolio

DAY0 = datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def at(text):
    return F.lit(text).cast("timestamp")


# -- skew ------------------------------------------------------------------------------


def test_top_k_with_one_hot_key(spark):
    rng = random.Random(1)
    data = [(("hot" if i % 3 else f"k{i % 7}"), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, id long")
    got = skew.top_k(df, ["k"], [F.col("v").desc(), F.col("id")], 5, spread=["id"])
    groups = defaultdict(list)
    for k, v, i in data:
        groups[k].append((-v, i))
    want = sorted((k, i, n) for k, g in groups.items() for n, (_, i) in enumerate(sorted(g)[:5], start=1))
    assert sorted(tuple(r) for r in got.select("k", "id", "rank").collect()) == want


def test_top_k_beyond_the_group_limit_threshold(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id"))
    assert skew.top_k(df, ["k"], [F.col("id").desc()], 1440, spread=["id"]).agg(F.min("id")).first()[0] == 3560


def test_struct_comparison_puts_null_first(spark):
    """The survivor test of the caps relies on it."""
    df = spark.createDataFrame([(None, 1), (DAY0, 2)], "t timestamp, id int")
    edge = F.struct(F.lit(None).cast("timestamp").alias("t"), F.lit(2).alias("id"))
    got = df.select((F.struct("t", "id") >= edge).alias("x")).collect()
    assert [r.x for r in got] == [False, True]


def test_keep_one_id_and_first_row(spark):
    data = [("a", "x", 3), ("a", "x", 1), ("a", "y", 2), ("b", "x", 4)]
    df = spark.createDataFrame(data, "k string, l string, id int")
    assert [r[2] for r in rows(skew.keep_one_id(df, ["k", "l"], "id"), "k", "l", "id")] == [1, 2, 4]
    assert rows(skew.first_row(df, ["k"], F.col("id"), last=True)) == [("a", "x", 3), ("b", "x", 4)]


# -- windows -------------------------------------------------------------------------------


def test_cap_newest_keeps_unmapped_and_prefers_dated(spark):
    data = [(i, "m", None if i % 10 == 0 else DAY0 + timedelta(minutes=i)) for i in range(30)]
    data += [(100 + i, "other", DAY0) for i in range(30)]
    df = spark.createDataFrame(data, "_id long, ticker string, extraction_timestamp_utc timestamp")
    mapping = spark.createDataFrame([("m",)], "ticker string")
    got = windows.cap_newest(df, mapping, keep=28)
    kept = {r._id for r in got.collect()}
    assert {i for i in kept if i >= 100} == set(range(100, 130))
    assert set(range(30)) - kept == {0, 10}
    again = windows.cap_newest(got, mapping, keep=28)
    assert {r._id for r in again.collect()} == kept


def test_dedupe_and_cap_equals_the_two_steps(spark):
    rng = random.Random(3)
    data = [
        (i, rng.choice("mno"), f"l{rng.randrange(40)}", None if rng.random() < 0.2 else DAY0 + timedelta(minutes=rng.randrange(500)))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "_id long, ticker string, link string, extraction_timestamp_utc timestamp")
    mapping = spark.createDataFrame([("m",), ("n",)], "ticker string")
    fused = windows.dedupe_and_cap(df, mapping, keep=15)
    stepped = windows.cap_newest(windows.dedupe_keep_first(df), mapping, keep=15)
    assert rows(fused, "_id") == rows(stepped, "_id")
    assert 30 < fused.count() < 120


def brute_retention(data, mapped, cutoff, floor):
    kept = []
    for asset in {d[1] for d in data}:
        group = [d for d in data if d[1] == asset]
        if asset is None or asset not in mapped:
            kept += group
            continue
        old = [d for d in group if d[2] is not None and d[2] < cutoff]
        spare = max(0, floor - (len(group) - len(old)))
        old.sort(key=lambda d: (d[2], d[0]), reverse=True)
        kept += [d for d in group if d not in old] + old[:spare]
    return sorted(d[0] for d in kept)


@pytest.mark.parametrize("floor", [0, 5, 40])
def test_retention_with_floor_against_brute_force(spark, floor):
    rng = random.Random(floor)
    data = [
        (i, rng.choice(["a", "a", "a", "b", "c", None]), None if rng.random() < 0.1 else DAY0 + timedelta(hours=rng.randrange(400)))
        for i in range(300)
    ]
    df = spark.createDataFrame(data, "_id long, asset_id string, created_at_utc timestamp")
    mapping = spark.createDataFrame([("a",), ("b",)], "asset_id string")
    cutoff = DAY0 + timedelta(hours=300)
    got = windows.retention_with_floor(df, mapping, F.lit(cutoff), floor=max(floor, 1)) if floor else windows.retention_with_floor(df, mapping, F.lit(cutoff), floor=0)
    assert sorted(r._id for r in got.collect()) == brute_retention(data, {"a", "b"}, cutoff, floor)
    again = windows.retention_with_floor(got, mapping, F.lit(cutoff), floor=floor)
    assert rows(again) == rows(got)


def test_streak_counts_at_most_five_and_zero_is_positive(spark):
    values = [0.1, 0.0, 0.2, 0.3, 0.1, 0.4, -0.1, -0.2, 0.1]
    df = spark.createDataFrame([("p", date(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)], "portfolio string, date date, daily_return double")
    got = windows.trend_state(df, ["portfolio"]).orderBy("date").collect()
    assert [r.streak for r in got] == [1, 2, 3, 4, 5, 5, 1, 2, 1]
    assert [r.trend for r in got] == ["positive"] * 6 + ["negative"] * 2 + ["positive"]


def test_running_return_restarts_at_stored_rows(spark):
    rng = random.Random(7)
    data, want, total = [], [], 0.0
    for i in range(400):
        daily = round(rng.uniform(-0.5, 0.5), 2)
        stored = round(rng.uniform(-5, 5), 2) if rng.random() < 0.1 else None
        total = stored if stored is not None else round(total + daily, 2)
        data.append(("p", date(2023, 1, 1) + timedelta(days=i), daily, stored))
        want.append(total)
    df = spark.createDataFrame(data, "portfolio string, date date, daily_return double, stored_cumulative double")
    got = [r.cumulative_return for r in windows.running_return(df, ["portfolio"]).orderBy("date").collect()]
    assert got == pytest.approx(want, abs=1e-12)


def test_book_skips_stored_dates_and_counts(spark):
    d = lambda n: date(2024, 1, n)
    stored = spark.createDataFrame([("p", d(2), 0.5, 9.0)], "portfolio string, date date, daily_return double, stored_cumulative double")
    supplied = spark.createDataFrame([("p", d(1), 0.1), ("p", d(2), 0.2), ("p", d(3), -0.3)], "portfolio string, date date, daily_return double")
    got = portfolio.book(stored, supplied).orderBy("date").collect()
    assert [(r.status, r.daily_return, r.cumulative_return) for r in got] == [("inserted", 0.1, 0.1), ("stored", 0.5, 9.0), ("inserted", -0.3, 8.7)]
    assert rows(portfolio.backfill_summary(stored, supplied)) == [("exists", 1), ("inserted", 2)]


def test_newest_comments_is_stable(spark):
    c = [("1", DAY0), ("2", DAY0 + timedelta(hours=2)), ("3", DAY0 + timedelta(hours=2)), ("4", DAY0 + timedelta(hours=1))]
    df = spark.createDataFrame([(c,), ([],)], "c array<struct<id:string,created_at_utc:timestamp>>")
    got = df.select(F.transform(windows.newest_comments(F.col("c")), lambda x: x["id"]).alias("x")).collect()
    assert [r.x for r in got] == [["2", "3", "4"], []]


@pytest.mark.parametrize("n", [1439, 1440, 1441])
def test_trim_day(spark, n):
    df = spark.range(n).select(F.lit("BTC").alias("symbol"), (F.timestamp_seconds(1_704_067_200 + F.col("id") * 59)).alias("timestamp"))
    assert windows.trim_day(df).count() == min(n, 1440)


def test_last_day_rows(spark):
    data = [("a", DAY0), ("a", DAY0 + timedelta(days=1, hours=3)), ("a", DAY0 + timedelta(days=1, hours=23)), ("b", DAY0)]
    df = spark.createDataFrame(data, "symbol string, timestamp timestamp")
    assert len(windows.last_day_rows(df).collect()) == 3


# -- aggregates ------------------------------------------------------------------------------


def test_completeness_and_missing_slots(spark):
    df = spark.createDataFrame([("a", DAY0 + timedelta(hours=h)) for h in range(1, 24) if h != 5], "symbol string, timestamp timestamp")
    audit = aggregates.completeness(df, "symbol", "timestamp", expected=24, step="1 HOUR").first()
    assert (audit.actual, audit.missing, audit.missing_at_start, audit.missing_at_end) == (22, 2, True, False)
    gaps = aggregates.missing_slots(df, "symbol", "timestamp", slot_seconds=3600)
    assert sorted(r.slot for r in gaps.collect()) == [0, 5]


def test_latest_per_series_ties(spark):
    df = spark.createDataFrame([("s", date(2024, 1, 2), 5.0, 9), ("s", date(2024, 1, 2), 6.0, 3), ("s", date(2024, 1, 1), 7.0, 1)], "series_id string, date date, value double, n int")
    assert rows(aggregates.latest_per_series(df, "series_id", "date", "value", "n")) == [("s", date(2024, 1, 2), 6.0)]


def test_batch_statistics_on_empty_input(spark):
    df = spark.createDataFrame([], "t string, v array<float>")
    assert rows(aggregates.batch_statistics(df, "t", "v")) == [(0, 0, 0, 0, 0)]


CAPS = "Symbol string, Name string, `Market Cap` double"
STORED = f"Date date, {CAPS}"


def test_snapshot_rules(spark):
    stored = spark.createDataFrame(
        [
            (date(2024, 1, 1), "OLD", "Old", 50.0), (date(2024, 1, 2), "USDT", "Tether", 100.0),
            (date(2024, 1, 2), "ALL_STABLECOINS", "All Stablecoins", 100.0), (date(2024, 1, 2), "ZERO", "Zero", 0.0),
        ], STORED,
    )
    fetched = spark.createDataFrame(
        [("USDT", "Tether", 110.0, 1), ("USDT", "Tether", 999.0, 2), ("OLD", "Old", 70.0, 3), ("NEW", "New", 1000.0, 4), ("ZERO", "Zero", 5.0, 5)],
        f"{CAPS}, n int",
    )
    got = caps.snapshot(fetched, stored, F.lit("2024-01-03").cast("date"), F.col("n")).collect()
    by = {r.Symbol: (r["Market Cap"], r["Trend (%)"], r["Trend direction"]) for r in got}
    assert [r.Symbol for r in got] == ["ALL_STABLECOINS", "USDT", "OLD", "ZERO"]
    assert by["USDT"] == (110.0, 10.0, "up")  # the first duplicate stays
    assert by["OLD"] == (70.0, 0.0, "equal")  # not in the latest snapshot
    assert by["ZERO"] == (5.0, None, "equal")
    # All fetched rows count, duplicates and unselected coins included.
    assert by["ALL_STABLECOINS"] == (2184.0, round((2184 - 1270) / 1270 * 100, 2), "up")


def test_snapshot_total_direction_uses_the_unrounded_trend(spark):
    stored = spark.createDataFrame([(date(2024, 1, 2), "A", "A", 1_000_000.0)], STORED)
    fetched = spark.createDataFrame([("A", "A", 1_000_001.0)], CAPS)
    got = {r.Symbol: (r["Trend (%)"], r["Trend direction"]) for r in caps.snapshot(fetched, stored, F.lit("2024-01-03").cast("date")).collect()}
    assert got == {"A": (0.0, "equal"), "ALL_STABLECOINS": (0.0, "up")}


# -- joins and changes ---------------------------------------------------------------------


def test_lookup_collapses_duplicates(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    earlier = spark.createDataFrame([("a", 5.0, 1), ("a", 4.0, 2)], "k string, v double, n int")
    assert rows(joins.lookup_or_own(df, earlier, ["k"], "v", "prev", F.col("n"))) == [("a", 1.0, 4.0), ("b", 2.0, 2.0)]


def test_predicates_keep_missing_fields(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert df.filter(filters.differs(F.col("k"), "a")).count() == 1
    assert df.filter(filters.none_of(F.col("k"), ["a"])).count() == 1


def test_not_enriched_needs_all_columns_missing(spark):
    df = spark.createDataFrame([(None, None), ("x", None)], "a string, b string")
    assert df.filter(filters.not_enriched("a", "b")).count() == 1


def candles(spark, data):
    return spark.createDataFrame(data, "symbol string, timestamp timestamp, close double")


def test_replace_first_day_appends_other_days(spark):
    h = lambda d, n: DAY0 + timedelta(days=d, hours=n)
    stored = candles(spark, [("a", h(0, 1), 1.0), ("a", h(1, 1), 1.0), ("b", h(0, 1), 1.0)])
    incoming = candles(spark, [("a", h(0, 2), 2.0), ("a", h(1, 1), 2.0)])
    first = rows(dml.replace_days(stored, incoming, days="first"))
    assert first == sorted([("a", h(0, 2), 2.0), ("a", h(1, 1), 1.0), ("a", h(1, 1), 2.0), ("b", h(0, 1), 1.0)], key=repr)
    every = dml.replace_days(stored, incoming, days="all")
    assert rows(every) == sorted([("a", h(0, 2), 2.0), ("a", h(1, 1), 2.0), ("b", h(0, 1), 1.0)], key=repr)
    assert rows(dml.replace_days(every, incoming, days="all")) == rows(every)


def test_upsert_nulls_win_and_enrichment_survives(spark):
    schema = "url string, asset_id string, score long, binance_asset string, vec string"
    stored = spark.createDataFrame([("u", "a", 1, "B", "v"), ("w", "a", 2, None, None)], schema)
    incoming = spark.createDataFrame(
        [("u", "a", 7, None, 1), ("u", "a", None, None, 2), ("u", "b", 3, "N", 1)], "url string, asset_id string, score long, binance_asset string, n int"
    )
    once = dml.upsert(stored, incoming, ["url", "asset_id"], F.col("n"), only_if_present=("binance_asset",))
    assert rows(once) == sorted([("u", "a", None, "B", "v"), ("u", "b", 3, "N", None), ("w", "a", 2, None, None)], key=repr)
    twice = dml.upsert(once, incoming, ["url", "asset_id"], F.col("n"), only_if_present=("binance_asset",))
    assert rows(twice) == rows(once)


def test_insert_if_newer(spark):
    schema = "series_id string, date date, value double"
    d = lambda n: date(2024, 1, n)
    incoming = spark.createDataFrame([("g", d(1), 1.0), ("g", d(3), 3.0), ("h", d(2), 2.0), ("i", d(2), 2.0)], schema)
    stored = spark.createDataFrame([("g", d(2), 0.0), ("h", d(2), 0.0)], schema)
    new = joins.insert_if_newer(incoming, stored, "series_id", "date")
    assert rows(new) == [("g", d(3), 3.0), ("i", d(2), 2.0)]
    assert joins.insert_if_newer(incoming, stored.unionByName(new), "series_id", "date").count() == 0


def test_expire_only_listed_symbols(spark):
    df = candles(spark, [("a", DAY0, 1.0), ("a", DAY0 + timedelta(days=60), 1.0), ("b", DAY0, 1.0)])
    listed = spark.createDataFrame([("a",)], "symbol string")
    got = dml.expire(df, listed, at("2024-03-05"), 60)
    assert rows(got, "symbol", "timestamp") == sorted([("a", DAY0 + timedelta(days=60)), ("b", DAY0)], key=repr)


def test_purge_is_skipped_without_mapping(spark):
    df = spark.createDataFrame([(None, DAY0), (None, None), ("a", DAY0)], "asset_id string, created_at_utc timestamp")
    some = spark.createDataFrame([("a",)], "asset_id string")
    assert dml.purge_unkeyed(df, some, at("2024-02-01")).count() == 2
    assert dml.purge_unkeyed(df, some.limit(0), at("2024-02-01")).count() == 3


def test_fallback_chain(spark):
    universe = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "symbol string")
    incoming = candles(spark, [("a", DAY0, 1.0)])
    stored = candles(spark, [("b", DAY0 - timedelta(days=3), 2.0), ("b", DAY0 - timedelta(days=4), 2.5), ("a", DAY0 - timedelta(days=1), 9.0)])
    backup = candles(spark, [("c", datetime(2020, 5, 5, 14, 30), 3.0), ("b", DAY0, 8.0)])
    got, failed = dml.fill_missing_symbols(universe, incoming, stored, backup, F.lit("2024-01-01").cast("date"))
    assert rows(got) == sorted(
        [("a", DAY0, 1.0, "incoming"), ("b", DAY0, 2.0, "last_day"), ("c", DAY0 + timedelta(hours=14, minutes=30), 3.0, "backup")], key=repr
    )
    assert rows(failed) == [("d",)]


def test_not_fetched_today(spark):
    pairs = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "asset_id string, subreddit string")
    stored = spark.createDataFrame(
        [("A", "x", datetime(2024, 1, 1, 23, 59, 59, 999999)), ("A", "y", datetime(2024, 1, 2)), ("B", "X", DAY0)],
        "asset_id string, subreddit string, extraction_timestamp_utc timestamp",
    )
    assert rows(joins.not_fetched_today(pairs, stored, at("2024-01-01 05:00:00"))) == [("A", "y"), ("B", "x")]


def test_keep_first_and_unions(spark):
    a = spark.createDataFrame([("x", 1), ("x", 0)], "k string, n int")
    assert rows(setops.keep_first(a, ["k"], F.col("n"))) == [("x", 0)]
    assert setops.symbol_union(a.select("k"), a.select("k")).count() == 1
    assert rows(setops.concat_classes({"e": a, "c": a}), "asset_class") == [("c",), ("c",), ("e",), ("e",)]


# -- enrichment --------------------------------------------------------------------------------


def test_only_pending_texts_reach_the_embedder(spark):
    class Counting:
        def __call__(self, texts):
            assert "done" not in texts and "" not in texts
            return [np.array([len(t), 0.0]) for t in texts]

    df = spark.createDataFrame([(1, "done", [9.0]), (2, "abc", None), (3, "", None), (4, None, None)], "_id int, t string, v array<float>")
    got = enrich.embed_missing(df, "t", "v", enrich.vectorize(Counting))
    assert {r._id: r.v for r in got.collect()} == {1: [9.0], 2: [3.0, 0.0], 3: None, 4: None}


def test_default_embedder_is_unit_length_and_whole_text(spark):
    embedder = enrich.HashingEmbedder(32)
    long = " ".join(f"w{i}" for i in range(5000))
    vectors_ = embedder(["a b a", long, "   "])
    assert vectors_[2] is None
    for v in vectors_[:2]:
        assert abs(float(np.linalg.norm(v)) - 1) < 1e-12
    assert not np.allclose(vectors_[1], embedder([long + " tail" * 500])[0])


def test_model_scores_plug_in(spark):
    class Shouting:
        """A scorer with labels in mixed case that fails on one text."""

        def __call__(self, texts):
            return [None if t == "bad" else {"POSITIVE": 0.5, "Negative": 0.25, "neutral": 0.25} for t in texts]

    df = spark.createDataFrame([("ok",), ("bad",), (None,)], "t string").coalesce(1)
    got = [r.s for r in df.select(enrich.model_scores(Shouting)("t").alias("s")).collect()]
    assert got[0].positive == 0.5 and got[0].negative == 0.25
    assert got[1] is None and got[2] is None


def test_lexicon_scores_sum_to_one(spark):
    df = spark.createDataFrame([("Gains beat LOSSES today",), ("",), (None,)], "t string")
    got = [r.s for r in df.select(enrich.lexicon_scores(F.col("t")).alias("s")).collect()]
    assert got[1] is None and got[2] is None
    assert got[0].positive == 3 / 7 and got[0].negative == 2 / 7
    assert abs(got[0].positive + got[0].negative + got[0].neutral - 1) < 1e-12


def test_nearest_against_brute_force_in_several_passes(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(200, 8))
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, v array<float>").repartition(3)
    queries = corpus.filter("id < 20").select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("vector"))
    got = vectors.nearest(corpus, queries, 4, row_id="id", vector="v", dim=8, exclude_self=True, pass_bytes=8 * 8 * 5)
    unit = data.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    want = set()
    for q in range(20):
        order = sorted((i for i in range(200) if i != q), key=lambda i: (-scores[q, i], i))[:4]
        want |= {(q, i, n) for n, i in enumerate(order, start=1)}
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == want


def test_news_refresh_fills_and_keeps(spark):
    schema = (
        "_id string, headline string, source string, posted string, description string, link string, synced boolean, "
        "extraction_timestamp_utc timestamp, ticker string, article_string string, article_embedding array<float>, "
        "sentiment_score struct<positive:double,negative:double,neutral:double>"
    )
    done = ("1", "h", "s", "p", "d", "l", False, DAY0, "BTC", "old text", [1.0], (1.0, 0.0, 0.0))
    new = ("2", "gain", "s", "p", "d", "m", False, DAY0, "BTC", None, None, None)
    copy = ("3", "gain", "s", "p", "d", "l", False, DAY0, "BTC", None, None, None)
    stored, fetched = spark.createDataFrame([done], schema), spark.createDataFrame([new, copy], schema)
    mapping = spark.createDataFrame([("BTC",)], "ticker string")
    embed = enrich.vectorize(lambda: enrich.HashingEmbedder(4))
    got = {r._id: r for r in news.refresh(stored, fetched, mapping, embed).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].article_string == "old text" and got["1"].article_embedding == [1.0]
    assert got["2"].article_string.startswith("Headline: gain") and len(got["2"].article_embedding) == 4
    assert got["2"].sentiment_score.positive > 0


def test_failed_embedding_leaves_the_text_unset(spark):
    class Failing:
        def __call__(self, texts):
            return [None for _ in texts]

    df = spark.createDataFrame(
        [("h", "d", "s", "t", "l", None, None)],
        "headline string, description string, source string, ticker string, link string, article_string string, article_embedding array<float>",
    )
    got = news.with_embeddings(df, enrich.vectorize(Failing)).first()
    assert got.article_string is None and got.article_embedding is None


def test_forum_pairs_default_query(spark):
    mapping = spark.createDataFrame([("A", ["x", "y"], None), (None, ["z"], "q")], "asset_id string, subreddits array<string>, query string")
    stored = spark.createDataFrame([], "asset_id string, subreddit string, extraction_timestamp_utc timestamp")
    assert rows(forum.pairs_to_fetch(mapping, stored, at("2024-01-01")), "asset_id", "subreddit", "query") == [("A", "x", "A"), ("A", "y", "A")]


def test_repeated_updates_holdings_without_value_and_pending_texts(spark):
    from marketloom.operators import joins

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    twice = spark.createDataFrame([(1, "c"), (1, "d")], "id int, x string")
    assert sorted(tuple(r) for r in joins.update_by_id(rows, twice, "id", ["x"]).collect()) == [(1, "d"), (2, "b")]

    held = joins.weighted_holdings(rows.selectExpr("x", "id * 0.5D as w"), spark.createDataFrame([("a", 4.0)], "x string, v double"), "x", "w", "v")
    assert sorted((r.x, r.weighted) for r in held.collect()) == [("a", 2.0), ("b", None)]

    texts = spark.createDataFrame([("seen", 1.0), ("new", None)], "t string, s double")
    scored = enrich.score_missing(texts, "t", "s", lambda t: F.length(t).cast("double"))
    assert sorted((r.t, r.s) for r in scored.collect()) == [("new", 3.0), ("seen", 1.0)]


def test_upsert_matches_null_keys(spark):
    schema = "url string, asset_id string, score int"
    stored = spark.createDataFrame([("u", None, 1), ("u", "a", 2), (None, None, 3)], schema)
    new = spark.createDataFrame([("u", None, 10), ("v", None, 20), (None, None, 30)], schema)
    once = dml.upsert(stored, new, ["url", "asset_id"], F.col("score"))
    twice = dml.upsert(once, new, ["url", "asset_id"], F.col("score"))
    expected = {("u", None, 10), ("u", "a", 2), (None, None, 30), ("v", None, 20)}
    for got in (once, twice):
        found = [tuple(r) for r in got.collect()]
        assert len(found) == 4 and set(found) == expected
    status = dml.insert_absent(stored, new, ["url", "asset_id"], F.col("score"))
    assert {(r.url, r.status) for r in status.collect()} == {("u", "exists"), ("v", "inserted"), (None, "exists")}


def test_nearest_takes_text_ids_and_zero_vectors(spark):
    corpus = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, v array<double>")
    queries = spark.createDataFrame([("b", [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, vector array<double>")
    got = vectors.nearest(corpus, queries, 2, row_id="id", vector="v", dim=2)
    found = sorted((r["query_id"], r["id"], r["score"]) for r in got.collect())
    assert found == [("b", "a", 1.0), ("b", "b", 1.0), ("z", "a", 0.0), ("z", "b", 0.0)]


def test_native_vectors_equal_the_plug_in(spark):
    import random

    rng = random.Random(1)
    texts = ["", None, "  ", "a", "a b a", "Hello World hello 　x"]
    texts += [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for dim in (1, 7, 64):
        plug_in = enrich.HashingEmbedder(dim)
        got = {r.i: r.v for r in rows.select("i", enrich.hashed_vectors(dim)("t").alias("v")).collect()}
        for i, text in enumerate(texts):
            own = plug_in([text])[0] if text else None
            assert got[i] == (None if own is None else [float(x) for x in own.astype("float32")])
