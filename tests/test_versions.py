"""Versions of whole tables and of hash buckets: stops at every step, other writers, untouched files."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators import enrich
from marketloom.plans import news
from marketloom.sources import tables, versions

DAY = datetime(2025, 2, 21)
NUMBERS = "k long, v string"


def numbers(spark, *pairs):
    return spark.createDataFrame(list(pairs), NUMBERS)


def held(spark, table):
    return sorted(tuple(r) for r in tables.read(spark, table).collect())


class Stop(Exception):
    pass


def stops(monkeypatch, name):
    """Let the next call of a step end the writer."""

    def stop(*_, **__):
        raise Stop

    monkeypatch.setattr(versions, name, stop)


def half_a_pointer(monkeypatch):
    """The writer ends while it writes the pointer."""
    whole = versions._text
    monkeypatch.setattr(versions, "_text", lambda v: whole(v)[: len(whole(v)) // 2])
    stops(monkeypatch, "vacuum")


STEPS = ["commit", "pointer", "vacuum"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("changed", [0, 1])
def test_whole_table_survives_a_stop(spark, folder, monkeypatch, step, changed):
    table = tables.Table(folder("t"), NUMBERS)
    tables.create(spark, table)
    old = [(i, "old") for i in range(6)]
    tables.append(numbers(spark, *old), table)
    if changed:
        tables.replace(tables.read(spark, table), table)
    with monkeypatch.context() as m:
        half_a_pointer(m) if step == "pointer" else stops(m, step)
        with pytest.raises(Stop):
            tables.replace(numbers(spark, (1, "new")), table)
    now = [(1, "new")] if step == "vacuum" else old
    assert held(spark, table) == now
    # The next run goes on as if nothing had happened.
    assert tables.create(spark, table) == "exists"
    stored = tables.read(spark, table)
    assert tables.replace(stored.unionByName(numbers(spark, (7, "again"))), table) == len(now) + 1
    tables.append(numbers(spark, (8, "more")), table)
    assert held(spark, table) == sorted([*now, (7, "again"), (8, "more")])


def test_second_writer_fails_and_changes_nothing(spark, folder, monkeypatch):
    table = tables.Table(folder("t"), NUMBERS)
    tables.create(spark, table)
    tables.replace(numbers(spark, (1, "a")), table)
    mine = versions.latest(spark, table.path)
    tables.replace(numbers(spark, (2, "b")), table)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, table.path, mine, {"": "data-none"})
    # The same when the other writer's pointer appears after the check.
    now = versions.latest(spark, table.path)
    with monkeypatch.context() as m:
        m.setattr(versions, "latest", lambda *_: mine)
        m.setattr(versions, "_pointers", lambda *_: [f"{mine.number:012d}.json"])
        with pytest.raises(versions.Conflict):
            versions.commit(spark, table.path, mine, {"": "data-none"})
    assert versions.latest(spark, table.path) == now and held(spark, table) == [(2, "b")]


def test_old_folders_go_and_left_ones_are_swept(spark, folder, monkeypatch):
    table = tables.Table(folder("t"), NUMBERS)
    tables.create(spark, table)
    for i in range(4):
        tables.replace(numbers(spark, (i, "x")), table)
    home = f"{table.path}/{versions.FOLDER}"
    data = lambda: [n for n in os.listdir(home) if n.startswith("data-")]
    assert len(data()) == 2 and len([n for n in os.listdir(home) if n.endswith(".json")]) == 2
    with monkeypatch.context() as m:
        stops(m, "commit")
        with pytest.raises(Stop):
            tables.replace(numbers(spark, (9, "x")), table)
    assert len(data()) == 3
    assert versions.sweep(spark, table.path, 0) == 0
    assert versions.sweep(spark, table.path, 4_000_000_000_000) == 1 and held(spark, table) == [(3, "x")]


# -- article table in buckets ------------------------------------------------------------


def article(i, ticker, link=None, minutes=0):
    return (f"{i:06d}", f"head {i}", "s", None, f"text {i}", link or f"l{i}", False, DAY + timedelta(minutes=minutes or i), ticker, None, None, None)


def articles(spark, *rows):
    return spark.createDataFrame([article(*r) for r in rows], schemas.ARTICLES)


def mapped(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "ticker string")


def embedder():
    return enrich.hashed_vectors(8)


def table_of(spark, folder, buckets=8):
    table = tables.article_table(folder("articles"), buckets)
    tables.create(spark, table)
    return table


def shown(df):
    return sorted((r._id, r.ticker, r.link, r.article_string, tuple(r.article_embedding), tuple(r.sentiment_score)) for r in df.collect())


TICKERS = [f"T{i}" for i in range(12)]
FIRST = [(i, TICKERS[i % 12]) for i in range(60)]
SECOND = [(100 + i, "T3", f"l{i}") for i in range(20)] + [(200, "T4", "l4"), (201, "new")]


def test_buckets_equal_a_refresh_of_the_whole_table(spark, folder):
    table = table_of(spark, folder)
    mapping = mapped(spark, *TICKERS)
    plain = spark.createDataFrame([], schemas.ARTICLES)
    for batch in (FIRST, SECOND, SECOND, [(300, "T5")], []):
        n = news.store(spark, articles(spark, *batch), table, mapping, embedder(), keep=4)
        plain = spark.createDataFrame(news.refresh(plain, articles(spark, *batch), mapping, embedder(), keep=4).collect(), schemas.ARTICLES)
        assert shown(tables.read(spark, table)) == shown(plain) and n == plain.count()


def files(table):
    found = {}
    for home, _, names in os.walk(table.path):
        for name in names:
            if name.endswith(".parquet"):
                at = os.path.join(home, name)
                found[at] = os.stat(at).st_mtime_ns
    return found


def test_untouched_buckets_keep_their_files(spark, folder):
    table = table_of(spark, folder)
    mapping = mapped(spark, *TICKERS)
    news.store(spark, articles(spark, *FIRST), table, mapping, embedder())
    before, version = files(table), versions.latest(spark, table.path)
    news.store(spark, articles(spark, (500, "T3")), table, mapping, embedder())
    own = spark.createDataFrame([("T3",)], "ticker string").select(tables.bucket_of(table)).first()[0]
    after = versions.latest(spark, table.path)
    assert {b for b in after.folders if after.folders[b] != version.folders.get(b)} == {str(own)}
    kept = {f: t for f, t in files(table).items() if f in before}
    assert kept == before  # the version before is still there too
    read = tables.read(spark, table, {own}).inputFiles()
    assert read and all(f"_bucket={own}/" in f for f in read)


@pytest.mark.parametrize("step", STEPS)
def test_bucketed_table_survives_a_stop(spark, folder, monkeypatch, step):
    table = table_of(spark, folder)
    mapping = mapped(spark, *TICKERS)
    news.store(spark, articles(spark, *FIRST), table, mapping, embedder(), keep=4)
    before = shown(tables.read(spark, table))
    with monkeypatch.context() as m:
        half_a_pointer(m) if step == "pointer" else stops(m, step)
        with pytest.raises(Stop):
            news.store(spark, articles(spark, *SECOND), table, mapping, embedder(), keep=4)
    if step != "vacuum":
        assert shown(tables.read(spark, table)) == before
    news.store(spark, articles(spark, *SECOND), table, mapping, embedder(), keep=4)
    first = news.refresh(spark.createDataFrame([], schemas.ARTICLES), articles(spark, *FIRST), mapping, embedder(), keep=4)
    assert shown(tables.read(spark, table)) == shown(news.refresh(first, articles(spark, *SECOND), mapping, embedder(), keep=4))


def test_pending_rows_and_a_new_mapping_touch_their_buckets(spark, folder):
    table = table_of(spark, folder)
    fails = lambda text: F.when(~F.col(text).contains("Ticker: T7"), embedder()(text))
    news.store(spark, articles(spark, *FIRST), table, mapped(spark, "T1"), fails, keep=4)
    assert tables.read(spark, table).filter("article_embedding IS NULL").count() == 5
    # A run without articles tries them again.
    news.store(spark, articles(spark), table, mapped(spark, "T1"), embedder(), keep=4)
    assert tables.read(spark, table).filter("article_embedding IS NULL").count() == 0
    # A ticker that is mapped now is capped, though no article of it came in.
    news.store(spark, articles(spark), table, mapped(spark, "T1", "T2"), embedder(), keep=2)
    counts = {r.ticker: r["count"] for r in tables.read(spark, table).groupBy("ticker").count().collect()}
    assert counts["T2"] == 2 and counts["T1"] == 2 and counts["T3"] == 5


def test_vectors_of_all_buckets_are_made_anew(spark, folder):
    table = table_of(spark, folder)
    news.store(spark, articles(spark, *FIRST), table, mapped(spark, *TICKERS), embedder())
    assert news.run_recreate(spark, table, enrich.hashed_vectors(5)) == 60
    assert {len(r.article_embedding) for r in tables.read(spark, table).collect()} == {5}


def test_rows_of_other_buckets_are_refused(spark, folder):
    table = table_of(spark, folder)
    with pytest.raises(ValueError, match="among those of"):
        tables.replace_buckets(articles(spark, *FIRST), table, {0}, None)
    assert tables.read(spark, table).count() == 0
