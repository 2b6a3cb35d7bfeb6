"""The keyword index against looking for every term in every text."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import filters, keywords


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_ten_thousand_queries_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 6)))
    texts = [(i, f"s{i % 3}", rng.choice([None, "", " ".join(word().upper() for _ in range(rng.randint(0, 25)))]), " ".join(word() for _ in range(12))) for i in range(60)]
    posts = spark.createDataFrame(texts, "_id long, subreddit string, title string, selftext string").repartition(3)
    queries = [(f"A{i}", f"s{i % 4}", rng.choice([" OR ", "  OR "]).join(word() + rng.choice(["", " " + word()]) for _ in range(rng.randint(1, 3)))) for i in range(10_000)]
    pairs = spark.createDataFrame([*queries, ("none", "s1", None)], "asset_id string, subreddit string, query string")
    got = keywords.matching_pairs(posts, pairs, "_id", ["title", "selftext"], on="subreddit")
    want = []
    for i, sub, title, body in texts:
        both = ((title or "").lower(), body.lower())
        for asset, s, query in queries:
            if s == sub and any(t.strip().lower() in x for t in query.split(" OR ") for x in both):
                want.append((asset, i))
    found = rows(got, "asset_id", "_id")
    assert found == sorted(want, key=repr) and len(found) > 1000
    plain = filters.matching_query(posts.join(pairs.limit(300), "subreddit"), "query", "title", "selftext")
    index = keywords.matching_pairs(posts, pairs.limit(300), "_id", ["title", "selftext"], on="subreddit")
    assert rows(index, *plain.columns) == rows(plain, *plain.columns)


def test_no_terms_and_no_texts(spark):
    posts = spark.createDataFrame([(1, "s", "a b"), (2, "s", None)], "_id long, on string, text string")
    pairs = spark.createDataFrame([("x", "s", None), ("y", "t", "a")], "k string, on string, query string")
    assert keywords.matching_pairs(posts, pairs, "_id", ["text"], on="on").count() == 0
    assert keywords.matches(posts, keywords.terms_of(pairs.limit(0)), "_id", ["text"]).count() == 0
    assert rows(keywords.matches(posts, keywords.terms_of(pairs), "_id", ["text"]), "_id", "term") == [(1, "a")]
    assert keywords.matches(posts.limit(0), keywords.terms_of(pairs), "_id", ["text"]).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    """The runs of a text were cut one by one from its start, so 30 texts of 200,000 characters took many minutes."""
    import time

    posts = spark.createDataFrame([(i, "s", f"é{i}x " + "aß𝒳c " * 40_000) for i in range(30)], "_id long, on string, text string").repartition(4)
    pairs = spark.createDataFrame([("u", "s", "É7X OR ß𝒳"), ("v", "s", "é8x OR none"), ("w", "t", "aß")], "k string, on string, query string")
    began = time.time()
    found = keywords.matching_pairs(posts, pairs, "_id", ["text"], on="on")
    assert rows(found, "_id", "k") == sorted([(i, "u") for i in range(30)] + [(8, "v")], key=repr)
    assert found.columns == ["_id", "on", "text", "k", "query"]
    assert time.time() - began < 60


def test_pairs_met_by_several_terms_and_blocks_count_once(spark, monkeypatch):
    monkeypatch.setattr(keywords, "BLOCK", 2)
    posts = spark.createDataFrame([(1, "s", "One two"), (1, "s", "One two"), (2, "t", "two"), (None, "s", "one")], "_id long, on string, text string")
    pairs = spark.createDataFrame([(str(i), "s" if i % 2 else None, "one OR two OR one") for i in range(40)], "k string, on string, query string")
    found = keywords.matching_pairs(posts, pairs, "_id", ["text"], on="on")
    assert rows(found, "_id", "k") == sorted([(1, str(i)) for i in range(1, 40, 2)] * 2, key=repr)


def test_vector_blocks_meet_all_parts(spark, monkeypatch):
    import numpy as np

    from marketloom.operators import vectors

    monkeypatch.setattr(vectors, "PART_BYTES", 8 * 4 * 20)
    monkeypatch.setattr(vectors, "STEP_SCORES", 50)
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)]
    corpus = spark.createDataFrame(data, "id long, v array<double>").repartition(4)
    queries = corpus.filter("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    for exclude in (False, True):
        got = vectors.nearest(corpus, queries, 5, row_id="id", vector="v", dim=4, exclude_self=exclude, pass_bytes=8 * 4 * 7)
        one = vectors.nearest(corpus, queries, 5, row_id="id", vector="v", dim=4, exclude_self=exclude)
        unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in data}
        want = []
        for q in range(0, 150, 3):
            scored = sorted((-round(float(unit[q] @ u), 6), i) for i, u in unit.items() if not (exclude and i == q))
            want += [(q, i, n + 1) for n, (_, i) in enumerate(scored[:5])]
        assert rows(got, "query_id", "id", "rank") == rows(one, "query_id", "id", "rank") == sorted(want, key=repr)


def test_small_blocks_do_not_copy_the_corpus(spark):
    """Every block of four queries used to take a copy of the corpus: 50 copies here."""
    from marketloom.operators import vectors

    corpus = spark.range(4000).select(F.col("id"), F.array(*[F.rand(i) - 0.5 for i in range(16)]).alias("v"))
    queries = corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = vectors.nearest(corpus, queries, 3, row_id="id", vector="v", dim=16, pass_bytes=16 * 8 * 4)
    assert vectors._cuts(50, 4000 * 16 * 8, 16 * 8 * 4, 4) == (1, 2)
    assert vectors._cuts(1538, 615_000 * 512, 2048, 12) == (1, 48) and vectors._cuts(4, 100 << 20, 32 << 20, 12) == (4, 4)
    one = vectors.nearest(corpus, queries, 3, row_id="id", vector="v", dim=16)
    assert rows(got, "query_id", "id", "rank") == rows(one, "query_id", "id", "rank") and got.count() == 600


def test_text_ids_in_blocks_and_empty_parts(spark):
    from marketloom.operators import vectors

    data = [(f"r{i}", [float(i % 3), float(i % 5), 1.0]) for i in range(40)]
    corpus = spark.createDataFrame(data, "id string, v array<double>").repartition(60, "id")
    queries = corpus.filter("id like '%7'").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    for size in (24, vectors.PASS_BYTES):
        got = vectors.nearest(corpus, queries, 5, row_id="id", vector="v", dim=3, exclude_self=True, pass_bytes=size)
        found = rows(got, "query_id", "rank", "id")
        assert len(found) == 20 and found[:2] == [("r17", 1, "r2"), ("r17", 2, "r32")] and all(q != i for q, _, i in found)


def test_a_step_over_many_queries_stays_small():
    """Ids of every score of a step used to be gathered and sorted: some 400 MB here."""
    import tracemalloc

    import numpy as np

    from marketloom.operators import vectors

    rng = np.random.default_rng(1)
    ids = np.array([f"article-{i}" for i in range(6000)], dtype=object)
    data = rng.normal(size=(6000, 16))
    best = vectors._Best(ids[:1200], data[:1200], 5, True)
    tracemalloc.start()
    for i in (0, 3000):
        best.see(ids[i : i + 3000], data[i : i + 3000])
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = np.round(unit[:1200] @ unit.T, 6)
    np.fill_diagonal(scores, -9)
    for q in range(0, 1200, 97):
        want = sorted(range(6000), key=lambda i: (-scores[q, i], ids[i]))[:5]
        assert best.ids[q].tolist() == [ids[i] for i in want]


def shuffled_bytes(df) -> int:
    """Bytes that the last run of ``df`` wrote to shuffles."""

    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_what_is_found_is_not_shuffled(spark):
    """Every row of a source used to be shuffled with the list of all pairs it matches: 17 million numbers here."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    posts = spark.createDataFrame([(i, "s", " ".join(["the", *[word() for _ in range(20)]])) for i in range(3000)], "_id long, on string, text string").repartition(4)
    pairs = spark.createDataFrame([(f"P{i}", "s", f"the OR {word()}") for i in range(3000)], "k string, on string, query string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        found = keywords.matching_pairs(posts, pairs, "_id", ["text"], on="on", whole=False).select("_id", "k", "query")
        counts = found.agg(F.count("k"), F.count("query"))
        assert counts.collect()[0][0] == 3000 * 3000
        assert 0 < shuffled_bytes(counts) < 2_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("whole", [False, True])
def test_blocks_and_parts_equal_brute_force(spark, monkeypatch, whole):
    """Terms with white space, of one or two characters and longer than the words kept; ids that come twice and null ones."""
    for name, value in {"BLOCK": 4, "LEAST": 40, "MOST": 40, "PART_BYTES": 900, "CELLS": 1, "SLICE": 128, "READ": 300, "WORDS": 30, "LONGEST": 6, "LOOK": 50}.items():
        monkeypatch.setattr(keywords, name, value)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé𝒳") for _ in range(rng.randint(1, 9)))
    space = lambda: rng.choice([" ", "  ", "\n", "\x1c", "\u00a0"])
    texts = [(i if i % 9 else None, f"s{i % 3}" if i % 7 else None, rng.choice([None, "", word().upper()]), "".join(word() + space() for _ in range(6))) for i in range(150)]
    texts += texts[1:8] + texts[1:3]
    terms = lambda: [rng.choice([word(), word() + space() + word(), "\x1c"]) for _ in range(rng.randint(1, 4))]
    queries = [(f"A{i}", f"s{i % 4}" if i % 5 else None, " OR ".join(terms()) if i % 11 else None) for i in range(90)] * 2
    posts = spark.createDataFrame(texts, "_id long, subreddit string, title string, selftext string").repartition(3)
    pairs = spark.createDataFrame(queries, "asset_id string, subreddit string, query string")
    got = keywords.matching_pairs(posts, pairs, "_id", ["title", "selftext"], on="subreddit", whole=whole)
    assert got.columns == ["_id", "subreddit", *(["title", "selftext"] if whole else []), "asset_id", "query"]
    plain = filters.matching_query(posts.join(pairs, "subreddit").filter("_id is not null"), "query", "title", "selftext")
    assert rows(got, *got.columns) == rows(plain, *got.columns) and got.count() > 1000
