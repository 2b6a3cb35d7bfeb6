"""Operator 12 against a plain water-filling, and the words that it takes."""

import re
from collections import Counter, defaultdict

import pytest
from compare import connect, difference

from marketloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, budget, cap):
    """Clamp, share the excess again, until none is above."""
    left, free, out = budget * sum(sizes.values()), dict(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        above = [s for s in free if left * weights[s] / total > cap * sizes[s]]
        if not above:
            return out | {s: left * weights[s] / total for s in free}
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
            del free[s]
    return out


def by_turns(sources):
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}


def check(rows, found, budget=1.5, cap=2.0, weights=None, slack=1.5):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    goals = plain_targets(dict(sizes), weights or by_turns(sizes), budget, cap)
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    taken, cut = defaultdict(int), Counter()
    for r in found:
        got = r.copies * r.size + r.words
        assert 0 <= got <= cap * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goals[r.source], rel=1e-12)
        assert r.copies == (r.target // r.source_size if r.source_size else 0)
        taken[r.source] += got
        cut[r.source] += 0 < r.words < r.size
    for s, words in taken.items():
        assert abs(words - goals[s]) <= max(slack, cut[s]), s
    return cut


def test_given_documents(spark, folder_small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.plan(docs).collect()
    check(docs.collect(), found)
    again = mixing.plan(docs.repartition(5)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    other = mixing.plan(docs, seed=5).collect()
    assert Counter(map(tuple, other)) != Counter(map(tuple, found))


def test_sql(spark, folder_small):
    problem, n = difference(mixing.op12_mixing(spark, folder_small), connect(folder_small), mixing.OP12_SQL)
    assert problem is None and n > 0, problem


def test_edges(spark, edge, nothing):
    check(edge.collect(), mixing.plan(edge).collect(), slack=12)
    assert mixing.plan(nothing).collect() == [] and mixing.mixed(nothing).collect() == []
    wordless = spark.createDataFrame([(1, None, "a"), (2, " \n", None), (3, "", "a")], "doc_id long, text string, source string")
    assert {(r.size, r.source_size, r.target, r.copies, r.words) for r in mixing.plan(wordless).collect()} == {(0, 0, 0.0, 0, 0)}


@pytest.mark.parametrize("budget, cap", [(0.3, 2.0), (1.0, 1.0), (2.9, 3.0), (5.0, 2.0), (0.0, 1.0)])
def test_budgets_and_weights(spark, budget, cap):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), f"s{min(i % 11, 4)}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {f"s{i}": 10.0**i for i in range(5)}
    named = spark.createDataFrame(list(weights.items()), "source string, weight double")
    cut = check(docs.collect(), mixing.plan(docs, named, budget, cap).collect(), budget, cap, weights)
    assert max(cut.values()) <= 3  # only documents of one slot a source are taken in part


def test_half_the_rows_in_one_document(spark):
    rows = [(None if i % 2 else i, "a b c d e", "s") for i in range(2000)] + [(5000 + i, "x y", "t") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.plan(docs).collect()
    assert len(found) == 2010
    # All rows without doc_id are taken alike, so one rounding holds for all of them.
    got = sum(r.copies * r.size + r.words for r in found if r.source == "s")
    assert abs(got - next(r.target for r in found if r.source == "s")) <= 1000


def test_mixed_rows_hold_the_words(spark, edge):
    words = defaultdict(int)
    for r in mixing.plan(edge, budget=2.5, cap=3.0).collect():
        words[r.doc_id, r.size] += r.copies * r.size + r.words
    got = defaultdict(int)
    texts = {(r.doc_id, len(WORD.findall(r.text or ""))): r.text for r in edge.collect()}
    for r in mixing.mixed(edge, budget=2.5, cap=3.0).collect():
        assert len(WORD.findall(r.text)) == r.words and texts[r.doc_id, r.size].startswith(r.text)
        got[r.doc_id, r.size] += r.words
    assert got == {k: v for k, v in words.items() if v}


def test_a_source_without_weight_is_named(spark, folder_small):
    docs = spark.read.parquet(f"{folder_small}/documents.parquet")
    with pytest.raises(Exception, match="no weight above 0 for source src"):
        mixing.plan(docs, spark.createDataFrame([("src1", 1.0)], "source string, weight double")).collect()


def test_no_python_in_the_plan(spark, folder_small):
    text = mixing.op12_mixing(spark, folder_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
