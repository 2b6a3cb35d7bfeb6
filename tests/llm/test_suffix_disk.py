"""What operator 10 leaves on disk."""

import os

import pytest

from marketloom.llm import suffix


@pytest.mark.parametrize("hot", [1 << 20, 100])
def test_only_the_spans_stay(spark, monkeypatch, hot):
    """Texts of stretches, windows and anchors used to stay in the shared folder while the documents were cut."""
    monkeypatch.setattr(suffix, "HOT_BYTES", hot)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    same = "the passage that several of these documents share, long enough for a window of fifty bytes"
    docs = spark.createDataFrame([(i, f"{i * 7919}#{same}#{i * 104729}") for i in range(6)], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in suffix.clean(docs).collect()}
    assert found[0] == 0 and all(found[i] >= len(same) + 2 for i in range(1, 6))
    assert {x.split("-")[0] for x in set(os.listdir(shared)) - before} == {"spans", "differ"}
