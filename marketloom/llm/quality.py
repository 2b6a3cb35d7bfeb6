"""Operator 6: quality score from the sizes a text compresses to with a good and a bad zstandard dictionary.

One dictionary is built from good and one from bad labelled texts. A text is cut into blocks, each block is compressed
with both, and the difference of the sizes, divided by the text's size, becomes a probability by a logistic curve that is
fitted on labelled texts outside the dictionaries, weighted to the true frequency of the labels.

Learning uses at most ``SAMPLE`` labelled documents of each label, the first in the order of a hash of doc_id, and never
a row whose crc32(doc_id as text) mod 3 is 1. Scoring reads every text whole.

Defined results: null and empty texts have a difference of zero and the score of that; a null doc_id is not held out;
repeated rows are scored each; without labels of both kinds every score is the share of good labels (0.5 if there are
none); other columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import steps, texts_of

#: Labelled documents of each label that are read for learning.
SAMPLE = 3000
#: Every third of them is kept out of the dictionaries, for the curve.
CURVE_EVERY = 3
DICTIONARY_BYTES = 112_640
BLOCK = 2048
LEVEL = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts and labels to learn from, in the order of a hash of doc_id, and how many labels there are of each kind."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [known.where(F.col("quality") == q).orderBy(*by_hash).limit(size) for q in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * size rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id")
    rows = rows.dropDuplicates(["doc_id"]).orderBy(*by_hash).limit(2 * size).collect()
    return [(r.text or "", r.quality) for r in rows], counts


def blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of too little text, the text itself."""
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


class Sizer:
    """Normalised difference of the sizes under the bad and the good dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = self._compressor(good), self._compressor(bad)

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        kept = zstandard.ZstdCompressionDict(data) if data else None
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_dict_id=False)

    def difference(self, text: str) -> float:
        parts = blocks(text)
        more = sum(len(self.bad.compress(b)) - len(self.good.compress(b)) for b in parts)
        return more / max(1, sum(map(len, parts)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the curve, by Newton steps with a small ridge."""
    scale = float(np.abs(x).mean()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-3 * c
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), grad)
        c += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0] / scale), float(c[1])


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[bytes, bytes, float, float]:
    """(good dictionary, bad dictionary, slope, intercept)."""
    rows, counts = sample(docs, labels, size)
    kinds = {q: [t for t, own in rows if own == q] for q in (0, 1)}
    total = sum(counts.values())
    if not kinds[0] or not kinds[1]:
        share = (counts.get(1, 0) + 0.5) / (total + 1)
        return b"", b"", 0.0, math.log(share / (1 - share))
    parts = {q: [t for i, t in enumerate(own) if i % CURVE_EVERY] or own for q, own in kinds.items()}
    curve = [(t, q) for q, own in kinds.items() for t in (own[::CURVE_EVERY] or own)]
    good, bad = dictionary(parts[1]), dictionary(parts[0])
    sizer = Sizer(good, bad)
    y = np.array([q for _, q in curve], float)
    share = {q: counts[q] / total / max(1, (y == q).sum()) for q in (0, 1)}
    weight = np.where(y == 1, share[1], share[0]) * len(y)
    return good, bad, *logistic(np.array([sizer.difference(t) for t, _ in curve]), y, weight)


def score(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    good, bad, slope, intercept = learn(docs, labels, size)

    def scan(batches):
        sizer = Sizer(good, bad)
        for whole in batches:
            for batch in steps(whole):
                x = [slope * sizer.difference(t) + intercept for t in batch.column("text").to_pylist()]
                p = [1 / (1 + math.exp(-min(max(v, -30.0), 30.0))) for v in x]
                yield pa.record_batch([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    found = texts_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(scan, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark, folder: str) -> DataFrame:
    return score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
