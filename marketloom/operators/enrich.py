"""Embedding and sentiment of texts.

Both take a pluggable scorer. The defaults - hashed word counts and word lists -
only stand in for a model: they keep the contract (vector length, unit norm,
three scores that sum to one) and need no weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words

LABELS = ("positive", "negative", "neutral")

# A small default word list of the finance domain.
POSITIVE_WORDS = (
    "beat", "beats", "bullish", "gain", "gains", "growth", "high", "improve", "improved",
    "optimistic", "outperform", "profit", "profits", "rally", "record", "rise", "rises",
    "strong", "surge", "up", "upgrade",
)
NEGATIVE_WORDS = (
    "bearish", "crash", "cut", "decline", "declines", "default", "down", "downgrade", "drop",
    "fall", "falls", "fear", "loss", "losses", "low", "miss", "recession", "risk", "sell",
    "underperform", "weak",
)


class HashingEmbedder:
    """Word counts in ``dim`` hash buckets, scaled to length one."""

    REMEMBERED = 500_000

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.bucket: dict[str, int] = {}

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        return [self._vector(text) for text in texts]

    def _vector(self, text: str) -> np.ndarray | None:
        counts = Counter(text.lower().split())
        if not counts:
            return None
        if len(self.bucket) > self.REMEMBERED:
            self.bucket.clear()
        at = []
        for token in counts:
            place = self.bucket.get(token)
            if place is None:
                place = int(md5(token.encode()).hexdigest()[:8], 16) % self.dim
                self.bucket[token] = place
            at.append(place)
        sums = np.bincount(at, weights=list(counts.values()), minlength=self.dim)
        return sums / np.sqrt((sums**2).sum())


def hashed_vectors(dim: int) -> Callable[[Column | str], Column]:
    """Function text -> vector like that of ``HashingEmbedder``, in built-in functions alone.

    The sorted slots of the words are cut into runs, (slot, count), so the work
    grows with the words plus ``dim``; only then is the vector filled up."""

    def bind(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)

    def slot(word: Column) -> Column:
        return F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") % dim

    def runs(slots: Column) -> Column:
        n = F.size(slots)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(slots, i - 1) != F.get(slots, i)))
        return F.get(
            bind(ends, lambda e: F.zip_with(e, F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)), lambda b, a: F.struct(
                F.get(slots, a).cast("int").alias("slot"), (b - a).alias("n")))), F.lit(0),
        )

    def filled(pairs: Column) -> Column:
        norm = F.sqrt(F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + p["n"].cast("long") * p["n"]).cast("double"))
        zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
        # Each run follows the zeros since the one before.
        before = F.concat(F.array(F.lit(-1)), F.transform(F.slice(pairs, 1, F.size(pairs) - 1), lambda p: p["slot"]))
        parts = bind(norm, lambda l: F.flatten(F.zip_with(pairs, before, lambda p, b: F.concat(
            zeros(p["slot"] - b - 1), F.array((p["n"] / l).cast("float"))))))
        return F.get(bind(F.get(parts, F.lit(0)), lambda v: F.concat(v, zeros(F.lit(dim) - F.size(v)))), F.lit(0))

    def embed(text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        slots = F.sort_array(F.transform(words(F.lower(text)), slot))
        found = bind(slots, lambda s: F.when(F.size(s) > 0, F.get(bind(runs(s), filled), F.lit(0))))
        return F.get(found, F.lit(0))

    return embed


def vectorize(make_embedder: Callable[[], Callable[[Sequence[str]], list]], batch: int = 100):
    """Arrow UDF text -> vector. The embedder is made once per task and sees
    batches of texts; NULL and empty texts never reach it.

    It is marked non-deterministic so that the optimizer never copies it into a
    filter, which would call the model twice per text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for chunk in chunks:
            out = pd.Series([None] * len(chunk), index=chunk.index, dtype=object)
            todo = chunk[chunk.notna() & (chunk != "")]
            for start in range(0, len(todo), batch):
                part = todo.iloc[start : start + batch]
                for at, vector in zip(part.index, embedder(part.tolist()), strict=True):
                    out.at[at] = None if vector is None else np.asarray(vector, dtype=np.float32)
            yield out

    return embed.asNondeterministic()


def embed_missing(df: DataFrame, text: str, vector: str, embed, where: Column | None = None) -> DataFrame:
    """Fill the vector of rows that have none. Texts of finished rows become
    NULL before they leave the JVM, so Python only sees pending texts."""
    pending = F.col(vector).isNull()
    if where is not None:
        pending = pending & where
    fresh = embed(F.when(pending, F.col(text)))
    return df.withColumn(vector, F.coalesce(F.col(vector), fresh))


def lexicon_scores(
    text: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> Column:
    """struct<positive, negative, neutral> from word counts with one added to
    each; NULL for missing or empty text."""
    # One-element arrays bind the words and then the counts, so that each is
    # worked out once per text.
    counts = F.transform(
        F.array(words(F.lower(text))),
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.size(F.filter(w, lambda t: t.isin(*positive))).alias("good"),
            F.size(F.filter(w, lambda t: t.isin(*negative))).alias("bad"),
        ),
    )
    share = lambda c, hits: (hits + 1) / (c["n"] + 3).cast("double")
    scores = F.transform(
        counts,
        lambda c: F.struct(
            share(c, c["good"]).alias("positive"),
            share(c, c["bad"]).alias("negative"),
            share(c, c["n"] - c["good"] - c["bad"]).alias("neutral"),
        ),
    )
    return F.when(F.coalesce(text != "", F.lit(False)), F.get(scores, F.lit(0)))


def model_scores(make_scorer: Callable[[], Callable[[Sequence[str]], list[dict[str, float] | None]]], batch: int = 100):
    """Function text -> struct of three scores for a real model, run in Arrow
    batches. The model is made once per task; labels may come in any letter
    case; a text the model fails on (or without text) has no score."""
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in LABELS])

    @F.pandas_udf(schema)
    def score(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for chunk in chunks:
            out = np.full((len(chunk), len(LABELS)), np.nan)
            todo = np.flatnonzero((chunk.notna() & (chunk != "")).to_numpy())
            for start in range(0, len(todo), batch):
                part = todo[start : start + batch]
                for at, result in zip(part, scorer(chunk.iloc[part].tolist()), strict=True):
                    if result is not None:
                        lowered = {k.lower(): v for k, v in result.items()}
                        out[at] = [lowered.get(name, np.nan) for name in LABELS]
            yield pd.DataFrame(out, columns=list(LABELS))

    model = score.asNondeterministic()

    def scores(text: Column | str) -> Column:
        # The array lets the check use the result without a second call.
        scored = F.filter(F.array(model(text)), lambda s: s["positive"].isNotNull() & ~F.isnan(s["positive"]))
        return F.get(scored, F.lit(0))

    return scores


def label_scores(entries: Column) -> Column:
    """``array<struct<label, score>>`` of a classifier as a struct by label."""
    by_label = F.map_from_entries(F.transform(entries, lambda e: F.struct(F.lower(e["label"]), e["score"])))
    return F.struct(*[F.try_element_at(by_label, F.lit(name)).alias(name) for name in LABELS])


def score_missing(df: DataFrame, text: str, score: str, scores: Callable[[Column], Column]) -> DataFrame:
    """Fill the score of rows that have none; only their texts reach the scorer."""
    pending = F.when(F.col(score).isNull(), F.col(text))
    return df.withColumn(score, F.coalesce(F.col(score), scores(pending)))


def vector_problem(vector: Column, dim: int, tolerance: float = 1e-3) -> Column:
    """Why a vector breaks the declared index; NULL when it does not."""
    norm = F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )
    return (
        F.when(vector.isNull(), F.lit("missing"))
        .when(F.size(vector) != dim, F.lit("wrong dimension"))
        .when(F.abs(norm - 1) > tolerance, F.lit("not unit length"))
    )
