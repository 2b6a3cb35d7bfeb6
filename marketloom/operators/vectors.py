"""Exact top-k search by cosine similarity.

Query vectors that fit into one block of bounded size go to the tasks of the
corpus scan, which is not shuffled then. More of them are cut into blocks, the
corpus into parts, and each block meets each part once: a group holds one part
and as many blocks as memory of bounded size takes, sets block after block
against the part, and hands on its k best rows per query. So the corpus is
shuffled once for each PASS_BYTES of queries, however small the blocks are, and
the queries once for each part. Those few rows are merged by query. The driver
sees two counts and at most one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import top_k

#: Bytes of a block of query vectors; of the blocks of a group, and of a part of the corpus, at most.
PASS_BYTES = 32 << 20
#: Bytes of a part of the corpus, at least.
PART_BYTES = 1 << 18
#: Parts for each core, where parts of PASS_BYTES would be fewer.
PARTS_PER_CORE = 4
#: Scores that a task works out at a time, and of how many queries.
STEP_SCORES, STEP_QUERIES = 1 << 20, 1 << 10


def nearest(
    corpus: DataFrame, queries: DataFrame, k: int, *, row_id: str, vector: str, dim: int,
    exclude_self: bool = False, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(query_id, row id, score rounded to 6, rank) of the k best rows per query.

    ``queries`` has ``query_id`` and ``vector``; ids are integers or texts. Corpus vectors that are null or of another
    dimension are left out.
    """
    blocks = max(1, -(-queries.count() * dim * 8 // pass_bytes))
    usable = corpus.filter(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(row_id, vector)
    types = queries.schema["query_id"].dataType.simpleString(), corpus.schema[row_id].dataType.simpleString()
    schema = f"query_id {types[0]}, `{row_id}` {types[1]}, score double"
    search = _scan if blocks == 1 else _meet
    scored = search(usable, queries.select("query_id", "vector"), blocks, schema, k, row_id, vector, dim, exclude_self, pass_bytes)
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col(row_id)], k, spread=[row_id])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector stays zero and scores 0 everywhere."""
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1, lengths)


class _Best:
    """The k best rows of each query among those seen, by score and then id; queries are worked on ``block`` at a time."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool, block: int = STEP_QUERIES) -> None:
        self.query_ids, self.queries, self.k, self.exclude_self = query_ids, _unit(queries), k, exclude_self
        self.block = max(1, min(block, STEP_QUERIES, STEP_SCORES))
        self.scores, self.ids = np.full((len(query_ids), k), -np.inf), None

    def see(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(ids):
            return
        order = np.argsort(ids, kind="stable")  # so that of equal scores the first one counts
        ids, rows = ids[order], _unit(rows[order])
        if self.ids is None:
            self.ids = np.full(self.scores.shape, ids[0], ids.dtype)
        width = max(1, STEP_SCORES // self.block)
        for a in range(0, len(self.query_ids), self.block):
            for i in range(0, len(ids), width):
                self._step(slice(a, a + self.block), ids[i : i + width], rows[i : i + width])

    def _step(self, own: slice, ids: np.ndarray, rows: np.ndarray) -> None:
        scores = np.round(self.queries[own] @ rows.T, 6) + 0.0
        scores[np.isnan(scores)] = -np.inf
        if self.exclude_self:
            first, end = (np.searchsorted(ids, self.query_ids[own], side) for side in ("left", "right"))
            for q in np.flatnonzero(first < end):
                scores[q, first[q] : end[q]] = -np.inf
        n = scores.shape[1]
        if n > self.k:  # rounded scores are whole numbers of millionths; earlier rows come first among equal ones
            place = np.rint(np.maximum(scores, -2) * 1e6).astype(np.int64) * n - np.arange(n)
            at = np.argpartition(place, n - self.k, axis=1)[:, n - self.k :]
            scores = np.take_along_axis(scores, at, axis=1)
        else:
            at = np.broadcast_to(np.arange(n), scores.shape)
        gain = np.flatnonzero(scores.max(axis=1) >= self.scores[own, -1])
        q = gain + own.start
        scores = np.concatenate([self.scores[q], scores[gain]], axis=1)
        ids = np.concatenate([self.ids[q], ids[at[gain]]], axis=1)
        rank = np.unique(ids, return_inverse=True)[1].reshape(ids.shape) if ids.size else np.zeros(ids.shape, np.int64)
        order = np.lexsort((rank, -scores), axis=1)[:, : self.k]
        self.scores[q], self.ids[q] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)

    def rows(self, row_id: str) -> pd.DataFrame:
        real = self.scores > -np.inf
        which = np.nonzero(real)[0]
        return pd.DataFrame({"query_id": self.query_ids[which], row_id: self.ids[real], "score": self.scores[real]})


def _ids(column: pd.Series) -> np.ndarray:
    values = column.to_numpy()
    return values.astype(object) if values.dtype.kind not in "iu" else values.astype(np.int64)


def _vectors(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, dim))


def _scan(corpus, queries, blocks, schema, k, row_id, vector, dim, exclude_self, pass_bytes) -> DataFrame:
    """One block of queries, sent to the tasks that read the corpus."""
    block = queries.orderBy("query_id").toPandas()  # below pass_bytes
    ids, matrix = _ids(block["query_id"]), _vectors(block["vector"], dim)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _Best(ids, matrix, k, exclude_self)
        for batch in batches:
            if len(batch):
                found.see(_ids(batch[row_id]), _vectors(batch[vector], dim))
        if found.ids is not None:
            yield found.rows(row_id)

    return corpus.mapInPandas(best, schema)


def _cuts(blocks: int, size: int, pass_bytes: int, cores: int) -> tuple[int, int]:
    """Groups of blocks, and parts of a corpus of ``size`` bytes."""
    most, small = max(pass_bytes, PASS_BYTES), -(-size // max(pass_bytes, PART_BYTES))
    return max(1, -(-blocks * pass_bytes // most)), max(1, -(-size // most), min(small, PARTS_PER_CORE * cores))


def _meet(corpus, queries, blocks, schema, k, row_id, vector, dim, exclude_self, pass_bytes) -> DataFrame:
    """Every block of queries against every part of the corpus."""
    spark = corpus.sparkSession
    groups, parts = _cuts(blocks, corpus.count() * dim * 8, pass_bytes, spark.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda *c, n: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    asked = queries.select("query_id", "vector", own("query_id", "vector", n=groups).alias("_group"), every(parts).alias("_part"))
    rows = corpus.select(row_id, vector, own(row_id, vector, n=parts).alias("_part"), every(groups).alias("_group"))

    def best(group: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(part):
            return pd.DataFrame({"query_id": _ids(group["query_id"])[:0], row_id: _ids(part[row_id])[:0], "score": np.zeros(0)})
        found = _Best(_ids(group["query_id"]), _vectors(group["vector"], dim), k, exclude_self, pass_bytes // (dim * 8))
        found.see(_ids(part[row_id]), _vectors(part[vector], dim))
        return found.rows(row_id)

    keys = ["_group", "_part"]
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(best, schema)


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(query_id, vector): the mean vector of every group, combined map side."""
    at = df.select(F.col(group).cast("long").alias("query_id"), F.posexplode(vector).alias("pos", "x"))
    means = at.groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector")
    )
