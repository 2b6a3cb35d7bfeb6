"""Operator 9: mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. A window is a run of sequences; in every window each source is served
its target share. What a share leaves over below one token is the source's deficit and is carried to the next window. The
deficit after window w is target(w) - served(w), and served(w) has a closed form in the sources' totals, so each task
knows the deficits at any window, across partitions too, without running the windows before it. When a queue is empty the
others share its part. Queues are served one after another within a window, and the sequences are cut from that order
without gaps: only the last sequence is short.

Defined results: a null text is empty (one end id); a null source is a queue of its own; repeated rows are packed each;
rows with a null doc_id are packed like others; other columns are dropped; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged, steps, texts_of
from .tokens import ENCODE_BYTES, VOCABULARY, Encoder

SEQUENCE = 1024
#: Sequences in a window.
WINDOW = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Schedule:
    """What each queue has been served after each window.

    ``totals`` are the tokens of the queues; ``rates`` their target shares (in any unit; the shares of the totals by
    default). Every number follows from these two lists alone.
    """

    def __init__(self, totals: list[int], rates: list[float] | None, window_tokens: int) -> None:
        self.totals = np.array(totals, np.int64)
        self.rates = np.array(rates if rates is not None else totals, np.float64)
        if (self.rates <= 0).any():
            raise ValueError("every source with rows needs a share above 0")
        total = int(self.totals.sum())
        self.windows = max(1, -(-total // window_tokens))
        # Virtual time at which a queue runs empty, and the tokens served in all by then.
        ends = np.unique(self.totals / self.rates)
        served = np.array([np.minimum(self.totals, self.rates * t).sum() for t in ends])
        window = np.minimum(np.arange(self.windows + 1) * float(window_tokens), total)
        self.time = np.interp(window, np.append(0.0, served), np.append(0.0, ends))
        self.time[-1] = ends[-1]

    def served(self, window: np.ndarray) -> np.ndarray:
        """Tokens of every queue (last axis) served by the end of each window."""
        share = np.floor(self.rates * self.time[window][..., None]).astype(np.int64)
        done = np.asarray(window)[..., None] >= self.windows
        return np.where(done, self.totals, np.minimum(self.totals, share))

    def window_of(self, queue: int, positions: np.ndarray) -> np.ndarray:
        """Index of the window that serves each queue position."""
        own = np.minimum(self.totals[queue], np.floor(self.rates[queue] * self.time).astype(np.int64))
        own[-1] = self.totals[queue]
        return np.searchsorted(own, positions, side="right") - 1


def encode_queues(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write each document's ids with its place in its source's queue of its task; no shuffle."""

    def encode(batches):
        encoder = Encoder.of_worker(vocabulary)
        part, seen = TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in steps(whole, most=ENCODE_BYTES):
                ids = encoder.encode_column(batch.column("text"))
                sources = batch.column("source").to_pylist()
                counts = (np.asarray(pc.binary_length(ids)) // encoder.dtype.itemsize).tolist()
                place = []
                for source, n in zip(sources, counts):
                    place.append(seen.get(source, 0))
                    seen[source] = place[-1] + n
                yield pa.record_batch(
                    [pa.array([part] * len(ids), pa.int32()), batch.column("source"), batch.column("doc_id"),
                     pa.array(place, pa.int64()), pa.array(counts, pa.int64()), ids],
                    names=["part", "source", "doc_id", "place", "n", "ids"],
                )

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    rows = texts_of(named, "doc_id", "source").mapInArrow(encode, "part int, source string, doc_id long, place long, n long, ids binary")
    return staged(rows, "queues")


def pack(
    docs: DataFrame, sequence: int = SEQUENCE, window: int = WINDOW, targets: dict[str, float] | None = None,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Pieces of all documents with their places in the sequences.

    ``targets`` gives the share of each source in every window (default: the sources' shares of all tokens, so that all
    queues end together). The driver holds one total per source, which a mixture names one by one anyway.
    """
    queues = encode_queues(docs, vocabulary)
    totals = queues.groupBy("part", "source").agg(F.sum("n").alias("tokens"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", "source", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    mixture = sorted(totals.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect(), key=lambda r: (r.source is not None, r.source or ""))
    sources = {r.source: i for i, r in enumerate(mixture)}
    amounts = [r.tokens for r in mixture]
    rates = None if targets is None else [targets[s] for s in sources]

    def cut(batches):
        width = Encoder.of_worker(vocabulary).dtype
        schedule = Schedule(amounts, rates, sequence * window)
        for batch in batches:
            out = []
            queue = np.array([sources[s] for s in batch.column("source").to_pylist()], np.int64)
            begin = np.asarray(batch.column("place")) + np.asarray(batch.column("base"))
            size = np.asarray(batch.column("n"))
            ids = batch.column("ids")
            for q in np.unique(queue):
                own = np.flatnonzero(queue == q)
                out.append(_pieces(schedule, int(q), own, begin[own], size[own], sequence))
            row, start, length, position = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
            views = [np.frombuffer(x.as_buffer(), width) for x in ids]
            crc = [zlib.crc32(views[r][a : a + n].astype("<u4").tobytes()) for r, a, n in zip(row.tolist(), start.tolist(), length.tolist())]
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                 pa.array(size[row]), pa.array(position // sequence), pa.array(position % sequence)],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )

    # Written, so that Spark knows its size and sends it to the scan of the ids, which are then not shuffled.
    bases = staged(bases.select(F.col("part").alias("own_part"), F.col("source").alias("own_source"), "base"), "bases")
    placed = queues.join(bases, (F.col("part") == F.col("own_part")) & F.col("source").eqNullSafe(F.col("own_source")))
    return placed.select("source", "doc_id", "place", "base", "n", "ids").mapInArrow(cut, PIECES)


def _pieces(schedule: Schedule, q: int, row: np.ndarray, begin: np.ndarray, size: np.ndarray, sequence: int):
    """Cut the stretches [begin, begin + size) of queue q at the ends of windows, then of sequences."""
    first, last = schedule.window_of(q, begin), schedule.window_of(q, begin + size - 1)
    which = np.repeat(np.arange(len(row)), last - first + 1)
    window = first[which] + (np.arange(len(which)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1))
    used, place = np.unique(window, return_inverse=True)
    low, high = schedule.served(used), schedule.served(used + 1)
    # In a window the queues stand one after another.
    head = low.sum(axis=1) + (high - low)[:, :q].sum(axis=1) - low[:, q]
    a = np.maximum(begin[which], low[:, q][place])
    b = np.minimum((begin + size)[which], high[:, q][place])
    keep = b > a
    which, a, b, shift = which[keep], a[keep], b[keep], head[place][keep]
    start, end = a + shift, b + shift  # positions in the whole stream
    count = (end - 1) // sequence - start // sequence + 1
    again = np.repeat(np.arange(len(which)), count)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
    edge = (start // sequence)[again] * sequence + nth * sequence
    s = np.maximum(start[again], edge)
    e = np.minimum(end[again], edge + sequence)
    piece = which[again]
    return row[piece], (s - shift[again]) - begin[piece], e - s, s


def op9_packing(spark, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"))
