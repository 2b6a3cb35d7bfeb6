"""Helpers of the operators: staged tables, batches of bounded size, word hashes."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_folder

#: Text bytes that one step of a vectorised function holds at a time (a longer text is held alone).
STEP_BYTES = 1 << 20
#: Spark's own setting: shuffle files of a statement go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: the plan is cut, and a lost executor loses no result."""
    spark = df.sparkSession
    path = run_folder(spark, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def removed(*tables: DataFrame) -> None:
    """Delete staged tables whose consumers are written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def worker_state(name: str, make):
    """One object for the life of a Python worker, shared by the tasks it runs."""
    home = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def texts_of(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and ``text``, with null texts as empty ones; other columns are dropped."""
    return docs.select(*names, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together stay below ``most`` bytes."""
    _, ends = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column of texts without nulls, one after another, and the n + 1 offsets."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, values = column.buffers()
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x



def powers(n: int) -> np.ndarray:
    """At least n powers of one odd multiplier, kept by the worker."""
    have = worker_state("powers", lambda: [np.ones(1, np.uint64)])
    if len(have[0]) < n:
        size = max(n, 4096)
        with np.errstate(over="ignore"):
            have[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, 0x9E3779B97F4A7C15, np.uint64))])
    return have[0]


#: Bytes of words: 0-9, a-z (A-Z is lower-cased) and every byte of a character beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[65:91] = True
IN_WORD[128:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: (64-bit hash, text index, first byte, end byte) of each.

    ``data`` holds the texts one after another and ``offsets`` their bounds; a word never spans two texts.
    """
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = inside[inner]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(begins)
    if not len(first):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    slot = np.searchsorted(at, first)  # where each word's bytes begin among all word bytes
    size = np.diff(np.append(slot, len(at)))
    place = np.arange(len(at)) - np.repeat(slot, size)
    codes = mix(np.arange(1, 257, dtype=np.uint64))
    with np.errstate(over="ignore"):
        parts = codes[LOWER[data[at]]] * powers(int(size.max()) + 1)[place]
        hashes = mix(np.add.reduceat(parts, slot) + size.astype(np.uint64))
    text = np.searchsorted(offsets, first, side="right") - 1
    return hashes, text, first, first + size


def shingle_hashes(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a text, and the text of each. A text of fewer words, but not none, has one."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        last = np.flatnonzero(np.append(text[1:] != text[:-1], True))
        head = np.append(0, last[:-1] + 1)
        count = last - head + 1
        room = count[np.searchsorted(last, np.arange(len(words)))]
        before = np.arange(len(words)) - np.repeat(head, count)
        starts = np.flatnonzero((before + k <= room) | ((room < k) & (before == 0)))
        total = np.full(len(starts), 0x1234567, np.uint64)
        for j in range(k):
            there = j < room[starts]
            total = np.where(there, mix(total * np.uint64(31) + words[np.minimum(starts + j, len(words) - 1)]), total)
    return total, text[starts]
