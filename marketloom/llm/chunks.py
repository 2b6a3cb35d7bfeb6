"""Operator 3: substring deduplication by content-defined chunks.

A gear hash over the last 16 bytes rolls over the UTF-8 bytes of a text; where its leading bits are zero a chunk ends. An
insertion moves only the boundaries next to it, so equal passages fall into equal chunks wherever they stand. A chunk
whose 128-bit digest stands earlier, in the order of doc_id and place, is a repeat; runs of repeats of at least
``MIN_RUN`` bytes are removed, shorter ones (stock phrases) stay.

Defined results: a null text is empty; the earliest occurrence of a chunk stays, in the same document too; rows that share
a doc_id are one document and do not remove each other's chunks at equal places; rows with a null doc_id take no part
and lose nothing; other columns are dropped by the report and kept by ``remove``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import powers, mix, steps, text_bytes, texts_of

#: A boundary is one position in 2 ** 5 on average; a chunk without one ends after MAX_CHUNK bytes.
BITS = 5
MAX_CHUNK = 1024
MIN_RUN = 64

CHUNKS = "doc long, at int, size int, high long, low long"


def boundaries(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """First bytes of the chunks of texts that stand one after another."""
    gear = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)[data]
    for j in (1, 2, 4, 8):  # after the last step: sum of gear[i - j] << j for the last 16 bytes
        gear[j:] = gear[j:] + (gear[:-j] << np.uint16(j)) if len(gear) > j else gear[j:]
    cut = np.flatnonzero(gear >> np.uint16(16 - bits) == 0) + 1
    owner = np.searchsorted(offsets, cut - 1, side="right") - 1
    cut = cut[(cut - offsets[owner] >= 16) & (cut < offsets[owner + 1])]  # the hash saw this text only
    starts = np.union1d(cut, offsets[:-1][np.diff(offsets) > 0])
    size = np.diff(np.append(starts, len(data)))
    parts = -(-size // MAX_CHUNK)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * MAX_CHUNK
    for _ in range(3):  # to the next byte that begins a character
        starts = starts + (data[np.minimum(starts, len(data) - 1)] & 0xC0 == 0x80) if len(data) else starts
    return np.unique(starts[starts < len(data)])


def digests(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit hashes) of the stretches that begin at ``starts`` and end at the next."""
    size = np.diff(np.append(starts, len(data)))
    if not len(starts):
        return size, np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(starts, size)
    power = powers(int(size.max()) + 1)[place]
    out = []
    with np.errstate(over="ignore"):
        for seed in (1, 1001):
            codes = mix(np.arange(seed, seed + 256, dtype=np.uint64))
            out.append(mix(np.add.reduceat(codes[data] * power, starts) + size.astype(np.uint64)).view(np.int64))
    return size, *out


def chunks(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc, at, size, high, low): the chunks of every document, with byte offsets and digests."""

    def scan(batches):
        for whole in batches:
            for batch in steps(whole):
                data, offsets = text_bytes(batch.column("text"))
                starts = boundaries(data, offsets, bits)
                size, high, low = digests(data, starts)
                owner = np.searchsorted(offsets, starts, side="right") - 1
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(owner)), pa.array((starts - offsets[owner]).astype(np.int32)),
                     pa.array(size.astype(np.int32)), pa.array(high), pa.array(low)],
                    names=["doc", "at", "size", "high", "low"],
                )

    known = docs.withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    return texts_of(known, "doc_id").mapInArrow(scan, CHUNKS)


def repeats(docs: DataFrame, bits: int = BITS, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, spans): byte stretches [begin, end) of each document to remove, in order.

    The first place of a digest is an aggregate that combines before its shuffle; its join with the chunks has one row per
    digest on one side, so that adaptive execution can split a digest of many chunks.
    """
    rows = chunks(docs, bits)
    place = F.struct("doc", "at")
    first = rows.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = rows.join(first.select("high", "low", "first"), ["high", "low"]).where(F.struct("doc", "at") > F.col("first"))
    own = later.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("found"))
    return own.select(F.col("doc").alias("doc_id"), _runs(F.col("found"), min_run).alias("spans")).where(F.size("spans") > 0)


def _runs(found, min_run: int):
    """Join neighbouring chunks to runs and keep the long ones: a run begins where no chunk ends, and ends likewise."""
    begins = F.transform(found, lambda c: c["at"])
    ends = F.transform(found, lambda c: c["at"] + c["size"])
    first, last = F.array_except(begins, ends), F.array_except(ends, begins)
    runs = F.arrays_zip(F.sort_array(first).alias("begin"), F.sort_array(last).alias("end"))
    return F.filter(runs, lambda r: r["end"] - r["begin"] >= min_run)


def report(docs: DataFrame, bits: int = BITS, min_run: int = MIN_RUN) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (begin-end of bytes, comma-joined)."""
    found = repeats(docs, bits, min_run)
    all_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    joined = all_rows.join(found, "doc_id", "left")
    removed = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return joined.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.coalesce(listed, F.lit("")).alias("spans"),
    )


def remove(docs: DataFrame, bits: int = BITS, min_run: int = MIN_RUN) -> DataFrame:
    """The documents without their repeated passages; chunks begin and end with whole characters."""

    def cut(text, spans):
        if text is None or spans is None:
            return text
        data, out, at = text.encode(), [], 0
        for s in spans:
            out.append(data[at : s["begin"]])
            at = s["end"]
        return b"".join([*out, data[at:]]).decode()

    def apply(texts, spans):
        return texts.combine(spans, cut)

    found = repeats(docs, bits, min_run).select(F.col("doc_id").alias("_doc"), F.col("spans").alias("_found"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*docs.columns).alias("_row"))
    joined = rows.join(found, F.col("_id") == F.col("_doc"), "left")
    text = F.pandas_udf(apply, "string")(F.col("_row.text"), "_found").alias("text")
    return joined.select(*[text if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def op3_chunks(spark, folder: str) -> DataFrame:
    return report(spark.read.parquet(f"{folder}/documents.parquet"))
