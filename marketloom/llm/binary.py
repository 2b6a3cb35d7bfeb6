"""Operator 2: token ids in binary shards with a minimal perfect hash index.

A shard is one row of a Parquet table in the shared folder. Its ``payload`` holds the raw ids of consecutive documents in
ascending doc_id order; its index maps a document key to its place in the payload by hash and displace: a key's bucket
names a displacement, key and displacement name a slot, no two keys of a shard share a slot, and there are as many slots
as keys. A slot keeps a 32-bit fingerprint of its key (a foreign key is refused), the first id, and how many documents and
ids belong to the key. Writing rows through Spark's committer keeps shards whole when an executor is lost, and works on
any storage Spark can write.

Defined results: a null text is empty (its ids are the end id alone); repeated doc_ids keep all their rows, one after
another, ordered by length and ids; rows whose doc_id is null come first and are in no index; other columns are dropped;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mix, staged, steps, texts_of
from .tokens import ENCODE_BYTES, VOCABULARY, Encoder

#: A shard is closed when it holds as many ids (one longer document is a shard of its own).
SHARD_IDS = 1 << 21
#: Keys per bucket of the index, on average.
BUCKET_KEYS = 4

SHARDS = (
    "part int, block int, n_docs long, n_ids long, n_null long, width int, first_key long, last_key long, "
    "keys binary, lengths binary, displacements binary, fingerprints binary, slots binary, payload binary"
)


@dataclass(frozen=True)
class Shards:
    """The written table, and the bounds between its parts (one number per part, chosen by the writer)."""

    table: DataFrame
    bounds: np.ndarray


def part_range(bounds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last part that may hold each key; they differ only for a key that fills several ranges."""
    low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    return np.where(high - low > 1, low, high), high


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.int64).view(np.uint64) + np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of each bucket, and the slot of each of the distinct keys.

    Large buckets come first and try displacements until all their keys fall on free slots; a bucket of one key names
    its slot directly, as -1 - slot.
    """
    n = len(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    displacement = np.zeros(buckets, np.int32)
    slots = np.zeros(n, np.int64)
    free = np.ones(n, bool)
    bucket = (_hash(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(sizes)
    for b in np.argsort(-sizes, kind="stable"):
        own = order[ends[b] - sizes[b] : ends[b]]
        if len(own) < 2:
            break
        tried = 1
        while True:
            places = (_hash(keys[own][:, None], np.arange(tried, tried + 16)) % np.uint64(n)).astype(np.int64)
            ranked = np.sort(places, axis=0)
            good = free[places].all(axis=0) & (ranked[1:] != ranked[:-1]).all(axis=0)
            if good.any():
                j = int(np.argmax(good))
                displacement[b], slots[own], free[places[:, j]] = tried + j, places[:, j], False
                break
            tried += 16
    left = np.flatnonzero(free)
    alone = np.flatnonzero(sizes == 1)
    for b, slot in zip(alone, left):
        displacement[b] = -1 - slot
        slots[order[ends[b] - 1]] = slot
    return displacement, slots


def find(keys: np.ndarray, displacement: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 for a key whose fingerprint is not the stored one. Constant time per key."""
    n = len(fingerprints)
    if not n or not len(keys):
        return np.full(len(keys), -1, np.int64)
    d = displacement[(_hash(keys, 0) % np.uint64(len(displacement))).astype(np.int64)].astype(np.int64)
    slot = np.where(d < 0, -1 - d, (_hash(keys, np.maximum(d, 0)) % np.uint64(n)).astype(np.int64))
    return np.where(fingerprints[slot] == fingerprint(keys), slot, -1)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0x7F4A7C15) >> np.uint64(32)).astype(np.uint32)


def _shard(part: int, block: int, keys: list, ids: list[bytes], width: int) -> dict:
    nulls = sum(k is None for k in keys)
    lengths = np.array([len(x) // width for x in ids], np.int64)
    begins = np.append(0, np.cumsum(lengths))
    known = np.array(keys[nulls:], np.int64)
    distinct, first, count = np.unique(known, return_index=True, return_counts=True)
    displacement, slot = build_index(distinct) if len(distinct) else (np.zeros(1, np.int32), np.zeros(0, np.int64))
    prints = np.zeros(len(distinct), np.uint32)
    table = np.zeros((len(distinct), 3), "<i8")  # first document of the key in the shard, its documents, first id
    prints[slot] = fingerprint(distinct)
    table[slot] = np.stack([first + nulls, count, begins[first + nulls]], axis=1) if len(distinct) else table
    return {
        "part": part, "block": block, "n_docs": len(keys), "n_ids": int(begins[-1]), "n_null": nulls, "width": width,
        "first_key": int(known[0]) if len(known) else None, "last_key": int(known[-1]) if len(known) else None,
        "keys": known.astype("<i8").tobytes(), "lengths": lengths.astype("<i8").tobytes(),
        "displacements": displacement.astype("<i4").tobytes(), "fingerprints": prints.astype("<u4").tobytes(),
        "slots": table.tobytes(), "payload": b"".join(ids),
    }


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split(" ") for x in SHARDS.split(","))])


def write_shards(docs: DataFrame, parts: int | None = None, vocabulary: str = VOCABULARY, shard_ids: int = SHARD_IDS) -> Shards:
    """Encode all documents and write the shards; returns the written table.

    Parts are ranges of doc_id between quantiles of the doc_id column. A doc_id that fills several ranges is dealt over
    all of them in turn.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.col("doc_id").cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)
    bounds = np.array(cuts, np.float64)

    def encode(batches):
        encoder = Encoder.of_worker(vocabulary)
        turn = 0
        for whole in batches:
            for batch in steps(whole, most=ENCODE_BYTES):
                ids = encoder.encode_column(batch.column("text"))
                keys = batch.column("doc_id")
                at = np.asarray(keys.fill_null(np.iinfo(np.int64).min)).astype(np.float64)
                low, high = part_range(bounds, at)
                part = low + (turn + np.arange(len(at))) % (high - low + 1)
                turn += len(at)
                yield pa.record_batch(
                    [pa.array(part, pa.int32()), keys, pc.binary_length(ids).cast(pa.int64()), ids],
                    names=["part", "doc_id", "n", "ids"],
                )

    def build(batches):
        width = Encoder.of_worker(vocabulary).dtype.itemsize
        keys, ids, held, part, block = [], [], 0, 0, 0
        for batch in batches:
            for p, key, own in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if keys and held + len(own) > shard_ids * width:
                    yield pa.RecordBatch.from_pylist([_shard(part, block, keys, ids, width)], schema=_schema())
                    keys, ids, held, block = [], [], 0, block + 1
                part = p
                keys.append(key)
                ids.append(own)
                held += len(own)
        if keys:
            yield pa.RecordBatch.from_pylist([_shard(part, block, keys, ids, width)], schema=_schema())

    named = texts_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    encoded = named.mapInArrow(encode, "part int, doc_id long, n long, ids binary")
    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    return Shards(staged(dealt.mapInArrow(build, SHARDS), "shards"), bounds)


def read_shards(written: Shards) -> DataFrame:
    """Every document of the shards, found through the index: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: those of the shards before it in its part, and those of the parts
    before its own, of which there is one row each.
    """
    shards = written.table
    totals = staged(shards.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.lit(0).alias("all")), "totals")
    earlier = Window.partitionBy("all").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("low"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = shards.select("part", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("inner"))
    base = inner.join(parts, "part").select("part", "block", (F.col("inner") + F.col("low")).alias("base"))

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                kind = np.dtype(f"<u{row['width']}")
                payload = np.frombuffer(row["payload"], kind)
                keys, lengths = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                table = np.frombuffer(row["slots"], "<i8").reshape(-1, 3)
                distinct, nth = np.unique(keys, return_inverse=True)
                slot = find(distinct, np.frombuffer(row["displacements"], "<i4"), np.frombuffer(row["fingerprints"], "<u4"))
                if (slot < 0).any():
                    raise ValueError("a stored key is not in the index of its shard")
                begins = np.cumsum(lengths) - lengths
                doc = table[slot, 0][nth] + (np.arange(len(keys)) - np.searchsorted(keys, keys))
                start, size = begins[doc], lengths[doc]
                start, size = np.append(begins[: row["n_null"]], start), np.append(lengths[: row["n_null"]], size)
                crc = [zlib.crc32(payload[a : a + n].astype("<u4").tobytes()) for a, n in zip(start.tolist(), size.tolist())]
                n = len(start)
                yield pa.record_batch(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                     pa.array([None] * row["n_null"] + keys.tolist(), pa.int64()), pa.array(start, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "block", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    inside = shards.mapInArrow(scan, "part int, block int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return inside.join(base, ["part", "block"]).select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(shards: Shards, keys: DataFrame) -> DataFrame:
    """Ids of the asked doc_ids (column ``doc_id``), one row per stored document; unknown keys have no row.

    The writer's bounds name the parts of a key, the shards' key ranges the shards; a shard that may hold an asked key is
    opened once, and each key in it is found in constant time.
    """

    bounds = shards.bounds

    def parts(batches):
        for batch in batches:
            k = np.asarray(batch.column("k"))
            low, high = part_range(bounds, k.astype(np.float64))
            nth = np.repeat(np.arange(len(k)), high - low + 1)
            part = low[nth] + (np.arange(len(nth)) - np.searchsorted(nth, nth))
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(k[nth])], names=["part", "k"])

    wanted = keys.select(F.col("doc_id").cast("long").alias("k")).where("k is not null").distinct().mapInArrow(parts, "part int, k long")
    asked = shards.table.select("part", "block", "first_key", "last_key").join(wanted, "part")
    asked = asked.where("k between first_key and last_key").groupBy("part", "block").agg(F.collect_set("k").alias("asked"))

    def fetch(batches):
        for batch in batches:
            for row in batch.to_pylist():
                payload = np.frombuffer(row["payload"], np.dtype(f"<u{row['width']}"))
                lengths, table = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["slots"], "<i8").reshape(-1, 3)
                asked = np.array(row["asked"], np.int64)
                slot = find(asked, np.frombuffer(row["displacements"], "<i4"), np.frombuffer(row["fingerprints"], "<u4"))
                found = []
                for key, s in zip(asked.tolist(), slot.tolist()):
                    if s < 0:
                        continue
                    doc, count, at = table[s].tolist()
                    for n in lengths[doc : doc + count].tolist():
                        found.append({"doc_id": key, "ids": payload[at : at + n].tolist()})
                        at += n
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return shards.table.join(asked, ["part", "block"]).mapInArrow(fetch, "doc_id long, ids array<long>")


def op2_binary(spark, folder: str) -> DataFrame:
    return read_shards(write_shards(spark.read.parquet(f"{folder}/documents.parquet")))
