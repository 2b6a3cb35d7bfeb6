"""Operator 10: removal of repeated 50-byte strings by merged Burrows-Wheeler transforms.

Every 50-byte window has a content-defined anchor: the smallest hash of the 18-byte strings in it. Consecutive windows of
one anchor form a stretch, so each window lies in one stretch, and equal windows have equal anchors. Three steps follow:

1. Stretches whose anchor occurs in one document only cannot repeat and go. Tasks ship sorted, packed anchors to the
   anchor's bucket; an anchor that a task already saw in two documents is known to repeat, so its stretches are spread over
   all buckets and only one of them goes to its own: a frequent passage fills no bucket.
2. The texts of the remaining stretches are dealt to buckets by anchor and grouped there by content, keeping the smallest
   document. In a bucket, shards of stretches are sorted to Burrows-Wheeler transforms whose
   symbols are the 25 bytes before a suffix. The transforms are merged by interleave refinement: starting from any
   interleaving, each round sorts the interleaving stably by its symbols, which orders it 25 bytes deeper; suffixes are
   never compared. Neighbours that a round tears apart have their common prefix there. After two rounds the unbroken
   intervals are the suffixes that share 50 bytes; each takes the smallest document of its members. The number of buckets
   follows the bytes of all stretches. At the edges of a passage a stretch holds its document's own context, so a passage
   in many documents has many distinct stretches of one anchor: anchors of more than HOT_BYTES stay out of the buckets,
   and their windows meet by their own hash in an aggregate that is combined before the shuffle.
3. A window whose interval has a smaller document is removed from its document.

Defined results: a null text is empty; texts below 50 bytes lose nothing; rows that share a doc_id never remove each
other; rows with a null doc_id take no part and lose nothing; other columns are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import digests
from .shared import mix, removed, staged, steps, text_bytes, texts_of

LENGTH = 50
#: Bytes of an anchor string.
ANCHOR = 18
#: Bytes of a symbol of the transforms; it divides LENGTH.
SYMBOL = 25
#: Text bytes whose stretches are packed together.
PACK_BYTES = 16 << 20
#: Stretch bytes of a shard.
SHARD_BYTES = 256 << 10
#: Stretch bytes of a bucket, on average.
BUCKET_BYTES = 16 << 20
#: Stretch bytes of one anchor beyond which its windows are dealt by their own hash.
HOT_BYTES = 1 << 20

# -- anchors and stretches -------------------------------------------------------------


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each position on (shorter at the end, where no window begins)."""
    p = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        h = mix(np.arange(1, 257, dtype=np.uint64))[data]
        pair, size, power = None, 1, p
        while size < 16:
            new = h.copy()
            new[:-size] = h[:-size] * power + h[size:]
            h, power, size = new, power * power, size * 2
            pair = h if size == 2 else pair
        new = h.copy()
        new[:-16] = h[:-16] * (p * p) + pair[16:] if len(h) > 16 else h[:-16]
        return mix(new)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive values."""
    m, size = h, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:]) if len(m) > size else m[:0]
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest and len(m) > rest else m if not rest else m[:0]


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text index, first byte in the text, windows) of each stretch."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), none, none, none
    least = window_minima(anchor_hashes(data), LENGTH - ANCHOR + 1)[: len(data) - LENGTH + 1]
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)] - np.arange(len(least))
    valid = room >= LENGTH
    owner_start = np.zeros(len(least) + 1, bool)
    owner_start[offsets[:-1][offsets[:-1] <= len(least)]] = True
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1] | owner_start[1 : len(least)]
    first = np.flatnonzero(new)
    ends = np.append(np.flatnonzero(new[1:] | (valid[:-1] & ~valid[1:])) + 1, len(least))
    stop = ends[np.searchsorted(ends, first, side="right")]
    owner = np.searchsorted(offsets, first, side="right") - 1
    return least[first], owner, first - offsets[owner], stop - first


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


PACKED = "bucket int, direct boolean, anchors binary, docs binary, checks binary, places binary, sizes binary"
PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _packed_rows(anchor, doc, check, at, size, buckets: int, turn: int) -> list[dict]:
    """Packed stretches by bucket, sorted by anchor; known repeats are dealt out by ``turn``."""
    order = np.argsort(anchor, kind="stable")
    anchor, doc, check, at, size = anchor[order], doc[order], check[order], at[order], size[order]
    first = np.append(True, anchor[1:] != anchor[:-1])
    start = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    differs = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
    known = differs[group]
    own = (anchor % np.uint64(buckets)).astype(np.int64)
    rows = []

    def add(bucket: int, direct: bool, pick: np.ndarray) -> None:
        step = np.diff(anchor[pick] >> np.uint64(24), prepend=np.uint64(0))  # 40 bits are enough to tell anchors apart
        rows.append(
            {"bucket": bucket, "direct": direct, "anchors": _pack(step), "docs": _pack(doc[pick]), "checks": _pack(check[pick]),
             "places": _pack(at[pick].astype(np.int32)), "sizes": _pack(size[pick].astype(np.int32))}
        )

    # A known repeat sends two stretches of different documents to its bucket, so that others of its anchor are found.
    low = np.zeros(len(anchor), bool)
    low[start] = True
    other = np.flatnonzero(known & (doc != doc[start][group]))
    low[other[np.unique(group[other], return_index=True)[1]]] = True
    to_bucket = np.flatnonzero(~known | low)
    by = np.argsort(own[to_bucket], kind="stable")
    to_bucket = to_bucket[by]
    cut = np.searchsorted(own[to_bucket], np.arange(buckets + 1))
    for b in range(buckets):
        if cut[b + 1] > cut[b]:
            add(b, False, to_bucket[cut[b] : cut[b + 1]])
    spread = np.flatnonzero(known & ~low)
    for i in range(0, len(spread), 8192):
        add((turn + i // 8192) % buckets, True, spread[i : i + 8192])
    return rows


_SCHEMA = pa.schema([("bucket", pa.int32()), ("direct", pa.bool_()), *((n, pa.binary()) for n in PACKED_NAMES[2:])])
STRETCHES = "doc long, check long, anchor int, at int, size int"


def repeated_stretches(rows: DataFrame, buckets: int) -> DataFrame:
    """Stretches whose anchor occurs in more than one document. ``rows``: doc, check, text."""

    def pack(batches):
        held, kept, turn = 0, [], 0
        for whole in batches:
            for batch in steps(whole):
                data, offsets = text_bytes(batch.column("text"))
                anchor, owner, at, size = stretches(data, offsets)
                kept.append((anchor, np.asarray(batch.column("doc"))[owner], np.asarray(batch.column("check"))[owner], at, size))
                held += len(data)
                if held >= PACK_BYTES:
                    parts = [np.concatenate(x) for x in zip(*kept)]
                    turn += int(parts[1][0]) + 1 if len(parts[1]) else 1
                    held, kept = 0, []
                    if len(parts[0]):
                        yield pa.RecordBatch.from_pylist(_packed_rows(*parts, buckets, turn), schema=_SCHEMA)
        if kept:
            parts = [np.concatenate(x) for x in zip(*kept)]
            if len(parts[0]):
                yield pa.RecordBatch.from_pylist(_packed_rows(*parts, buckets, turn + 7), schema=_SCHEMA)

    def meet(batches):
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                part = [np.cumsum(_unpack(row["anchors"], np.uint64), dtype=np.uint64)]
                part += [_unpack(row["docs"], np.int64), _unpack(row["checks"], np.int64)]
                part += [_unpack(row["places"], np.int32), _unpack(row["sizes"], np.int32)]
                if row["direct"]:
                    yield _stretch_batch(*part)
                else:
                    held.append(part)
        if not held:
            return
        anchor, doc, check, at, size = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(anchor, kind="stable")
        ordered, own = anchor[order], doc[order]
        start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        differs = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
        pick = order[np.repeat(differs, np.diff(np.append(start, len(ordered))))]
        for i in range(0, len(pick), 50_000):
            p = pick[i : i + 50_000]
            yield _stretch_batch(anchor[p], doc[p], check[p], at[p], size[p])

    packed = rows.mapInArrow(pack, PACKED).repartitionById(buckets, F.col("bucket"))
    return packed.mapInArrow(meet, STRETCHES)


def _stretch_batch(anchor, doc, check, at, size) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(doc), pa.array(check), pa.array((anchor >> np.uint64(8)).astype(np.uint32).view(np.int32)), pa.array(at), pa.array(size)],
        names=["doc", "check", "anchor", "at", "size"],
    )


# -- transforms ------------------------------------------------------------------------


def _stable_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of fewer than 2 ** 32 numbers below 2 ** 32, and the sorted numbers: each is sorted with its place behind it."""
    both = ids.astype(np.uint64) << np.uint64(32)
    both |= np.arange(len(ids), dtype=np.uint64)
    both.sort()
    return (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.uint32)


def _by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts 64-bit hashes, and the sorted hashes.

    Hashes are sorted with their places in place of their lowest bits; runs that only these bits tell apart are sorted again.
    """
    bits = np.uint64(max(len(key) - 1, 1).bit_length())
    both = key >> bits << bits
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ranked = key[order]
    both >>= bits
    new = np.append(True, both[1:] != both[:-1])[: len(key)]
    mixed = np.flatnonzero((ranked[1:] != ranked[:-1]) & ~new[1:])
    if len(mixed):
        run = np.cumsum(new) - 1
        often = np.zeros(run[-1] + 1, bool)
        often[run[mixed]] = True
        again = np.flatnonzero(often[run])
        order[again] = order[again][np.argsort(ranked[again])]
        ranked = key[order]
    return order, ranked


def _keys(data: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """64-bit hash of the ``length`` bytes from each position on; at the end it runs into zeros."""
    wide = np.append(data, np.zeros(length, np.uint8))
    p, h, size, total, done = np.uint64(0xD6E8FEB86659FD93), mix(np.arange(seed, seed + 256, dtype=np.uint64))[wide], 1, None, 0
    with np.errstate(over="ignore"):
        while size <= length:  # h covers ``size`` bytes; length is put together from its binary digits
            if length & size:
                part = h[done:][: len(data)]
                total, done = (part if total is None else total[: len(part)] * p + part), done + size
            h, p, size = h[:-size] * p + h[size:], p * p, size * 2
        return mix(total)


def symbols(data: np.ndarray) -> np.ndarray:
    """A number for the SYMBOL bytes from each position on, by rank of a 64-bit hash of them.

    At the end of a string it runs into the next one; no window begins there.
    """
    key = _keys(data, SYMBOL)
    order, ranked = _by_key(key)
    ids = np.empty(len(key), np.uint32)
    ids[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1]), dtype=np.uint32)
    return ids


def transform(ids: np.ndarray, later: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of one shard to LENGTH bytes, and its transform: the symbol before each suffix.

    ``later`` and ``before`` name the place SYMBOL bytes on and back, in the same string and around its ends.
    """
    labels = [ids]
    while len(labels) < LENGTH // SYMBOL:
        labels.append(labels[-1][later])
    order = _stable_order(labels.pop())[0]
    while labels:  # last symbol first, each pass stable
        order = order[_stable_order(labels.pop()[order])[0]]
    return order, ids[before[order]]


def merge(shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the transforms of shards.

    Returns the shard of each suffix in merged order, and whether an interval of LENGTH equal bytes begins there. Round r
    orders the interleaving to r * SYMBOL bytes; an interval breaks between suffixes whose common prefix ends in the round.
    """
    which = np.repeat(np.arange(len(shards), dtype=np.min_scalar_type(len(shards))), [len(s) for s in shards])
    own = symbol = np.concatenate(shards)  # shard after shard, which is the first interleaving
    breaks = interval = None
    for _ in range(LENGTH // SYMBOL):
        if interval is not None:
            interval = np.cumsum(breaks, dtype=np.int32)
            symbol = np.empty(len(which), np.uint32)
            symbol[np.argsort(which, kind="stable")] = own  # places of each shard's suffixes, in its own order
        order, symbol = _stable_order(symbol)
        which = which[order]
        breaks = np.append(True, symbol[1:] != symbol[:-1])
        if interval is not None:
            interval = interval[order]
            breaks[1:] |= interval[1:] != interval[:-1]
        else:
            interval = breaks
    return which, breaks if len(which) else np.zeros(0, bool)


def smallest_docs(data: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window of each string, the smallest document that has the same LENGTH bytes in any of the strings.

    Strings stand one after another between ``bounds``; the windows of all strings are returned one after another.
    """
    ids = symbols(data)
    orders, transforms, size = [], [], np.diff(bounds)
    doc_of = np.repeat(docs, size)
    left = np.repeat(bounds[1:], size) - np.arange(len(data))  # bytes from here to the string's end
    later, before = np.arange(len(data)) + SYMBOL, np.arange(len(data)) - SYMBOL
    later -= np.where(left <= SYMBOL, np.repeat(size, size), 0)
    before[later] = np.arange(len(data))
    first = 0
    while first < len(docs):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SHARD_BYTES, side="right")) - 1)
        a, b = bounds[first], bounds[last]
        order, own = transform(ids[a:b], later[a:b] - a, before[a:b] - a)
        orders.append(order + a)
        transforms.append(own)
        first = last
    which, breaks = merge(transforms)
    suffix = np.empty(len(which), np.int64)
    suffix[np.argsort(which, kind="stable")] = np.concatenate(orders)
    # Suffixes that are no window (they run over the end of their string) count for nothing.
    own = np.where(left >= LENGTH, doc_of, np.iinfo(np.int64).max)[suffix]
    at = np.flatnonzero(breaks)
    least = np.empty(len(data), np.int64)
    least[suffix] = np.repeat(np.minimum.reduceat(own, at), np.diff(np.append(at, len(own))))
    return least[left >= LENGTH]


# -- windows of frequent anchors -------------------------------------------------------


def windows_met(parts: DataFrame) -> DataFrame:
    """(high, low, least): for each window of each stretch, the smallest document that has it. ``parts``: doc, part.

    Every window goes its own way by its hash, so no task holds more for a passage that many documents share.
    """

    def named(batches):
        for whole in batches:
            for batch in steps(whole, "part"):
                data, bounds = text_bytes(batch.column("part"))
                size, high, low = digests(data, bounds[:-1])
                yield pa.record_batch(
                    [pa.array(high), pa.array(low), pa.array((size - LENGTH + 1).astype(np.int32)), batch.column("doc"), batch.column("part")],
                    names=["high", "low", "size", "doc", "part"],
                )

    def deal(batches):
        for whole in batches:
            for batch in steps(whole, "part"):
                data, bounds = text_bytes(batch.column("part"))
                size = np.diff(bounds) - LENGTH + 1
                row = np.repeat(np.arange(batch.num_rows), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                first, second = (_keys(data, LENGTH, seed)[bounds[row] + at].view(np.int64) for seed in (1, 1001))
                for i in range(0, len(row), 50_000):
                    j = slice(i, i + 50_000)
                    own = batch.select(["high", "low", "doc"]).take(pa.array(row[j]))
                    yield pa.record_batch(
                        [pa.array(first[j]), pa.array(second[j]), *own.columns, pa.array(at[j].astype(np.int32))],
                        names=["first", "second", "high", "low", "doc", "at"],
                    )

    def fill(batches):
        for batch in batches:
            size, doc, found = np.asarray(batch.column("size")).astype(np.int64), np.asarray(batch.column("doc")), batch.column("found")
            start = np.append(0, np.cumsum(size))
            least = np.repeat(doc, size)
            counts = np.asarray(found.value_lengths().fill_null(0))
            at, other = (np.asarray(found.flatten().field(i)) for i in range(2))
            least[np.repeat(start[:-1], counts) + at] = other
            blobs = [least[a:b].tobytes() for a, b in zip(start[:-1], start[1:])]
            yield pa.record_batch([batch.column("high"), batch.column("low"), pa.array(blobs, pa.binary())], names=["high", "low", "least"])

    kept = staged(parts.select("doc", "part").mapInArrow(named, "high long, low long, size int, doc long, part binary"), "frequent")
    dealt = kept.select("high", "low", "doc", "part").mapInArrow(deal, "first long, second long, high long, low long, doc long, at int")
    # Each step is written, so that its shuffle files go before those of the next one come.
    shared = dealt.groupBy("first", "second").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    shared = staged(shared, "shared")
    found = dealt.join(shared, ["first", "second"]).where("least < doc")
    found = staged(found.groupBy("high", "low").agg(F.collect_list(F.struct("at", "least")).alias("found")), "met")
    removed(shared)
    whole = kept.select("high", "low", "size", "doc").join(found, ["high", "low"], "left")
    filled = staged(whole.mapInArrow(fill, "high long, low long, least binary"), "filled")
    removed(kept, found)
    return filled


# -- operator --------------------------------------------------------------------------


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc, check, spans): packed byte stretches to remove of each document. ``docs``: doc, check, text."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    repeated = staged(repeated_stretches(docs, buckets), "repeated")  # so that packed anchors go before texts are shuffled
    found = repeated.groupBy("doc").agg(F.collect_list(F.struct("check", "anchor", "at", "size")).alias("own"))

    def take(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            own = batch.column("own")
            counts = np.diff(np.asarray(own.offsets))
            check, anchor, at, size = (np.asarray(own.flatten().field(i)) for i in range(4))
            row = np.repeat(np.arange(batch.num_rows), counts)
            good = check == np.asarray(batch.column("check"))[row]  # else of another text with this doc_id
            row, anchor, at, size = row[good], anchor[good], at[good], size[good]
            for i in range(0, len(row), 50_000):
                r, a, n = row[i : i + 50_000], at[i : i + 50_000], size[i : i + 50_000]
                bounds = np.append(0, np.cumsum(n + LENGTH - 1))
                whole = np.repeat(offsets[r] + a - bounds[:-1], n + LENGTH - 1) + np.arange(bounds[-1])
                part = data[whole]
                high, low = digests(part, bounds[:-1])[1:]
                parts = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(part)])
                docs_ = batch.column("doc").take(pa.array(r)), batch.column("check").take(pa.array(r))
                yield pa.record_batch(
                    [pa.array(high), pa.array(low), pa.array(anchor[i : i + 50_000]), *docs_, pa.array(a), pa.array(n), parts],
                    names=["high", "low", "anchor", "doc", "check", "at", "size", "part"],
                )

    names = "high long, low long, anchor int, doc long, check long, at int, size int, part binary"
    texts = staged(docs.join(found, "doc").select("doc", "check", "text", "own").mapInArrow(take, names), "stretches")
    removed(repeated)
    held = F.sum(F.col("size").cast("long") + (LENGTH - 1)).alias("held")
    whole = texts.agg(held).first().held or 0
    frequent = staged(texts.groupBy("anchor").agg(held).where(F.col("held") > HOT_BYTES).select("anchor"), "anchors")
    some = not frequent.isEmpty()
    rest = texts.join(frequent, "anchor", "left_anti") if some else texts
    def refine(batches):
        rows = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.concat_tables(rows)
        table = table.set_column(table.column_names.index("part"), "part", table.column("part").cast(pa.large_binary())).combine_chunks()
        data, bounds = text_bytes(table.column("part").chunk(0))
        least = smallest_docs(data, bounds, table.column("doc").to_numpy())
        high, low = digests(data, bounds[:-1])[1:]
        windows = np.append(0, np.cumsum(np.diff(bounds) - LENGTH + 1))
        for i in range(0, table.num_rows, 20_000):
            j = min(i + 20_000, table.num_rows)
            ends = ((windows[i : j + 1] - windows[i]) * 8).astype(np.int32)
            own = np.ascontiguousarray(least[windows[i] : windows[j]])
            blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(own)])
            yield pa.record_batch([pa.array(high[i:j]), pa.array(low[i:j]), blobs], names=["high", "low", "least"])

    merged = max(buckets, -(-whole // BUCKET_BYTES))
    # Equal stretches have equal anchors, so those of a bucket are told apart where they are merged, after one shuffle.
    dealt = rest.select("anchor", "part", "doc").repartition(merged, "anchor")
    distinct = dealt.groupBy("anchor", "part").agg(F.min("doc").alias("doc"))
    least = [staged(distinct.mapInArrow(refine, "high long, low long, least binary"), "merged")]
    if some:
        often = texts.join(frequent, "anchor", "left_semi").groupBy("anchor", "part").agg(F.min("doc").alias("doc"))
        least.append(windows_met(often))
    known = least[0] if len(least) == 1 else least[0].unionByName(least[1])

    def hit(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column("least"))
            least, count = np.frombuffer(data.tobytes(), "<i8"), np.diff(bounds) // 8
            row = np.repeat(np.arange(batch.num_rows), count)
            doc, place = np.asarray(batch.column("doc")), np.asarray(batch.column("at")).astype(np.int64)
            covered = np.flatnonzero(least < doc[row])
            row = row[covered]
            at = covered - (bounds[:-1] // 8)[row] + place[row]
            # windows closer than their length overlap: one span
            new = np.append(True, (row[1:] != row[:-1]) | (np.diff(at) > LENGTH)) if len(at) else np.zeros(0, bool)
            last = np.append(new[1:], True) if len(at) else new
            yield pa.record_batch(
                [pa.array(doc[row[new]]), batch.column("check").take(pa.array(row[new])), pa.array(at[new].astype(np.int32)),
                 pa.array((at[last] + LENGTH).astype(np.int32))],
                names=["doc", "check", "begin", "end"],
            )

    spans = texts.select("high", "low", "doc", "check", "at").join(known, ["high", "low"]).select("doc", "check", "at", "least")
    spans = spans.mapInArrow(hit, "doc long, check long, begin int, end int")
    spans = staged(spans.groupBy("doc", "check").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans")), "spans")
    removed(texts, frequent, *least)
    return spans


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of the bytes without the sorted, perhaps overlapping spans, and how many maximal runs went."""
    out, at, runs, end = [], 0, 0, -1
    for a, b in spans:
        if a > end:
            out.append(data[at:a])
            runs += 1
            end = b
        end = max(end, b)
        at = end
    return b"".join([*out, data[at:]]), runs


def clean(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    rows = texts_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    rows = _with_check(rows.withColumnRenamed("doc_id", "doc"))
    spans = repeated_bytes(rows.where("doc is not null"))
    joined = rows.join(spans, ["doc", "check"], "left")

    def cut(batches):
        for batch in batches:
            found = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans"))):
                data = text.encode()
                kept, runs = kept_bytes(data, [(s["begin"], s["end"]) for s in spans or []])
                found.append((doc, len(data), len(data) - len(kept), runs, kept))
                if sum(len(f[4]) for f in found) > PACK_BYTES if len(found) % 64 == 0 else False:
                    yield _kept_batch(found)
                    found = []
            yield _kept_batch(found)

    return joined.select("doc", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _with_check(rows: DataFrame) -> DataFrame:
    """Add ``check``: the hash of the text where rows of one doc_id differ in their texts, else 0 (which packs to nothing)."""
    own = F.xxhash64("text")
    differ = rows.groupBy("doc").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high and doc is not null")
    differ = staged(differ.select("doc", F.lit(True).alias("differs")), "differ")
    if differ.isEmpty():
        return rows.withColumn("check", F.lit(0).cast("long"))
    return rows.join(differ, "doc", "left").withColumn("check", F.when(F.col("differs"), own).otherwise(F.lit(0).cast("long"))).drop("differs")


def _kept_batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    columns = list(zip(*found)) or [()] * 5
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def op10_suffix(spark, folder: str) -> DataFrame:
    found = clean(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
