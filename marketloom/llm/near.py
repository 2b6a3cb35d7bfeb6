"""Operator 7: near-duplicate classes by BagMinHash signatures of multisets of word shingles.

The similarity of two texts is the multiset (weighted) Jaccard overlap of their runs of five words. A signature has M
values. Each shingle runs Poisson processes over its discretised weight range: one for the stretch (0, 1], one for (1, 2],
then (2, 4], (4, 8] and so on; the last stretch is split by halves down to the weight, which keeps the points that fall
below it. A point lowers one value of the signature, and a process stops when it is later than the largest value. Two
signatures agree in a value with the probability of the similarity, without bias.

Texts of equal shingle multisets are one from the start, and named by their digest (``same``) from then on. Texts that agree
in a band of values meet in a bucket; buckets of the same members are one. Within a bucket every text is compared with one
hub; those outside the largest class that results are compared with all members of other classes, so that no link between
two texts of a bucket is lost. For that they send 32 bits of each shingle, by which two texts share no less than they do in
truth. Of the pairs that reach the threshold so, those that join the classes of a bucket are read and compared; if one of
them does not hold, all others between classes that are still apart follow. Every link is verified by the exact overlap.

Defined results: a text without words (or null) is in a class of its own; a text of fewer than five words is one shingle;
repeated rows share their class; rows that share a doc_id and differ in their texts are classed each by its text; a null
doc_id has a null class; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import mix, removed, shingle_hashes, staged, steps, text_bytes, texts_of, word_hashes

WORDS = 5
SIMILAR = 0.8
#: 24 bands of 5 values: a pair of similarity 0.8 is missed with a chance of 7e-5.
BANDS, ROWS = 24, 5
STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, times) of the different shingles of each text, sorted."""
    words, text, _, _ = word_hashes(*text_bytes(batch.column("text")))
    shingles, owner = shingle_hashes(words, text, k)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    if not len(order):
        return owner, shingles, owner
    new = np.append(True, (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    return owner[first], shingles[first], np.diff(np.append(first, len(order)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures of n bags: element ``element`` of bag ``owner`` has weight ``weight`` (1, 2, ...)."""
    levels = np.ones(len(weight), np.int64)
    levels[weight > 1] += np.ceil(np.log2(weight[weight > 1])).astype(np.int64)
    which = np.repeat(np.arange(len(weight)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    size = np.where(level > 1, 1 << np.maximum(level - 1, 0), 1)  # stretch of the level, and its rate
    low = np.where(level > 0, size, 0)
    low[level == 1] = 1
    bag, most = owner[which], weight[which]
    with np.errstate(over="ignore"):
        key = mix(element[which] + (level.astype(np.uint64) + np.uint64(1)) * STEP)
        values = np.full((n, m), np.inf)
        highest = np.full(n, np.inf)
        time, turn = np.zeros(len(which)), 0
        while len(bag):
            turn += 1
            r = mix(key + np.uint64(turn) * STEP)
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / size
            r = mix(r ^ STEP)
            slot = ((r >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            # The halves of the stretch that lead to the point, as the leading bits of a fraction.
            unit = low + ((r & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * size).astype(np.int64) + 1
            lower = (unit <= most) & (time < highest[bag])
            np.minimum.at(values.reshape(-1), bag[lower] * m + slot[lower], time[lower])
            touched = np.unique(bag)
            highest[touched] = values[touched].max(axis=1)
            on = time < highest[bag]
            bag, key, time, size, low, most = bag[on], key[on], time[on], size[on], low[on], most[on]
    return values


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = values.reshape(len(values), bands, rows).view(np.uint64)
    with np.errstate(over="ignore"):
        total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * STEP, (len(values), bands)).copy()
        for j in range(rows):
            total = mix(total * np.uint64(31) + bits[:, :, j])
    return total.view(np.int64)


def tokens_of(owner: np.ndarray, element: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: the i-th occurrence of a shingle is an element of its own. (text index, element)"""
    which = np.repeat(np.arange(len(times)), times)
    nth = (np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return owner[which], mix(element[which] + nth * STEP)


def _same(element: np.ndarray, times: np.ndarray, bound: np.ndarray) -> list[bytes | None]:
    """Digest of each multiset, None for an empty one."""
    return [
        hashlib.blake2b(element[a:b].tobytes() + times[a:b].tobytes(), digest_size=16).digest() if b > a else None
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())
    ]


def _marks(owner: np.ndarray, element: np.ndarray, times: np.ndarray, n: int) -> list[bytes]:
    """The upper 32 bits of each shingle of each text, its repetitions apart."""
    text, token = tokens_of(owner, element, times)
    marks, bound = (token >> np.uint64(32)).astype("<u4"), np.searchsorted(text, np.arange(n + 1)).tolist()
    return [np.sort(marks[a:b]).tobytes() for a, b in zip(bound[:-1], bound[1:])]


def prints(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, same, marks, bands): ``same`` is equal for texts of equal shingle multisets, null for a text without words;
    ``marks`` are 32 bits of each shingle."""

    def scan(batches):
        for whole in batches:
            for batch in steps(whole):
                owner, element, times = bags(batch, k)
                n = batch.num_rows
                keys = band_keys(signatures(owner, element, times, n, bands * rows), bands, rows)
                same = _same(element, times, np.searchsorted(owner, np.arange(n + 1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(same, pa.binary()), pa.array(_marks(owner, element, times, n), pa.binary()), lists],
                    names=["doc_id", "same", "marks", "bands"],
                )

    return texts_of(docs, "doc_id").mapInArrow(scan, "doc_id long, same binary, marks binary, bands array<long>")


def token_sets(docs: DataFrame, k: int) -> DataFrame:
    """(same, tokens): the shingle multiset of each text that has words, as a set of 64-bit hashes."""

    def scan(batches):
        for whole in batches:
            for batch in steps(whole):
                owner, element, times = bags(batch, k)
                same = _same(element, times, np.searchsorted(owner, np.arange(batch.num_rows + 1)))
                owner, token = tokens_of(owner, element, times)
                bound = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(token.view(np.int64)))
                yield pa.record_batch([pa.array(same, pa.binary()), lists], names=["same", "tokens"])

    return texts_of(docs, "doc_id").mapInArrow(scan, "same binary, tokens array<long>").where("same is not null")


def similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, k: int, similar: float) -> DataFrame:
    """The pairs (a, b) of texts whose multiset overlap reaches ``similar``; only texts of the pairs are made into sets."""
    asked = staged(pairs.select(F.explode(F.array("a", "b")).alias("same")).distinct(), "asked")
    # Written, so that Spark knows its size: where the ids are too many to be sent to the scan, only texts that may be asked
    # for are shuffled.
    ids = staged(first.join(asked, "same").select(F.col("doc").alias("doc_id")).distinct(), "ids")
    # Written, so that no task needs the filter's Python worker beside that of the sets.
    texts = staged(mostly(docs.select("doc_id", "text"), ids, "doc_id").join(ids, "doc_id", "left_semi"), "texts")
    # A doc_id may bring other texts as well.
    sets = token_sets(texts, k).dropDuplicates(["same"])
    sets = staged(sets.join(asked, "same", "left_semi"), "tokens")
    removed(texts)
    left = sets.select(F.col("same").alias("a"), F.col("tokens").alias("of_a"))
    right = sets.select(F.col("same").alias("b"), F.col("tokens").alias("of_b"))
    found = staged(pairs.join(right, "b").join(left, "a").where(similarity(F.col("of_a"), F.col("of_b")) >= similar).select("a", "b"), "verified")
    removed(asked, ids, sets)
    return found


def _classed(docs: DataFrame, k: int, similar: float, bands: int, rows: int) -> DataFrame:
    """Per row of ``docs``: doc_id, same, class_id, and ``head``, the digest of the text that stands for its class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = staged(prints(docs, k, bands, rows), "prints")
    known = found.where("doc_id is not null and same is not null")
    # A text's bands follow from its digest, so any of its rows has them.
    heads = staged(known.groupBy("same").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands")), "same")
    first = heads.select("same", "doc")
    met = staged(heads.select(F.explode(F.array_distinct("bands")).alias("key"), "same"), "met")
    # Copies of one text meet in the same company in most bands; one bucket of equal members is enough.
    members = (F.bit_xor(F.xxhash64("same")), F.bit_xor(F.xxhash64(F.lit(1), "same")))
    full = met.groupBy("key").agg(F.min("same").alias("hub"), F.count("*").alias("n"), members[0].alias("x"), members[1].alias("y")).where("n > 1")
    full = full.groupBy("hub", "n", "x", "y").agg(F.min("key").alias("key")).select("key", "hub")
    members = staged(met.join(full, "key").select("key", "same", "hub"), "buckets")
    removed(met)

    pairs = staged(members.where("same <> hub").select(F.col("hub").alias("a"), F.col("same").alias("b")).distinct(), "pairs")
    links = verified(pairs, first, docs, k, similar)
    comp = components(links)
    removed(pairs)
    # Links that join the classes of a bucket are enough if all of them hold; only if one does not are all the others tried.
    for forest in (True, False):
        left = staged(_open_buckets(members, comp), "open")
        tried = held = 0
        if not left.isEmpty():
            near = staged(may_link(left, known.select("same", "marks"), similar, forest), "near")
            more = verified(near, first, docs, k, similar)
            tried, held = near.count(), more.count()
            if held:
                links = links.unionByName(more)
                comp = components(links)
            removed(near)
        removed(left)
        if tried == held:
            break
    removed(members)

    one = first.join(comp.select(F.col("doc").alias("same"), "comp"), "same", "left").select("same", "doc", F.coalesce("comp", "same").alias("comp"))
    own = one.groupBy("comp").agg(F.min(F.struct("doc", "same")).alias("head"))
    named = one.join(own, "comp").select("same", F.col("head.doc").alias("class_id"), F.col("head.same").alias("head"))
    # Rows without words meet nothing, so they stay out of the join.
    alone = found.where("same is null").select("doc_id", "same", F.col("doc_id").alias("class_id"), F.col("same").alias("head"))
    rest = found.where("same is not null").select("doc_id", "same").join(named, "same", "left")
    classed = F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")
    return rest.select("doc_id", "same", classed, "head").unionByName(alone)


def classes(docs: DataFrame, k: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class)."""
    return _classed(docs, k, similar, bands, rows).select("doc_id", "class_id")


def _open_buckets(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, same, comp, top): the members of buckets that hold more than one class, and the bucket's largest class."""
    now = members.join(comp.withColumnRenamed("doc", "same"), "same", "left").select("key", "same", F.coalesce("comp", "same").alias("comp"))
    sizes = now.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("classes"))
    return now.join(largest.where("classes > 1"), "key").select("key", "same", "comp", F.col("top.comp").alias("top"))


#: Bits of a filter, 1 MB however many keys there are.
FILTER_BITS = 1 << 23


def may_hold(asked: DataFrame, name: str):
    """A test of columns that is true for every value of ``asked``'s column ``name``, and for a few others.

    Two bits per key; the driver and the tasks hold FILTER_BITS of them, and more keys only let more other values pass.
    """

    def places(column: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), column), F.lit(FILTER_BITS)) for i in range(2)]

    # Words of 32,768 bits, whose numbers and places begin with 1; there are at most FILTER_BITS / 32,768 of them.
    bit = asked.select(F.explode(F.array(*(p + 1 for p in places(F.col(name))))).alias("bit"))
    words = bit.groupBy(F.expr("bitmap_bucket_number(bit)").alias("word")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    table = np.zeros(FILTER_BITS, bool)
    for word, bits in words.collect():
        table[(word - 1) << 15 : word << 15] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    table = np.packbits(table, bitorder="little")

    @F.pandas_udf("boolean")
    def may_be(first: pd.Series, second: pd.Series) -> pd.Series:
        a, b = first.to_numpy(), second.to_numpy()
        return pd.Series(((table[a >> 3] >> (a & 7)) & (table[b >> 3] >> (b & 7)) & 1).astype(bool))

    return lambda column: may_be(*places(column))


def mostly(rows: DataFrame, asked: DataFrame, name: str = "same") -> DataFrame:
    """The rows whose ``name`` is in ``asked``, and a few others: most rows that a join would drop go before its shuffle."""
    return rows.where(may_hold(asked, name)(F.col(name)))


def without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows whose ``name`` is not in ``gone``, of which few are shuffled: most are known not to be by the filter."""
    doubtful = may_hold(gone, name)(F.col(name))
    return rows.where(~doubtful).unionByName(rows.where(doubtful).join(gone, name, "left_anti"))


#: Documents outside the largest class, and bucket members, that one group compares.
ASKED, AGAINST = 128, 4096
#: Slack of a bound, so that rounding loses no pair that lies on the threshold.
ROUNDING = 1e-6


def may_link(left: DataFrame, marked: DataFrame, similar: float, forest: bool = False) -> DataFrame:
    """Pairs (a, b) of members of one bucket and different classes that reach ``similar`` by 32 bits of each shingle.

    With ``forest``, a group leaves out pairs whose classes its earlier pairs already join, so it gives fewer pairs than it
    has classes.

    Every member outside the largest class is set against all members of other classes. Both sides are cut into blocks, so
    that a group holds a bounded number of texts however large the bucket is, and only what may be a link leaves it. Two
    texts share no fewer marks than shingles. ``marked``: same, marks, with one or more rows per text.
    """
    asked = staged(left.select("same").distinct(), "asked")
    marked = mostly(marked, asked).join(asked, "same", "left_semi").groupBy("same").agg(F.max("marks").alias("marks"))
    outside = F.col("comp") != F.col("top")
    sizes = left.groupBy("key").agg(
        F.ceil(F.sum(outside.cast("long")) / ASKED).cast("int").alias("blocks"), F.ceil(F.count("*") / AGAINST).cast("int").alias("parts")
    )
    rows = left.join(sizes, "key").join(marked, "same")
    spread = F.xxhash64("same")
    ask = rows.where(outside).select(
        "key", F.pmod(spread, "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(True).alias("asks"), "same", "comp", "marks",
    )
    answer = rows.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(spread, "parts").cast("int").alias("part"),
        F.lit(False).alias("asks"), "same", "comp", "marks",
    )

    def compare(group):
        asks, comp, same = group.asks.to_numpy(), group.comp.to_numpy(), group.same.to_numpy()
        marks = [np.frombuffer(m, "<u4") for m in group.marks]
        size = np.array([len(m) for m in marks], np.int64)
        own, found = np.flatnonzero(asks), set()
        _, label = np.unique(comp, return_inverse=True)
        joined = list(range(int(label.max()) + 1))

        def top(x: int) -> int:
            while joined[x] != x:
                joined[x] = x = joined[joined[x]]
            return x

        if len(own):
            tokens, owner = np.concatenate([marks[i] for i in own]), np.repeat(np.arange(len(own)), size[own])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            for i in np.flatnonzero(~asks).tolist():
                low, high = np.searchsorted(tokens, marks[i], "left"), np.searchsorted(tokens, marks[i], "right")
                n = high - low
                hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                shared = np.bincount(owner[hit], minlength=len(own))
                good = (shared >= similar * (size[own] + size[i] - shared) - ROUNDING) & (comp[own] != comp[i])
                for j in own[good].tolist():
                    if forest:
                        x, y = top(label[i]), top(label[j])
                        if x == y:
                            continue
                        joined[x] = y
                    found.add((min(same[i], same[j]), max(same[i], same[j])))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype=object)

    groups = ask.unionByName(answer).groupBy("key", "block", "part")
    return groups.applyInPandas(compare, "a binary, b binary").distinct()


def keep_first(docs: DataFrame, k: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The documents that are the first of their class, each with all its columns; rows with a null doc_id stay.

    Rows of one doc_id and equal multisets are one document, of which the smallest row stays. Rows of one doc_id and
    different texts are decided each by its text.
    """
    named = staged(_classed(docs, k, similar, bands, rows), "classes")
    known = named.where("doc_id is not null")
    go = (F.col("doc_id") != F.col("class_id")) | ~F.col("same").eqNullSafe(F.col("head"))
    several = staged(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    gone = staged(known.where(go).select("doc_id").distinct(), "gone")
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*docs.columns).alias("_row"))
    gone, several = gone.withColumnRenamed("doc_id", "_id"), several.withColumnRenamed("doc_id", "_id")
    if several.isEmpty():
        return without(ids, gone, "_id").select("_row.*")
    alone = without(ids, gone.unionByName(several).distinct(), "_id").select("_row.*")
    heads = mostly(known.where(~go).select(F.col("doc_id").alias("_id"), F.col("same").alias("_head")), several, "_id").distinct()
    repeated = _with_same(staged(mostly(ids, several, "_id").join(several, "_id", "left_semi"), "repeated"), k)
    stays = repeated.join(heads.withColumnRenamed("_id", "_doc"), (F.col("_id") == F.col("_doc")) & F.col("_same").eqNullSafe(F.col("_head")), "left_semi")
    return alone.unionByName(stays.groupBy("_id", "_same").agg(F.min("_row").alias("_row")).select("_row.*"))


def _with_same(rows: DataFrame, k: int) -> DataFrame:
    """Add ``_same``, the digest of the text's multiset. ``rows``: _id, _row (with text)."""

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        batch = pa.record_batch([pa.array(texts.fillna(""), pa.string())], names=["text"])
        out = []
        for part in steps(batch):
            owner, element, times = bags(part, k)
            out += _same(element, times, np.searchsorted(owner, np.arange(part.num_rows + 1)))
        return pd.Series(out, dtype=object)

    return rows.withColumn("_same", digest(F.col("_row.text").cast("string")))


def op7_near(spark, folder: str) -> DataFrame:
    return classes(spark.read.parquet(f"{folder}/documents.parquet"))
