"""Matching of many OR-queries against texts, a block of queries and a part of the texts at a time.

Texts meet the queries of their source: a source's queries are cut into blocks, its texts into parts, and every part is
sent to every block. Only texts and queries are shuffled, never what they have in common. A term without white space
occurs in a text if it occurs in one of the text's words, so the terms of a word are looked up once, however many texts
hold it; a term with white space is looked for in the texts that hold its longest word. What is found leaves as one row
per query with the ids of a step's texts, and is taken apart where it is used.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import query_terms
from ..session import written

#: Bits of the number of terms of a block of queries.
BLOCK = 19
#: Bytes of a part's texts, and rows times queries that meet in one task: at most MOST, fewer if few meet in all, but not below LEAST.
PART_BYTES, LEAST, MOST = 32 << 20, 1 << 24, 1 << 30
#: Cells (term, row) that a step holds, cells (query, row) worked out at once, and bytes of texts read at once.
CELLS, SLICE, READ = 1 << 25, 1 << 20, 1 << 20
#: Words whose terms are kept, and the longest of them.
WORDS, LONGEST = 1 << 18, 64
#: Bits of a character, and characters of words looked up at once.
BITS, LOOK = 21, 1 << 20


def _chars(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of some texts, a space after each text, and their lengths."""
    return np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.array([len(t) for t in texts], np.int64)


class _Tree:
    """Terms without white space as a tree of characters, a level at a time: the numbers (node above, character), in order."""

    def __init__(self, terms: Sequence[str]) -> None:
        chars, sizes = _chars(terms)
        starts, node, self.levels, n = np.cumsum(sizes + 1) - sizes - 1, np.zeros(len(terms), np.int64), [], 1
        for depth in range(sizes.max(initial=0)):
            deep = np.flatnonzero(sizes > depth)
            keys, at = np.unique(node[deep] << BITS | chars[starts[deep] + depth], return_inverse=True)
            self.levels.append((keys, n))
            node[deep] = n + at
            n += len(keys)
        self.term = np.full(n, -1, np.int32)
        self.term[node] = np.arange(len(terms))
        self.term[0] = -1

    def held(self, words: Sequence[str]) -> Iterator[bytes]:
        """For each word the numbers of the terms that occur in it, some of them more than once."""
        chars, sizes = _chars(words)
        own, found = np.repeat(np.arange(len(words)), sizes + 1), [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for start in range(0, len(chars), LOOK):
            at = np.arange(start, min(start + LOOK, len(chars)))
            node = np.zeros(len(at), np.int64)
            for depth, (keys, first) in enumerate(self.levels):
                wanted = node << BITS | chars[at + depth]  # no term holds the space behind a word, so none goes beyond it
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                some = np.flatnonzero(keys[place] == wanted)
                at, node = at[some], place[some] + first
                if not len(at):
                    break
                term = self.term[node]
                ends = np.flatnonzero(term >= 0)
                found.append((own[at[ends]], term[ends]))
        word, term = (np.concatenate(x) for x in zip(*found))
        data = term[np.argsort(word, kind="stable")].tobytes()
        ends = [0, *(np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()]
        return (data[a:b] for a, b in zip(ends, ends[1:]))


class _Block:
    """Queries of a block, the rows that they have met, and how terms are found in a text."""

    def __init__(self, queries: pa.Table, id_type: pa.DataType, once: bool) -> None:
        queries = queries.take(pa.array(np.arange(len(queries)))).combine_chunks()  # a copy, or else it holds whole batches
        lists = queries.column("_terms").combine_chunks()
        terms = lists.flatten().dictionary_encode()
        self.named, self.id_type, self.once = queries.column("_named").combine_chunks(), id_type, once
        self.flat, self.ends = terms.indices.to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        names = terms.dictionary.to_pylist()
        self.n, self.spaced, self.blank = len(names), {}, []
        whole = {t: i for i, t in enumerate(names) if t.split() == [t]}
        numbers = list(whole.values())
        for i, t in enumerate(names):
            if t not in whole and (words := t.split()):
                if (word := max(words, key=len)) not in whole:
                    whole[word] = self.n + len(self.spaced)
                    numbers.append(whole[word])
                self.spaced.setdefault(whole[word], []).append((i, t))
            elif t not in whole:
                self.blank.append((i, t))
        self.tree, self.numbers = _Tree(list(whole)), np.array(numbers, np.int32)
        self.near = np.isin(np.arange(self.n + len(self.spaced)), list(self.spaced))
        self.words: dict[str, bytes] = {}
        self.width = 1 << min(11, max(6, (CELLS // self.n).bit_length() - 1))
        self.cells = np.zeros((self.n, self.width), np.uint8)
        self.row_ids: list = []
        self.times: list[int] = []

    def see(self, row_ids: list, texts: list[list[str]]) -> Iterator[pa.RecordBatch]:
        """Take in rows; those of one id, which follow one another, count as one that comes several times."""
        words = [set().union(*[t.split() for t in own]) for own in texts]
        new = set().union(*words).difference(self.words)
        if len(self.words) + len(new) > WORDS:
            self.words, new = {}, set().union(*words)
        self.words.update(zip(new, self.tree.held(list(new))))
        for row_id, own, some in zip(row_ids, texts, words):
            if self.row_ids and self.row_ids[-1] == row_id:
                self.times[-1] += not self.once
            else:
                if len(self.row_ids) == self.width:
                    yield from self.met()
                self.row_ids.append(row_id)
                self.times.append(1)
            found = self.numbers[np.frombuffer(b"".join(map(self.words.__getitem__, some)), np.int32)]
            if self.spaced or self.blank:
                near = [x for i in {*found[self.near[found]].tolist()} for x in self.spaced[i]] + self.blank
                found = np.concatenate([found[found < self.n], np.array([i for i, t in near if any(t in x for x in own)], np.int32)])
            self.cells[found, len(self.row_ids) - 1] = 1
        for w in new:
            if len(w) > LONGEST:
                del self.words[w]

    def met(self) -> Iterator[pa.RecordBatch]:
        """Each query with the ids of the rows taken in since the last call that it matches."""
        row_ids, times, start = pa.array(self.row_ids, self.id_type), np.resize(np.array(self.times, np.int64), self.width), 0
        while start < len(self.ends) - 1:
            stop = max(start + 1, int(np.searchsorted(self.ends, self.ends[start] + SLICE // self.width, "right")) - 1)
            own = self.cells.view(np.uint64)[self.flat[self.ends[start] : self.ends[stop]]]
            hit = np.bitwise_or.reduceat(own, self.ends[start:stop] - self.ends[start], axis=0).view(bool)
            for i in range(max(self.times, default=0)):
                now = hit & (times > i) if i else hit
                sizes = np.count_nonzero(now, axis=1)
                if len(some := np.flatnonzero(sizes)):
                    at = row_ids.take(pa.array(np.flatnonzero(now) & (self.width - 1)))
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32), at)
                    yield pa.RecordBatch.from_arrays([self.named.take(pa.array(some + start)), lists], ["_named", "_ids"])
            start = stop
        self.cells[:] = 0
        self.row_ids, self.times = [], []


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of some READ bytes of texts."""
    lists = batch.column("_texts")
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False))])
    ends, start = sizes[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])], 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + READ, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _meet(once: bool):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, the queries of a group before its texts, and these by their id."""
        group, block, queries = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_no", "_block", "_part", "_is_row")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for start, stop in zip(cuts, cuts[1:]):
                *key, is_row = keys[:, start].tolist()
                if key != group:
                    if block is not None:
                        yield from block.met()
                    group, block, queries = key, None, []
                if not is_row:
                    queries.append(batch.slice(start, stop - start).select(["_named", "_terms"]))
                    continue
                if queries:
                    block, queries = _Block(pa.Table.from_batches(queries), batch.column("_id").type, once), []
                for step in _steps(batch.slice(start, stop - start)) if block is not None else ():
                    yield from block.see(step.column("_id").to_pylist(), step.column("_texts").to_pylist())
        if block is not None:
            yield from block.met()

    return meet


def _found(rows: DataFrame, queries: DataFrame, row_id: str, texts: Sequence[str], on: str, *, once: bool) -> DataFrame:
    """(row_id, ``queries`` without _terms) for every query of the same ``on`` that has one of its ``_terms`` in a text of a
    row: once per row, or with ``once`` once per id."""
    spark = rows.sparkSession
    lowered = F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in texts])
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0))
    own = rows.filter(F.col(row_id).isNotNull() & F.col(on).isNotNull())
    queries = written(queries.filter(F.col(on).isNotNull() & (F.size("_terms") > 0)).withColumn("_query", F.monotonically_increasing_id()), "queries")
    of_rows = own.groupBy(on).agg(F.count("*").alias("_rows"), F.sum(size).alias("_bytes"))
    of_queries = queries.groupBy(on).agg(F.count("*").alias("_queries"), F.ceil(F.sum(F.size("_terms")) / (1 << BLOCK)).alias("_blocks"))
    # Small, so written: Spark knows its size and need not shuffle the texts to meet it.
    sizes = written(of_rows.join(of_queries, on).withColumn("_no", F.monotonically_increasing_id()), "sizes")
    work = F.col("_rows").cast("double") * F.col("_queries")
    total, n_bytes = sizes.agg(F.coalesce(F.sum(work), F.lit(0.0)), F.coalesce(F.sum(F.col("_bytes") * F.col("_blocks")), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    most = min(MOST, max(LEAST, total / (8 * cores)))
    parts = F.greatest(F.lit(1), F.ceil(work / F.col("_blocks") / most), F.ceil(F.col("_bytes") / PART_BYTES))
    groups = sizes.select(on, "_no", "_blocks", parts.alias("_parts"))
    tasks = int(min(groups.agg(F.coalesce(F.sum(F.col("_blocks") * F.col("_parts")), F.lit(1))).first()[0], cores + 2 * (total / most + n_bytes / PART_BYTES)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("long")
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    named = F.struct(*[c for c in queries.columns if c not in ("_terms", "_query")])
    none = lambda c: F.lit(None).cast(c)
    kind = lambda df, c: df.select(c).schema[0].dataType
    id_type, name_type = rows.schema[row_id].dataType, kind(queries, named.alias("n"))
    sent = queries.join(groups, on).select(
        "_no", deal("_query", "_blocks").alias("_block"), copies("_parts").alias("_part"), F.lit(False).alias("_is_row"),
        none(id_type).alias("_id"), none("array<string>").alias("_texts"), named.alias("_named"), "_terms",
    ).unionByName(own.join(groups, on).select(
        "_no", copies("_blocks").alias("_block"), deal(row_id, "_parts").alias("_part"), F.lit(True).alias("_is_row"),
        F.col(row_id).alias("_id"), lowered.alias("_texts"), none(name_type).alias("_named"), none("array<string>").alias("_terms"),
    ))
    # Groups of one source go to tasks one after another.
    tasks = max(1, tasks)
    task = F.pmod(F.pmod(F.xxhash64("_no"), F.lit(tasks)) + F.col("_block") * 31 + F.col("_part"), F.lit(tasks)).cast("int")
    dealt = sent.repartitionById(tasks, task).sortWithinPartitions("_no", "_block", "_part", "_is_row", "_id")
    met = dealt.mapInArrow(_meet(once), T.StructType([T.StructField("_named", name_type), T.StructField("_ids", T.ArrayType(id_type))]))
    names = [c for c in queries.columns if c not in ("_terms", "_query")]
    return met.select(*[F.col("_named")[c].alias(c) for c in names], "_ids").select(F.explode("_ids").alias(row_id), *names)


def terms_of(queries: DataFrame, query: str = "query") -> DataFrame:
    """The different terms of OR-queries, lower-case; an empty term is in every text and stands for no word."""
    return queries.select(F.explode(query_terms(F.col(query))).alias("term")).filter("term <> ''").distinct()


def matches(rows: DataFrame, terms: DataFrame, row_id: str, texts: Sequence[str], *, on: str | None = None) -> DataFrame:
    """(row_id, term) for every term that occurs in one of the texts of a row, in any letter case.

    Ids must be unique. With ``on``, a column of both sides, only terms of the same ``on`` are looked for, and it is
    returned too.
    """
    if on is None:
        rows, terms = rows.withColumn("_on", F.lit(0)), terms.withColumn("_on", F.lit(0))
    by = on or "_on"
    own = terms.select("term", by).filter("term <> ''").distinct().withColumn("_terms", F.array("term"))
    found = _found(rows, own, row_id, texts, by, once=True)
    return found.select(row_id, "term") if on is None else found.select(row_id, on, "term")


def matching_pairs(
    rows: DataFrame, pairs: DataFrame, row_id: str, texts: Sequence[str], *, on: str, query: str = "query", whole: bool = True
) -> DataFrame:
    """Rows joined with the pairs of the same ``on`` whose query has a term in one of the row's texts, once per row and
    pair. Equals a join on ``on`` followed by ``filters.matching_query``, without a row per (row, pair). With ``whole`` off
    of the row's columns only its id and ``on`` are returned, and what is found is not shuffled to meet the others."""
    listed = F.filter(F.array_distinct(query_terms(F.col(query))), lambda t: t != "")
    found = _found(rows, pairs.withColumn("_terms", listed), row_id, texts, on, once=whole)
    rest = [c for c in pairs.columns if c != on]
    if not whole:
        return found.select(row_id, on, *rest)
    return rows.join(found, [row_id, on]).select(row_id, *[c for c in rows.columns if c != row_id], *rest)
