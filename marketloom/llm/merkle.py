"""Operator 11: Merkle manifest of a dataset, stored as aligned subtrees in van Emde Boas order.

Each row is a leaf. The leaves of a source, by ascending doc_id, form a tree of 16 children a node; the roots of the sources,
by source, form a tree of the same kind above them. A tree is cut into aligned blocks of three levels (4,096 leaves). A block
is one row of a table: its nodes lie in one byte string in van Emde Boas order, that is, the levels are split at half
height, the top part comes first and the bottom subtrees follow, each laid out in the same way. Nothing but the address
arithmetic of ``Layout`` finds a node, for building a block and for reading siblings alike. The roots of the blocks of a
tree are the leaves of the next blocks above, until one block is left, so no task holds more than one block, however large
a source is; texts are read in one scan and never shuffled.

Proofs go down the same tables: a block hands the siblings on the way from its leaf to the global root to the block below,
once per block, and the leaf blocks put their own in front.

Defined results: null columns count as ``-``; null doc_ids come first in their source, repeated doc_ids stand in the order
of their leaves (equal rows are equal leaves, each with a place and a proof of its own); the null source comes first; a row
without doc_id is never tampered with; other columns are dropped; an empty table gives no rows (and no root).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import positions, same
from .shared import removed, staged

ARITY = 16
#: Levels of a block above its leaves.
LEVELS = 3
#: Hash inputs of a leaf.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# -- leaves ----------------------------------------------------------------------------


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column, columns: tuple[str, ...] = COLUMNS) -> Column:
    """Digest of a row; ``text`` stands for its column of that name."""
    return F.unhex(F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in columns]), 256))


def tampered_text() -> Column:
    """Lower-cased A-Z where 5 divides the crc32 of the decimal doc_id, else null (the row is left as it is)."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, F.translate(F.col("text"), UPPER, LOWER))


# -- blocks ----------------------------------------------------------------------------


def run_digest(nodes: list[bytes]) -> bytes:
    return sha256("".join([n.hex() for n in nodes]).encode()).digest()


class Layout:
    """Addresses of a complete tree of ``levels`` + 1 rows of nodes in van Emde Boas order; depth 0 is the root."""

    def __init__(self, levels: int, arity: int = ARITY) -> None:
        self.levels, self.arity = levels, arity
        self.size = self.count(levels + 1)

    def count(self, rows: int) -> int:
        return (self.arity**rows - 1) // (self.arity - 1)

    def address(self, depth: int, index: np.ndarray, rows: int | None = None) -> np.ndarray:
        """Place of the nodes of one depth. A tree of ``rows`` rows is a top part of half of them, then its bottom trees."""
        rows = self.levels + 1 if rows is None else rows
        index = np.asarray(index, np.int64)
        if rows == 1:
            return index
        top = rows // 2
        if depth < top:
            return self.address(depth, index, top)
        below = self.arity ** (depth - top)
        return self.count(top) + index // below * self.count(rows - top) + self.address(depth - top, index % below, rows - top)

    @lru_cache(maxsize=None)
    def row(self, depth: int) -> np.ndarray:
        return self.address(depth, np.arange(self.arity**depth))


@lru_cache(maxsize=None)
def layout(levels: int, arity: int = ARITY) -> Layout:
    return Layout(levels, arity)


def levels_of(total: int, arity: int = ARITY, levels: int = LEVELS) -> int:
    """Levels of the blocks of a tree (or what is left of it) of ``total`` leaves."""
    height = 0
    while arity**height < total and height < levels:
        height += 1
    return height


class Block:
    """Nodes of an aligned subtree of n leaves, in van Emde Boas order."""

    def __init__(self, n: int, levels: int, arity: int, nodes: bytes | None = None) -> None:
        self.layout, self.levels, self.arity = layout(levels, arity), levels, arity
        self.widths = [n]  # nodes of each depth, leaves first
        for _ in range(levels):
            self.widths.append(-(-self.widths[-1] // arity))
        self.widths.reverse()
        self.nodes = np.zeros((self.layout.size, 32), np.uint8) if nodes is None else np.frombuffer(nodes, np.uint8).reshape(-1, 32)

    @classmethod
    def of_leaves(cls, leaves: list[bytes], levels: int, arity: int) -> Block:
        block = cls(len(leaves), levels, arity)
        block.nodes[block.layout.row(levels)[: len(leaves)]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
        for depth in range(levels - 1, -1, -1):
            for i in range(block.widths[depth]):
                block.nodes[block.layout.row(depth)[i]] = np.frombuffer(run_digest(block.run(depth + 1, i)), np.uint8)
        return block

    def run(self, depth: int, parent: int) -> list[bytes]:
        """The children, at ``depth``, of a node of the depth above."""
        low, high = parent * self.arity, min((parent + 1) * self.arity, self.widths[depth])
        return [self.nodes[a].tobytes() for a in self.layout.row(depth)[low:high]]

    def way(self, leaf: int) -> list[tuple[int, list[bytes]]]:
        """(place in its run, siblings) of each node from a leaf up to the block's root."""
        out = []
        for depth in range(self.levels, 0, -1):
            run, own = self.run(depth, leaf // self.arity), leaf % self.arity
            out.append((own, run[:own] + run[own + 1 :]))
            leaf //= self.arity
        return out

    @property
    def root(self) -> bytes:
        return self.nodes[0].tobytes()


def folded(node: bytes, way: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a node and its siblings lead to."""
    for place, siblings in way:
        node = run_digest([*siblings[:place], node, *siblings[place:]])
    return node


def _pack_way(way: list[tuple[int, list[bytes]]]) -> bytes:
    """Per level: the place, the number of siblings, the siblings."""
    return b"".join(bytes((place, len(siblings))) + b"".join(siblings) for place, siblings in way)


def _unpack_way(data: bytes) -> list[tuple[int, list[bytes]]]:
    way, at = [], 0
    while at < len(data):
        place, n = data[at], data[at + 1]
        way.append((place, [data[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]))
        at += 2 + 32 * n
    return way


BLOCKS = "tree string, block long, total long, levels int, n int, root binary, nodes binary"
LEAF_BLOCKS = f"{BLOCKS}, ids array<long>, tampered array<binary>"


def _blocks(nodes: DataFrame, arity: int, levels: int, ids: bool = False) -> DataFrame:
    """One row per aligned block. ``nodes``: tree, position, total (leaves of the tree), digest (and doc_id, tampered)."""
    names = [x.split()[0] for x in (LEAF_BLOCKS if ids else BLOCKS).split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]

    def build(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = sorted(row["own"], key=lambda x: x["position"])
                height = levels_of(row["total"], arity, levels)
                block = Block.of_leaves([x["digest"] for x in own], height, arity)
                out.append([row["tree"], row["block"], row["total"], height, len(own), block.root, block.nodes.tobytes()])
                if ids:
                    out[-1] += [[x["doc_id"] for x in own], [x["tampered"] for x in own]]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    own = ["position", "digest", *(["doc_id", "tampered"] if ids else [])]
    grouped = nodes.groupBy("tree", "total", F.call_function("div", F.col("position"), F.lit(arity**levels)).alias("block"))
    return grouped.agg(F.collect_list(F.struct(*own)).alias("own")).mapInArrow(build, LEAF_BLOCKS if ids else BLOCKS)


@dataclass(frozen=True)
class Manifest:
    """The written tables. ``sources`` and ``top`` hold the blocks of the trees of the sources and of the tree over them,
    one table per layer, leaves first; ``subroots`` has one row per source."""

    sources: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    arity: int = ARITY
    levels: int = LEVELS

    @property
    def root(self) -> str | None:
        row = self.top[-1].select("root").first()
        return bytes(row["root"]).hex() if row else None


def _layers(nodes: DataFrame, purpose: str, arity: int, levels: int, ids: bool = False) -> list[DataFrame]:
    """Blocks over the nodes, blocks over the roots of these, and so on, until every tree has one root."""
    step = arity**levels
    layers = [staged(_blocks(nodes, arity, levels, ids), purpose)]
    while (layers[-1].agg(F.max("total")).first()[0] or 0) > step:
        above = layers[-1].where(F.col("total") > step).select(
            "tree", F.col("block").alias("position"), F.call_function("div", F.col("total") + (step - 1), F.lit(step)).alias("total"), F.col("root").alias("digest")
        )
        layers.append(staged(_blocks(above, arity, levels), purpose))
    return layers


def manifest(docs: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> Manifest:
    """Hash every row and write the trees. Leaf blocks also keep the doc_ids, and digests of rows that were tampered with."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "lang", "n_chars",
        F.col("text").cast("string").alias("text"),
    )
    other = tampered_text()
    leaves = rows.select(
        F.col("source").alias("tree"), "doc_id", leaf_of(F.col("text")).alias("digest"),
        F.when(other.isNotNull(), leaf_of(other)).alias("tampered"),
        F.monotonically_increasing_id().alias("_row"),  # tells equal rows apart
    )
    leaves = staged(leaves, "leaves")
    ranked = positions(leaves, ["tree"], ["doc_id", "digest", "_row"])
    removed(leaves)
    layers = _layers(ranked, "source-blocks", arity, levels, ids=True)
    removed(ranked)
    step = arity**levels
    roots = [layer.where(F.col("total") <= step).select("tree", "root") for layer in layers]
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    over = positions(found.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest")), ["tree"], ["source"])
    top = _layers(over, "top-blocks", arity, levels)
    return Manifest(layers, over.select("source", "position", F.col("digest").alias("subroot")), top, arity, levels)


# -- proofs ----------------------------------------------------------------------------


def _down(blocks: DataFrame, arity: int) -> DataFrame:
    """(tree, position, way): the way from each leaf of the blocks to the global root. ``blocks`` has ``above``."""

    def ways(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["n"], row["levels"], arity, row["nodes"])
                way = [_pack_way(block.way(i)) + row["above"] for i in range(row["n"])]
                first = row["block"] * arity ** row["levels"]
                yield pa.record_batch(
                    [pa.array([row["tree"]] * row["n"], pa.string()), pa.array(range(first, first + row["n"]), pa.int64()), pa.array(way, pa.binary())],
                    names=["tree", "position", "way"],
                )

    return blocks.select("tree", "block", "levels", "n", "nodes", "above").mapInArrow(ways, "tree string, position long, way binary")


def _with_ways(layers: list[DataFrame], above: DataFrame, arity: int, step: int) -> DataFrame:
    """The lowest layer with ``above``: the way from each block's root to the global root.

    ``above`` (tree, way) goes on from the roots of the trees: a layer's trees of at most ``step`` leaves end there; all
    other blocks take their way from the layer above.
    """
    ends = above.select(F.col("tree").alias("_tree"), F.col("way").alias("above"))
    below = None
    for layer in reversed(layers):
        held = layer.where(F.col("total") <= step).join(ends, same([(F.col("tree"), F.col("_tree"))])).drop("_tree")
        if below is not None:
            ways = below.select(F.col("tree").alias("_tree"), "position", F.col("way").alias("above"))
            on = same([(F.col("tree"), F.col("_tree"))]) & (F.col("block") == F.col("position"))
            held = held.unionByName(layer.where(F.col("total") > step).join(ways, on).drop("_tree", "position"))
        if layer is not layers[0]:
            below = staged(_down(held, arity), "ways")
    return held


PROOFS = "doc_id long, source string, position long, leaf binary, subroot binary, way binary, proof_sha256 string, folded binary"


def proofs(made: Manifest, ways: bool = True) -> DataFrame:
    """One row per leaf, from the tables of ``manifest`` alone: its place, the root of its source, its way to the root
    (place and siblings of every level, unless ``ways`` is false), the digest of all siblings, and the root that the
    tampered leaf, else the leaf itself, leads to."""
    arity, step = made.arity, made.arity**made.levels
    start = made.top[-1].select("tree", F.unhex(F.lit("")).alias("way")).distinct()
    over = staged(_down(_with_ways(made.top, start, arity, step), arity), "ways")
    by_source = over.join(made.subroots, "position").select(F.col("source").alias("tree"), "way")
    blocks = _with_ways(made.sources, by_source, arity, step)

    def prove(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _proofs_of(row, arity, ways)

    return blocks.select("tree", "block", "total", "levels", "n", "nodes", "ids", "tampered", "above").mapInArrow(prove, PROOFS)


def _proofs_of(row: dict, arity: int, ways: bool):
    """Proofs of the leaves of one block; what leaves share (runs, the way from a run on, folded nodes) is made once."""
    block, above = Block(row["n"], row["levels"], arity, row["nodes"]), _unpack_way(row["above"])
    # Levels of the source's tree above the block come first in ``above``.
    height = 0
    while arity**height < row["total"]:
        height += 1
    subroot = folded(block.root, above[: height - row["levels"]])
    above_hex = "".join(s.hex() for _, siblings in above for s in siblings)
    runs: dict[tuple[int, int], list[str]] = {}
    rests: dict[tuple[int, int], str] = {}
    ends: dict[tuple[int, int, bytes], bytes] = {}

    def run(depth: int, parent: int) -> list[str]:
        if (depth, parent) not in runs:
            runs[depth, parent] = [n.hex() for n in block.run(depth, parent)]
        return runs[depth, parent]

    def siblings(depth: int, index: int) -> str:
        own, at = run(depth, index // arity), index % arity
        return "".join(own[:at] + own[at + 1 :])

    def rest(depth: int, index: int) -> str:
        """Siblings from a node of the block upwards."""
        if depth == 0:
            return above_hex
        if (depth, index) not in rests:
            rests[depth, index] = siblings(depth, index) + rest(depth - 1, index // arity)
        return rests[depth, index]

    def fold(depth: int, index: int, node: bytes) -> bytes:
        """Root that a node leads to by its siblings."""
        if depth == 0:
            return folded(node, above)
        own, at = run(depth, index // arity), index % arity
        parent = sha256("".join([*own[:at], node.hex(), *own[at + 1 :]]).encode()).digest()
        key = (depth, index // arity, parent)
        if key not in ends:
            ends[key] = fold(depth - 1, index // arity, parent)
        return ends[key]

    bottom, first = row["levels"], row["block"] * arity ** row["levels"]
    leaves = [block.nodes[a].tobytes() for a in block.layout.row(bottom)[: row["n"]]]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in PROOFS.split(", ")]
    for begin in range(0, row["n"], 512):
        out = []
        for i in range(begin, min(begin + 512, row["n"])):
            upward = siblings(bottom, i) + rest(bottom - 1, i // arity) if bottom else above_hex
            way = _pack_way(block.way(i)) + row["above"] if ways else None
            end = fold(bottom, i, row["tampered"][i] or leaves[i])
            out.append((row["ids"][i], row["tree"], first + i, leaves[i], subroot, way, sha256(upward.encode()).hexdigest(), end))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def op11_merkle(spark, folder: str) -> DataFrame:
    made = manifest(spark.read.parquet(f"{folder}/documents.parquet"))
    root = F.lit(made.root)
    found = proofs(made, ways=False).select("doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "folded")], "proof_sha256")
    return found.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )


def _sql_tree(name: str, nodes: str, depth: int) -> str:
    """CTEs of the levels of the trees in ``nodes`` (tree, pos, n, h), and of the siblings left and right of each node."""
    runs = f"(PARTITION BY tree, pos // {ARITY} ORDER BY pos ROWS BETWEEN"
    ctes = [f"{name}0 AS ({nodes})"]
    for k in range(depth):
        ctes.append(
            f"{name}s{k} AS (SELECT tree, pos, n, coalesce(string_agg(h, '') OVER {runs} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER {runs} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
        )
        ctes.append(
            f"{name}{k + 1} AS (SELECT tree, pos // {ARITY} AS pos, (any_value(n) + {ARITY - 1}) // {ARITY} AS n, "
            f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY tree, pos // {ARITY})"
        )
    return ", ".join(ctes)


def _sql_climb(start: str, name: str, depth: int, tree: str, pos: str) -> str:
    """From rows with ``node`` and ``proof``: both carried up through the levels of their tree."""
    for k in range(depth):
        start = (
            f"SELECT x.* REPLACE (x.proof || s.l || s.r AS proof, CASE WHEN s.n > 1 THEN sha256(s.l || x.node || s.r) ELSE x.node END AS node) "
            f"FROM ({start}) x JOIN {name}s{k} s ON s.tree IS NOT DISTINCT FROM x.{tree} AND s.pos = x.{pos} // {ARITY**k}"
        )
    return start


def _sql_field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


#: Levels that the SQL unrolls: 16 ** 6 rows a source, 16 ** 3 sources.
_SQL_ROWS, _SQL_SOURCES = 6, 3
_SQL_LEAF = " || ".join(_sql_field(c) for c in COLUMNS)
_SQL_CRC = (
    "xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), "
    "lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]), 4294967295::BIGINT))"
)
OP11_SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
         lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i::BIGINT)) AS t),
docs AS (
  SELECT doc_id, source, sha256({_SQL_LEAF}) AS leaf,
         CASE WHEN {_SQL_CRC} % 5 = 0 THEN sha256({_SQL_LEAF.replace("text", f"translate(text, '{UPPER}', '{LOWER}')")}) END AS tampered
  FROM documents, crc),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM docs),
{_sql_tree("a", "SELECT source AS tree, pos, n, leaf AS h FROM ranked", _SQL_ROWS)},
roots AS (
  SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS top_pos, count(*) OVER () AS n FROM a{_SQL_ROWS}),
{_sql_tree("b", "SELECT 0 AS tree, top_pos AS pos, n, subroot AS h FROM roots", _SQL_SOURCES)},
low AS (
  {_sql_climb("SELECT *, coalesce(tampered, leaf) AS node, '' AS proof FROM ranked", "a", _SQL_ROWS, "source", "pos")}),
placed AS (SELECT low.*, subroot, top_pos, 0 AS one FROM low JOIN roots ON low.source IS NOT DISTINCT FROM roots.source),
high AS ({_sql_climb("SELECT * FROM placed", "b", _SQL_SOURCES, "one", "top_pos")})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM high, (SELECT h AS root FROM b{_SQL_SOURCES})"""
