"""Operator 11 against a plain recursion over the whole tree."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from compare import connect, difference

from marketloom.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, arity):
    """(root, for each node: [(place, siblings)] up to it)"""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for i, own in enumerate(at):
            run, place = runs[own // arity], own % arity
            ways[i].append((place, run[:place] + run[place + 1 :]))
            at[i] = own // arity
        nodes = [h(*run) for run in runs]
    return nodes[0], ways


def brute(rows, arity=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = climb([x[2] for x in groups[s]], arity)
    root, over = climb([trees[s][0] for s in order], arity) if order else (None, [])
    out = []
    for s, upper in zip(order, over):
        for (_, _, own, r), way in zip(groups[s], trees[s][1]):
            way = way + upper
            text, node = r.text, own
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for place, siblings in way:
                node = h(*siblings[:place], node, *siblings[place:])
            out.append((r.doc_id, own, trees[s][0], root, h(*[x for _, w in way for x in w]), node, node == root))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("arity, levels", [(16, 3), (2, 2), (3, 1)])
def test_manifest_equals_plain_recursion(spark, edge, folder_small, monkeypatch, arity, levels):
    docs = spark.read.parquet(f"{folder_small}/documents.parquet")
    docs = docs if arity == 16 else docs.where("source in ('src1', 'src2', 'src3')")
    extra = edge.select(*docs.columns, "spans", "check")
    rows = docs.unionByName(extra, allowMissingColumns=True)
    made = merkle.manifest(rows, arity, levels)
    assert merkle.manifest(rows.repartition(7), arity, levels).root == made.root
    found = merkle.proofs(made).collect()
    got = sorted(
        [(r.doc_id, r.leaf.hex(), r.subroot.hex(), made.root, r.proof_sha256, r.folded.hex(), r.folded.hex() == made.root) for r in found], key=repr
    )
    expected = brute(rows.select(*docs.columns).collect(), arity)
    assert got == expected
    for r in found:  # the stored way alone leads from the leaf to the root
        assert merkle.folded(bytes(r.leaf), merkle._unpack_way(bytes(r.way))).hex() == made.root
    places = defaultdict(list)
    for r in found:
        places[r.source].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_one_large_source(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "'only' as source", "cast(null as string) as lang", "id as n_chars", "concat('Text ', id) as text")
    made = merkle.manifest(docs)
    assert [layer.count() for layer in made.sources] == [3, 1] and [layer.count() for layer in made.top] == [1]
    got = merkle.proofs(made, ways=False).collect()
    expected = {x[0]: x for x in brute(docs.collect())}
    assert len(got) == 9000 and made.root == expected[0][3]
    for r in got:
        x = expected[r.doc_id]
        assert (r.leaf.hex(), r.subroot.hex(), r.proof_sha256, r.folded.hex()) == (x[1], x[2], x[4], x[5])


def test_query(spark, folder_small):
    docs = spark.read.parquet(f"{folder_small}/documents.parquet")
    assert result(merkle.op11_merkle(spark, folder_small)) == brute(docs.collect())


def test_empty(spark, nothing):
    made = merkle.manifest(nothing)
    assert made.root is None and merkle.proofs(made).collect() == []


@pytest.mark.parametrize("arity, levels", [(16, 3), (2, 7), (3, 4), (4, 0)])
def test_layout_is_van_emde_boas(arity, levels):
    def plain(rows):
        """Nodes of a complete tree, as (depth, index), in layout order."""
        if rows == 1:
            return [(0, 0)]
        top = rows // 2
        out, below = plain(top), plain(rows - top)
        for i in range(arity**top):
            out += [(top + d, i * arity**d + j) for d, j in below]
        return out

    own = merkle.Layout(levels, arity)
    for place, (depth, index) in enumerate(plain(levels + 1)):
        assert own.address(depth, np.array([index]))[0] == place
    assert own.size == len(plain(levels + 1))


def test_sql(spark, folder_small):
    problem, n = difference(merkle.op11_merkle(spark, folder_small), connect(folder_small), merkle.OP11_SQL)
    assert problem is None and n > 0, problem
