"""Operator 13 against plain numpy in exact integers and extended precision."""

import math
from fractions import Fraction

import numpy as np
import pytest

from marketloom.llm import whitening


def integers(rows):
    out = []
    for vec_id, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((vec_id, tuple(math.floor(256 * float(c)) + 0 for c in v)))
    return out


def plain(rows):
    kept = integers(rows)
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centred = [[n * c - s for c, s in zip(x, sums)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    return kept, n, sums, v


def test_given_embeddings(spark, folder_small):
    table = spark.read.parquet(f"{folder_small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    kept, n, sums, v = plain(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    got = whitening.op13_whitening(spark, folder_small).collect()
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    of = {(r.vec_id, r.component): r for r in got}
    sign = {}
    for vec_id, x in kept:
        assert {of[vec_id, c].deviation for c in range(1, 5)} == {sum((n * a - s) ** 2 for a, s in zip(x, sums))}
        for c in range(4):
            w = float((np.array(x) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c]))
            sign.setdefault(c, 1 if w * of[vec_id, c + 1].whitened >= 0 else -1)
            assert of[vec_id, c + 1].whitened == pytest.approx(sign[c] * w, abs=1e-9)
    for c in range(4):
        assert of[kept[0][0], c + 1].explained == pytest.approx(values[c] / np.trace(v), rel=1e-12)
    assert {r.identity_error for r in got}.pop() < 1e-10 and len({r.identity_error for r in got}) == 1


def test_reruns_agree_to_the_bit(spark, folder_small):
    table = spark.read.parquet(f"{folder_small}/embeddings.parquet")
    a = whitening.whiten(table)[1]
    b = whitening.whiten(table.repartition(7))[1]
    assert a.sums == b.sums and (a.values == b.values).all() and (a.vectors == b.vectors).all()


def error_of(matrix):
    """Largest residual and departure from orthogonality, in extended precision."""
    values, x = whitening.eigenvectors(matrix)
    a = np.asarray(matrix, np.longdouble)
    size = max(float(np.abs(a).max()), 1e-300)
    assert (np.diff(values) <= 0).all()
    return float(np.abs(a @ x - x * values).max()) / size, float(np.abs(x.T @ x - np.eye(len(a))).max())


def turned(values, seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal beyond double precision
        q = q @ (1.5 * np.eye(len(values)) - 0.5 * (q.T @ q))
    a = q * np.asarray(values, np.longdouble) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values",
    [
        [5, 4, 3, 2, 1, 0.5],
        [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 + 1e-12, 1e-3],
        [1, 1, 1, 0.25, 0.25, 0],
        list(np.linspace(1, 1 + 1e-6, 40)) + [3.0, 2.0],
        [0.0] * 5,
        [1e-200, 2e-200, 5e-200],
    ],
)
def test_clusters(values):
    a, _ = turned(values, 3)
    residual, orthogonal = error_of(a)
    assert residual < 1e-17 and orthogonal < 1e-17


def test_close_eigenvectors_are_told_apart():
    values = [1, 1 - 1e-7, 0.9, 0.1]
    a, q = turned(values, 8)
    _, x = whitening.eigenvectors(a)
    # double precision alone leaves about 1e-16 / 1e-7; the refined vectors are right to double precision
    assert np.abs(np.abs(np.sum(q * x, axis=0)) - 1).max() < 1e-16
    assert min(np.abs(q[:, 0] - x[:, 0]).max(), np.abs(q[:, 0] + x[:, 0]).max()) < 1e-11


SCHEMA = "vec_id long, embedding array<double>, label int, component int, n long"


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [math.sin(i), math.cos(3 * i), i / 7], None, 1, 2) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 2.0]), (103, [inf, 1.0, 1.0]), (104, [-inf, 1.0, 1.0]), (105, []), (106, [1.0])]
    rows = good + good[:9] + [(None, *good[3][1:])] + [(*b, 0, 0, 0) for b in bad]
    found, fitted, distinct = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4))
    _, n, sums, v = plain([r[:2] for r in good])
    assert fitted.n == n == distinct.count() and fitted.sums == sums and len(fitted.values) == 3
    assert sorted(r.vec_id for r in found.where("component = 1 and vec_id is not null").collect()) == sorted(r[0] for r in good + good[:9])
    assert found.where("vec_id is null").count() == 3
    assert np.allclose(fitted.values, np.linalg.eigvalsh(v)[::-1]) and whitening.identity_error(distinct, fitted) < 1e-12


@pytest.mark.parametrize("rows, components", [([], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [2.0, 4.0])], 1), ([(1, None)], 0)])
def test_small_tables(spark, rows, components):
    table = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)
    found, fitted, distinct = whitening.whiten(table)
    assert len(fitted.values) == components and found.count() == components * len(rows)
    assert whitening.identity_error(distinct, fitted) < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e6 * i + 0.5, -3e5 * (i % 5), 1.0 * i], 0, 0, 0) for i in range(200)]
    found, _, _ = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    _, n, sums, _ = plain([r[:2] for r in rows])
    kept = dict(integers([r[:2] for r in rows]))
    for r in found.where("component = 1").collect():
        assert int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(kept[r.vec_id], sums))
