"""Operator 13: whitening of embeddings by eigenvectors of a distributed covariance, refined in higher precision.

Entries become integers (floor(scale * entry)); the components are fitted on each distinct integer vector once. Tasks
centre the vectors on whole numbers near the means before multiplying, so their sums of products are exact integers, and
the covariance is the same to the last bit however rows are dealt. The driver holds numbers of the dimension only: one
vector of sums and one matrix.

The solver starts from float32 eigenvectors and corrects them by Ogita-Aishima iterations (matrix products in extended
precision, each of which squares the error). Eigenvalues that lie too close for a correction to tell them apart form a
cluster; the matrix is projected on the cluster's vectors, shifted by the cluster's mean and solved by itself, which
separates them, and the iterations go on.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out, and so are vectors of
another length than most rows have (of two lengths as frequent the shorter); a null or repeated vec_id is kept; repeated
vectors weigh once in the fit and are each whitened; components whose eigenvalue is zero to rounding (a single vector, fewer
distinct vectors than components) are left out; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

SCALE = 256
COMPONENTS = 4
#: Sums that may grow beyond this are kept as Python integers.
LIMIT = 2**62
#: Vectors that one step of a task multiplies.
STEP_ROWS = 4096

# -- eigenvectors ----------------------------------------------------------------------


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of eigenvalues whose neighbours lie within ``gap``; groups of one are left out."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def eigenvectors(matrix: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, beyond double precision."""
    a = np.asarray(matrix, np.longdouble)
    size = np.abs(a).max(initial=0)
    if not size > 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye = np.eye(len(a), dtype=np.longdouble)
    tiny = np.finfo(np.longdouble).eps * len(a)
    norm = np.linalg.norm(a.astype(np.float64), 2)
    best, found, stale = np.inf, x, 0
    for _ in range(rounds):
        away = eye - x.T @ x
        turned = x.T @ a @ x
        values = np.diag(turned) / (1 - np.diag(away))
        # What is off the diagonal bounds how far eigenvalues may still move.
        off = float(np.linalg.norm((turned - np.diag(values)).astype(np.float64), 2) + norm * np.linalg.norm(away.astype(np.float64), 2))
        best, found, stale = (off, x, 0) if off < best else (best, found, stale + 1)
        if off <= tiny or stale > 2:
            break
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 2 * max(off, tiny)
        x = x + x @ np.where(near, away / 2, (turned + values[None, :] * away) / np.where(near, 1, gap))
        for group in clusters(values, 2 * off):
            own = x[:, group]
            inner = own.T @ (a @ own - values[group].mean() * own)
            spread = np.abs(inner).max()
            if spread > tiny:
                x[:, group] = own @ np.linalg.eigh((inner / spread).astype(np.float64))[1].astype(np.longdouble)
    x = found
    for _ in range(2):  # vectors of eigenvalues that differ by rounding alone are made orthogonal without regard to these
        x = x @ (1.5 * eye - 0.5 * (x.T @ x))
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


# -- operator --------------------------------------------------------------------------


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x (whole numbers) of the rows whose entries are all finite."""
    x = F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False))).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _sums(distinct: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """Number of vectors, sum of each entry, largest entry by size."""

    def add(batches):
        total, n, top = np.zeros(dim, object), 0, 0
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            if len(x):
                reach = max(abs(int(x.min())), abs(int(x.max())))
                total, n, top = total + x.sum(axis=0, dtype=np.int64 if reach * len(x) < LIMIT else object), n + len(x), max(top, reach)
        if n:
            yield pa.record_batch(
                [pa.array(range(dim), pa.int32()), pa.array([str(v) for v in total]), pa.array([n] * dim), pa.array([str(top)] * dim)],
                names=["i", "s", "n", "top"],
            )

    parts = distinct.mapInArrow(add, "i int, s string, n long, top string").groupBy("i")
    exact = [F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max(F.col("top").cast("decimal(38,0)")).alias("top")]
    rows = sorted(parts.agg(*exact, F.sum("n").alias("n")).collect(), key=lambda r: r.i)
    return (rows[0].n, [int(r.s) for r in rows], max(int(r.top) for r in rows)) if rows else (0, [0] * dim, 0)


def _products(distinct: DataFrame, centre: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of y and of the products y y', of y = x - centre, as exact Python integers."""
    dim = len(centre)
    reach = top + int(np.abs(centre).max(initial=0)) + 1
    rows_at_once = min(STEP_ROWS, max(0, 2**53 // reach**2))

    def multiply(batches):
        total, products, held = np.zeros(dim, object), np.zeros((dim, dim), object), False
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            for i in range(0, len(x), rows_at_once or STEP_ROWS):
                y = x[i : i + (rows_at_once or STEP_ROWS)] - centre
                held = True
                # Below 2 ** 53 products of doubles are exact.
                own = (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64) if rows_at_once else y.T.astype(object) @ y.astype(object)
                total, products = total + y.sum(axis=0).astype(object), products + own.astype(object)
        if held:
            i, j = np.triu_indices(dim)
            i, j = np.append(np.full(dim, -1), i), np.append(np.arange(dim), j)
            values = [*total.tolist(), *products[np.triu_indices(dim)].tolist()]
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in values])], names=["i", "j", "v"])

    parts = distinct.mapInArrow(multiply, "i int, j int, v string")
    found = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    total, products = np.zeros(dim, object), np.zeros((dim, dim), object)
    for r in found:
        if r.i < 0:
            total[r.j] = int(r.v)
        else:
            products[r.i, r.j] = products[r.j, r.i] = int(r.v)
    return total, products


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: x is projected as (x - sums / n) @ vectors / sqrt(values)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int = SCALE

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if len(self.values) else self.values

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - sums) squared, exact."""
        top, reach = max(map(abs, self.sums), default=0), int(np.abs(x).max(initial=0))
        kind = np.int64 if max(top, reach) * max(reach, 1) * len(self.sums) < LIMIT else object
        own, sums = x.astype(kind), np.array(self.sums, kind)
        squares, crossed, fixed = (own * own).sum(axis=1).tolist(), (own * sums).sum(axis=1).tolist(), sum(s * s for s in self.sums)
        return [self.n**2 * a - 2 * self.n * b + fixed for a, b in zip(squares, crossed)]


def fit(distinct: DataFrame, dim: int, components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Fit on the vectors of ``distinct`` (column x), each of ``dim`` whole numbers."""
    n, sums, top = _sums(distinct, dim)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, scale)
    centre = np.array([round(s / n) for s in sums], np.int64)
    total, products = _products(distinct, centre, top)
    # y is centred to within a half, so nothing is lost in taking off the rest of the mean; the numerators are exact.
    numerators = n * products - np.outer(total, total)
    covariance = np.array([[np.longdouble(v) for v in row] for row in numerators.tolist()]) / (np.longdouble(n) * np.longdouble(n))
    values, vectors = eigenvectors(covariance)
    trace = np.trace(covariance)
    kept = [k for k in range(min(components, dim)) if values[k] > dim * np.finfo(np.float64).eps * trace]
    values, vectors = values[kept].astype(np.float64), vectors[:, kept].astype(np.float64)
    if kept:  # one sign for each component: its largest entry is positive
        at = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.sign(vectors[at, np.arange(len(kept))])
    return Whitening(n, sums, values, vectors, float(trace), scale)


def identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit vectors minus the identity, measured on them."""
    dim, k = len(fitted.sums), len(fitted.values)
    if not k:
        return 0.0

    def project(batches):
        for batch in batches:
            own = fitted.project(_matrix(batch.column("x"), dim))
            yield pa.record_batch([pa.array(own[:, j]) for j in range(k)], names=[f"w{j}" for j in range(k)])

    rows = distinct.mapInArrow(project, ", ".join(f"w{j} double" for j in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


WHITE = "vec_id long, component int, deviation decimal(38,0), whitened double, explained double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, Whitening, DataFrame]:
    """Rows (vec_id, component, deviation, whitened, explained), the fitted whitening, and the table it was fitted on."""
    x = staged(integer_vectors(vectors, scale), "vectors")
    lengths = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = lengths["dim"] if lengths else 0
    x = x.where(F.size("x") == dim)
    distinct = staged(x.select("x").distinct(), "distinct")
    fitted = fit(distinct, dim, components, scale)
    k = len(fitted.values)

    def apply(batches):
        for batch in batches:
            own = _matrix(batch.column("x"), dim)
            white, deviation = fitted.project(own), fitted.deviations(own)
            n = len(own)
            for c in range(k):
                yield pa.record_batch(
                    [batch.column("vec_id"), pa.array(np.full(n, c + 1, np.int32)), pa.array([str(d) for d in deviation]),
                     pa.array(white[:, c]), pa.array(np.full(n, fitted.explained[c]))],
                    names=["vec_id", "component", "deviation", "whitened", "explained"],
                )

    rows = x.mapInArrow(apply, WHITE.replace("decimal(38,0)", "string"))
    return rows.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")), fitted, distinct


def op13_whitening(spark, folder: str) -> DataFrame:
    rows, fitted, distinct = whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    error = identity_error(distinct, fitted)
    return rows.select(
        "vec_id", "component", F.lit(fitted.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        "explained", F.lit(error).alias("identity_error"),
    )
