"""Embedding whitening: the leading principal components by a block Jacobi-Davidson method, matrix-free.

The covariance V is never formed. Each product of V with a block of vectors is one pass over the rows: tasks centre their
rows, multiply twice and add up; the sums meet in FAN tasks and then on the driver, which holds only arrays of the
dimension times the subspace. The subspace grows by approximate solutions of the projected correction equations
(I - QQ') (V - theta I) (I - QQ') t = -r, Q being the locked and the present Ritz vectors, found by a few steps of MINRES
for all wanted pairs at once; Rayleigh-Ritz pairs are locked, the leading ones first, when their residual is down at the
rounding of double precision, until all are.

Cases: rows whose vector is null, empty, holds null or non-finite entries, entries beyond 2 ** 46, or has another dimension
than most rows (the smaller one at ties) are dropped; zero vectors, repeated rows and null ids stay and count each; with
fewer components of positive variance than asked for only these are returned, with one row or equal rows none; a deviation
that no long can hold is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, table, written

#: Components, the scale and the offset of the integers that entries become.
COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000

#: Entries from here on don't become exact integers times the scale.
LARGEST = float(1 << 46)

#: Guard vectors beside the wanted ones, steps of MINRES, tasks that sums meet in, rounds before giving up.
GUARD, STEPS, FAN, ROUNDS = 4, 5, 16, 200

#: Components whose variance is below this share of the greatest one are rounding.
NOTHING = 1e-11


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that take part, as a written table (vec_id, f), f = floor(SCALE * entry), and their dimension."""
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    whole = written(rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("f")), "whole-vectors")
    sizes = whole.groupBy(F.size("f").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return whole.filter(F.size("f") == d), d


def _entries(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all rows of what `of` gives for blocks of them, an array of doubles. Sums are kept in extended precision within tasks."""

    def add(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in blocks:
            total = b.astype(np.longdouble) if total is None else total + b
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.astype(np.float64).ravel()], pa.list_(pa.float64()))})
        give_back()

    def parts(batches):
        yield from add(of(_entries(b, d)) for b in batches if len(b))

    def meet(batches):
        yield from add(row.values.to_numpy() for b in batches for row in b.column("part"))

    found = rows.mapInArrow(parts, "part array<double>").repartition(FAN).mapInArrow(meet, "part array<double>").collect()  # FAN rows at most
    return np.sum([np.array(r["part"], np.longdouble) for r in found], axis=0).astype(np.float64)


def exact_sums(whole: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension, exactly."""

    def halves(f: np.ndarray) -> np.ndarray:  # so that the sums of a batch fit 64 bits
        return np.concatenate([[len(f)], (f >> 26).sum(0), (f & ((1 << 26) - 1)).sum(0)])

    def parts(batches):
        total = 0
        for b in batches:
            if len(b):
                total = total + halves(_entries(b, d)).astype(object)
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"part": pa.array([[str(x) for x in total]], pa.list_(pa.string()))})

    at = F.posexplode("part").alias("at", "x")
    sums = dict(whole.mapInArrow(parts, "part array<string>").select(at).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)"))).collect())  # 2 d + 1 rows
    n = int(sums.get(0, 0))
    return n, [(int(sums[1 + i]) << 26) + int(sums[1 + d + i]) for i in range(d)] if n else []


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of the symmetric systems apply(t) = b, a column each: least residuals over the Krylov spaces of `steps` products."""
    size = np.linalg.norm(b, axis=0)
    basis, alphas, betas = [b / np.where(size > 0, size, 1)], [], []
    for _ in range(steps):
        w = apply(basis[-1])
        alphas.append((basis[-1] * w).sum(0))
        for _ in range(2):
            for q in basis:
                w = w - q * (q * w).sum(0)
        norm = np.linalg.norm(w, axis=0)
        norm = np.where(norm > 1e-14 * (np.abs(alphas[-1]) + (betas[-1] if betas else 0)), norm, 0)  # the space is exhausted
        betas.append(norm)
        basis.append(np.where(norm > 0, w / np.where(norm > 0, norm, 1), 0))
    out = np.zeros_like(b)
    for i in range(b.shape[1]):
        t = np.zeros((steps + 1, steps))
        for j in range(steps):
            t[j, j], t[j + 1, j] = alphas[j][i], betas[j][i]
            if j:
                t[j - 1, j] = betas[j - 1][i]
        y = np.linalg.lstsq(t, np.eye(steps + 1)[0] * size[i], rcond=None)[0]
        out[:, i] = sum(basis[j][:, i] * y[j] for j in range(steps))
    return out


def orthonormal(x: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of x add to the (orthonormal) columns of `against`."""
    size = np.linalg.norm(x, axis=0)
    x = x[:, size > 0] / size[size > 0]
    for _ in range(2):
        for q in against:
            x = x - q @ (q.T @ x)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    x = u[:, s > 1e-10 * max(1.0, s.max(initial=0))]
    for q in against:
        x = x - q @ (q.T @ x)
    return np.linalg.qr(x)[0]


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, steps: int = STEPS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, of a symmetric operator on d dimensions, and their unit eigenvectors as columns. product: the operator on a block of columns."""
    k = min(k, d)
    most = min(d, 3 * k + 2 * guard)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), []
    s = orthonormal(rng.standard_normal((d, min(d, k + guard))))
    vs, scale = product(s), 0.0
    for _ in range(ROUNDS):
        theta, u = np.linalg.eigh((s.T @ vs + vs.T @ s) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        s, vs = s @ u, vs @ u
        scale = max(scale, np.abs(theta).max(initial=0))
        left = k - len(values)
        off = vs - s * theta
        off -= locked @ (locked.T @ off)
        small = np.linalg.norm(off[:, :left], axis=0) <= max(d, 256) * np.finfo(float).eps * scale
        new = left if small.all() else int(np.argmin(small))
        locked, values = np.hstack([locked, s[:, :new]]), [*values, *theta[:new]]
        s, vs, theta, off = s[:, new:], vs[:, new:], theta[new:], off[:, new:]
        if len(values) == k:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        left = k - len(values)
        if s.shape[1] + locked.shape[1] + left > most:  # restart from the leading Ritz vectors
            keep = min(s.shape[1], left + guard)
            s, vs = s[:, :keep], vs[:, :keep]
        near = np.hstack([locked, s[:, :left]])
        project = lambda x: x - near @ (near.T @ x)  # noqa: B023, E731
        shift = theta[:left]
        t = minres(lambda x: project(product(p := project(x)) - p * shift), -project(off[:, :left]), steps)  # noqa: B023
        more = orthonormal(t, locked, s)[:, : d - locked.shape[1] - s.shape[1]]
        if not more.shape[1]:
            more = orthonormal(rng.standard_normal((d, min(left, max(1, d - locked.shape[1] - s.shape[1])))), locked, s)
        vs = np.hstack([vs, product(more)]) if more.shape[1] else product(s)
        s = np.hstack([s, more])
    raise ArithmeticError(f"{k - len(values)} of {k} components haven't reached double precision after {ROUNDS} rounds")


class Whitening:
    """Fitted to all rows of `whole` (vec_id, f): n, sums, mean (of f), values, vectors, explained and identity_error."""

    def __init__(self, whole: DataFrame, d: int, k: int = COMPONENTS):
        self.whole, self.d = whole, d
        self.n, sums = exact_sums(whole, d)
        self.sums, n, mean = sums, self.n, np.array([s / self.n for s in sums])
        self.mean = mean

        def product(block: np.ndarray) -> np.ndarray:
            def times(f):
                y = f - mean
                return y.T @ (y @ block)

            return _summed(whole, times, d).reshape(d, -1) / n

        values, vectors = jacobi_davidson(product, d, k) if n > 1 else (np.zeros(0), np.zeros((d, 0)))
        there = values > NOTHING * values.max(initial=0)
        self.values, self.vectors = values[there], vectors[:, there]
        axes = self.axes = self.vectors / np.sqrt(self.values)
        self.explained, self.identity_error = self.values, 0.0
        if len(self.values):
            c = len(self.values)

            def moments(f):
                y = f - mean
                w = y @ axes
                return np.concatenate([[(y * y).sum()], w.sum(0), (w.T @ w).ravel()])

            trace, first, second = np.split(_summed(whole, moments, d) / n, [1, 1 + c])
            self.explained = self.values / trace[0]
            self.identity_error = float(np.abs(second.reshape(c, c) - np.outer(first, first) - np.eye(c)).max())

    def rows(self) -> DataFrame:
        """A row for each row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
        n, d, sums, mean, axes, explained, error = self.n, self.d, self.sums, self.mean, self.axes, self.explained, self.identity_error
        c, reach = len(explained), max([0, *map(abs, sums)])

        def deviations(f: np.ndarray) -> pa.Array:
            most = n * int(np.abs(f).max(initial=0)) + reach
            if d * most * most < 1 << 63:
                return pa.array(((n * f - np.array(sums, np.int64)) ** 2).sum(1))
            exact = [sum((n * x - s) ** 2 for x, s in zip(r, sums, strict=True)) for r in f.tolist()]
            return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())

        def made(batches):
            for b in batches:
                for at in range(0, len(b), 2048):
                    part = b.slice(at, 2048)
                    f, m = _entries(part, d), len(part)
                    each = pa.array(np.repeat(np.arange(m), c))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n)), deviations(f).take(each), pa.array(((f - mean) @ axes).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * c, error))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )
            give_back()

        return self.whole.mapInArrow(made, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark, sf_dir: str) -> DataFrame:
    whole, d = whole_vectors(table(spark, sf_dir, "embeddings"))
    if not d:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return Whitening(whole, d).rows()
