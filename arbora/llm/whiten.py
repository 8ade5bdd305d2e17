"""Embedding whitening: the leading eigenvectors of the covariance by LOBPCG, then a projection of every row.

The covariance V (D x D) is never formed.  A pass over the fit list gives V Z for a block Z of at most 3 b columns: every task adds
up y (y.Z) over its centred rows y, a row for each dimension leaves the task, and Spark adds these up.  Each step takes for Z an
orthonormal basis of the iterate, the residual block and the direction of the step before, solves the small eigenproblem of
Z'VZ (Rayleigh-Ritz) and goes on with the b best Ritz vectors.  b is the number of components and GUARD more, so that close
eigenvalues at the border don't hold up the wanted ones.  No product is carried over by recurrence: V Z comes from the rows each
time, so rounding errors don't add up.  It ends when the residuals |V u - e u| of all wanted components, from a pass of their own,
are below TOLERANCE times the largest eigenvalue; if they don't get there an error is raised, and nothing is whitened.

Rows are whole numbers (floor(64 c) + 1000000).  Means are exact fractions: a row is centred by the whole part of S/n first, as a
whole number, then by the rest, so nothing is cancelled away.

Cases: rows whose vector is null or holds a null or non-finite entry are dropped; shorter vectors count as filled up with zero
entries; rows without an id stay, rows that share one are rows of their own; repeated vectors count once in the fit list and are
all returned; without rows there are none; components whose eigenvalue is zero (up to rounding: SMALLEST of the largest) can't be
whitened and have no rows, so a single distinct vector gives none; a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import discard, written

SCALE, PLUS, COMPONENTS, GUARD = 64, 1_000_000, 16, 8
TOLERANCE, ENOUGH, SMALLEST, STEPS = 1e-13, 1e-11, 1e-12, 400
LOW = 32


class Moments:
    """Number of rows, exact sums, and sums of squares of the fit list; centring."""

    def __init__(self, n: int, sums: list[int], squares: list[int]):
        self.n, self.sums = n, sums
        self.trace = sum(n * q - s * s for q, s in zip(squares, sums)) / (n * n)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], dtype=object)
        self.part = np.array([r / n for r in self.rest.tolist()])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum (n x - S)^2 of each row, exact; None beyond a long."""
        y = x - self.whole
        top = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if top * top * x.shape[1] < 2**62:
            d = y * self.n - self.rest.astype(np.int64)
            return (d * d).sum(1).tolist()
        d = y.astype(object) * self.n - self.rest
        return [v if v < 2**63 else None for v in (d * d).sum(1).tolist()]


def moments(fit: DataFrame, size: int) -> Moments:
    """Exact sums by halves of the components: a row for each task and dimension, summed as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        squares = [0] * size
        for b in batches:
            if b.num_rows:
                x = vectors.matrix(b, "x")
                n, high, low = n + len(x), high + (x >> LOW).sum(0), low + (x & (2**LOW - 1)).sum(0)
                small = int(np.abs(x).max(initial=0)) ** 2 * len(x) < 2**62
                squares = [a + int(v) for a, v in zip(squares, ((x * x) if small else (x.astype(object) ** 2)).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array([n] * size, pa.int64()), pa.array(high), pa.array(low), pa.array([str(v) for v in squares])], ["i", "n", "high", "low", "squares"])

    parts = fit.mapInArrow(run, "i int, n long, high long, low long, squares string")
    # Squares may be long numbers: they are added up in pieces of 15 digits.
    digits = [F.expr(f"cast(substring(lpad(squares, 60, '0'), {1 + 15 * j}, 15) as decimal(38,0))") for j in range(4)]
    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), big(F.col("high")).alias("high"), big(F.col("low")).alias("low"), *[F.sum(d).alias(f"s{j}") for j, d in enumerate(digits)]).orderBy("i").collect()  # a row for each dimension
    squares = [sum(int(r[f"s{j}"]) * 10 ** (15 * (3 - j)) for j in range(4)) for r in rows]
    return Moments(int(rows[0]["n"]), [(int(r["high"]) << LOW) + int(r["low"]) for r in rows], squares)


def product(fit: DataFrame, about: Moments, z: np.ndarray) -> np.ndarray:
    """V z, from the rows."""
    size, width = z.shape
    shared = fit.sparkSession.sparkContext.broadcast((about, z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, block = shared.value
        out = np.zeros((size, width))
        for b in batches:
            if b.num_rows:
                y = m.centred(vectors.matrix(b, "x"))
                out += y.T @ (y @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *[pa.array(c) for c in out.T]], ["i", *[f"p{j}" for j in range(width)]])

    parts = fit.mapInArrow(run, "i int, " + ", ".join(f"p{j} double" for j in range(width)))
    rows = parts.groupBy("i").agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(width)]).collect()  # a row for each dimension
    out = np.zeros((size, width))
    for r in rows:
        out[r["i"]] = r[1:]
    shared.destroy()
    return out / about.n


def _basis(*blocks: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the blocks; the first block stays as it is (it is orthonormal)."""
    out = blocks[0]
    for b in blocks[1:]:
        b = b / np.maximum(np.linalg.norm(b, axis=0), 1e-300)
        for _ in range(2):
            b = b - out @ (out.T @ b)
        u, s, _ = np.linalg.svd(b, full_matrices=False)
        u = u[:, s > 1e-8]
        u = u - out @ (out.T @ u)
        out = np.hstack([out, np.linalg.qr(u)[0]]) if u.shape[1] else out
    return out[:, : out.shape[0]]


def lobpcg(times, size: int, k: int, guard: int = GUARD, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The k largest eigenvalues, their vectors as columns, and the residual of each pass.  times(Z): V Z."""
    b = min(size, k + guard)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, b)))[0]
    history: list[float] = []
    basis, best = x, np.inf
    since = 0
    for _ in range(STEPS):
        vz = times(basis)
        h = basis.T @ vz
        e, c = np.linalg.eigh((h + h.T) / 2)
        c = c[:, ::-1][:, :b]
        e = e[::-1][:b]
        x, vx = basis @ c, vz @ c
        direction = basis[:, b:] @ c[b:]
        x = np.linalg.qr(x)[0] * np.where((np.linalg.qr(x)[0] * x).sum(0) < 0, -1.0, 1.0)
        r = vx - x * e
        worst = float(np.linalg.norm(r[:, :k], axis=0).max()) / max(float(e[0]), 1e-300) if e[0] > 0 else 0.0
        history.append(worst)
        since = 0 if worst < best / 2 else since + 1
        best = min(best, worst)
        if worst <= tolerance or since >= 4 and worst <= ENOUGH:
            # The certificate: residuals of these very vectors, from the rows.
            y = x[:, :k]
            vy = times(y)
            h = y.T @ vy
            e, c = np.linalg.eigh((h + h.T) / 2)
            e, c = e[::-1], c[:, ::-1]
            worst = float(np.linalg.norm(vy @ c - (y @ c) * e, axis=0).max()) / max(float(e[0]), 1e-300) if e[0] > 0 else 0.0
            history.append(worst)
            if worst <= ENOUGH:
                return e, y @ c, history
        basis = _basis(x, r, direction) if direction.shape[1] and np.abs(direction).max(initial=0) > 0 else _basis(x, r)
    raise ArithmeticError(f"the residuals of the covariance's eigenvectors stay at {best:.1e} of the largest eigenvalue")


def _identity(fit: DataFrame, about: Moments, project: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = project.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast((about, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p = shared.value
        out = np.zeros((k, k + 1))
        for b in batches:
            if b.num_rows:
                w = m.centred(vectors.matrix(b, "x")) @ p
                out += np.hstack([w.T @ w, w.sum(0)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), *[pa.array(c) for c in out.T]], ["i", *[f"p{j}" for j in range(k + 1)]])

    rows = fit.mapInArrow(run, "i int, " + ", ".join(f"p{j} double" for j in range(k + 1))).groupBy("i").agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(k + 1)]).orderBy("i").collect()
    all_ = np.array([r[1:] for r in rows]) / about.n
    mean = all_[:, k]
    return float(np.abs(all_[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, stats: dict | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.  Into `stats`: the residual of each pass."""
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.filter(vectors.finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), vectors.whole("embedding", SCALE, PLUS).alias("x"))
    rows = vectors.aligned(rows, "x", F.lit(PLUS).cast("long"))
    fit = written(rows.select("x").distinct(), "whiten-fit")
    first = fit.select(F.size("x").alias("n")).first()
    if first is None or not first["n"]:
        discard(fit)
        return spark.createDataFrame([], schema)
    size = first["n"]
    about = moments(fit, size)
    values, found, history = lobpcg(lambda z: product(fit, about, z), size, min(components, size))
    if stats is not None:
        stats |= {"residuals": history}
    good = values > max(float(values[0]), 0.0) * SMALLEST
    values, found = values[good], found[:, good]
    if not len(values):
        discard(fit)
        return spark.createDataFrame([], schema)
    project = found / np.sqrt(values)
    off = _identity(fit, about, project)
    discard(fit)
    explained = values / about.trace
    k = len(values)
    shared = spark.sparkContext.broadcast((about, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p = shared.value
        for b in batches:
            if b.num_rows:
                x = vectors.matrix(b, "x")
                at = pa.array(np.repeat(np.arange(len(x)), k))
                spread = [pa.array((m.centred(x) @ p).ravel()), pa.array(np.tile(explained, len(x)))]
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, m.n)), pa.array(m.deviation(x), pa.int64()).take(at), *spread, pa.array(np.full(len(x) * k, off))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
