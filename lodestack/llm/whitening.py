"""Embedding whitening by shifted CholeskyQR: no covariance is decomposed, so small components keep their digits.

The distinct integer vectors are the fit list; A is its centred rows. A pass over the list sums the Gram matrix of
Q = A R^-1 (each task sums its own, numbers meet by rows of the matrix), its Cholesky factor joins R, and the next pass
solves the triangular systems again. The first factor is of the Gram matrix plus a small shift, so that it exists however
ill-conditioned A is; later ones are shifted only if they have to be. When Q is orthonormal to 1e-10, one more factor makes it so to
rounding. The right singular vectors of R are the components, its singular values over sqrt(n) their deviations.
If a factor still has to be shifted after four passes, A has directions without extent (constant entries, fewer rows than
entries): those that R shows are left out and the passes begin anew.

The driver and each task hold a few matrices of d x d numbers for vectors of length d; vectors never meet in one place.

Vectors that are null or hold null or non-finite entries are dropped. Repeated vectors count once for the fit, and every
row is whitened, also with a null or repeated id. Vectors of each length are whitened by themselves. Components without
extent (fewer than four there, none where all vectors are equal) have no rows. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, quantised, table

#: Passes before directions without extent are looked for, and in all.
RETRY, PASSES = 4, 12
ROUND = float(np.finfo(np.float64).eps) / 2


@dataclass
class Whitening:
    """n fit rows of one length, their sums, and what the passes found."""

    n: int
    sums: list[int]
    basis: np.ndarray | None = None
    factors: list[np.ndarray] = field(default_factory=list)
    trace: float = 0.0
    components: np.ndarray | None = None  # a row each
    variances: np.ndarray | None = None
    identity_error: float = 0.0

    def residual(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they are wide enough, else Python's."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        x, s = (x, np.array(self.sums, dtype=np.int64)) if most < 1 << 62 else (x.astype(object), np.array(self.sums, dtype=object))
        return self.n * x - s

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.residual(x) / self.n).astype(np.float64)

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        """Rows of Q: triangular solves, one factor after another."""
        q = self.centred(x)
        q = q if self.basis is None else q @ self.basis
        for r in self.factors:
            q = solve(q, r)
        return q

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        r = self.residual(x)
        if r.dtype == object or float(np.abs(r).max(initial=0)) ** 2 * max(1, r.shape[1]) >= 1 << 62:
            r = r.astype(object)
        return [v if v < 1 << 63 else None for v in map(int, (r * r).sum(axis=1))]


def solve(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows q with q @ r = y, for upper triangular r: forward substitution, a column of all rows at a time."""
    q = np.empty_like(y, order="F")
    for j in range(len(r)):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the batch's vectors of each length."""
    column = batch.column(batch.schema.get_field_index(name))
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(lengths)]
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield d, at, flat[starts[at][:, None] + np.arange(d)].astype(np.int64)


def moments(fit: DataFrame) -> dict[int, Whitening]:
    """n and exact sums for each length of the fit list (x)."""

    def run(batches):
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, _, x in _by_length(batch, "x"):
                n, s = sums.get(d, (0, np.zeros(d, dtype=object)))
                wide = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
                sums[d] = n + len(x), s + (x.astype(object) if wide else x).sum(axis=0).astype(object)
        for d, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))], names=["d", "i", "n", "s"])

    told = fit.mapInArrow(run, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, Whitening] = {}
    for r in told.orderBy("d", "i").collect():  # a row for each entry of a vector
        out.setdefault(r["d"], Whitening(r["n"], [])).sums.append(int(r["s"]))
    return out


def gram(fit: DataFrame, models: dict[int, Whitening], rows_of: Callable[[Whitening, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The Gram matrix of rows_of(model, vectors) over the fit list, for each length."""
    shared = fit.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("g", pa.binary())])

    def out(sums):
        for (d, i), row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tobytes()], pa.binary())], schema=schema)

    def run(batches):
        models, sums = shared.value, {}
        for batch in batches:
            for d, _, x in _by_length(batch, "x"):
                if d in models:
                    q = rows_of(models[d], x)
                    sums[d] = sums.get(d, 0.0) + q.T @ q
        yield from out({(d, i): row for d, g in sums.items() for i, row in enumerate(g)})

    def add(batches):
        sums = {}
        for batch in batches:
            for d, i, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[d, i] = sums.get((d, i), 0.0) + np.frombuffer(raw)
        yield from out(sums)

    parts = fit.mapInArrow(run, "d int, i int, g binary").repartition(16, "d", "i").mapInArrow(add, "d int, i int, g binary")
    rows: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.collect():  # one matrix for each length
        rows.setdefault(r["d"], {})[r["i"]] = np.frombuffer(r["g"])
    shared.destroy()
    return {d: np.array([g[i] for i in range(len(g))]) for d, g in rows.items()}


def factor(g: np.ndarray, n: int, shift: bool) -> tuple[np.ndarray, bool]:
    """The upper triangular factor of g, shifted if asked for or if there is none, and whether it was."""
    if not shift:
        try:
            r = np.linalg.cholesky(g).T
            if np.isfinite(r).all() and r.diagonal().min() > 1e-7 * r.diagonal().max():
                return r, False
        except np.linalg.LinAlgError:
            pass
    d = len(g)
    s = 11 * (n * d + d * (d + 1)) * ROUND * np.linalg.norm(g, 2)
    return np.linalg.cholesky(g + s * np.eye(d)).T, True


def composed(m: Whitening) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Singular vectors and values of R, and how many of them have extent."""
    r = m.factors[0]
    for f in m.factors[1:]:
        r = f @ r
    u, s, w = np.linalg.svd(r)
    return u, s, w, int((s > s[0] * ROUND * max(m.n, len(m.sums))).sum())


def fit_whitening(fit: DataFrame, most: int = 4) -> dict[int, Whitening]:
    """A model for each length of the vectors x of the fit list, with at most `most` components."""
    models = moments(fit)
    left, tries = dict(models), dict.fromkeys(models, 0)
    for _ in range(PASSES):
        if not left:
            break
        grams = gram(fit, left, Whitening.orthogonal)
        for d, m in list(left.items()):
            g = grams.get(d, np.zeros((0, 0)))
            if not m.factors and m.basis is None:
                m.trace = float(np.trace(g)) / m.n
            if not m.trace > 0:
                del left[d]
                continue
            near = False
            if m.factors:
                u, _, _, extent = composed(m)
                k = min(most, extent)
                near = float(np.abs((u.T @ g @ u)[:, :k] - np.eye(len(g))[:, :k]).max()) < 1e-10
            r, shifted = factor(g, m.n, not m.factors)
            if near and not shifted:
                m.factors.append(r)
                del left[d]
                continue
            m.factors.append(r)
            tries[d] += 1
            if shifted and tries[d] >= RETRY:
                _, _, w, extent = composed(m)
                m.basis = w[:extent].T if m.basis is None else m.basis @ w[:extent].T
                m.factors, tries[d] = [], 0
    for m in models.values():
        m.components, m.variances = np.empty((0, len(m.sums))), np.empty(0)
        if m.factors:
            _, s, w, extent = composed(m)
            k = min(most, extent)
            c = w[:k] if m.basis is None else w[:k] @ m.basis.T
            turn = np.take_along_axis(c, np.abs(c).argmax(axis=1)[:, None], axis=1)
            m.components, m.variances = c * np.sign(turn), s[:k] ** 2 / m.n
    some = {d: m for d, m in models.items() if len(m.components)}
    for d, g in (gram(fit, some, Whitening.whitened) if some else {}).items():
        models[d].identity_error = float(np.abs(g / models[d].n - np.eye(len(g))).max())
    return models


def whiten(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each of rows (vec_id, x) and component."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for d, at, x in _by_length(batch, "x"):
                m = models.get(d)
                if m is None:  # no entries
                    continue
                z, deviation = m.whitened(x), pa.array(m.deviations(x), pa.int64())
                ids = batch.column(0).take(pa.array(at))
                for c in range(z.shape[1]):
                    same = lambda v, kind: pa.array(np.full(len(at), v), kind)
                    yield pa.RecordBatch.from_arrays([ids, same(c + 1, pa.int32()), same(m.n, pa.int64()), deviation, pa.array(z[:, c]), same(m.variances[c] / m.trace, pa.float64()), same(m.identity_error, pa.float64())], schema=schema)

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "whitening-rows")
    fit = cut(rows.select("x").distinct(), "whitening-fit")
    models = fit_whitening(fit)
    forget(fit)
    return whiten(rows, models)


SQL: dict[str, str] = {}
QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
