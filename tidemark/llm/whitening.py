"""Embedding whitening by an incremental eigendecomposition.

Vectors are turned into whole numbers x = floor(64 c) + 1,000,000, so that their sums are exact. The covariance is that of the
distinct x vectors, divided by their number, centred by the exact mean. It is never formed: each task keeps the spectrum of
its own vectors and takes in one centred vector after another as a rank-one update (`updated`): in the basis of the spectrum
the new eigenvalues are the roots of a secular equation, after entries that do not couple and equal eigenvalues have been
deflated. Spectra are combined in groups of `FAN_IN` until one is left, each eigenpair of one as a rank-one update of another.
A Rayleigh-Ritz step over all vectors then corrects the basis: the covariance within it, summed over tasks, is diagonalised.

Rows whose vector is null or holds null, NaN or infinite entries are left out, and so are rows with another number of entries
than most rows have (ties: the greater number), and entries beyond 2^40, for which sums of squares have no room. Repeated vectors
count once for the covariance and are all returned. Components whose eigenvalue is zero (up to rounding) are not returned, since
nothing can be scaled by it: one distinct vector gives no rows. `deviation` is exact; where it does not fit a long, a
ValueError is raised. Null ids stay null. Extra columns are ignored; empty tables give empty tables.

A task holds one batch of vectors and one spectrum (dimensions squared), the driver a spectrum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Tables, checkpointed, mapped, partitions, text_batches

SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 40
COMPONENTS = 16
#: Spectra that one task combines.
FAN_IN = 8
EPS = np.finfo(float).eps
#: Share of the trace below which an eigenvalue counts as zero.
NOTHING = 1e-12


def updated(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of basis diag(values) basisᵀ + v vᵀ, eigenvalues rising.

    The new eigenvalues are the roots of 1 + Σ z²/(d - λ) = 0 with z = basisᵀ v, one above each d. Each is found as a distance
    to the nearer pole, so that differences to the poles keep their digits, and z is taken anew from the roots found, which
    makes the new vectors orthogonal (Gu and Eisenstat)."""
    z = basis.T @ v
    size = float(z @ z)
    if not size > 0:
        return values, basis
    order = np.argsort(values, kind="stable")
    d, z, q = values[order], z[order], basis[:, order]
    level = 8 * EPS * max(float(d[-1]), size)
    # equal eigenvalues: a rotation moves the weight of the lower into the upper
    for i in np.flatnonzero(np.diff(d) <= level):
        r = float(np.hypot(z[i], z[i + 1]))
        if r > 0:
            c, s = z[i + 1] / r, z[i] / r
            z[i], z[i + 1] = 0.0, r
            q[:, i], q[:, i + 1] = c * q[:, i] - s * q[:, i + 1], s * q[:, i] + c * q[:, i + 1]
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > level)
    if not len(live):
        return d, q
    p, w = d[live], z[live]
    roots, pole = _roots(p, w)
    # d_i - λ_j by way of the pole that λ_j was measured from
    apart = (p[:, None] - p[pole][None]) - roots[None]
    between = p[None] - p[:, None]
    np.fill_diagonal(between, 1.0)
    weights = np.copysign(np.sqrt(np.abs(apart / between).prod(axis=1)), w)
    vectors = weights[:, None] / apart
    vectors /= np.linalg.norm(vectors, axis=0)
    d, q = d.copy(), q.copy()
    d[live] = p[pole] + roots
    q[:, live] = q[:, live] @ vectors
    return d, q


def _roots(p: np.ndarray, w: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(distance, pole) of each root of 1 + Σ w²/(p - λ) = 0: one between every two poles, one above the last.

    Both sides of a root are replaced by a constant and the nearest pole with the same value and slope, which gives a quadratic
    equation for the next guess; a guess outside the bounds known so far is replaced by their middle."""
    k, w2 = len(p), w * w
    upper = np.concatenate((p[1:], [p[-1] + w2.sum()]))
    gap = upper - p
    middle = 1 + (w2[:, None] / (p[:, None] - (p + gap / 2)[None])).sum(axis=0)
    left = middle > 0
    left[-1] = True
    pole = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = p[:, None] - p[pole][None]
    below = np.arange(k)[:, None] <= np.arange(k)[None]
    one, two = np.where(left, 0.0, -gap), np.where(left, gap, 0.0)
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    x = (low + high) / 2
    last = np.arange(k) == k - 1
    for _ in range(most):
        terms = w2[:, None] / (delta - x[None])
        slopes = terms / (delta - x[None])
        psi, phi = np.where(below, terms, 0).sum(axis=0), np.where(below, 0, terms).sum(axis=0)
        f = 1 + psi + phi
        done = np.abs(f) <= 4 * EPS * k * (1 + np.abs(psi) + np.abs(phi))
        if done.all():
            break
        high, low = np.where(f > 0, x, high), np.where(f > 0, low, x)
        dpsi, dphi = np.where(below, slopes, 0).sum(axis=0), np.where(below, 0, slopes).sum(axis=0)
        a, b = one - x, two - x
        s, t = dpsi * a * a, dphi * b * b
        c = 1 + psi - dpsi * a + phi - dphi * b
        minus = c * (one + two) + s + t
        rest = c * one * two + s * two + t * one
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(minus * minus - 4 * c * rest, 0))
            new = np.where(minus >= 0, 2 * rest / (minus + root), (minus - root) / (2 * c))
            new = np.where(last, one + s / c, new)
        inside = (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return x, pole


def combined(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of the sum of two matrices, the pairs of the other taken in one by one, the largest last."""
    values, basis = one
    for value, vector in zip(other[0], other[1].T, strict=True):
        if value > 0:
            values, basis = updated(values, basis, np.sqrt(value) * vector)
    return values, basis


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): the rows that have finite vectors, as whole numbers."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    field = rows.schema["id"].dataType
    kind = to_arrow_type(field)

    def run(batches):
        for batch in text_batches(batches, 2048):
            ids, out = [], []
            lists = batch.column(1)
            for k in range(batch.num_rows):
                v = lists[k].values
                if v is not None and not v.null_count:
                    scaled = np.floor(SCALE * v.to_numpy(zero_copy_only=False))
                    if (np.abs(scaled) <= LARGEST).all():
                        ids.append(batch.column(0)[k].as_py())
                        out.append(scaled.astype(np.int64) + SHIFT)
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(v) for v in out], dtype=np.int64))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "x"])

    return mapped(rows, run, f"id {field.simpleString()}, x array<bigint>")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


@dataclass
class Mean:
    """The exact mean: n, and per dimension the whole part of S / n and what is left of S."""

    n: int
    whole: np.ndarray
    left: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.left / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)²."""
        apart = x - self.whole
        if self.n * (int(np.abs(apart).max(initial=0)) + 1) * float(x.shape[1]) ** 0.5 < 2.0**31:
            return ((self.n * apart - self.left) ** 2).sum(axis=1)
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.left.tolist(), strict=True)) for row in apart.tolist()]
        if max(exact, default=0) >= 1 << 63:
            raise ValueError("the squared deviation does not fit a long")
        return np.array(exact, np.int64)


def mean_of(fit: DataFrame, dims: int) -> Mean:
    def run(batches):
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1, dtype=np.int32)), pa.array(np.append(total, n))], names=["i", "s"])

    sums = {r["i"]: r["s"] for r in mapped(fit, run, "i int, s bigint").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n = sums.get(dims, 0)
    total = np.array([sums.get(i, 0) for i in range(dims)], np.int64)
    return Mean(n, total // max(1, n), total % max(1, n))


SPECTRUM = "part bigint, vals array<double>, basis array<double>"


def _spectrum(part: int, values: np.ndarray, basis: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([values.tolist()]), pa.array([basis.ravel().tolist()])], names=["part", "vals", "basis"])


def spectrum_of(fit: DataFrame, mean: Mean, tables: Tables, fan_in: int = FAN_IN) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the sum of centred squares, by rank-one updates in tasks and a tree over their spectra."""
    dims = len(mean.whole)

    def run(batches):
        values, basis, some = np.zeros(dims), np.eye(dims), False
        for batch in batches:
            for v in mean.centred(_matrix(batch.column(0), dims)):
                values, basis = updated(values, basis, v)
                some = True
        if some:
            yield _spectrum(TaskContext.get().partitionId(), values, basis)

    def together(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        spectra = [(np.array(r["vals"]), np.array(r["basis"]).reshape(dims, dims)) for r in rows]
        whole = spectra[0]
        for other in spectra[1:]:
            whole = combined(whole, other)
        return pa.Table.from_batches([_spectrum(rows[0]["part"], *whole)])

    found = tables.write(mapped(fit, run, SPECTRUM))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:  # a group is a whole number of neighbours, named by its first
        found = found.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInArrow(together, SPECTRUM)
        parts = -(-parts // fan_in)
    row = found.first()
    return np.array(row["vals"]), np.array(row["basis"]).reshape(dims, dims)


def squares(fit: DataFrame, mean: Mean, matrix: np.ndarray) -> np.ndarray:
    """Sum of y yᵀ over y = matrixᵀ (x - mean), added up in the cluster."""
    dims, k = matrix.shape

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            y = mean.centred(_matrix(batch.column(0), dims)) @ matrix
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    out = np.zeros(k * k)
    for r in mapped(fit, run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(k, k)


@dataclass
class Whitening:
    """mean, unit eigenvectors (columns) by falling eigenvalue, their eigenvalues and the trace of the covariance."""

    mean: Mean
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def train(fit: DataFrame, dims: int, tables: Tables, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors fit (x)."""
    mean = mean_of(fit, dims)
    if not mean.n:
        return Whitening(mean, np.zeros((dims, 0)), np.zeros(0), 0.0)
    _, basis = spectrum_of(fit, mean, tables)
    basis = np.linalg.qr(basis[:, ::-1])[0]
    # Rayleigh-Ritz: the covariance within the basis is diagonal but for rounding
    values, turn = np.linalg.eigh(squares(fit, mean, basis) / mean.n)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    kept = min(components, int((values > NOTHING * trace).sum())) if trace > 0 else 0
    return Whitening(mean, vectors[:, :kept], values[:kept], trace)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row with a finite vector and component."""
    tables = Tables(rows.sparkSession)
    x = tables.write(whole_vectors(rows, id_col, vector))
    sizes = x.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 0
    x = x.where(F.size("x") == dims)
    # copies go before the vectors are dealt out again, so that a vector with many of them fills no task
    fit = checkpointed(x.select("x").distinct().repartition(partitions(rows), "x"))
    model = train(fit, dims, tables, components)
    k = len(model.values)
    error = float(np.abs(squares(fit, model.mean, model.matrix) / model.mean.n - np.eye(k)).max()) if k else 0.0
    field = x.schema["id"].dataType
    kind, mean, matrix, explained = to_arrow_type(field), model.mean, model.matrix, model.values / (model.trace or 1.0)

    def run(batches):
        for batch in text_batches(batches, 4096):
            if k:
                vectors = _matrix(batch.column(1), dims)
                deviation, whitened = mean.deviation(vectors), mean.centred(vectors) @ matrix
                n = len(vectors)
                columns = [batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, mean.n)), pa.array(np.repeat(deviation, k)), pa.array(whitened.ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))]
                yield pa.RecordBatch.from_arrays([columns[0].cast(kind), *columns[1:]], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return mapped(x, run, f"id {field.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
