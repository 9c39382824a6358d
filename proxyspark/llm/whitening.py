"""Whitening of embeddings by an incremental eigendecomposition.

Every partition starts from nothing and takes its vectors one at a time: the
centred vector updates mean, count and the spectrum of the scatter matrix by one
rank. A rank-one update of a known spectrum is a secular equation; components with
no weight and equal eigenvalues are deflated first, the roots of all others are
found together, and vectors are formed from weights recomputed from the roots, which
keeps them orthogonal however close the roots are. Spectra of partitions are combined
in groups of ``FAN_IN``, a level at a time: each takes the other's eigenpairs and the
difference of the means as successive rank-one updates.

What comes out is a basis that is right up to rounding over many updates. A last
distributed pass projects the exactly centred vectors on it (Rayleigh-Ritz): the small
matrix that it sums is all but diagonal, and its eigenvectors turn the basis into
components to double precision. A model is a mean and a square matrix of the vectors'
width, whatever the number of rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark.llm.common import cut, rows_batch
from proxyspark.llm.topk import _matrix, whole_components

SCALE, SHIFT = 1024, 100_000
#: Components returned.
COMPONENTS = 8
#: Spectra that one task combines.
FAN_IN = 16
#: Integer components from here on are no exact matter of 64-bit sums.
LARGEST = 1 << 40

_SPECTRUM = "part long, n long, width int, mean binary, values binary, basis binary"


class Model(NamedTuple):
    """What whitening needs: bounded by the square of the width."""
    n: int
    sums: list
    components: np.ndarray  # a unit vector per column, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float


# --- a spectrum and its rank-one updates ---------------------------------------------

def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - x)) = 0 for rising, distinct ``d`` and
    positive ``z2``, ``rho``: the pole each is measured from, and its distance."""
    k = len(d)
    above = np.append(d[1:], d[-1] + rho * z2.sum())
    width = above - d
    # Measured from the nearer pole, so that small distances keep their digits.
    middle = d + width / 2
    at_middle = 1 + rho * (z2[:, None] / (d[:, None] - middle[None, :])).sum(0)
    lower = at_middle >= 0
    lower[-1] = True
    pole = np.where(lower, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    gap = d[:, None] - d[pole][None, :]
    low = np.where(lower, 0.0, -width / 2)
    high = np.where(lower, width / 2, 0.0)
    high[-1] = width[-1]
    x = (low + high) / 2
    left = np.arange(k)[:, None] <= np.arange(k)[None, :]
    for _ in range(60):
        apart = gap - x
        term = rho * z2[:, None] / apart
        slope = term / apart
        f = 1 + term.sum(0)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        # Each side's sum is replaced by one pole that has its value and its slope here.
        to_left, to_right = -(x - (d - d[pole])), (np.append(d[1:], np.inf) - d[pole]) - x
        left_slope, right_slope = np.where(left, slope, 0).sum(0), np.where(left, 0, slope).sum(0)
        with np.errstate(all="ignore"):
            s, q = to_left ** 2 * left_slope, np.where(np.isfinite(to_right), to_right ** 2 * right_slope, 0)
            c = f - to_left * left_slope - np.where(np.isfinite(to_right), to_right * right_slope, 0)
            # c + s / (to_left - step) + q / (to_right - step) = 0
            only = to_left + s / c
            b = c * (to_left + to_right) + s + q
            root = np.sqrt(np.maximum(b * b - 4 * c * (c * to_left * to_right + s * to_right + q * to_left), 0))
            far = 2 * (c * to_left * to_right + s * to_right + q * to_left) / (b + np.where(b >= 0, root, -root))
            near = (b + np.where(b >= 0, root, -root)) / (2 * c)
        step = np.where(np.isfinite(to_right), far, only)
        other = np.where(np.isfinite(to_right), near, only)
        ahead = lambda v: np.isfinite(v) & (x + v > low) & (x + v < high)
        new = np.where(ahead(step), x + step, np.where(ahead(other), x + other, (low + high) / 2))
        # Good where the value is within rounding of the terms that it sums.
        done = (np.abs(f) <= 4 * k * np.finfo(float).eps * (1 + np.abs(term).sum(0))) | (np.abs(new - x) <= 4e-16 * np.abs(new))
        x = np.where(done, x, new)
        if done.all():
            break
    return pole, x


def update(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``basis * diag(values) * basis' + rho * vector * vector'``
    for rising ``values``; rising again."""
    z = basis.T @ vector
    norm = float(z @ z)
    if rho <= 0 or norm == 0:
        return values, basis
    size = max(abs(values[-1]), abs(values[0]), rho * norm)
    tiny = 8 * np.finfo(float).eps * size
    # Weights that move nothing are zero; equal values give their weight to one of them.
    active = [int(i) for i in np.flatnonzero(rho * np.sqrt(norm) * np.abs(z) > tiny)]
    basis = basis.copy()
    kept = []
    for i in active:
        if kept and values[i] - values[kept[-1]] <= tiny:
            j = kept.pop()
            r = np.hypot(z[i], z[j])
            c, s = z[i] / r, z[j] / r
            basis[:, j], basis[:, i] = c * basis[:, j] - s * basis[:, i], s * basis[:, j] + c * basis[:, i]
            z[i], z[j] = r, 0.0
        kept.append(i)
    if not kept:
        return values, basis
    kept = np.array(kept)
    d, w = values[kept], z[kept]
    pole, x = _roots(d, w * w, rho)
    apart = (d[:, None] - d[pole][None, :]) - x  # d[i] - root[j]
    # Weights for which these roots are exact, from products of differences.
    k = len(d)
    between = d[:, None] - d[None, :]
    np.fill_diagonal(between, 1.0)
    ratio = apart / between
    own = np.diagonal(apart).copy()
    np.fill_diagonal(ratio, 1.0)
    mended = np.sqrt(np.abs(own * np.prod(ratio, axis=1))) if k > 1 else np.sqrt(np.abs(own))
    with np.errstate(all="ignore"):
        vectors = np.where(w < 0, -mended, mended)[:, None] / apart
    stuck = ~np.isfinite(vectors).all(0)
    if stuck.any():
        vectors[:, stuck] = np.eye(k)[:, stuck]
    vectors /= np.sqrt((vectors * vectors).sum(0))
    values = values.copy()
    values[kept] = d[pole] + x
    basis[:, kept] = basis[:, kept] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Count, mean and eigenpairs of the scatter matrix of some vectors."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.basis = np.zeros(width), np.eye(width)

    def add(self, x: np.ndarray) -> None:
        apart = x - self.mean
        if self.n:
            self.values, self.basis = update(self.values, self.basis, apart, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + apart / self.n

    def merge(self, other: Spectrum) -> None:
        apart, n = other.mean - self.mean, self.n + other.n
        if not n:
            return
        for value, vector in zip(other.values, other.basis.T):
            self.values, self.basis = update(self.values, self.basis, vector, float(value))
        self.values, self.basis = update(self.values, self.basis, apart, self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n

    def row(self, part: int) -> tuple:
        return part, self.n, len(self.mean), self.mean.tobytes(), self.values.tobytes(), np.ascontiguousarray(self.basis).tobytes()

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        width = row["width"]
        out = cls(width)
        out.n, out.mean, out.values = row["n"], np.frombuffer(row["mean"]), np.frombuffer(row["values"])
        out.basis = np.frombuffer(row["basis"]).reshape(width, width)
        return out


# --- passes over the vectors ------------------------------------------------------------

def _vectors(batches, width: int):
    for batch in batches:
        if batch.num_rows:
            yield batch, _matrix(batch.column(batch.schema.get_field_index("_x")), width)


def _exact(numbers: np.ndarray) -> list[int]:
    """Column sums of whole numbers of any size."""
    out = np.zeros(numbers.shape[1], object)
    for a in range(0, len(numbers), 1 << 20):
        out = out + numbers[a:a + (1 << 20)].sum(0).astype(object)
    return [int(v) for v in out]


def _local(width: int):
    def run(batches):
        from pyspark import TaskContext
        spectrum = Spectrum(width)
        for _, x in _vectors(batches, width):
            for row in x.astype(np.float64) - SHIFT:
                spectrum.add(row)
        if spectrum.n:
            yield rows_batch(_SPECTRUM, [[v] for v in spectrum.row(TaskContext.get().partitionId())])
    return run


def _combine(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = Spectrum.of(rows[0])
    for row in rows[1:]:
        total.merge(Spectrum.of(row))
    return pa.Table.from_batches([rows_batch(_SPECTRUM, [[v] for v in total.row(rows[0]["part"] // FAN_IN)])])


def _sums(width: int):
    """Exact column sums, as text, a row per partition and dimension."""
    def run(batches):
        total = [0] * width
        for _, x in _vectors(batches, width):
            total = [a + b for a, b in zip(total, _exact(x))]
        yield rows_batch("dim int, total string", [list(range(width)), [str(v) for v in total]])
    return run


def _products(width: int, n: int, sums: list, basis: np.ndarray, scale: np.ndarray):
    """Sums of products of projected vectors, a row per partition and pair."""
    centre = _centre(n, sums)

    def run(batches):
        k = basis.shape[1]
        total = np.zeros((k, k))
        for _, x in _vectors(batches, width):
            y = _centred(x, centre) @ basis * scale
            total += y.T @ y
        i, j = np.divmod(np.arange(k * k), k)
        yield rows_batch("i int, j int, total double", [i, j, total.ravel()])
    return run


def _centre(n: int, sums: list) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole number and the rest, so that centring loses nothing."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def _centred(x: np.ndarray, centre) -> np.ndarray:
    return (x - centre[0]).astype(np.float64) - centre[1]


def _deviation(x: np.ndarray, n: int, sums: list) -> list:
    """Sum over dimensions of (n*x - S)^2; None where no long holds it."""
    most = max((max(abs(int(v)) for v in (x.max(initial=0), x.min(initial=0)))), 1)
    if n * most < 1 << 62 and max((abs(s) for s in sums), default=0) < 1 << 62:
        apart = n * x - np.array(sums, np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * max(x.shape[1], 1) < 1 << 63:
            return (apart * apart).sum(1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def _matrix_of(df: DataFrame, k: int) -> np.ndarray:
    """A summed k by k matrix; its rows in the driver are bounded by the width."""
    out = np.zeros((k, k))
    for i, j, total in df.groupBy("i", "j").agg(F.sum("total")).collect():
        out[i, j] = total
    return (out + out.T) / 2


_OUT = "n long, deviation long, component int, whitened double, explained double"


def _whiten(model: Model, shown: int):
    n, sums, width = model.n, model.sums, len(model.sums)
    centre = _centre(n, sums)
    basis, e = model.components[:, :shown], model.eigenvalues[:shown]
    spread = _spread(model, shown)
    share = [float(v / model.trace) if model.trace > 0 else 0.0 for v in e]

    def run(batches):
        for batch, x in _vectors(batches, width):
            rows = len(x)
            y = _centred(x, centre) @ basis * np.where(spread > 0, spread, 0)
            far = np.repeat(np.array(_deviation(x, n, sums), object), shown).tolist()
            ids = batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(rows), shown)))
            void = np.tile(spread <= 0, rows)
            tail = rows_batch(_OUT, [
                np.full(rows * shown, n), far, np.tile(np.arange(1, shown + 1), rows),
                pa.array(y.ravel(), mask=void), np.tile(share, rows)])
            yield pa.record_batch([ids, *tail.columns], names=["vec_id", *tail.schema.names])
    return run


def _spread(model: Model, shown: int) -> np.ndarray:
    """One over the root of each eigenvalue; 0 where rounding is all there is."""
    e = model.eigenvalues[:shown]
    real = e > len(model.sums) * np.finfo(float).eps * max(model.trace, 0)
    return np.where(real, 1 / np.sqrt(np.where(real, e, 1)), 0.0)


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        F.col("vec_id"), whole_components(F.col("embedding"), SCALE, SHIFT, LARGEST).alias("_x")).where("_x IS NOT NULL")


def _fit(rows: DataFrame) -> Model | None:
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("_x"))).first()
    if not n or not width:
        return None
    parts = cut(rows.mapInArrow(_local(width), _SPECTRUM), "spectra")
    while parts.count() > 1:
        parts = cut(parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(_combine, _SPECTRUM), "spectra")
    sums = [0] * width
    for dim, total in rows.mapInArrow(_sums(width), "dim int, total string").groupBy("dim").agg(
            F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        sums[dim] = int(total)
    # The basis is made orthonormal to the last digit before it is refined.
    basis = np.linalg.qr(Spectrum.of(parts.first().asDict()).basis[:, ::-1])[0]
    ritz = _matrix_of(rows.mapInArrow(_products(width, n, sums, basis, np.ones(width)), "i int, j int, total double"), width) / n
    values, turn = np.linalg.eigh(ritz)
    return Model(n, sums, basis @ turn[:, ::-1], values[::-1], float(np.trace(ritz)))


def fit(vectors: DataFrame) -> Model | None:
    """Mean, components and eigenvalues over all usable vectors; None without any."""
    return _fit(cut(_usable(vectors), "vectors"))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row (vec_id, embedding; other columns are
    ignored): a row per vector and component with n, deviation, component, whitened,
    explained and identity_error.

    Entries c become floor(1024 * c) + 100000. Vectors that are NULL or hold an entry
    that is NULL, not finite or of a magnitude of 2**40 or more after that go; repeated
    rows and ids count and are returned as often as they come, a NULL id as NULL. What a
    shorter vector lacks counts as zero (as an integer component). A component without
    spread (all vectors alike, or fewer than there are components) has whitened NULL and
    is left out of identity_error; deviation is NULL where it exceeds a long. Empty
    tables give no rows.
    """
    rows = cut(_usable(vectors), "vectors")
    model = _fit(rows)
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, {', '.join(_OUT.split(', '))}"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema + ", identity_error double")
    width = len(model.sums)
    shown = min(components, width)
    spread = _spread(model, shown)
    real = np.flatnonzero(spread > 0)
    measured = rows.mapInArrow(
        _products(width, model.n, model.sums, model.components[:, real], spread[real]), "i int, j int, total double")
    error = float(np.abs(_matrix_of(measured, len(real)) / model.n - np.eye(len(real))).max(initial=0.0)) if len(real) else 0.0
    return rows.mapInArrow(_whiten(model, shown), schema).withColumn("identity_error", F.lit(error))
