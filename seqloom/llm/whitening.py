"""Whitening of embeddings by an incremental eigendecomposition.

Entries become whole numbers ``floor(scale * c) + offset``. The fit list holds each distinct vector once. A
task carries the mean and the spectrum of the vectors it has seen. A new vector adds a centred rank-one
matrix to their scatter: the eigenvalues move to the roots of the secular equation, components that the
vector does not touch, or of equal eigenvalues, are deflated. Spectra are combined in a tree of bounded
fan-in, again by rank-one updates, one for each eigenvector of the other spectrum and one for the distance
of the means. A Rayleigh-Ritz step over the whole fit list then refines the basis: the exactly centred
vectors are projected, their covariance in the basis is summed in the same tree, and its eigenvectors turn
the basis. The covariance of the whitened fit list is measured in one more pass.

A task holds one spectrum (the square of the dimension) and one Arrow batch; the driver gets one spectrum.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, so are
vectors of another length than most (of equally frequent lengths the longest stays); an entry beyond a long
becomes the nearest long. Repeated rows and repeated ids are each returned. A component without variance
(one distinct vector, or fewer than the dimensions span) has a null ``whitened``; ``explained`` is null where
no component has any. ``deviation`` is exact; it is null where a long cannot hold it, and
``deviation_exact``, a decimal, has it always. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

FAN_IN = 16  # states that one task of the tree combines
STEPS = 60  # of the root finder; it ends after about six
EPS = np.finfo(np.float64).eps

# the secular equation


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (d - x)) = 0`` for rising, distinct ``d`` and positive ``z2``.

    Returns the roots and the matrix ``d[j] - root[i]``, which is formed from the distance to the pole that
    is nearest, so that small distances keep their digits.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    rows = np.arange(k)
    left = np.tri(k, dtype=np.float64)  # the poles up to the root's own
    gap = upper - d
    middle = 1 + (z2 / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    near_upper = middle < 0
    near_upper[-1] = False
    origin = np.where(near_upper, upper, d)
    poles = d[None, :] - origin[:, None]
    low = np.where(near_upper, -gap / 2, 0.0)
    high = np.where(near_upper, 0.0, np.where(rows == k - 1, gap, gap / 2))
    own, other = d - origin, upper - origin
    x = (low + high) / 2
    for _ in range(STEPS):
        delta = poles - x[:, None]
        part = z2 / delta
        slope = part / delta
        psi, dpsi = np.einsum("ij,ij->i", part, left), np.einsum("ij,ij->i", slope, left)
        phi, dphi = part.sum(1) - psi, slope.sum(1) - dpsi
        f = 1 + psi + phi
        done = np.abs(f) <= 8 * EPS * k * (1 + np.abs(psi) + np.abs(phi))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        # both sums as one pole each, with the same value and slope
        d1, d2 = own - x, other - x
        s, t = d1 * d1 * dpsi, d2 * d2 * dphi
        c = f - d1 * dpsi - d2 * dphi
        a, b = c * (d1 + d2) + s + t, c * d1 * d2 + s * d2 + t * d1
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = d1[-1] + s[-1] / (f[-1] - d1[-1] * dpsi[-1])
        new = x + step
        inside = (new > low) & (new < high)
        new = np.where(inside, new, (low + high) / 2)
        x, moved = np.where(done, x, new), np.abs(new - x) > EPS * np.abs(new)
        if not (moved & ~done).any():
            break
    return origin + x, poles - x[:, None]


@dataclass
class Spectrum:
    """Mean and scatter matrix of ``n`` vectors, the matrix as rising eigenvalues and eigenvectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.zeros(size), np.eye(size))

    def rank_one(self, v: np.ndarray) -> None:
        """Add the matrix ``v v'`` to the scatter."""
        z = self.vectors.T @ v
        size = float(np.sqrt(z @ z))
        if size == 0:
            return
        d, basis = self.values, self.vectors
        scale = max(abs(d[-1]), size * size)
        # of equal eigenvalues one direction takes the whole of z
        same = np.diff(d) <= 4 * EPS * scale
        if same.any():
            starts = np.flatnonzero(np.append(True, ~same))
            for lo, hi in zip(starts, np.append(starts[1:], len(d))):
                part = z[lo:hi]
                norm = np.sqrt(part @ part)
                if hi - lo > 1 and norm > 0:
                    mirror = part.copy()
                    sign = 1.0 if part[-1] >= 0 else -1.0
                    mirror[-1] += sign * norm
                    basis[:, lo:hi] -= np.outer(basis[:, lo:hi] @ mirror, mirror) * (2 / (mirror @ mirror))
                    z[lo:hi] = 0
                    z[hi - 1] = -sign * norm
        live = np.abs(z) * size > 2 * EPS * scale
        if live.any():
            at = np.flatnonzero(live)
            dk = d[at]
            roots, delta = _roots(dk, z[at] ** 2)
            # the z for which these roots are exact keeps the new vectors orthogonal
            ratio = dk[None, :] - dk[:, None]
            np.fill_diagonal(ratio, -1.0)
            z2 = np.prod(delta / ratio, axis=0)  # (root_i - d_j) / (d_i - d_j), and root_j - d_j
            fitted = np.sqrt(np.abs(z2)) * np.where(z[at] < 0, -1.0, 1.0)
            turn = fitted[:, None] / delta.T
            turn /= np.sqrt(np.einsum("ij,ij->j", turn, turn))
            if len(at) == len(d):
                basis, d = basis @ turn, roots
            else:
                basis[:, at] = basis[:, at] @ turn
                d = d.copy()
                d[at] = roots
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], basis[:, order]

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update by its distance from the mean so far."""
        away = x - self.mean
        self.rank_one(away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """The vectors of another spectrum: a rank-one update for each of its eigenvectors, one for the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.rank_one(vector * np.sqrt(value))
        total = self.n + other.n
        away = other.mean - self.mean
        self.rank_one(away * np.sqrt(self.n * other.n / total))
        self.mean = self.mean + away * (other.n / total)
        self.n = total

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @staticmethod
    def unpack(data: bytes, size: int) -> Spectrum:
        flat = np.frombuffer(data)
        mean, values = flat[1 : 1 + size].copy(), flat[1 + size : 1 + 2 * size].copy()
        return Spectrum(int(flat[0]), mean, values, flat[1 + 2 * size :].reshape(size, size).copy())


# Spark jobs

_STATE = pa.schema([("part", pa.int64()), ("state", pa.binary())])


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _fold(rows: DataFrame, start: Callable, step: Callable, merge: Callable) -> bytes | None:
    """One state for the whole table: each task folds its batches, a tree of written tables combines them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = step(start() if state is None else state, batch.column(0))
        if state is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([state[1](state[0])], pa.binary())], schema=_STATE)

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        whole = merge(table.column("state").to_pylist())
        return pa.table([pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int64()), pa.array([whole], pa.binary())], schema=_STATE)

    states = materialize(rows.mapInArrow(run, "part long, state binary"), "states")
    while states.limit(2).count() > 1:
        grouped = states.groupBy(F.floor(F.col("part") / FAN_IN))
        states = materialize(grouped.applyInArrow(combine, "part long, state binary"), "states")
    last = states.first()
    return bytes(last["state"]) if last else None


def spectrum(fit: DataFrame, size: int) -> Spectrum | None:
    """The spectrum of the column ``x`` of ``fit`` by rank-one updates alone."""

    def step(state: tuple, column: pa.ListArray) -> tuple:
        for x in _matrix(column, size).astype(np.float64):
            state[0].add(x)
        return state

    def merge(states: list[bytes]) -> bytes:
        whole = Spectrum.unpack(states[0], size)
        for other in states[1:]:
            whole.merge(Spectrum.unpack(other, size))
        return whole.pack()

    packed = _fold(fit, lambda: (Spectrum.empty(size), Spectrum.pack), step, merge)
    return Spectrum.unpack(packed, size) if packed else None


def _covariance(fit: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int, centre: bool = False) -> np.ndarray:
    """Covariance, divisor ``n``, of the vectors less ``mean`` in the basis; ``centre`` also takes off what mean they have left."""
    size, width = basis.shape

    def step(state: tuple, column: pa.ListArray) -> tuple:
        y = (_matrix(column, size) - mean) @ basis
        return np.vstack([state[0][:-1] + y.T @ y, state[0][-1:] + y.sum(0)]), state[1]

    start = lambda: (np.zeros((width + 1, width)), lambda a: a.tobytes())
    merge = lambda states: np.sum([np.frombuffer(s) for s in states], axis=0).tobytes()
    total = np.frombuffer(_fold(fit, start, step, merge)).reshape(width + 1, width) / n
    return total[:-1] - np.outer(total[-1], total[-1]) if centre else total[:-1]


@dataclass
class Whitening:
    """``components`` are columns, by falling eigenvalue; ``sums`` are exact sums over the ``n`` vectors of the fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # whole numbers are divided exactly and rounded once

    @property
    def usable(self) -> np.ndarray:
        """Whether a component has variance beyond rounding."""
        return self.values > 64 * EPS * len(self.sums) * max(self.trace, 0)


def integer_vectors(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = 256, offset: int = 0) -> DataFrame:
    """``vec_id, x`` of the rows whose vectors take part."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    given = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    whole = given.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", entry))
    return whole.select("vec_id", F.transform("c", lambda c: F.floor(c * scale) + F.lit(offset).cast("long")).alias("x"))


def usual_length(vectors: DataFrame) -> int | None:
    """The most frequent length of ``x``, of several the largest."""
    lengths = vectors.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    first = lengths.orderBy(F.desc("rows"), F.desc("size")).first()
    return first["size"] if first else None


def fit(vectors: DataFrame, size: int, keep: int = 4) -> Whitening:
    """Fit on the distinct vectors ``x`` of length ``size``."""
    distinct = materialize(vectors.select("x").distinct(), "fit-list")
    n = distinct.count()
    sums = distinct.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    model = Whitening(n, [int(r["s"]) for r in sums.orderBy("j").collect()], np.empty((size, 0)), np.empty(0), 0.0, None)
    rough = spectrum(distinct, size)
    ritz = _covariance(distinct, model.mean, rough.vectors, n)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    basis = np.linalg.qr(rough.vectors @ turn[:, ::-1])[0]
    model.trace, model.values = float(np.trace(ritz)), values[::-1][:keep].copy()
    model.components = basis[:, :keep].copy()
    good = model.usable
    if good.any():
        whitened = _covariance(distinct, model.mean, model.components[:, good] / np.sqrt(model.values[good]), n, centre=True)
        model.identity_error = float(np.abs(whitened - np.eye(good.sum())).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of ``(n x - S)^2``, exactly."""
    most = n * max(1, int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + max(map(abs, sums))
    if most * most * len(sums) < 1 << 63:
        t = x * n - np.array(sums, dtype=np.int64)
        return np.einsum("ij,ij->i", t, t).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row for each vector and component."""
    keep, size = model.components.shape[1], len(model.sums)
    good = model.usable
    weights = model.components / np.sqrt(np.where(good, model.values, 1.0))
    mean = model.mean
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    schema = pa.schema(
        [
            ("vec_id", pa.int64()),
            ("component", pa.int32()),
            ("n", pa.int64()),
            ("deviation", pa.int64()),
            ("whitened", pa.float64()),
            ("explained", pa.float64()),
            ("identity_error", pa.float64()),
            ("deviation_exact", pa.decimal128(38, 0)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch.column(1), size)
            exact = _deviations(x, model.n, model.sums)
            fits = [v if v < 1 << 63 else None for v in exact]
            whitened = (x - mean) @ weights
            at = np.repeat(np.arange(rows), keep)
            columns = [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * keep, model.n, dtype=np.int64)),
                pa.array(fits, pa.int64()).take(pa.array(at)),
                pa.array(whitened.ravel(), mask=np.tile(~good, rows)),
                pa.array(explained * rows, pa.float64()),
                pa.array([model.identity_error] * (rows * keep), pa.float64()),
                pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)).take(pa.array(at)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, f"{kinds}, deviation_exact decimal(38,0)")


def whiten(rows: DataFrame, keep: int = 4, **columns: str | int) -> DataFrame:
    """The whitened components of every row, from a fit on the whole table."""
    vectors = integer_vectors(rows, **columns)
    size = usual_length(vectors)
    if size is None:
        nothing = vectors.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"))
        return nothing.selectExpr(
            "*", "cast(0 as double) whitened", "cast(0 as double) explained", "cast(0 as double) identity_error", "cast(0 as decimal(38,0)) deviation_exact"
        ).where("false")
    vectors = vectors.where(F.size("x") == size)
    return transform(vectors, fit(vectors, size, keep))
