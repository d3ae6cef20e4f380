"""Whitening of vectors onto their principal components, which a contour-integration eigensolver extracts.

The covariance comes from two passes: exact sums first, then products of the centred entries. Its leading eigenpairs are found interval by interval.
Inertia counts (signs of the pivots of a symmetric factorisation of the shifted covariance) say how many eigenvalues lie above a shift;
bisection cuts the spectrum into intervals of few eigenvalues whose borders lie in gaps. For each interval a Gauss-Legendre quadrature over
a circle around it, one complex shifted solve a node, projects random vectors onto the interval's eigenspace; Rayleigh-Ritz extracts the pairs
from the projected basis; both are repeated until residuals vanish, and until as many pairs are found as the inertia counts ask for.

Work on rows is done by Spark in passes over the vectors; the driver holds matrices of the vectors' dimension alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
NODES = 8
"""Quadrature nodes of the upper half circle; the lower half mirrors them."""
FEW = 8
"""Eigenvalues of an interval, unless they are too close to be told apart."""
ROUNDS = 40
LARGEST = float(1 << 31)
"""Vectors with an entry whose 64-fold exceeds this take no part: their centred entries may exceed a long."""


# ---- eigensolver --------------------------------------------------------------------------------------------------
def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above *shift*: positive pivots of a symmetric factorisation with blocks of one or two rows, pivoted over the whole rest."""
    rest = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(rest):
        size = len(rest)
        diagonal = np.abs(np.diag(rest))
        i = int(diagonal.argmax())
        off = np.abs(np.triu(rest, 1))
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[i] >= 0.64 * off[p, q]:
            if diagonal[i] == 0:
                break  # what is left is zero: eigenvalues equal to the shift
            above += rest[i, i] > 0
            stays = np.delete(np.arange(size), i)
            column = rest[stays, i]
            rest = rest[np.ix_(stays, stays)] - np.outer(column, column) / rest[i, i]
        else:  # an indefinite block has one positive and one negative eigenvalue
            above += 1
            stays = np.delete(np.arange(size), [p, q])
            block = rest[np.ix_([p, q], [p, q])]
            columns = rest[np.ix_(stays, [p, q])]
            rest = rest[np.ix_(stays, stays)] - columns @ np.linalg.solve(block, columns.T)
    return above


def gap_near(matrix: np.ndarray, low: float, high: float, width: float) -> tuple[float, int]:
    """A shift between *low* and *high* with an empty surrounding as wide as can be had, and the eigenvalues above it."""
    while True:
        for share in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
            shift = low + share * (high - low)
            if (n := count_above(matrix, shift - width)) == count_above(matrix, shift + width):
                return shift, n
        width /= 8


def intervals(matrix: np.ndarray, wanted: int, norm: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) from the top of the spectrum downwards, until *wanted* eigenvalues are covered."""
    floor, roof = -1e-3 * norm, 1.001 * norm  # a covariance has no negative eigenvalue
    todo, out, covered = [(floor, roof, count_above(matrix, floor))], [], 0
    while todo and covered < wanted:
        low, high, n = todo.pop()
        if not n:
            continue
        if n <= FEW or high - low < 1e-9 * norm:
            out.append((low, high, n))
            covered += n
            continue
        above_high = count_above(matrix, high)
        middle, above = gap_near(matrix, low, high, (high - low) / 64)
        todo += [(low, middle, above_high + n - above), (middle, high, above - above_high)]
    return out


def rayleigh_ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of *matrix* within the span of *basis*, whose nearly dependent directions are left out."""
    left, size, _ = np.linalg.svd(basis, full_matrices=False)
    held, _ = np.linalg.qr(left[:, size > 1e-13 * size[0]]) if len(size) and size[0] > 0 else (left[:, :0], None)
    inner = held.T @ matrix @ held
    values, turns = np.linalg.eigh((inner + inner.T) / 2)
    return values, held @ turns


def feast(matrix: np.ndarray, low: float, high: float, count: int, norm: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The *count* eigenpairs of *matrix* between *low* and *high*."""
    size = len(matrix)
    subspace = min(size, count + max(4, count // 2))
    basis = np.random.default_rng(seed).normal(size=(size, subspace))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * np.pi / 2 * (1 - points))
    best = None
    for _ in range(ROUNDS):
        projected = np.zeros_like(basis)
        for z, weight in zip(turn, weights):
            projected += weight / 2 * np.real(radius * z * np.linalg.solve((centre + radius * z) * np.eye(size) - matrix, basis.astype(complex)))
        values, vectors = rayleigh_ritz(matrix, projected)
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        if inside.sum() == count:
            worst = residual[inside].max()
            if best is not None and worst >= 0.5 * best[0]:
                break  # as good as it gets
            best = worst, values[inside], vectors[:, inside]
            if worst <= 1e-15 * norm:
                break
        basis = vectors if vectors.shape[1] == subspace else np.column_stack([vectors, np.random.default_rng(seed + 1).normal(size=(size, subspace - vectors.shape[1]))])
    if best is None or best[0] > 1e-9 * norm:
        raise ArithmeticError(f"{count} eigenvalues between {low} and {high}, but not all were found")
    return best[1], best[2]


def leading_eigenpairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The *wanted* largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns.

    Eigenvalues of no more than rounding size beside the largest are left out: the covariance is zero along their vectors.
    """
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0))
    if not norm > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    found = [feast(matrix, low, high, n, norm, seed) for seed, (low, high, n) in enumerate(intervals(matrix, wanted, norm))]
    values, vectors = rayleigh_ritz(matrix, np.column_stack([v for _, v in found]))
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], vectors[:, order]
    stays = values > len(matrix) * np.finfo(float).eps * norm
    if stays.all() and wanted < len(matrix):
        least = count_above(matrix, values[-1] + 1e-9 * norm)
        if least > wanted:
            raise ArithmeticError(f"{least} eigenvalues lie above the last of {wanted}")
    values, vectors = values[stays], vectors[:, stays]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * signs


# ---- passes over the vectors ----------------------------------------------------------------------------------------
def integers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x) for each vector length: the places of the usable vectors and their integer entries."""
    column = column.cast(pa.list_(pa.float64()))
    flat = pc.list_flatten(column)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(SCALE * values)
    fits = np.abs(values) <= LARGEST
    start = np.cumsum(size) - size
    whole = np.diff(np.concatenate([[0], np.cumsum(fits)])[np.concatenate([[0], np.cumsum(size)])]) == size
    for length in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero((size == length) & whole)
        if len(rows):
            yield length, rows, values[start[rows][:, None] + np.arange(length)].astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Fit:
    """Rows, sums and components of a fit list."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) / self.n @ self.scaled


def length_and_sums(vectors: DataFrame) -> tuple[int, int, np.ndarray]:
    """The most frequent length of a vector (of ties the larger), how many vectors have it and the exact sum of each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, rows, x in integers(batch.column("v")):
                held[length] = held.get(length, 0) + np.append(x.sum(axis=0), len(rows))
        for length, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(length + 1, length)), pa.array(np.arange(length + 1)), pa.array(sums)], ["length", "at", "total"])

    sums = vectors.mapInArrow(add, "length long, at long, total long").groupBy("length", "at").agg(F.sum("total").alias("total"))
    counts = {row["length"]: row["total"] for row in sums.filter("at = length").collect()}
    if not counts:
        return 0, 0, np.zeros(0, np.int64)
    length = max(counts, key=lambda k: (counts[k], k))
    table = sums.filter((F.col("length") == length) & (F.col("at") < length)).toArrow().sort_by("at")
    return length, counts[length], table.column("total").to_numpy().astype(np.int64)


def products(vectors: DataFrame, length: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all vectors of the outer product of *of*(x) with itself."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for n, _, x in integers(batch.column("v")):
                if n == length:
                    y = of(x)
                    total += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "total"])

    out = np.zeros((size, size))
    rows = vectors.mapInArrow(add, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
    out[i, j] = out[j, i] = rows.column("total").to_numpy()
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[int, Fit, float]:
    """Length of the vectors, their fit and the largest deviation of the whitened covariance from the identity."""
    length, n, sums = length_and_sums(vectors)
    if not n:
        return 0, Fit(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0), 0.0
    covariance = products(vectors, length, lambda x: (n * x - sums) / n, length) / n
    values, axes = leading_eigenpairs(covariance, min(components, length))
    fitted = Fit(n, sums, values, axes, float(np.trace(covariance)))
    if not len(values):
        return length, fitted, 0.0
    ones = lambda x: np.column_stack([fitted.whitened(x), np.ones(len(x))])  # noqa: E731 - the last column gives the means
    moments = products(vectors, length, ones, len(values) + 1) / n
    mean = moments[-1, :-1]
    return length, fitted, float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(len(values))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every vector on the leading principal components of all of them, scaled to unit variance.

    Entries c become floor(64 c) + 1,000,000. Returns for each usable row and component: the id, component (from 1, by falling eigenvalue), n (usable
    rows), deviation (exact sum of (n x - S)^2 over the entries; null where it exceeds a long), whitened, explained (the eigenvalue's share of the trace)
    and identity_error (largest entry of the whitened vectors' covariance minus the identity). Null and empty vectors and those with a null, a
    non-finite or an unrepresentable entry (floor(64 c) beyond 2^31) take no part, nor do vectors of another length than the most frequent one (of
    ties the larger). Components along which all vectors agree are left out, so equal vectors, like an empty table, give no rows. Null and
    repeated ids and repeated rows are whitened like any others and count as often as they occur; other columns are ignored. Vectors of any sign of a component
    are right; here its largest entry is positive.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    length, fitted, error = fit(source.select("v"), components)
    count = len(fitted.values)
    sent = vectors.sparkSession.sparkContext.broadcast(fitted)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        shares = fitted.values / fitted.trace if fitted.trace else fitted.values
        for batch in batches:
            for size, rows, x in integers(batch.column("v")):
                if size != length or not count:
                    continue
                centred = fitted.centred(x)
                fits = (centred.astype(float) ** 2).sum(axis=1) < 9e18
                deviation = pa.array((centred**2).sum(axis=1), mask=~fits)
                each = np.repeat(np.arange(len(rows)), count)
                columns = [
                    batch.column("id").take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), fitted.n)),
                    deviation.take(pa.array(each)), pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(shares, len(rows))), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = vectors.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
