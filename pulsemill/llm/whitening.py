"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the number of its rows, their mean and the eigendecomposition U diag(d) U' of their scatter matrix.
A block of rows changes these by rank-one updates: the block, centred, is first brought to a triangle with the same
scatter (QR), so that a block of any length costs as many updates as there are dimensions, and one for the difference
of the means. An update d + z z' is solved through its secular equation 1 + sum z_i^2 / (d_i - x) = 0, whose roots
lie between the d_i; coordinates with a vanishing z_i, and all but one of those with equal d_i, are deflated first.
Spectra of partitions are joined the same way, one rank-one update for each eigenvector, in a tree.

Rounding in thousands of updates is removed at the end: the basis is made orthonormal and the covariance of all rows
is projected on it in one more pass over the data, which makes a small eigenproblem (Rayleigh-Ritz).

Nothing that the driver or a task holds grows with the rows: it is squares of the dimension.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulsemill.session import cut_lineage

COMPONENTS = 8
# Numbers are made integers: floor(SCALE * c) + OFFSET, held within +-LARGEST.
SCALE = 1024
OFFSET = 100_000
LARGEST = 1 << 52
# Bytes of rows that become one triangle.
BLOCK_BYTES = 32 << 20
# Spectra that one task joins.
FAN = 8
# Rayleigh-Ritz passes, and the share of the largest variance below which a component has none.
PASSES = 2
FLAT = 1e-13

_EPS = np.finfo(np.float64).eps
_LONG = (1 << 63) - 1
_SPECTRUM = "part int, n bigint, sums array<string>, mean array<double>, values array<double>, vectors array<double>"
_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim and x (array of longs) of all rows whose vector is present and finite throughout."""
    kept = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = kept.where(F.col("embedding").isNotNull() & finite)
    inside = lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))
    x = F.transform("embedding", lambda c: F.floor(inside(c)) + OFFSET)
    return kept.select("vec_id", F.size("embedding").alias("dim"), x.alias("x"))


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' for strictly ascending d and no zero in z, and d_i - x_j for each of them.

    The differences are kept apart, as distances from the nearer pole, because x_j - d_i would lose its digits.
    """
    k, square = len(d), z * z
    upper = np.append(d[1:], d[-1] + square.sum())
    gap = upper - d
    middle = 1 + (square / (d - (d + gap / 2)[:, None])).sum(axis=1)
    # The root lies in the left half where the function is positive in the middle, else its pole is the right one.
    left = (middle >= 0) | (np.arange(k) == k - 1)
    pole = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    far = d[None, :] - d[pole][:, None]  # row j: distances of all poles from the pole of root j
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, np.where(middle >= 0, gap / 2, gap), 0.0)
    for _ in range(110):
        mid = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            value = 1 + (square / (far - mid[:, None])).sum(axis=1)
        below = value < 0
        low, high = np.where(below, mid, low), np.where(below, high, mid)
        if (high - low <= 2 * _EPS * np.minimum(np.abs(low), np.abs(high))).all():
            break
    shift = (low + high) / 2
    return d[pole] + shift, far - shift[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition (ascending) of U diag(values) U' + row row'."""
    z = row @ vectors
    size = float(np.linalg.norm(z))
    if not size:
        return values, vectors
    scale = max(float(values[-1]), size * size)
    values, vectors = values.copy(), vectors.copy()
    # Deflation of equal values: turn each group so that one coordinate holds all of its z.
    same = np.flatnonzero(np.append(True, np.diff(values) > 8 * _EPS * scale))
    ends = np.append(same[1:], len(values))
    for a, b in zip(same, ends):
        if b - a > 1 and (norm := np.linalg.norm(z[a:b])) > 0:
            mirror = z[a:b].copy()
            mirror[-1] += norm if mirror[-1] >= 0 else -norm
            mirror /= np.linalg.norm(mirror)
            vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ mirror, mirror)
            turned = z[a:b] - 2 * (z[a:b] @ mirror) * mirror
            z[a:b] = 0
            z[b - 1] = turned[-1]
    # Deflation of vanishing coordinates: their eigenpairs stay.
    live = np.flatnonzero(np.abs(z) * size > 8 * _EPS * scale)
    if not len(live):
        return values, vectors
    d, v = values[live], z[live]
    roots, apart = secular_roots(d, v)
    # The z for which the computed roots are exact makes the eigenvectors orthogonal.
    ratio = -apart  # roots - d, row j: root j
    steps = d[None, :] - d[:, None]
    np.fill_diagonal(steps, 1.0)
    over = np.sqrt(np.abs(np.prod(ratio / steps.T, axis=0)))
    exact = np.copysign(over, v)
    turn = exact[None, :] / apart
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    vectors[:, live] = vectors[:, live] @ turn.T
    values[live] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, exact sums, mean and eigendecomposition of the scatter matrix of some rows."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, [0] * dim
        self.mean, self.values, self.vectors = np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        """A block of rows (long integers)."""
        wide = np.abs(x).max(initial=0) * len(x) >= 1 << 62
        self.sums = [a + int(b) for a, b in zip(self.sums, x.astype(object).sum(axis=0) if wide else x.sum(axis=0))]
        shifted = (x - OFFSET).astype(np.float64)
        mean = shifted.mean(axis=0)
        triangle = np.linalg.qr(shifted - mean, mode="r")
        self._join(len(x), mean, triangle)

    def merge(self, other: "Spectrum") -> None:
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self._join(other.n, other.mean, np.sqrt(np.maximum(other.values, 0))[:, None] * other.vectors.T)

    def _join(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        for row in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, row)
        if self.n:
            apart = (mean - self.mean) * np.sqrt(self.n * n / (self.n + n))
            self.values, self.vectors = rank_one(self.values, self.vectors, apart)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def batch(self, part: int) -> pd.DataFrame:
        row = [part, self.n, [str(s) for s in self.sums], self.mean.tolist(), self.values.tolist(), self.vectors.ravel().tolist()]
        return pd.DataFrame([row], columns=[f.split(" ")[0] for f in _SPECTRUM.split(", ")])

    @classmethod
    def read(cls, row) -> "Spectrum":
        dim = len(row["mean"])
        out = cls(dim)
        out.n, out.sums = int(row["n"]), [int(s) for s in row["sums"]]
        out.mean, out.values = np.array(row["mean"], np.float64), np.array(row["values"], np.float64)
        out.vectors = np.array(row["vectors"], np.float64).reshape(dim, dim).copy()
        return out


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, BLOCK_BYTES // (16 * dim))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            yield piece, _matrix(piece, dim)


def spectrum(rows: DataFrame, dim: int) -> Spectrum:
    """Spectrum of all rows (x), by partitions and then in a tree of FAN at a time."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = Spectrum(dim), [], 0
        for _, x in _blocks(batches, dim):
            held.append(x)
            size += x.nbytes
            if size > BLOCK_BYTES:
                out.add(np.concatenate(held))
                held, size = [], 0
        if size:
            out.add(np.concatenate(held))
        if out.n:
            yield pa.RecordBatch.from_pandas(out.batch(TaskContext.get().partitionId()), schema=_ARROW, preserve_index=False)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        each = [Spectrum.read(r) for _, r in group.sort_values("part").iterrows()]
        for other in each[1:]:
            each[0].merge(other)
        return each[0].batch(int(group.part.min()) // FAN)

    found = cut_lineage(rows.select("x").mapInArrow(fit, _SPECTRUM), "spectra")
    parts = found.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        found = found.groupBy(F.expr(f"part div {FAN}")).applyInPandas(merge, _SPECTRUM)
        parts = -(-parts // FAN)
    return Spectrum.read(found.toPandas().iloc[0])  # one row


def projected(rows: DataFrame, sums: list[int], n: int, basis: np.ndarray) -> np.ndarray:
    """Covariance of all rows on an orthonormal basis, rows centred before they are multiplied."""
    dim = len(basis)
    shared = rows.sparkSession.sparkContext.broadcast((basis, [int(s) for s in sums], n))
    shape = np.triu_indices(dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, sums, n = shared.value
        total, seen = np.zeros((dim, dim)), False
        for _, x in _blocks(batches, dim):
            on = centred(x, sums, n) @ basis
            total += on.T @ on
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(shape[0]))), pa.array(total[shape] / n)], names=["at", "v"])

    out = np.zeros((dim, dim))
    summed = rows.select("x").mapInArrow(scan, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    at = summed.column("at").to_numpy()
    out[shape[0][at], shape[1][at]] = summed.column("v").to_numpy()
    return out + np.triu(out, 1).T


def scaled_deviation(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """n x - S, exactly."""
    if (int(np.abs(x).max(initial=0)) + 1) * n + max((abs(s) for s in sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S / n: the exact difference, rounded once, over n."""
    return scaled_deviation(x, sums, n).astype(np.float64) / n


def deviations(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """Sum of the squares of n x - S, exactly; the largest long where it is beyond that."""
    off = scaled_deviation(x, sums, n)
    if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] <= _LONG:
        return (off * off).sum(axis=1)
    return np.array([min(sum(int(c) ** 2 for c in row), _LONG) for row in off], np.int64)


def fit(rows: DataFrame, dim: int, passes: int = PASSES) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """Number of rows, sums, and all eigenvalues (falling) and eigenvectors (columns) of their covariance."""
    found = spectrum(rows, dim)
    values, basis = found.values / found.n, found.vectors
    for _ in range(passes):
        basis = np.linalg.qr(basis)[0]
        values, turn = np.linalg.eigh(projected(rows, found.sums, found.n, basis))
        basis = basis @ turn
    return found.n, found.sums, np.maximum(values[::-1], 0), basis[:, ::-1]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every row on the first components of all rows.

    embeddings: vec_id, embedding; other columns are ignored. Rows whose vector is NULL or holds a NULL or a number that
    is not finite are left out; a NULL vec_id and repeated rows stay and count. Numbers beyond +-2^52 / SCALE are taken as
    that. Vectors of different lengths have no covariance in common: each length is fitted by itself. A component
    without variance (fewer rows than dimensions, equal rows) has whitened 0 and explained 0 and does not count in identity_error.
    An empty vector has no component, an empty table no row. Returns vec_id, component (from 1), n, deviation (the largest
    long where it is beyond that), whitened, explained and identity_error (one value a length: the largest entry of
    the covariance of `whitened` less the identity).
    """
    spark = embeddings.sparkSession
    rows = cut_lineage(whole(embeddings), "vectors")
    out = None
    for (dim,) in rows.where("dim > 0").select("dim").distinct().orderBy("dim").collect():  # lengths, not rows
        one = _whitened(rows.where(F.col("dim") == dim), dim, components)
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], _OUT) if out is None else out


def _whitened(rows: DataFrame, dim: int, components: int) -> DataFrame:
    n, sums, values, basis = fit(rows, dim)
    many = min(components, dim)
    trace, first = float(values.sum()), values[:many]
    live = first > FLAT * max(trace, np.finfo(np.float64).tiny)
    factor = np.where(live, 1 / np.sqrt(np.where(live, first, 1)), 0)
    shares = np.where(live, first / trace if trace else 0.0, 0.0)
    shared = rows.sparkSession.sparkContext.broadcast((sums, basis[:, :many] * factor))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, turn = shared.value
        for piece, x in _blocks(batches, dim):
            on = centred(x, sums, n) @ turn
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, on.size + 1, many, dtype=np.int32)), pa.array(on.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), pa.array(deviations(x, sums, n)), listed], names=["vec_id", "deviation", "w"])

    found = rows.select("vec_id", "x").mapInArrow(scan, "vec_id bigint, deviation bigint, w array<double>")
    found = cut_lineage(found, "whitened")
    shape = [(i, j) for i in range(many) for j in range(i + 1)]
    products = [F.avg(F.col("w")[i] * F.col("w")[j]) for i, j in shape]
    *means, = found.agg(*[F.avg(F.col("w")[i]) for i in range(many)], *products).first()
    off = [abs(p - means[i] * means[j] - (i == j)) for (i, j), p in zip(shape, means[many:]) if live[i] and live[j]]
    explained = F.array(*[F.lit(float(s)) for s in shares])
    return found.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(float(max(off, default=0.0))).alias("identity_error"),
    )


_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("n", pa.int64()),
        ("sums", pa.list_(pa.string())),
        ("mean", pa.list_(pa.float64())),
        ("values", pa.list_(pa.float64())),
        ("vectors", pa.list_(pa.float64())),
    ]
)
