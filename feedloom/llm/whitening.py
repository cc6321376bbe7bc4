"""Embedding whitening by spectral divide and conquer with QDWH polar decompositions.

Fit. Entries become whole numbers floor(256 c), and each distinct vector counts once. Partitions add up exact sums per
dimension, then, centred by the mean, products of dimensions; only these d x d sums are shuffled.

Components, on the driver, from the d x d covariance V (``MOST_DIMENSIONS`` bounds d). V - s I = U H is decomposed by
QDWH, the dynamically weighted Halley iteration: at most about six steps by QR or Cholesky, backward stable, no shifts.
U has the eigenvalue 1 on the eigenvectors above s and -1 below, so (U + I) / 2 projects on an invariant
subspace. A basis of it and of its complement splits V into two smaller blocks, which are split in turn until they have
one row; only blocks that can hold one of the wanted components are. s is the mean of the block's eigenvalues, which
parts them unless they are all equal; if it hits one, so that U is not whole, another s is tried.

Whitening. Means, components and eigenvalues are broadcast, d x (k + 2) numbers, and each row is projected where it is.

Defined cases: a vector that is null, or holds a null or an entry that is not finite, is dropped. Vectors of different lengths
are fitted and whitened apart, as there is no covariance between them; an empty vector has no component. A
component without variance (eigenvalue within rounding of 0, as for one single vector) has whitened null and explained 0, or
null if there is no variance at all. deviation is null where it exceeds a long. Repeated rows and ids are each a row, null
ids too. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import landed, table

COMPONENTS = 4
SCALE = 256
MOST_DIMENSIONS = 8192
EPS = np.finfo(float).eps


# ---------------------------------------------------------------- linear algebra of one d x d block


def polar(a: np.ndarray, most_steps: int = 20) -> np.ndarray | None:
    """Unitary polar factor of a symmetric matrix by QDWH; None if the matrix is singular."""
    size, scale = len(a), np.linalg.norm(a, 2)
    try:
        inverse = np.linalg.norm(np.linalg.inv(a / scale)) if scale else np.inf
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(inverse):
        return None
    # A lower bound of the smallest singular value, which each step brings nearer to 1.
    low, x, one = min(1.0, 0.9 / inverse), a / scale, np.eye(size)
    for _ in range(most_steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        weight_a = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        weight_b = (weight_a - 1) ** 2 / 4
        weight_c = weight_a + weight_b - 1
        before, ratio = x, weight_b / weight_c
        if weight_c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(weight_c) * x, one]))
            x = ratio * x + (weight_a - ratio) / np.sqrt(weight_c) * q[:size] @ q[size:].T
        else:
            # Well conditioned by now: Cholesky of I + c X'X, a third of the work.
            lower = np.linalg.cholesky(one + weight_c * x.T @ x)
            half = np.linalg.solve(lower, x.T)
            x = ratio * x + (weight_a - ratio) * np.linalg.solve(lower.T, half).T
        x = (x + x.T) / 2
        low = min(1.0, low * (weight_a + weight_b * square) / (1 + weight_c * square))
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) < np.cbrt(EPS) * np.sqrt(size):
            break
    return x


def halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below a shift; None if all eigenvalues are equal."""
    size = len(a)
    mean, spread = np.trace(a) / size, np.linalg.norm(a - np.trace(a) / size * np.eye(size), 2)
    if spread <= 4 * size * EPS * scale:
        return None
    random = np.random.default_rng(size)
    # Other shifts only if the mean hits an eigenvalue.
    for shift in [mean, *(mean + spread * x for x in random.uniform(-0.2, 0.2, 20))]:
        unitary = polar(a - shift * np.eye(size))
        if unitary is None or np.linalg.norm(unitary @ unitary - np.eye(size)) > 1e-8:
            continue
        projector = (unitary + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size:
            continue
        # Any vectors, projected, span the range; twice, as the first time may be ill conditioned.
        basis = random.standard_normal((size, rank))
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ basis)
        whole, _ = np.linalg.qr(np.hstack([basis, random.standard_normal((size, size - rank))]))
        above, below = whole[:, :rank], whole[:, rank:]
        if np.linalg.norm(below.T @ a @ above) <= 100 * size * EPS * scale:
            return above, below
    raise ArithmeticError("no shift parts the eigenvalues")


def components(a: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the largest eigenvalues of a symmetric matrix, falling."""
    a = (a + a.T) / 2
    wanted, scale = min(wanted, len(a)), np.linalg.norm(a, 2) if len(a) else 0.0

    def split(block: np.ndarray, basis: np.ndarray, most: int) -> list[np.ndarray]:
        """Bases of single eigenvectors, those of large eigenvalues first; at least ``most``, or all."""
        parts = halves(block, scale) if len(block) > 1 else None
        if parts is None:
            return [basis]
        found: list[np.ndarray] = []
        for part in parts:
            left = most - sum(x.shape[1] for x in found)
            if left > 0:
                inner = part.T @ block @ part
                found += split((inner + inner.T) / 2, basis @ part, left)
        return found

    vectors = np.hstack(split(a, np.eye(len(a)), wanted)) if wanted else np.zeros((len(a), 0))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


# ---------------------------------------------------------------- sums over the table


@dataclass(frozen=True)
class Fit:
    """What whitening vectors of one length needs."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Components that have variance."""
        return self.values > 8 * len(self.sums) * EPS * max(self.trace, 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections of whole-number vectors, NaN where a component has no variance."""
        spread = np.sqrt(np.where(self.live, self.values, np.nan))
        return (x - self.sums / self.n) @ self.vectors / spread

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of (n x - S)^2, whether they fit a long). Long arithmetic wraps, so a sum that fits is exact."""
        about = ((self.n * x.astype(float) - self.sums.astype(float)) ** 2).sum(1)
        return ((self.n * x - self.sums) ** 2).sum(1), about < 9.2e18


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of the column x of a batch, for each length in it."""
    lists = batch.column("x")
    ends, flat = np.asarray(lists.offsets).astype("i8"), np.asarray(lists.values)
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, flat[ends[rows][:, None] + np.arange(size)]


def whole_numbers(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite entries, with x, the entries as floor(256 c)."""
    finite = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    kept = rows.where(F.col(column).isNotNull() & finite)
    return kept.withColumn("x", F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE)))))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for size, _, x in _vectors(batch):
            n, sums = total.get(size, (0, np.zeros(size, "i8")))
            total[size] = [n + len(x), sums + x.sum(0)]
    sizes = sorted(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(sizes, pa.int32()), pa.array([total[s][0] for s in sizes], pa.int64()), pa.array([total[s][1] for s in sizes], pa.list_(pa.int64()))],
        names=["size", "n", "sums"],
    )


def _products(means: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for size, _, x in _vectors(batch):
                if size:
                    centred = x - means[size]
                    total[size] = total.get(size, 0) + centred.T @ centred
        rows = [(size, i, row) for size, products in total.items() for i, row in enumerate(products)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
            names=["size", "i", "row"],
        )

    return run


def fit(vectors: DataFrame, wanted: int = COMPONENTS) -> dict[int, Fit]:
    """Fits of the distinct whole-number vectors (column x), by length. The result holds at most d x (k + 1) numbers for each."""
    sums = vectors.mapInArrow(_sums, "size int, n long, sums array<bigint>")
    counts = {r["size"]: r["n"] for r in sums.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    if counts and max(counts) > MOST_DIMENSIONS:
        raise ValueError(f"{max(counts)} dimensions; the driver solves at most {MOST_DIMENSIONS}")
    each = sums.select("size", F.posexplode("sums").alias("i", "s")).groupBy("size", "i").agg(F.sum("s").alias("s")).collect()
    total = {size: np.zeros(size, "i8") for size in counts}
    for r in each:
        total[r["size"]][r["i"]] = r["s"]
    means = {size: total[size] / counts[size] for size in counts}
    products = vectors.mapInArrow(_products(means), "size int, i int, row array<double>")
    # A row of each task's products has a number for each dimension; they meet per place.
    cells = products.select("size", "i", F.posexplode("row").alias("j", "v")).where("j >= i")
    cells = cells.groupBy("size", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    size_of, row_of, column_of, value_of = (cells[name].to_numpy() for name in ("size", "i", "j", "v"))
    fits = {}
    for size, n in counts.items():
        own = size_of == size
        covariance = np.zeros((size, size))
        covariance[row_of[own], column_of[own]] = covariance[column_of[own], row_of[own]] = value_of[own] / n
        values, axes = components(covariance, wanted)
        fits[size] = Fit(n, total[size], values, axes, float(np.trace(covariance)))
    return fits


def identity_errors(vectors: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """Largest difference from the identity of the covariance of the whitened fit list, by length."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)
    most = max((len(f.values) for f in fits.values()), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, x in _vectors(batch):
                held = shared.value[size]
                found = held.whitened(x)[:, held.live]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), size, "i4")), pa.array(list(found), pa.list_(pa.float64()))], names=["size", "w"]
                )

    rows = vectors.mapInArrow(run, "size int, w array<double>")
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    # Spark's covariance moves its means along, so that products are of centred numbers.
    cells = [F.abs(F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) - F.lit(float(i == j))) for i, j in pairs]
    found = rows.groupBy("size").agg(F.array_max(F.array(*cells, F.lit(None).cast("double"))).alias("error"))
    return {r["size"]: r["error"] for r in found.collect()}


def whiten(rows: DataFrame, wanted: int = COMPONENTS, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kept = whole_numbers(rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(column).alias("embedding"))).select("vec_id", "x")
    vectors = landed(kept.select("x").distinct(), "distinct-vectors")
    fits = fit(vectors, wanted)
    errors = identity_errors(vectors, fits)
    shared = rows.sparkSession.sparkContext.broadcast((fits, errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, errors = shared.value
        for batch in batches:
            for size, at, x in _vectors(batch):
                held = fits[size]
                k = len(held.values)
                whitened, (deviation, fitting) = held.whitened(x), held.deviation(x)
                explained = np.where(held.live, held.values, 0) / held.trace if held.trace > 0 else np.full(k, np.nan)
                error = errors.get(size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(at))),
                        pa.array(np.full(len(at) * k, held.n, "i8")),
                        pa.array(np.repeat(deviation, k), mask=np.repeat(~fitting, k)),
                        pa.array(whitened.ravel(), from_pandas=True),
                        pa.array(np.tile(explained, len(at)), from_pandas=True),
                        pa.array([error] * (len(at) * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return kept.mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
