"""Whitening of embeddings: leading components of their covariance by LOBPCG, whose products with blocks of vectors are Spark jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import added_up, as_lists, finite_rows, usual_length

LARGEST = 2.0**53  # entries beyond it, once scaled, count as this
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Centre:
    """The mean of integer vectors as S / n, split into whole numbers and rests, so that little is lost in taking it away."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.rest = n, [s % n for s in sums]
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([r / n for r in self.rest])

    def away(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n x - S)^2, exact; None where it is beyond a long."""
        far = x - self.whole
        most = int(np.abs(far).max(initial=0)) + 1
        if (most * self.n) ** 2 * x.shape[1] < 2**62:
            own = far * self.n - np.array(self.rest, np.int64)
            return (own * own).sum(axis=1).tolist()
        exact = (sum((int(v) * self.n - r) ** 2 for v, r in zip(row, self.rest)) for row in far)
        return [e if e < 2**63 else None for e in exact]


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def prepared(vectors: DataFrame, dims: int, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors with ``dims`` finite entries: x = floor(scale * entry) + shift as longs."""

    def run(batches):
        for batch in batches:
            at, values = finite_rows(batch.column(1), dims)
            if len(at):
                x = np.clip(np.floor(scale * values), -LARGEST, LARGEST).astype(np.int64) + shift
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), as_lists(x)], ["vec_id", "x"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, x array<long>")


def orthonormal(block: np.ndarray, against: np.ndarray | None = None, least: float = 1e-8) -> np.ndarray:
    """An orthonormal basis of what the block's columns add to ``against``; directions that add next to nothing go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # once leaves what rounding has brought in
        if against is not None and block.shape[1]:
            block = block - against @ (against.T @ block)
        if block.shape[1]:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, s > least]
    return block


def lobpcg(product, dims: int, k: int, guard: int = 8, tolerance: float = 1e-12, most_rounds: int = 500, seed: int = 3):
    """(values, vectors, residual): the ``k`` largest eigenvalues, falling, their unit vectors, and the largest residual |A v - e v| / e_1.

    ``product`` gives A times a block of vectors. In each round it is asked for the products with the current vectors, their
    residuals and the directions of the round before, all orthonormal, and the best vectors in their span (Rayleigh-Ritz) are
    taken. It ends when the residuals, which come from that round's products themselves, are certified to be within
    ``tolerance``; ``guard`` more vectors than asked for speed that up. Without that within ``most_rounds`` it is an error.
    """
    m = min(dims, k + guard)
    basis, own = orthonormal(np.random.default_rng(seed).normal(size=(dims, m))), m
    for _ in range(most_rounds):
        image = product(basis)
        small = basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1][:m], mix[:, ::-1][:, :m]
        found, image = basis @ mix, image @ mix
        residual = image - found * values
        worst = float(np.linalg.norm(residual[:, :k], axis=0).max() / values[0]) if values[0] > 0 else 0.0
        if worst <= tolerance:
            return values[:k], found[:, :k], worst
        direction = basis[:, own:] @ mix[own:]
        found, own = orthonormal(found), m  # rounding grows else, round by round
        basis = np.hstack([found, orthonormal(np.hstack([residual, direction]), found)])
    raise RuntimeError(f"residuals are at {worst:.1e} after {most_rounds} rounds")


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, tolerance: float = 1e-12, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null, empty, or hold a null or an entry that isn't finite are left out; so are those of another length than most
    (``usual_length``). Scaled entries beyond 2^53 count as that. Repeated rows count each, null ids stay. Components
    without variance (at most 1e-12 of the first one's) aren't returned, so that a single vector or equal vectors give no rows; nor
    does an empty table. Eigenvalues that are equal leave their components open: any basis of their space is right.
    ``deviation`` is null where it is beyond a long. ``identity_error`` is measured over all whitened rows.

    Other columns, whatever their names, play no part.

    The driver holds matrices of ``dims`` x 3 (components + 8) numbers; each task adds up one such matrix.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], SCHEMA)
    dims = usual_length(vectors, vector_col)
    if dims is None:
        return empty
    table = written(prepared(vectors, dims, scale, shift, id_col, vector_col), "vectors")

    def sums(batches):
        total = np.zeros((2, dims), np.int64)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            total[0] += x.sum(axis=0)
            total[1, 0] += len(x)
        return total

    first = added_up(table, sums, (2, dims), exact=True)
    if not first[1, 0]:
        return empty
    centre = Centre(first[1, 0], list(first[0]))

    def over(make, shape):
        """Sum over all centred rows of what ``make`` gives for a matrix of them."""

        def part(batches):
            return sum((make(centre.away(_matrix(batch.column(1), dims))) for batch in batches), np.zeros(shape))

        return added_up(table, part, shape)

    trace = float(over(lambda c: (c * c).sum(axis=0)[None], (1, dims)).sum()) / centre.n

    def product(block):
        return over(lambda c: c.T @ (c @ block), block.shape) / centre.n

    values, found, _ = lobpcg(product, dims, min(components, dims), tolerance=tolerance)
    real = values > 1e-12 * max(values[0], 0.0)
    if not real.any():
        return empty
    values, found = values[real], found[:, real]
    found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(len(values))] < 0, -1, 1)  # else the sign is open
    project = found / np.sqrt(values)
    k = len(values)
    spread = over(lambda c: (c @ project).T @ (c @ project), (k, k)) / centre.n
    error = float(np.abs(spread - np.eye(k)).max())

    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = _matrix(part.column(1), dims)
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), centre.n, np.int64)),
                    pa.array(centre.deviations(x), pa.int64()).take(pa.array(each)), pa.array((centre.away(x) @ project).ravel()), pa.array(np.tile(values / trace, len(x))), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    return table.mapInArrow(rows, SCHEMA)
