"""What the operators on embeddings share: rows of Arrow lists as numpy matrices, and sums of matrices over tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_rows(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): which rows of an Arrow list column hold ``dims`` finite numbers, and these as doubles."""
    right = pc.equal(pc.fill_null(pc.list_value_length(column), -1), dims)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    numbers = pc.fill_null(column.filter(right).flatten().cast(pa.float64()), float("nan"))
    values = numbers.to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    return at[finite], values[finite]


def usual_length(vectors: DataFrame, column: str) -> int | None:
    """The most frequent length of the vectors, the longer of two equally frequent ones; empty and null ones don't count."""
    n = F.size(F.col(column))
    found = vectors.where(n > 0).groupBy(n.alias("dims")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).first()
    return found["dims"] if found else None


def as_lists(matrix: np.ndarray) -> pa.Array:
    """A matrix as an Arrow array of lists, one for each row."""
    kind = pa.int64() if matrix.dtype.kind == "i" else pa.float64()
    return pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32), pa.array(matrix.ravel(), kind))


def added_up(table: DataFrame, part, shape: tuple[int, int], exact: bool = False) -> np.ndarray:
    """The sum over all tasks of ``part``, a function from a task's Arrow batches to a matrix of ``shape``.

    Each task gives one matrix, Spark adds them up element by element, and the driver gets one matrix. ``exact``: the
    elements are integers, and come as Python's.
    """

    def run(batches):
        total = part(batches)
        used = np.flatnonzero(total.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), as_lists(total[used])], ["row", "values"])

    value = F.col("value").cast("decimal(38,0)") if exact else F.col("value")
    parts = table.mapInArrow(run, f"row int, values array<{'long' if exact else 'double'}>")
    sums = parts.select("row", F.posexplode("values").alias("col", "value")).groupBy("row", "col").agg(F.sum(value).alias("value"))
    out = np.zeros(shape, object if exact else float)
    for r in sums.collect():
        out[r["row"], r["col"]] = int(r["value"]) if exact else r["value"]
    return out
