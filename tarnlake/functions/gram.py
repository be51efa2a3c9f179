"""Second moments of vectors, from one pass: tasks send a number for each pair of components, rows are never sent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def mean_and_covariance(df: DataFrame, vector: str, dimensions: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and population covariance of vectors without nulls; values are taken from those of one row, so that large offsets cost no digits."""
    first = df.select(F.col(vector).cast("array<double>")).first()
    shift = np.array(first[0] if first else [0.0] * dimensions)
    at = np.triu_indices(dimensions + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.ones(batch.num_rows), list_matrix(batch.column(0)) - shift])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0])), pa.int32()), pa.array(total[at])], names=["cell", "s"])

    sums = np.zeros((dimensions + 1, dimensions + 1))
    for r in df.select(F.col(vector).cast("array<double>")).mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():  # a row a pair of components
        sums[at[0][r["cell"]], at[1][r["cell"]]] = sums[at[1][r["cell"]], at[0][r["cell"]]] = r["s"]
    n = max(1.0, sums[0, 0])
    mean = sums[0, 1:] / n
    return int(sums[0, 0]), mean + shift, sums[1:, 1:] / n - np.outer(mean, mean)
