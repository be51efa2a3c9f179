"""Centroid clustering in integers, with candidates filtered in a PCA rotation.

A vector x is rotated to principal axes. Stored with it are its LEADING first rotated coordinates and the norm of what is left. For a centroid c, the squared distance of the leading
coordinates plus the squared difference of the residual norms is at most |x - c|^2 (triangle inequality in the remaining axes), so centroids whose bound exceeds the distance to the nearest
by bound can't be nearest. The survivors are verified in integers, ties go to the smaller number. Coordinates are stored as floats; the bound is lowered by SLACK of the squared norms, above their rounding, so
no centroid is lost. Any rotation gives the same result; how few survive depends on it.

Vectors are written once, with their coordinates, to the shared folder. A round is a pass over them: tasks send sums and counts by cluster (clusters x components numbers each),
Spark adds them, and the centroids, clusters x components integers, are what the driver holds.

Defined cases: vectors with another number of components, null ones, and ones with a null, NaN or infinite component are left out and have no row. Vectors of one id each have a row; null ids count as the empty text in the
hash that picks the first centroids, and equal hashes are ordered by the components. Where fewer vectors are kept than clusters, each is a centroid. Components beyond 2^27 after scaling are held at that, so that
distances fit a long. Other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.columns import clipped
from tarnlake.llm.staging import quoted, staged

#: Rotated coordinates stored with a vector.
LEADING = 16
SLACK = 1e-6
#: Components are held within this, so that the squared distance of 64 of them is under 2^62.
MOST = 1 << 27
#: Cells of (vector, centroid) bounds, and of verified differences, that a task holds at once.
CELLS = 1 << 20


def integer_vectors(table: DataFrame, id_column: str, vector_column: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v): the kept vectors, components floor(scale * x)."""
    x = F.col(quoted(vector_column)).cast("array<double>")
    rows = table.select(F.col(quoted(id_column)).alias("id"), x.alias("x")).filter(F.size("x") == dimensions)
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform("x", lambda c: F.floor(clipped(c * scale, -float(MOST), float(MOST))).cast("int"))
    return rows.filter(sound).select("id", held.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as int64 rows or float rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def principal_axes(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Orthonormal axes as columns, by falling variance, from second moments of all vectors; tasks send one number for each pair of components."""
    at = np.triu_indices(dimensions + 1)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions + 1))
        for batch in batches:
            x = matrix(batch.column(0)).astype(float)
            if len(x):
                one = np.column_stack([np.ones(len(x)), x])
                total += one.T @ one
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0])), pa.int32()), pa.array(total[at])], names=["cell", "s"])

    sums = np.zeros((dimensions + 1, dimensions + 1))
    for r in vectors.select("v").mapInArrow(moments, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        sums[at[0][r["cell"]], at[1][r["cell"]]] = sums[at[1][r["cell"]], at[0][r["cell"]]] = r["s"]
    n = max(1.0, sums[0, 0])
    _, axes = np.linalg.eigh(sums[1:, 1:] / n - np.outer(sums[0, 1:], sums[0, 1:]) / n**2)
    return axes[:, ::-1]


def rotated(x: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the residual of each row."""
    y = x.astype(float) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(axis=1))


def with_coordinates(vectors: DataFrame, axes: np.ndarray, leading: int) -> DataFrame:
    """(id, v, lead, rest): vectors with what the filter needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotated(matrix(batch.column(1)), axes, leading) if batch.num_rows else (np.zeros((0, leading)), np.zeros(0))
            offsets = pa.array(np.arange(0, (len(rest) + 1) * leading, leading), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(lead.ravel().astype(np.float32))), pa.array(rest.astype(np.float32))], names=["id", "v", "lead", "rest"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, v array<int>, lead array<float>, rest float")


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x: the nearest centroid, the smaller number of equals, its squared distance, and how many centroids were verified."""
    n, k = len(x), len(centroids)
    c_lead, c_rest = rotated(centroids, axes, lead.shape[1])
    c_norm = np.sqrt((c_lead**2).sum(axis=1) + c_rest**2)
    cluster, distance, verified = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    step = max(1, CELLS // max(1, k))
    for a in range(0, n, step):
        own, y, r = x[a : a + step].astype(np.int64), lead[a : a + step].astype(float), rest[a : a + step].astype(float)
        m = len(own)
        bound = (y**2).sum(axis=1)[:, None] + (c_lead**2).sum(axis=1)[None, :] - 2 * (y @ c_lead.T) + (r[:, None] - c_rest[None, :]) ** 2
        bound -= SLACK * (np.sqrt((y**2).sum(axis=1) + r**2)[:, None] + c_norm[None, :]) ** 2
        first = bound.argmin(axis=1)
        most = ((own - centroids[first]) ** 2).sum(axis=1)
        row, c = np.nonzero(bound <= most.astype(float)[:, None] * (1 + 1e-12))
        exact = np.empty(len(row), np.int64)
        each = max(1, CELLS // max(1, x.shape[1]))
        for b in range(0, len(row), each):
            exact[b : b + each] = ((own[row[b : b + each]] - centroids[c[b : b + each]]) ** 2).sum(axis=1)
        order = np.lexsort((c, exact, row))
        begins = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]]))
        cluster[a : a + m], distance[a : a + m] = c[order][begins], exact[order][begins]
        verified[a : a + m] = np.bincount(row, minlength=m)
    return cluster, distance, verified


def _new_centroids(stored: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Floors of the means of the vectors nearest to each centroid; a centroid without vectors stays."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0)).astype(np.int64)
                cluster, _, _ = nearest(x, matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False), centroids, axes)
                np.add.at(sums, cluster, x)
                counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        at = np.arange(d + 1)
        cell = (some[:, None] * (d + 1) + at[None, :]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.column_stack([counts[some], sums[some]]).ravel(), pa.int64())], names=["cell", "s"])

    total: dict[int, int] = {r["cell"]: int(r["s"]) for r in stored.select("v", "lead", "rest").mapInArrow(run, "cell long, s long").groupBy("cell").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # k * (d + 1) rows
    out = centroids.copy()
    for c in range(k):
        if n := total.get(c * (d + 1), 0):
            out[c] = [total[c * (d + 1) + 1 + i] // n for i in range(d)]
    return out


def first_centroids(stored: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose `seed:id` has the smallest SHA-256, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in stored.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()], dtype=np.int64)


def clustered(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2, leading: int = LEADING) -> DataFrame:
    """Per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and n_verified, the centroids that passed the filter in the last assignment. See the module's text."""
    spark = table.sparkSession
    vectors = integer_vectors(table, id_column, vector_column, dimensions, scale)
    axes = principal_axes(vectors, dimensions)
    stored = staged(with_coordinates(vectors, axes, leading), "rotated-vectors")
    kind = stored.schema["id"].dataType.simpleString()
    centroids = first_centroids(stored, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_verified int").withColumnRenamed("id", id_column)
    for _ in range(rounds):
        centroids = _new_centroids(stored, centroids, axes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance, n = nearest(matrix(batch.column(1)).astype(np.int64), matrix(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False), centroids, axes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(n, pa.int32())], names=["id", "cluster", "distance", "n_verified"])

    found = staged(stored.mapInArrow(assign, f"id {kind}, cluster int, distance long, n_verified int"), "assigned-vectors")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a cluster
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), shas[c]) for c, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_verified")
