"""Texture of images: grey levels beside each other over several distances and angles, and local binary patterns. A row an image, worked on one at a time; Spark partitions the table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROPERTIES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")
SUMMARIES = {"mean": np.mean, "std": np.std, "min": np.min, "max": np.max}
DISTANCES, ANGLES = (1, 2, 3), (0.0, math.pi / 4, math.pi / 2, 3 * math.pi / 4)


def levels_of(a: np.ndarray, levels: int) -> np.ndarray:
    """Grey levels 0 to levels - 1 over an image's range, rounded down; a constant image is 0."""
    low, high = a.min(), a.max()
    return ((a - low) / (high - low) * (levels - 1)).astype(int) if high > low else np.zeros(a.shape, int)


def pair_counts(q: np.ndarray, levels: int, distance: int, angle: float, symmetric: bool = False) -> np.ndarray:
    """Counts (levels, levels) of a pixel's level and that of the pixel at this distance and angle; pairs that leave the image don't count."""
    dy, dx = round(math.sin(angle) * distance), round(math.cos(angle) * distance)
    h, w = q.shape
    own = q[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
    other = q[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    n = np.bincount((own * levels + other).ravel(), minlength=levels * levels).reshape(levels, levels) if own.shape == other.shape else np.zeros((levels, levels), int)
    return n + n.T if symmetric else n


def pair_properties(counts: np.ndarray) -> dict[str, float]:
    """Contrast, dissimilarity, homogeneity, energy (root of the sum of squared shares) and correlation (1 where either side is constant) of pair counts; 0 without pairs, but for the correlation."""
    total = counts.sum()
    p = counts / total if total else counts.astype(float)
    i, j = np.indices(p.shape)
    d = (i - j) ** 2
    mi, mj = (i * p).sum(), (j * p).sum()
    si, sj = math.sqrt(max(0.0, (p * (i - mi) ** 2).sum())), math.sqrt(max(0.0, (p * (j - mj) ** 2).sum()))
    correlation = 1.0 if si < 1e-15 or sj < 1e-15 else float((p * (i - mi) * (j - mj)).sum() / (si * sj))
    return {"contrast": float((p * d).sum()), "dissimilarity": float((p * np.abs(i - j)).sum()), "homogeneity": float((p / (1.0 + d)).sum()), "energy": math.sqrt((p * p).sum()), "correlation": correlation}


def binary_patterns(a: np.ndarray, points: int, radius: float) -> np.ndarray:
    """Uniform, rotation-invariant codes: of `points` places on a circle, bilinearly sampled with 0 outside the image, how many are no darker than the centre; points + 1 where they change sides more than twice around."""
    angle = 2 * math.pi * np.arange(points) / points
    dy, dx = np.round(-radius * np.sin(angle), 5), np.round(radius * np.cos(angle), 5)
    edge = int(math.ceil(radius)) + 1
    wide = np.pad(a.astype(float), edge)
    h, w = a.shape
    bits = np.empty((points, h, w), bool)
    for k in range(points):
        y, x = math.floor(dy[k]), math.floor(dx[k])
        fy, fx = dy[k] - y, dx[k] - x
        at = lambda i, j: wide[edge + i : edge + i + h, edge + j : edge + j + w]
        top = (1 - fx) * at(y, x) + fx * at(y, x + 1)
        bottom = (1 - fx) * at(y + 1, x) + fx * at(y + 1, x + 1)
        bits[k] = (1 - fy) * top + fy * bottom - a >= 0
    changes = (bits != np.roll(bits, -1, axis=0)).sum(axis=0)
    return np.where(changes <= 2, bits.sum(axis=0), points + 1)


def texture_of(a: np.ndarray, levels: int, distances: tuple[int, ...], angles: tuple[float, ...], radius: int) -> dict[str, float]:
    """Summaries of the pair properties over all distances and angles, and energy and entropy of the pattern histogram, whose bins span the codes that occur."""
    q = levels_of(a, levels)
    found = [pair_properties(pair_counts(q, levels, d, t)) for d in distances for t in angles]
    out = {f"glcm_{p}_{s}": float(f([x[p] for x in found])) for p in PROPERTIES for s, f in SUMMARIES.items()}
    counts, _ = np.histogram(binary_patterns(q, 8 * radius, radius), bins=8 * radius + 2)
    share = counts / (counts.sum() + 1e-7)
    return out | {"lbp_energy": float((share**2).sum()), "lbp_entropy": float(-(share * np.log2(share + 1e-7)).sum())}


NAMES = [f"glcm_{p}_{s}" for p in PROPERTIES for s in SUMMARIES] + ["lbp_energy", "lbp_entropy"]


def texture_features(df: DataFrame, image: str, shape: str, keys: list[str], levels: int = 256, distances: tuple[int, ...] = DISTANCES, angles: tuple[float, ...] = ANGLES, radius: int = 3) -> DataFrame:
    """keys and NAMES of each two-dimensional image; all null where the image or its shape is."""
    source = df.select(*keys, F.col(shape).cast("array<int>").alias("__shape"), F.col(image).cast("array<double>").alias("__image"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s, a in zip(batch.column(n), batch.column(n + 1), strict=True):
                rows.append(texture_of(np.array(a.values.to_numpy(zero_copy_only=False), float).reshape(s.as_py()), levels, distances, angles, radius) if s.is_valid and a.is_valid else {})
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array([r.get(c) for r in rows], pa.float64()) for c in NAMES]], names=[*keys, *NAMES])

    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} double" for c in NAMES))
