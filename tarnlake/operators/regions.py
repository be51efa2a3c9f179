"""Properties of the regions of labelled two-dimensional masks: a row for each region of each image. Sums of all regions of an image come from one pass over its pixels; an image is worked on by one task, as every image here."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.kernels import eroded

# How much a border pixel adds to a perimeter, by the sum of 1 for itself, 2 for each border pixel beside it and 10 for each at a corner.
STEPS = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: math.sqrt(2), 33: math.sqrt(2), 13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}
COLUMNS = ["area", "perimeter", "centre_y", "centre_x", "top", "left", "bottom", "right", "major_axis", "minor_axis", "eccentricity", "equivalent_diameter", "extent", "convex_area", "solidity", "circularity", "mean_intensity"]
WHOLE = {"area", "top", "left", "bottom", "right", "convex_area"}


def perimeter(mask: np.ndarray) -> float:
    """Length of the border by the codes of its pixels."""
    wide = np.pad(mask.astype(bool), 1)
    border = (wide & ~eroded(wide)).astype(int)
    code = np.zeros_like(border)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            code += (1 if dy == dx == 0 else 10 if dy and dx else 2) * np.roll(border, (dy, dx), (0, 1))
    codes, counts = np.unique(code[border > 0], return_counts=True)
    return float(sum(STEPS.get(int(c), 0.0) * n for c, n in zip(codes, counts, strict=True)))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, by the two chains of sorted points."""
    ordered = np.unique(points, axis=0).tolist()
    if len(ordered) < 3:
        return np.array(ordered)
    chains = []
    for run in (ordered, ordered[::-1]):
        chain: list = []
        for p in run:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


def convex_area(mask: np.ndarray) -> int:
    """Pixels whose centres lie in the hull of the region's pixels, each with the middles of its four sides."""
    y, x = np.nonzero(mask)
    ends = np.concatenate([np.column_stack([y, x]) + o for o in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
    corners = hull(ends)
    inside = np.ones(mask.shape, bool)
    gy, gx = np.indices(mask.shape)
    for (ay, ax), (by, bx) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        inside &= (by - ay) * (gx - ax) - (bx - ax) * (gy - ay) >= -1e-9
    return int(inside.sum())


def region_rows(labels: np.ndarray, image: np.ndarray | None = None) -> list[dict]:
    """label and COLUMNS of each region, a label other than 0, by label."""
    names, at = np.unique(labels, return_inverse=True)
    at = at.reshape(labels.shape)
    y, x = np.indices(labels.shape)
    total = lambda v: np.bincount(at.ravel(), weights=np.asarray(v, float).ravel(), minlength=len(names))
    n = np.bincount(at.ravel(), minlength=len(names))
    cy, cx = total(y) / n, total(x) / n
    dy, dx = y - cy[at], x - cx[at]
    yy, xx, xy = total(dy * dy) / n, total(dx * dx) / n, total(dy * dx) / n
    half, spread = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + xy**2)
    large, small = half + spread, np.maximum(half - spread, 0.0)
    light = total(image) / n if image is not None else None
    out = []
    for k, name in enumerate(names.tolist()):
        if name == 0:
            continue
        mask = at == k
        rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        top, bottom, left, right = int(rows[0]), int(rows[-1]) + 1, int(columns[0]), int(columns[-1]) + 1
        box = mask[top:bottom, left:right]
        area, around, convex = int(n[k]), perimeter(box), convex_area(box)
        out.append({
            "label": int(name), "area": area, "perimeter": around, "centre_y": float(cy[k]), "centre_x": float(cx[k]), "top": top, "left": left, "bottom": bottom, "right": right,
            "major_axis": 4 * math.sqrt(large[k]), "minor_axis": 4 * math.sqrt(small[k]), "eccentricity": math.sqrt(1 - small[k] / large[k]) if large[k] > 0 else 0.0, "equivalent_diameter": math.sqrt(4 * area / math.pi),
            "extent": area / box.size, "convex_area": convex, "solidity": area / convex if convex else None, "circularity": 4 * math.pi * area / around**2 if around else 0.0, "mean_intensity": float(light[k]) if light is not None else None,
        })
    return out


def region_properties(df: DataFrame, labels: str, shape: str, keys: list[str], image: str | None = None) -> DataFrame:
    """keys, label and COLUMNS: a row for each region; bounds are half open. Images without regions, or null, have no row. image: values for mean_intensity, of the same shape."""
    light = F.col(image).cast("array<double>") if image else F.lit(None).cast("array<double>")
    source = df.select(*keys, F.col(shape).cast("array<int>").alias("__shape"), F.col(labels).cast("array<long>").alias("__labels"), light.alias("__image"))
    n = len(keys)
    fields = [("label", pa.int64()), *[(c, pa.int64() if c in WHOLE else pa.float64()) for c in COLUMNS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, (s, a, v) in enumerate(zip(*(batch.column(n + k) for k in range(3)), strict=True)):
                if s.is_valid and a.is_valid:
                    found = region_rows(np.array(a.values.to_numpy(zero_copy_only=False)).reshape(s.as_py()), np.array(v.values.to_numpy(zero_copy_only=False)).reshape(s.as_py()) if v.is_valid else None)
                    take += [i] * len(found)
                    rows += found
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[:n]], *[pa.array([r[c] for r in rows], t) for c, t in fields]], names=[*keys, *[c for c, _ in fields]])

    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{kinds}, " + ", ".join(f"`{c}` {'long' if t == pa.int64() else 'double'}" for c, t in fields))


def region_summary(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Per image: number of regions, and mean, population deviation, most and least of area, and means of perimeter, circularity, solidity and eccentricity."""
    return regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_regions"), F.avg("area").alias("mean_area"), F.stddev_pop("area").alias("std_area"), F.max("area").alias("max_area"), F.min("area").alias("min_area"), *[F.avg(c).alias(f"mean_{c}") for c in ("perimeter", "circularity", "solidity", "eccentricity")])
