"""Array kernels that have no column expression: each is a small numpy function of one image, mapped over a table in Arrow batches.

Images are flat arrays in C order beside their shape. Rows are worked on one at a time inside a task, so memory is one image per task; Spark partitions the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], np.ndarray]


def mapped(df: DataFrame, image: str, shape: str, kernel: Kernel, keys: list[str]) -> DataFrame:
    """keys, shape and data of each image after the kernel; a null image stays null."""
    source = df.select(*keys, F.col(shape).cast("array<int>").alias("shape"), F.col(image).cast("array<double>").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keys)
        for batch in batches:
            shapes, images = [], []
            for s, a in zip(batch.column(at), batch.column(at + 1), strict=True):
                if not (s.is_valid and a.is_valid):
                    shapes.append(None)
                    images.append(None)
                    continue
                out = kernel(np.array(a.values.to_numpy(zero_copy_only=False), dtype=float).reshape(s.as_py()))
                shapes.append(list(out.shape))
                images.append(out.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array(shapes, pa.list_(pa.int32())), pa.array(images, pa.list_(pa.float64()))], names=[*keys, "shape", "data"])

    return source.mapInArrow(run, source.schema)


def resampled(a: np.ndarray, shape: tuple[int, ...], order: int = 1) -> np.ndarray:
    """Nearest (0) or linear (1) resampling, end voxels on end voxels, one axis after the other."""
    for axis, n in enumerate(shape):
        m = a.shape[axis]
        x = np.linspace(0, m - 1, n) if n > 1 else np.zeros(1)
        low = np.rint(x).astype(int) if order == 0 else np.minimum(np.floor(x).astype(int), m - 1)
        first = np.take(a, low, axis=axis)
        if order:
            part = (x - low).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
            first = first * (1 - part) + np.take(a, np.minimum(low + 1, m - 1), axis=axis) * part
        a = first
    return a


def respaced(a: np.ndarray, spacing: list[float], target: list[float], order: int = 1) -> np.ndarray:
    return resampled(a, tuple(max(1, round(n * s / t)) for n, s, t in zip(a.shape, spacing, target, strict=True)), order)


def fitted(a: np.ndarray, shape: tuple[int, ...], fill: float = 0.0) -> np.ndarray:
    """Padded and cropped about the centre to a shape."""
    out = np.full(shape, fill)
    take, put = [], []
    for n, m in zip(a.shape, shape, strict=True):
        k = min(n, m)
        take.append(slice((n - k) // 2, (n - k) // 2 + k))
        put.append(slice((m - k) // 2, (m - k) // 2 + k))
    out[tuple(put)] = a[tuple(take)]
    return out


def otsu(a: np.ndarray, bins: int = 256) -> float:
    """The threshold of greatest variance between classes; a constant image's value."""
    if a.min() == a.max():
        return float(a.min())
    counts, edges = np.histogram(a, bins)
    centre = (edges[1:] + edges[:-1]) / 2
    w0, w1 = np.cumsum(counts)[:-1], np.cumsum(counts[::-1])[::-1][1:]
    s = np.cumsum(counts * centre)
    m0, m1 = s[:-1] / np.maximum(w0, 1), (s[-1] - s[:-1]) / np.maximum(w1, 1)
    return float(centre[:-1][np.argmax(w0 * w1 * (m0 - m1) ** 2)])


def equalised(a: np.ndarray, bins: int = 256) -> np.ndarray:
    """Values replaced by their share of voxels up to their histogram bin."""
    counts, edges = np.histogram(a, bins)
    return np.cumsum(counts)[np.clip(np.searchsorted(edges, a, side="right") - 1, 0, bins - 1)] / a.size


def _blend(n: int, tile: int, tiles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place on an axis: the tiles whose centres lie about it, and the weight of the second."""
    at = (np.arange(n) + 0.5) / tile - 0.5
    low = np.clip(np.floor(at).astype(int), 0, tiles - 1)
    return low, np.minimum(low + 1, tiles - 1), np.where(low < tiles - 1, np.clip(at - low, 0.0, 1.0), 0.0)


def adaptively_equalised(a: np.ndarray, kernel: int | None = None, clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited equalisation: each pixel by the histograms of the tiles about it, 0 to 1; an image of more dimensions slice by slice along its last axis.

    Values go to bins between the slice's least and greatest. A tile has kernel pixels a side (an eighth of the slice's side if None), the slice reflected where its last tiles reach beyond it. Counts over the limit, `clip` times a tile's
    pixels and at least 1, are dealt evenly to all bins; a tile maps a bin to its share of counts up to it. A pixel's value is the bilinear blend of the maps of the four tiles whose centres lie about it. A constant slice is 0."""
    if a.ndim > 2:
        return np.stack([adaptively_equalised(a[..., i], kernel, clip, bins) for i in range(a.shape[-1])], axis=-1)
    if a.min() == a.max():
        return np.zeros_like(a)
    level = np.minimum(((a - a.min()) / (a.max() - a.min()) * bins).astype(int), bins - 1)
    sides = [kernel or max(1, n // 8) for n in a.shape]
    ny, nx = (-(-n // t) for n, t in zip(a.shape, sides, strict=True))
    whole = np.pad(level, [(0, c * t - n) for n, t, c in zip(a.shape, sides, (ny, nx), strict=True)], mode="symmetric")
    tile = (np.arange(whole.shape[0]) // sides[0])[:, None] * nx + np.arange(whole.shape[1]) // sides[1]
    counts = np.bincount((tile * bins + whole).ravel(), minlength=ny * nx * bins).reshape(ny * nx, bins)
    pixels = sides[0] * sides[1]
    limit, parts = max(Fraction(1), Fraction(str(clip)) * pixels).limit_denominator(1 << 20).as_integer_ratio()  # in whole parts of a count, sums are exact
    over = np.maximum(counts * parts - limit, 0).sum(axis=1, keepdims=True)
    share = (np.cumsum(np.minimum(counts * parts, limit), axis=1) / parts + over * np.arange(1, bins + 1) / parts / bins) / pixels
    (y0, y1, wy), (x0, x1, wx) = (_blend(n, t, c) for n, t, c in zip(a.shape, sides, (ny, nx), strict=True))
    wy, wx = wy[:, None], wx[None, :]
    near = lambda y, x: share[y[:, None] * nx + x[None, :], level]
    return (1 - wy) * (1 - wx) * near(y0, x0) + (1 - wy) * wx * near(y0, x1) + wy * (1 - wx) * near(y1, x0) + wy * wx * near(y1, x1)


def clipped(a: np.ndarray, low: float = 1, high: float = 99) -> np.ndarray:
    return np.clip(a, *np.percentile(a, [low, high]))


def mad_normalised(a: np.ndarray) -> np.ndarray:
    centre = np.median(a)
    spread = 1.4826 * np.median(np.abs(a - centre))
    return np.zeros_like(a) if spread == 0 else (a - centre) / spread


def repaired(a: np.ndarray) -> np.ndarray:
    """NaN as 0, infinities as the largest finite doubles."""
    return np.nan_to_num(a)


def flipped(a: np.ndarray, axis: int) -> np.ndarray:
    return np.flip(a, axis)


def _shifts(a: np.ndarray, fill: bool) -> Iterator[np.ndarray]:
    """The mask and its neighbours along each axis."""
    yield a
    for axis in range(a.ndim):
        for step in (1, -1):
            out = np.roll(a, step, axis)
            edge = [slice(None)] * a.ndim
            edge[axis] = slice(0, 1) if step == 1 else slice(-1, None)
            out[tuple(edge)] = fill
            yield out


def dilated(mask: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce(list(_shifts(mask > 0, False)))


def eroded(mask: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce(list(_shifts(mask > 0, True)))


def opened(mask: np.ndarray) -> np.ndarray:
    return dilated(eroded(mask)).astype(float)


def closed(mask: np.ndarray) -> np.ndarray:
    return eroded(dilated(mask)).astype(float)


def component_labels(mask: np.ndarray) -> np.ndarray:
    """Face-connected components from 1, background 0: smallest indices spread along faces, and jump to their own label, until nothing changes."""
    inside = mask > 0
    flat = np.arange(1, mask.size + 1).reshape(mask.shape)
    label = np.where(inside, flat, 0)
    while True:
        new = label.copy()
        for axis in range(mask.ndim):
            a, b = [slice(None)] * mask.ndim, [slice(None)] * mask.ndim
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            both = inside[tuple(a)] & inside[tuple(b)]
            least = np.minimum(new[tuple(a)], new[tuple(b)])
            new[tuple(a)] = np.where(both, least, new[tuple(a)])
            new[tuple(b)] = np.where(both, np.minimum(least, new[tuple(b)]), new[tuple(b)])
        new = np.where(inside, np.concatenate([[0], new.ravel()])[new], 0)
        if np.array_equal(new, label):
            return np.where(inside, np.searchsorted(np.unique(label[inside]), label) + 1, 0)
        label = new


def largest_component(mask: np.ndarray) -> np.ndarray:
    labels = component_labels(mask)
    if not labels.any():
        return np.zeros(mask.shape)
    return (labels == np.bincount(labels[labels > 0]).argmax()).astype(float)


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    labels = component_labels(mask)
    keep = np.bincount(labels.ravel()) >= least
    keep[0] = False
    return keep[labels].astype(float)


def filled_holes(mask: np.ndarray) -> np.ndarray:
    """Background that doesn't reach the border becomes foreground."""
    outside = np.pad(mask <= 0, 1, constant_values=True)
    labels = component_labels(outside.astype(float))
    return (labels != labels[(0,) * mask.ndim])[(slice(1, -1),) * mask.ndim].astype(float)


def median_filtered(a: np.ndarray, size: int = 3) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(a, size // 2, mode="edge"), (size,) * a.ndim)
    return np.median(windows, axis=tuple(range(a.ndim, 2 * a.ndim)))


def gaussian_filtered(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    radius = max(1, int(4 * sigma + 0.5))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in range(a.ndim):
        padded = np.pad(a, [(radius, radius) if i == axis else (0, 0) for i in range(a.ndim)], mode="symmetric")
        a = sum(w * np.take(padded, np.arange(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(weights))
    return a


def surface_distance(a: np.ndarray, b: np.ndarray, spacing: list[float] | None = None, percentile: float = 95) -> float | None:
    """Percentile of the pooled distances between two masks' surfaces; null if just one is empty, 0 if both are."""
    a, b = a > 0, b > 0
    if not a.any() or not b.any():
        return 0.0 if not a.any() and not b.any() else None
    scale = np.array(spacing or [1.0] * a.ndim)
    p, q = (np.argwhere(m & ~eroded(np.pad(m, 1))[(slice(1, -1),) * m.ndim]) * scale for m in (a, b))

    def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([np.sqrt(((x[i : i + 512, None, :] - y[None, :, :]) ** 2).sum(axis=2)).min(axis=1) for i in range(0, len(x), 512)])

    return float(np.percentile(np.concatenate([nearest(p, q), nearest(q, p)]), percentile))


def similarity_index(a: np.ndarray, b: np.ndarray, value_range: float | None = None, size: int = 7) -> float:
    """Mean structural similarity over square windows."""
    span = value_range or float(a.max() - a.min()) or 1.0
    size = min(size, *a.shape)
    x, y = (np.lib.stride_tricks.sliding_window_view(v, (size,) * v.ndim) for v in (a, b))
    axes = tuple(range(a.ndim, 2 * a.ndim))
    n = size**a.ndim
    mx, my = x.mean(axis=axes), y.mean(axis=axes)
    vx, vy = x.var(axis=axes) * n / (n - 1), y.var(axis=axes) * n / (n - 1)
    cov = ((x * y).mean(axis=axes) - mx * my) * n / (n - 1)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def compared(df: DataFrame, a: str, b: str, shape: str, keys: list[str], measure: str = "surface_distance") -> DataFrame:
    """keys and `value`: surface_distance or similarity_index of each pair."""
    f = {"surface_distance": surface_distance, "similarity_index": similarity_index}[measure]
    source = df.select(*keys, F.col(shape).cast("array<int>").alias("__s"), F.col(a).cast("array<double>").alias("__a"), F.col(b).cast("array<double>").alias("__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keys)
        for batch in batches:
            found = [f(np.array(x, float).reshape(s), np.array(y, float).reshape(s)) for s, x, y in zip(*(batch.column(at + i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array(found, pa.float64())], names=[*keys, "value"])

    return source.mapInArrow(run, source.select(*keys, F.lit(0.0).alias("value")).schema)


def component_sizes(df: DataFrame, mask: str, shape: str, keys: list[str]) -> DataFrame:
    """keys, component and its voxels, of each mask."""
    labelled = mapped(df, mask, shape, component_labels, keys)
    return labelled.select(*keys, F.explode("data").alias("component")).filter("component > 0").groupBy(*keys, F.col("component").cast("int").alias("component")).agg(F.count(F.lit(1)).alias("n_voxels"))
