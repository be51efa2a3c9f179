"""Crops, pads and regions of interest of volumes, with the affine moved along so that every voxel that stays keeps its place in the world.

A row holds a volume: `shape` (three lengths), `affine` (4 x 4 in rows) and `data` (in row order), as the readers in sources give it. All is an array expression per row: nothing is exploded, shuffled or sent to Python.
Where the shape hasn't three lengths or doesn't match the data, the new columns are null. Null and NaN voxels are kept as they are, and are no foreground of a mask.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.voxels import let, mean, values


def _cells(lengths: Column) -> Column:
    return F.get(lengths, 0) * F.get(lengths, 1) * F.get(lengths, 2)


def _lengths(shape: str) -> list[Column]:
    return [F.get(shape, k) for k in range(3)]


def _whole(data: Column, shape: Column) -> Column:
    return (F.size(shape) == 3) & (F.size(data) == _cells(shape))


def moved_affine(affine: Column, start: Column) -> Column:
    """The affine of a grid whose first voxel is at `start` of the old one; start may be negative."""
    origin = [affine[4 * r + 3] + sum(affine[4 * r + k] * start[k] for k in range(3)) for r in range(3)]
    return F.array(*[origin[i // 4] if i < 12 and i % 4 == 3 else affine[i] for i in range(16)])


def window(data: Column, shape: Column, start: Column, size: Column, fill: Column) -> Column:
    """The voxels from `start` on, `size` of them along each axis; what lies outside the volume is `fill`."""

    def cut(p: Column) -> Column:
        d, s, o, z = (p[k] for k in "dsoz")

        def cell(i: Column) -> Column:
            a, b, c = F.floor(i / (z[1] * z[2])) + o[0], F.floor(i / z[2]) % z[1] + o[1], i % z[2] + o[2]
            inside = (a >= 0) & (a < s[0]) & (b >= 0) & (b < s[1]) & (c >= 0) & (c < s[2])
            return F.when(inside, F.get(d, ((a * s[1] + b) * s[2] + c).cast("int"))).otherwise(p["f"])

        n = _cells(z)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), cell)).otherwise(F.array().cast("array<double>"))

    return F.when(_whole(data, shape), let(F.struct(data.alias("d"), shape.alias("s"), start.alias("o"), size.alias("z"), fill.cast("double").alias("f")), cut))


def _triple(parts: Sequence[Column]) -> Column:
    return F.array(*[p.cast("int") for p in parts])


def _cut(volumes: DataFrame, start: Column, size: Column, images: Sequence[str], shape: str, affine: str, fill: Column) -> DataFrame:
    """volumes with images cut to a window, and shape and affine of it."""
    rows = volumes.withColumns({"_start": start, "_size": size})
    whole = _whole(F.col(images[0]), F.col(shape))
    cut = {i: window(values(i), F.col(shape), F.col("_start"), F.col("_size"), fill) for i in images}
    return rows.withColumns({**cut, affine: F.when(whole, moved_affine(F.col(affine), F.col("_start"))), shape: F.when(whole, F.col("_size"))}).drop("_start", "_size")


def centre_cropped(volumes: DataFrame, to: tuple[int, int, int], image: str = "data", shape: str = "shape", affine: str = "affine") -> DataFrame:
    """The middle of each volume, of `to` voxels along each axis; a shorter axis stays whole. Of an odd rest the larger part goes at the end."""
    s = _lengths(shape)
    start = _triple([F.greatest(F.lit(0), F.floor((s[k] - n) / 2)) for k, n in enumerate(to)])
    return _cut(volumes, start, _triple([F.least(s[k], F.lit(n)) for k, n in enumerate(to)]), [image], shape, affine, F.lit(None))


def padded(volumes: DataFrame, to: tuple[int, int, int], fill: float | str = "min", image: str = "data", shape: str = "shape", affine: str = "affine") -> DataFrame:
    """Each volume in the middle of `to` voxels along each axis; a longer axis stays. fill: a number, or min, max or mean of the volume's present voxels. Of an odd rest the larger part comes at the end."""
    s, present = _lengths(shape), F.filter(values(image), lambda x: x.isNotNull() & ~F.isnan(x))
    with_what = {"min": F.array_min(present), "max": F.array_max(present), "mean": mean(present)}
    if isinstance(fill, str) and fill not in with_what:
        raise ValueError(f"unknown fill: {fill}")
    start = _triple([-F.floor(F.greatest(F.lit(0), F.lit(n) - s[k]) / 2) for k, n in enumerate(to)])
    return _cut(volumes, start, _triple([F.greatest(s[k], F.lit(n)) for k, n in enumerate(to)]), [image], shape, affine, with_what[fill] if isinstance(fill, str) else F.lit(fill))


def regions_of_interest(volumes: DataFrame, mask: str = "mask", margin: tuple[int, int, int] = (0, 0, 0), image: str = "data", shape: str = "shape", affine: str = "affine") -> DataFrame:
    """Image and mask of each volume, cut to the box of the mask's foreground widened by margin voxels within the volume, and `start`, the box's first voxel. Volumes without foreground, or whose mask doesn't match, are left out.

    The origin moves by the box's first voxel along each axis."""
    s = F.col(shape)
    at = F.filter(F.transform(values(mask), lambda x, i: F.when((x > 0) & ~F.isnan(x), i)), lambda i: i.isNotNull())
    rows = volumes.filter(_whole(F.col(image), s) & (F.size(mask) == F.size(image))).withColumn("_at", at).filter(F.size("_at") > 0)
    along = [F.transform("_at", lambda i: F.floor(i / (s[1] * s[2]))), F.transform("_at", lambda i: F.floor(i / s[2]) % s[1]), F.transform("_at", lambda i: i % s[2])]
    low = [F.greatest(F.lit(0), F.array_min(a) - m) for a, m in zip(along, margin, strict=True)]
    high = [F.least(s[k], F.array_max(a) + m + 1) for k, (a, m) in enumerate(zip(along, margin, strict=True))]
    rows = rows.withColumns({"start": _triple(low), "_to": _triple(high)}).drop("_at")
    size = _triple([F.col("_to")[k] - F.col("start")[k] for k in range(3)])
    return _cut(rows, F.col("start"), size, [image, mask], shape, affine, F.lit(None)).drop("_to")
