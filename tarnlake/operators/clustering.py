"""Clustering of feature rows: preparation, k-means, density clusters, Ward clusters, and their quality.

`clustered` is the whole sequence over a table of rows of many images: rows with a missing or infinite feature drop out, features are selected by variance or correlation, standardised, optionally rotated to principal
components, clustered, and scored. Labels stay beside the image and row keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.columns import require_columns
from tarnlake.functions.gram import list_matrix, mean_and_covariance
from tarnlake.functions.held import held
from tarnlake.functions.ordered import order_statistics, running_totals
from tarnlake.operators.components import connected

#: Own points, and points they are compared with, of one task's group.
TILE = 4096
#: Coordinates that make the grid; others only enter distances.
GRID_AXES = 3
#: Distances that a task holds at once.
CELLS = 1 << 20
#: Pairs of points that are compared without halving.
PAIRS = 1 << 14
#: Rows of a core row's surroundings up to which points meet by a join of cells.
FEW_POINTS = 64
#: Share by which cells are narrower than they could be, and the cells from zero up to which rounding stays below it.
MARGIN, FAR = 1e-6, 1 << 30


def complete_rows(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys and `v`, the features as doubles, of rows whose features are all finite."""
    require_columns(df, [*keys, *features])
    rows = df.select(*keys, F.array(*[F.col(c).try_cast("double") for c in features]).alias("v"))
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def selected_features(rows: DataFrame, features: list[str], method: str, vector: str = "v") -> list[int]:
    """Indices by "all", "variance" (population variance above the median of variances) or "correlation" (without the second of each pair with absolute correlation over 0.9)."""
    if method == "all":
        return list(range(len(features)))
    _, _, cov = mean_and_covariance(rows, vector, len(features))
    var = np.maximum(np.diag(cov), 0.0)
    if method == "variance":
        return np.flatnonzero(var > np.percentile(var, 50)).tolist()
    if method != "correlation":
        raise ValueError("features are selected by all, variance or correlation")
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.abs(cov / np.sqrt(np.outer(var, var)))
    return [j for j in range(len(features)) if not (r[:j, j] > 0.9).any()]


def projected(rows: DataFrame, keys: list[str], columns: list[int], standardise: bool = True, components: int | None = None, vector: str = "v") -> DataFrame:
    """keys and `v`: chosen components less their mean, over the population deviation if standardise, on the first principal axes if components. The largest weight of an axis is positive."""
    own = rows.select(*keys, F.array(*[F.col(vector)[c] for c in columns]).alias("v"))
    _, mean, cov = mean_and_covariance(own, "v", len(columns))
    std = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.where(std > 1e-12 * np.maximum(1.0, np.abs(mean)), std, 1.0) if standardise else np.ones(len(columns))
    weights = np.diag(1 / scale)
    if components:
        value, axes = np.linalg.eigh(cov / np.outer(scale, scale))
        axes = axes[:, np.argsort(-value, kind="stable")][:, :components]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        weights = weights @ axes
    names = [f"__{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = (list_matrix(batch.column(len(keys))) - mean) @ weights
                offsets = pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=[*names, "v"])

    kinds = ", ".join(f"{n} {own.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True))
    return own.mapInArrow(run, f"{kinds}, v array<double>").withColumnsRenamed(dict(zip(names, keys, strict=True)))


# ---------------------------------------------------------------- density


def _groups(points: DataFrame, eps: float, axes: list[int], tile: int) -> DataFrame:
    """Points dealt to groups (cell, own tile, other tile) of at most about `tile` own points and as many others.

    Cells are 2 eps wide on the grid's axes; a point goes to its own cell and to each whose box is within eps. Cells with many points, own or near, are split, so that no group grows with a dense place.
    Where points have a column asks, those that ask are own only, and cells without such are left out."""
    width = 2 * eps
    at = [F.col("v")[a] / width for a in axes]
    whole = [F.floor(F.greatest(F.least(x, F.lit(2.0**62)), F.lit(-(2.0**62)))) for x in at]  # the next cell is a long, too
    offsets = [o for o in product((-1, 0, 1), repeat=len(axes))]

    def near(o: tuple[int, ...]) -> Column:
        """Within eps, half a width, of the cell at this offset."""
        return reduce(lambda a, b: a & b, [F.lit(True) if k == 0 else x - w <= 0.5 + MARGIN if k < 0 else x - w >= 0.5 - MARGIN for k, x, w in zip(o, at, whole, strict=True)])

    cells = F.array(*[F.when(near(o), F.struct(F.concat_ws(",", *[(w + k).cast("string") for w, k in zip(whole, o, strict=True)]).alias("cell"), F.lit(not any(o)).alias("own"))) for o in offsets])
    sent = points.withColumn("c", F.explode(F.filter(cells, lambda c: c.isNotNull()))).select("id", "v", "weight", *[n for n in ("core", "node", "asks") if n in points.columns], "c.cell", "c.own")
    if "asks" in points.columns:
        sent = sent.withColumn("own", F.col("own") & F.col("asks"))
        sent = sent.join(sent.filter("own").select("cell").distinct(), "cell", "left_semi").drop("asks")
    sizes = sent.groupBy("cell").agg(F.sum(F.col("own").cast("long")).alias("n_own"), F.count(F.lit(1)).alias("n"))
    large = sizes.filter(f"n > {tile}").select("cell", F.ceil(F.col("n_own") / tile).cast("int").alias("a"), F.ceil(F.col("n") / tile).cast("int").alias("b"))  # at most a row for each `tile` rows sent
    split = sent.join(large, "cell", "left").withColumns({"a": F.greatest(F.coalesce("a", F.lit(1)), F.lit(1)), "b": F.coalesce("b", F.lit(1))})
    own = split.filter("own").withColumns({"i": F.pmod(F.xxhash64("id"), "a").cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("b") - 1))})
    other = split.withColumns({"own": F.lit(False), "j": F.pmod(F.xxhash64("id", F.lit(7)), "b").cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("a") - 1))})
    return own.unionByName(other).withColumn("group", F.concat_ws("/", "cell", "i", "j")).drop("cell", "a", "b", "i", "j")


def _within(own: np.ndarray, other: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices within eps, in bounded blocks."""
    step = max(1, CELLS // max(1, len(other) * own.shape[1]))
    for a in range(0, len(own), step):
        d = ((own[a : a + step, None, :] - other[None, :, :]) ** 2).sum(axis=2)
        x, y = np.nonzero(d <= eps * eps)
        yield x + a, y


def _touch(x: np.ndarray, y: np.ndarray, eps: float) -> bool:
    """Whether a row of x is within eps of one of y. Rows too far from the others' box drop out, and the larger side is halved until few pairs are left."""
    most, todo = eps * eps, [(x, y)]
    while todo:
        x, y = todo.pop()
        for _ in range(2):  # each side against the other's box
            if len(x) and len(y):
                gap = np.maximum(np.maximum(y.min(axis=0) - x, x - y.max(axis=0)), 0.0)
                x = x[(gap**2).sum(axis=1) <= most * (1 + 1e-9)]
            x, y = y, x
        if len(x) * len(y) <= PAIRS:
            if len(x) and len(y) and (((x[:, None] - y[None]) ** 2).sum(axis=2) <= most).any():
                return True
            continue
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        order = np.argpartition(x[:, np.ptp(x, axis=0).argmax()], len(x) // 2)
        todo += [(x[order[: len(x) // 2]], y), (x[order[len(x) // 2 :]], y)]
    return False


def _touching(open_pairs: DataFrame, own: DataFrame, d: int, eps: float, tile: int) -> DataFrame:
    """Those of the pairs (a, b, and the boxes of a's and b's points) of which a point of a is within eps of one of b. Pairs with many such points are split, so that no group grows with a dense place."""
    sides = []
    for side, box in (("a", "b"), ("b", "a")):
        gap = [F.greatest(F.col(f"{box}_lo")[i] - F.col("v")[i], F.col("v")[i] - F.col(f"{box}_hi")[i], F.lit(0.0)) for i in range(d)]
        near = open_pairs.join(own.select(F.col("node").alias(side), "id", "v"), side).filter(reduce(Column.__add__, [g * g for g in gap]) <= eps * eps * (1 + 1e-9))
        sides.append(near.select("a", "b", "id", "v", F.lit(side == "a").alias("first")))
    sent = held(sides[0].unionByName(sides[1]))
    sizes = held(sent.groupBy("a", "b").agg(*[F.ceil(F.count(F.when(F.col("first") == first, 1)) / tile).alias(n) for n, first in (("m", True), ("n", False))], F.count(F.lit(1)).alias("rows")).filter("m > 0 and n > 0"))
    buckets = sizes.agg(F.ceil(F.sum("rows") / tile)).first()[0] or 1
    split = sent.join(sizes, ["a", "b"]).withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    of_a = split.filter("first").withColumns({"i": part("m"), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))})
    of_b = split.filter("not first").withColumns({"j": part("n"), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))})

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        a, b, first, v = table.column("a").to_numpy(), table.column("b").to_numpy(), table.column("first").to_numpy(), list_matrix(table.column("v").combine_chunks())
        starts = [*np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]).tolist(), len(a)]
        found = np.array([s for s, e in zip(starts[:-1], starts[1:], strict=True) if _touch(v[s:e][first[s:e]], v[s:e][~first[s:e]], eps)], dtype=np.int64)
        return pa.table([pa.array(a[found]), pa.array(b[found])], names=["a", "b"])

    names = ["a", "b", "first", "v", "bucket", "i", "j"]
    return of_a.select(names).unionByName(of_b.select(names)).groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _square(a: list[Column], b: list[Column]) -> Column:
    return reduce(Column.__add__, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)])


def _listed(offsets: list[tuple[int, ...]]) -> Column:
    """A row for each offset."""
    return F.expr(f"explode(array({', '.join(f'array({", ".join(map(str, o))})' for o in offsets)}))")


def _met(asks: DataFrame, tells: DataFrame, c: list[str], width: float, eps: float, few: bool, tile: int) -> DataFrame:
    """(u, node, n): for each point that asks, the weight of points within eps that tell, by their node. few: few points ask in a cell, so that a join by cell is short; else they meet as arrays."""
    d = len(c)
    if not few:
        points = asks.select("id", "v", "weight", F.lit(None).cast("long").alias("node"), F.lit(True).alias("asks")).unionByName(tells.select("id", "v", "weight", "node", F.lit(False).alias("asks")))

        def run(table: pa.Table) -> pa.Table:
            own, other = (table.filter(m) for m in (table.column("own"), pc.and_(pc.invert(table.column("own")), pc.is_valid(table.column("node")))))
            node, code = np.unique(other.column("node").to_numpy(), return_inverse=True)  # a bounded number of cells
            n, w = np.zeros((own.num_rows, len(node)), np.int64), other.column("weight").to_numpy()
            if n.size:
                for i, j in _within(*(list_matrix(t.column("v").combine_chunks()) for t in (own, other)), eps):
                    np.add.at(n, (i, code[j]), w[j])
            i, j = np.nonzero(n)
            return pa.table([pa.array(own.column("id").to_numpy()[i]), pa.array(node[j].astype(np.int64)), pa.array(n[i, j])], names=["u", "node", "n"])

        return _groups(points, eps, list(range(d)), tile).groupBy("group").applyInArrow(run, "u long, node long, n long").groupBy("u", "node").agg(F.sum("n").alias("n"))
    o = [F.col("o")[i] for i in range(d)]
    inside = [F.col("v")[i] / width - F.col(n) for i, n in enumerate(c)]
    gap = [F.when(k > 0, k - x).when(k < 0, x - k - 1).otherwise(0.0) for k, x in zip(o, inside, strict=True)]
    visits = asks.withColumn("o", _listed(list(product(range(-2, 3), repeat=d)))).filter(reduce(Column.__add__, [g * g for g in gap]) <= d * (1 + 10 * MARGIN))
    visits = visits.select(F.col("id").alias("u"), F.col("v").alias("y"), *[(F.col(n) + k).alias(n) for n, k in zip(c, o, strict=True)])
    near = _square([F.col("v")[i] for i in range(d)], [F.col("y")[i] for i in range(d)]) <= eps * eps
    return visits.join(tells.select(*c, "v", "weight", "node"), c).filter(near).groupBy("u", "node").agg(F.sum("weight").alias("n"))


def _cell_clusters(rows: DataFrame, d: int, eps: float, min_points: int, tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows of at most GRID_AXES coordinates: points (v, id, node), components (node, root), and links (u, v) of points that aren't core to nodes.

    Cells are a little under eps / sqrt(d) wide, so points of one cell are within eps of each other: the core points of a cell are one node, and with min_points rows in a cell all its points are core. Only points of other
    cells, fewer than min_points each, are counted around. Nodes are linked by their outermost points along each axis; where these are not within eps and nothing else has linked two nodes, all their points are compared."""
    width, c, few = eps / math.sqrt(d) * (1 - MARGIN), [f"c{i}" for i in range(d)], min_points <= FEW_POINTS
    v, offset = ([F.col(n)[i] for i in range(d)] for n in ("v", "o"))
    points = rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    placed = held(points.withColumns({n: F.floor(x / width) for n, x in zip(c, v, strict=True)}))
    sized = placed.join(placed.groupBy(*c).agg((F.sum("weight") >= min_points).alias("dense")), c)
    counts = _met(sized.filter("not dense"), placed.withColumn("node", F.lit(0).cast("long")), c, width, eps, few, tile).select(F.col("u").alias("id"), (F.col("n") >= min_points).alias("many"))
    known = held(sized.join(counts, "id", "left").select("id", "v", "weight", *c, (F.col("dense") | F.coalesce("many", F.lit(False))).alias("core")))

    ends = [F.struct(*[f(x, v[i]).alias(f"x{k}") for k, x in enumerate(v)]).alias(f"{n}{i}") for n, f in (("lo", F.min_by), ("hi", F.max_by)) for i in range(d)]
    outer = {n: F.array(*[F.col(f"{n}{i}")[f"x{i}"] for i in range(d)]) for n in ("lo", "hi")}
    outer["ends"] = F.array(*[F.array(*[F.col(f"{n}{i}")[f"x{k}"] for k in range(d)]) for n in ("lo", "hi") for i in range(d)])
    nodes = held(known.filter("core").groupBy(*c).agg(F.min("id").alias("node"), *ends).select(*c, "node", *[x.alias(n) for n, x in outer.items()]))
    own = known.join(nodes.select(*c, "node"), c, "left").withColumn("node", F.when(F.col("core"), F.col("node")))

    a, b = (nodes.select(*c, *[F.col(n).alias(s if n == "node" else f"{s}_{n}") for n in ("node", *outer)]) for s in "ab")
    a = a.withColumn("o", _listed([o for o in product(range(-2, 3), repeat=d) if o > (0,) * d])).withColumns({n: F.col(n) + k for n, k in zip(c, offset, strict=True)})
    apart = [F.greatest(F.col("b_lo")[i] - F.col("a_hi")[i], F.col("a_lo")[i] - F.col("b_hi")[i], F.lit(0.0)) for i in range(d)]
    linked = F.exists("a_ends", lambda p: F.exists("b_ends", lambda q: _square([p[i] for i in range(d)], [q[i] for i in range(d)]) <= eps * eps))
    pairs = a.join(b, c).filter(reduce(Column.__add__, [g * g for g in apart]) <= eps * eps * (1 + 1e-9))
    pairs = held(pairs.select("a", "b", "a_lo", "a_hi", "b_lo", "b_hi", linked.alias("linked")))
    links = pairs.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected(links.unionByName(nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))))
    of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    left = held(pairs.filter(~F.col("linked")).join(of("a"), "a").join(of("b"), "b").filter("a_root <> b_root"))
    if not left.isEmpty():
        more = _touching(left.drop("linked", "a_root", "b_root"), own.filter("core"), d, eps, tile).join(left.select("a", "b", "a_root", "b_root"), ["a", "b"])
        merged = connected(more.select(F.col("a_root").alias("u"), F.col("b_root").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("least"))
        roots = held(roots.join(merged, "root", "left").select("node", F.coalesce("least", "root").alias("root")))
    borders = _met(known.filter("not core"), own.filter("core"), c, width, eps, few, tile).select("u", F.col("node").alias("v"))
    return own.select("v", "id", F.coalesce("node", "id").alias("node")), roots, borders


def _tile_clusters(rows: DataFrame, d: int, eps: float, min_points: int, tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As _cell_clusters, of vectors of any length d: points meet in cells of the grid and near its borders only; counts, then links between core points, come from two passes over the same groups."""
    points = held(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    _, _, cov = mean_and_covariance(points, "v", d)
    axes = np.argsort(-np.diag(cov), kind="stable")[:GRID_AXES].tolist()

    def counted(table: pa.Table) -> pa.Table:
        own, other = (table.filter(m) for m in (table.column("own"), pc.invert(table.column("own"))))
        x, y, w = list_matrix(own.column("v").combine_chunks()), list_matrix(other.column("v").combine_chunks()), other.column("weight").to_numpy()
        n = np.zeros(own.num_rows, np.int64)
        if own.num_rows and other.num_rows:
            for i, j in _within(x, y, eps):
                np.add.at(n, i, w[j])
        return pa.table([own.column("id"), pa.array(n)], names=["id", "n"])

    groups = _groups(points, eps, axes, tile)
    counts = groups.groupBy("group").applyInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    known = held(points.join(counts, "id").withColumn("core", F.col("n") >= min_points).drop("n"))

    def linked(table: pa.Table) -> pa.Table:
        """A link from each own core point to the least core point near it and from the others near to that; from another own point to each core point near it."""
        own, other = (table.filter(m) for m in (table.column("own"), pc.invert(table.column("own"))))
        other = other.filter(other.column("core"))
        u, v, kind = [], [], []
        if own.num_rows and other.num_rows:
            x, y = (list_matrix(t.column("v").combine_chunks()) for t in (own, other))
            core, a, b = own.column("core").to_numpy(), own.column("id").to_numpy(), other.column("id").to_numpy()
            parent = np.arange(len(b))  # components of the group's core points, one link each is enough

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            first: dict[int, int] = {}
            borders = []
            for i, j in _within(x, y, eps):
                is_core = core[i]
                for p, q in zip(i[is_core].tolist(), j[is_core].tolist(), strict=True):
                    if p in first:
                        s, t = root(first[p]), root(q)
                        if s != t:
                            parent[t] = s
                    else:
                        first[p] = q
                borders.append((i[~is_core], j[~is_core]))
            tops = np.array([root(i) for i in range(len(b))])
            linked_to = np.array([first[p] for p in sorted(first)], dtype=np.int64)
            u += [a[sorted(first)] if first else a[:0], b]
            v += [b[tops[linked_to]] if first else a[:0], b[tops]]
            kind += [np.ones(len(first), bool), np.ones(len(b), bool)]
            pairs = np.unique(np.concatenate([np.column_stack([i, tops[j]]) for i, j in borders]), axis=0)
            u.append(a[pairs[:, 0]])
            v.append(b[pairs[:, 1]])
            kind.append(np.zeros(len(pairs), bool))
        join = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.zeros(0), t)
        return pa.table([join(u, pa.int64()), join(v, pa.int64()), join(kind, pa.bool_())], names=["u", "v", "core"])

    links = held(_groups(known, eps, axes, tile).groupBy("group").applyInArrow(linked, "u long, v long, core boolean").distinct())
    roots = connected(links.filter("core").select("u", "v").unionByName(known.filter("core").select(F.col("id").alias("u"), F.col("id").alias("v"))))
    return points.select("v", "id", F.col("id").alias("node")), roots, links.filter(~F.col("core")).select("u", "v")


def density_clusters(df: DataFrame, key: str, vector: str, eps: float, min_points: int = 5, tile: int = TILE) -> DataFrame:
    """(key, cluster): DBSCAN over rows with whole vectors; noise is -1.

    A row with at least min_points rows within eps, itself included, is a core row; core rows within eps of each other share a cluster; another row joins the first cluster of a core row within eps. Clusters count from 0 in order of
    their least core key. Equal vectors are one weighted point. Vectors of at most GRID_AXES components go through _cell_clusters, whose work doesn't grow with the pairs of a dense place; longer ones, and values beyond
    FAR cells, through _tile_clusters. Components come from contraction. keys are whole numbers, each of one row. A row with a missing or infinite component is noise."""
    whole = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and id is not null")
    rows = held(whole)  # a sum formed twice may round apart, and rows meet their points by value
    finite = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    d, far = finite.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if d is None:
        return rows.select(F.col("id").alias(key), F.lit(-1).cast("long").alias("cluster"))
    if 0 < d <= GRID_AXES and eps > 0 and far / eps < FAR:
        points, roots, borders = _cell_clusters(finite, d, eps, min_points, tile)
    else:
        points, roots, borders = _tile_clusters(finite, d, eps, min_points, tile)
    names = running_totals(roots.groupBy("root").agg(F.lit(1).cast("long").alias("one")), "root", ["one"]).select("root", F.col("below_one").alias("cluster"))
    core = held(roots.join(names, "root").select("node", "cluster"))
    border = borders.join(core.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("cluster").alias("cluster"))
    found = points.join(core.unionByName(border), "node").select("v", "cluster")
    return rows.join(found, "v", "left").select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def neighbour_radius(df: DataFrame, key: str, vector: str, neighbours: int = 5, share: float = 0.9, most_queries: int = 2000) -> float:
    """A radius for density_clusters: the share's percentile of the distance to the neighbours-th nearest row, the row itself counted, over at most most_queries rows chosen by hash."""
    from tarnlake.operators.models import nearest_neighbours

    queries = df.orderBy(F.xxhash64(key), key).limit(most_queries)
    far = nearest_neighbours(df, queries, key, vector, neighbours - 1).groupBy("query").agg(F.max("distance").alias("d"))
    found = order_statistics(far, "d", [share]).first()
    return float(found["quantile"]) if found else 0.0


# ---------------------------------------------------------------- Ward


def ward_merges(centers: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Clusters of weighted points by Ward's rule, down to k, numbered by their first point: the pair whose union adds least to the squared error merges, the first of equals."""
    n = len(centers)
    x, w, alive = centers.astype(float).copy(), weights.astype(float).copy(), np.ones(n, bool)
    member = np.arange(n)
    cost = np.full((n, n), np.inf)
    for i in range(n):
        cost[i, i + 1 :] = w[i] * w[i + 1 :] / (w[i] + w[i + 1 :]) * ((x[i + 1 :] - x[i]) ** 2).sum(axis=1)
    best, at = cost.min(axis=1, initial=np.inf), cost.argmin(axis=1)
    for _ in range(n - max(1, k)):
        i = int(best.argmin())
        j = int(at[i])
        x[i] = (w[i] * x[i] + w[j] * x[j]) / (w[i] + w[j])
        w[i] += w[j]
        alive[j] = False
        member[member == j] = i
        cost[j], cost[:, j], best[j] = np.inf, np.inf, np.inf
        new = np.where(alive, w[i] * w / (w[i] + w) * ((x - x[i]) ** 2).sum(axis=1), np.inf)
        cost[i, i + 1 :], cost[:i, i] = new[i + 1 :], new[:i]
        for r in np.flatnonzero(alive & ((at == i) | (at == j) | (np.arange(n) <= i))):
            best[r], at[r] = cost[r].min(), cost[r].argmin()
    order = {m: c for c, m in enumerate(dict.fromkeys(member.tolist()))}
    return np.array([order[m] for m in member.tolist()])


def ward_clusters(df: DataFrame, keys: list[str], vector: str, k: int, most_points: int = 1000, seed: int = 42) -> DataFrame:
    """keys and cluster by Ward's rule: over the distinct vectors where they are most_points at most, else over that many k-means centres with their sizes, which stand for their rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    distinct = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    few = distinct.limit(most_points + 1).count() <= most_points
    if few:
        found = sorted((tuple(r["v"]), r["n"]) for r in distinct.collect())  # most_points rows at most
        if not found:
            return df.select(*keys, F.lit(0).alias("cluster")).limit(0)
        label = ward_merges(np.array([v for v, _ in found]), np.array([n for _, n in found]), k)
        named = df.sparkSession.createDataFrame([(list(v), int(c)) for (v, _), c in zip(found, label, strict=True)], "v array<double>, cluster int")
        return rows.join(F.broadcast(named), "v").select(*keys, "cluster")
    assembled = rows.withColumn("features", array_to_vector("v"))
    model = KMeans(k=most_points, seed=seed, predictionCol="micro", maxIter=20).fit(assembled)
    placed = held(model.transform(assembled).select(*keys, "micro"))
    size = {r["micro"]: r["count"] for r in placed.groupBy("micro").count().collect()}
    used = sorted(size)
    label = ward_merges(np.array([model.clusterCenters()[m] for m in used]), np.array([size[m] for m in used]), k)
    named = df.sparkSession.createDataFrame([(m, int(c)) for m, c in zip(used, label, strict=True)], "micro int, cluster int")
    return placed.join(F.broadcast(named), "micro").select(*keys, "cluster")


# ---------------------------------------------------------------- quality


def silhouette_squared(df: DataFrame, keys: list[str], vector: str, label: str) -> DataFrame:
    """(keys, label, silhouette) under squared distances, of all rows without noise (label -1 or null), from each cluster's size, sum and sum of squares: no rows meet. A cluster of one row has 0; null with one cluster."""
    rows = df.filter(F.col(label).isNotNull() & (F.col(label) != -1)).select(*keys, F.col(label).alias("own"), F.col(vector).cast("array<double>").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    parts = rows.select("own", F.posexplode("v").alias("at", "x")).groupBy("own", "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count(F.lit(1)).alias("n"))
    clusters = parts.groupBy("own").agg(F.max("n").alias("n"), F.sum("ss").alias("ss"), F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda e: e["s"]).alias("s"))  # components a cluster
    listed = clusters.agg(F.sort_array(F.collect_list(F.struct(F.col("own").alias("c"), "n", "ss", "s"))).alias("clusters"))  # clusters x components numbers
    q = square

    def mean(c: Column) -> Column:
        """Mean squared distance to a cluster's rows, the row itself not counted in its own."""
        dot = F.aggregate(F.zip_with(F.col("v"), c["s"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        total = c["n"] * q - 2 * dot + c["ss"]
        return F.greatest(total, F.lit(0.0)) / F.when(c["c"] == F.col("own"), F.greatest(c["n"] - 1, F.lit(1))).otherwise(c["n"])

    both = rows.crossJoin(F.broadcast(listed))
    a = F.element_at(F.transform(F.filter("clusters", lambda c: c["c"] == F.col("own")), mean), 1)
    b = F.array_min(F.transform(F.filter("clusters", lambda c: c["c"] != F.col("own")), mean))
    alone = F.element_at(F.transform(F.filter("clusters", lambda c: c["c"] == F.col("own")), lambda c: c["n"]), 1) == 1
    sized = both.select(*keys, F.col("own").alias(label), a.alias("a"), b.alias("b"), alone.alias("alone"))
    return sized.select(*keys, label, F.when(F.col("b").isNull(), None).when(F.col("alone"), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def silhouette(rows: DataFrame, queries: DataFrame, key: str, vector: str, label: str, most_queries: int = 2000) -> DataFrame:
    """(key, label, silhouette) of a stated query set under Euclidean distance to all rows, in blocks of queries; noise (label -1 or null) has no part. Tasks send a sum for each query and cluster they met."""
    good = F.col(label).isNotNull() & (F.col(label) != -1)
    rows, queries = (t.filter(good).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("own"), F.col(vector).cast("array<double>").alias("v")) for t in (rows, queries))
    blocks = max(1, math.ceil(queries.count() / most_queries))
    sums = []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        sent = rows.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in own], dtype=np.int64), np.array([r["v"] for r in own], dtype=float)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, points = sent.value
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                there, of = list_matrix(batch.column(1)), batch.column(0).to_numpy()
                step = max(1, CELLS // max(1, there.size))
                for a in range(0, len(ids), step):
                    d = np.sqrt(((points[a : a + step, None, :] - there[None]) ** 2).sum(axis=2))
                    for c in np.unique(of).tolist():
                        total.setdefault(c, np.zeros(len(ids)))[a : a + step] += d[:, of == c].sum(axis=1)
            for c, s in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([c] * len(ids), pa.int64()), pa.array(s)], names=["id", "c", "s"])

        sums.append(rows.select("own", "v").mapInArrow(run, "id long, c long, s double"))
    sizes = rows.groupBy(F.col("own").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    far = reduce(DataFrame.unionByName, sums).groupBy("id", "c").agg(F.sum("s").alias("s")).join(sizes, "c").join(queries.select("id", "own"), "id")
    is_own = F.col("c") == F.col("own")
    both = far.groupBy("id", "own").agg(F.max(F.when(is_own, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.max(F.when(is_own, F.col("n"))).alias("n"), F.min(F.when(~is_own, F.col("s") / F.col("n"))).alias("b"))
    return both.select(F.col("id").alias(key), F.col("own").alias(label), F.when(F.col("b").isNull(), None).when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


# ---------------------------------------------------------------- the whole sequence


class Clustered(NamedTuple):
    """labels: keys and cluster; quality: n_clusters, n_noise, silhouette (squared distances) and Calinski-Harabasz, noise left out; features that were in use."""

    labels: DataFrame
    quality: DataFrame
    features: list[str]


def clustered(df: DataFrame, key: str, features: list[str], method: str = "kmeans", k: int = 5, selection: str = "all", standardise: bool = True, components: int | None = None, eps: float | None = None, min_points: int | None = None, keep: list[str] | None = None, seed: int = 42) -> Clustered:
    """The whole sequence; see the module's text. key: a whole number for each row; keep: other columns, as the image's id, that stay beside it. Density clusters without eps use neighbour_radius, and without min_points a hundredth of the rows, 5 at least."""
    from tarnlake.operators.inference import cluster_quality

    keep = keep or []
    rows = held(complete_rows(df, [key, *keep], features))
    columns = selected_features(rows, features, selection)
    ready = held(projected(rows, [key], columns, standardise, components))
    if method == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        assembled = ready.select(key, array_to_vector("v").alias("features"))
        found = KMeans(k=k, seed=seed, predictionCol="cluster").fit(assembled).transform(assembled).select(key, "cluster")
    elif method == "dbscan":
        found = density_clusters(ready, key, "v", neighbour_radius(ready, key, "v") if eps is None else eps, max(5, ready.count() // 100) if min_points is None else min_points)
    elif method == "ward":
        found = ward_clusters(ready, [key], "v", k, seed=seed)
    else:
        raise ValueError("clusters are found by kmeans, dbscan or ward")
    labels = held(rows.select(key, *keep).join(found, key))
    scored = ready.join(labels.select(key, "cluster"), key)
    width = components or len(columns)
    spread = scored.filter("cluster <> -1").select("cluster", *[F.col("v")[i].alias(f"f{i}") for i in range(width)])
    quality = cluster_quality(spread, "cluster", [f"f{i}" for i in range(width)]).select("n_clusters", "calinski_harabasz")
    shape = silhouette_squared(scored, [key], "v", "cluster").agg(F.avg("silhouette").alias("silhouette"))
    noise = labels.agg(F.count(F.when(F.col("cluster") == -1, 1)).alias("n_noise"), F.count(F.lit(1)).alias("n_rows"))
    return Clustered(labels, quality.crossJoin(shape).crossJoin(noise), [features[c] for c in columns])
