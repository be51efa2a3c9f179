"""Many models of one table, fitted in shared passes.

Cross-validation with a grid fits a model for each (outer fold, inner fold, grid point). Instead of a job for each, one pass over the table gives what all of them need: moments of every training
set's features (differences of sums by cell), then, per Newton step, the loss, gradient and curvature of every model that hasn't converged. A task sends one such packet a model; Spark adds
those of a model. The driver solves systems of as many unknowns as a model has features. Passes are as many as the slowest model needs, whatever the number of models.

rows: (y double, x array<double>, cells array<int>, ...). cells[s] of a row is its fold in split s, or -1 if split s never trains on it. A training set (s, i) has the rows
with cells[s] neither -1 nor i; i = -1 leaves nothing more out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.ordered import order_statistics

#: Numbers of all models' packets in one pass; more models take several passes.
PACKET_CELLS = 1 << 22
STEPS = 60


def batch_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x with NaN for nulls, and cells, of a batch whose first columns are these."""
    n = batch.num_rows
    y = batch.column(0).to_numpy(zero_copy_only=False)
    x, cells = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for i in (1, 2))
    return y, x.astype(float), cells


def summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum over all rows of an array of `size` numbers that add(total, y, x, cells) adds to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                add(total, *batch_arrays(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "s"])

    out = np.zeros(size)
    for r in rows.select("y", "x", "cells").mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():  # `size` rows
        out[r["cell"]] = r["s"]
    return out


class Moments(NamedTuple):
    """Of each training set (split, left-out fold + 1) and class: rows, and per feature values, their sum, sum of squares and of products with y; sums of y where the feature is missing. Values less `shift`."""

    rows: np.ndarray
    n: np.ndarray
    s: np.ndarray
    ss: np.ndarray
    sy: np.ndarray
    y_missing: np.ndarray
    y: np.ndarray
    yy: np.ndarray
    shift: np.ndarray


def moments(rows: DataFrame, splits: int, folds: int, features: int, by_class: bool) -> Moments:
    """Moments of every training set, from one pass that sums each cell, and one before it for the means that values are taken from."""
    classes = 2 if by_class else 1
    row = rows.agg(*[F.avg(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])).alias(f"m{i}") for i in range(features)]).first()
    shift = np.array([row[i] or 0.0 for i in range(features)])
    width = 5 * features + 3

    def add(total: np.ndarray, y: np.ndarray, x: np.ndarray, cells: np.ndarray) -> None:
        of = total.reshape(splits, folds, classes, width)
        z = x - shift
        there = ~np.isnan(z)
        z = np.where(there, z, 0.0)
        for s in range(splits):
            for i in range(folds):
                for c in range(classes):
                    m = (cells[:, s] == i) & ((y == c) if by_class else True)
                    t, v, w = there[m], z[m], y[m]
                    of[s, i, c] += np.concatenate([t.sum(0), v.sum(0), (v * v).sum(0), w @ v, w @ ~t, [len(w), w.sum(), w @ w]])

    cells = summed(rows, splits * folds * classes * width, add).reshape(splits, folds, classes, width)
    whole = cells.sum(axis=1, keepdims=True)
    sets = np.concatenate([whole, whole - cells], axis=1)  # left-out fold + 1
    p = features
    return Moments(sets[..., 5 * p], *[sets[..., k * p : (k + 1) * p] for k in range(5)], sets[..., 5 * p + 1], sets[..., 5 * p + 2], shift)


def set_medians(rows: DataFrame, splits: int, folds: int, features: list[int]) -> np.ndarray:
    """Exact medians (splits, folds + 1, len(features)) of every training set, for features with missing values; 0 where a set has none."""
    out = np.zeros((splits, folds + 1, len(features)))
    if not features:
        return out
    long = rows.select("cells", F.posexplode(F.array(*[F.col("x")[i] for i in features])).alias("feature", "value")).filter("value is not null and not isnan(value)")
    sets = F.filter(F.flatten(F.array(*[F.array(*[F.when((F.col("cells")[s] != -1) & (F.col("cells")[s] != i), F.lit(s * (folds + 1) + i + 1)) for i in range(-1, folds)]) for s in range(splits)])), lambda v: v.isNotNull())
    found = order_statistics(long.select("feature", "value", F.explode(sets).alias("set")), "value", [0.5], ["set", "feature"])
    for r in found.collect():  # a row for each training set and such feature
        out[r["set"] // (folds + 1), r["set"] % (folds + 1), r["feature"]] = r["quantile"]
    return out


class TrainingSet(NamedTuple):
    """A training set, its columns in use, and what replaces missing values, centres and scales them. weights: of class 0 and 1."""

    split: int
    inner: int
    columns: np.ndarray
    fill: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weights: tuple[float, float]
    n: float

    def matrix(self, x: np.ndarray) -> np.ndarray:
        """1 and the prepared columns of rows x."""
        z = x[:, self.columns]
        z = (np.where(np.isnan(z), self.fill, z) - self.center) / self.scale
        return np.column_stack([np.ones(len(z)), z])


class Prepared(NamedTuple):
    """All training sets' imputed moments: fill, mean, population deviation and univariate score per feature."""

    fill: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    score: np.ndarray
    rows: np.ndarray
    class_mean: np.ndarray
    class_var: np.ndarray

    def of(self, split: int, inner: int, columns: np.ndarray) -> TrainingSet:
        at = (split, inner + 1)
        counts = self.rows[at]
        n = counts.sum()
        weights = tuple(n / (2 * c) if c else 0.0 for c in counts) if len(counts) == 2 else (1.0, 1.0)
        scale = self.std[at][columns]
        return TrainingSet(split, inner, columns, self.fill[at][columns], self.mean[at][columns], np.where(scale > 0, scale, 1.0), weights, float(n))


def prepared(rows: DataFrame, splits: int, folds: int, features: int, by_class: bool) -> Prepared:
    """Medians, means, deviations and F of every feature in every training set; F of a one-way analysis of variance, or of regression. NaN where a feature is constant."""
    m = moments(rows, splits, folds, features, by_class)
    missing = m.rows[:, 0, :, None] > m.n[:, 0] + 0.5
    some = np.flatnonzero(missing.any(axis=(0, 1))).tolist()
    fill = np.broadcast_to(m.shift, m.n.shape[:2] + (features,)).copy()
    fill[:, :, some] = set_medians(rows, splits, folds, some)
    v = (fill - m.shift)[:, :, None, :]
    lack = m.rows[..., None] - m.n
    s, ss, n = m.s + lack * v, m.ss + lack * v * v, m.rows[..., None]
    with np.errstate(divide="ignore", invalid="ignore"):
        total, square, count = s.sum(axis=2), ss.sum(axis=2), n.sum(axis=2)
        mean = total / count
        within_all = np.maximum(square - total * mean, 0.0)
        if by_class:
            class_mean = s / n
            within = np.maximum((ss - s * class_mean).sum(axis=2), 0.0)
            between = np.maximum(within_all - within, 0.0)
            score = between / (within / (count - 2))
            class_var = np.maximum(ss / n - class_mean**2, 0.0)
        else:
            class_mean = class_var = np.zeros_like(s)
            sy = (m.sy + m.y_missing * v).sum(axis=2)
            y, yy = m.y.sum(axis=2)[..., None], m.yy.sum(axis=2)[..., None]
            r2 = (sy - total * y / count) ** 2 / (within_all * (yy - y * y / count))
            score = r2 / (1 - r2) * (count - 2)
        flat = within_all <= 1e-12 * np.maximum(square, 1e-300)
        return Prepared(fill, mean + m.shift, np.where(flat, 0.0, np.sqrt(within_all / count)), np.where(flat, np.nan, score), m.rows, class_mean + m.shift, class_var)


def best_columns(score: np.ndarray, most: int) -> np.ndarray:
    """The features of largest score, in column order; the first of equals, those without a score last."""
    order = np.lexsort((np.arange(len(score)), -np.where(np.isnan(score), -np.inf, score)))
    return np.sort(order[:most])


class Penalised(NamedTuple):
    """A model to fit: loss summed over the training set, plus l2/2 |w|^2 + l1 |w|_1; the intercept is free. linear: half the squared error instead of the logistic loss."""

    of: TrainingSet
    l2: float
    l1: float = 0.0
    linear: bool = False


def _packets(rows: DataFrame, models: list[Penalised], betas: list[np.ndarray], active: list[int]) -> dict[int, np.ndarray]:
    """Loss, gradient and curvature of the active models at betas."""
    sets: dict[int, list[int]] = {}
    for k in active:
        sets.setdefault(id(models[k].of), []).append(k)
    jobs = [(models[ks[0]].of, [(k, betas[k], models[k].linear) for k in ks]) for ks in sets.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 + len(b) + len(b) ** 2) for _, own in jobs for k, b, _ in own}
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x, cells = batch_arrays(batch)
            for t, own in jobs:
                m = (cells[:, t.split] != -1) & (cells[:, t.split] != t.inner)
                z, label = t.matrix(x[m]), y[m]
                weight = np.where(label > 0.5, t.weights[1], t.weights[0])
                for k, b, linear in own:
                    eta = z @ b
                    if linear:
                        total[k] += np.concatenate([[((label - eta) ** 2).sum() / 2], z.T @ (eta - label), (z.T @ z).ravel()])
                        continue
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    loss = weight @ (np.logaddexp(0.0, eta) - label * eta)
                    total[k] += np.concatenate([[loss], z.T @ (weight * (p - label)), ((z.T * (weight * p * (1 - p))) @ z).ravel()])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["model", "part", "packet"])

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")  # one order of addition, so a run repeats to the bit
        packets = table.column("packet").to_pylist()
        return pa.table([table.column("model").slice(0, 1), pa.array([sum(np.frombuffer(packets[i]) for i in order).tobytes()], pa.binary())], names=["model", "packet"])

    sent = rows.select("y", "x", "cells").mapInArrow(run, "model int, part int, packet binary")
    return {r["model"]: np.frombuffer(r["packet"]) for r in sent.groupBy("model").applyInArrow(add, "model int, packet binary").collect()}  # a packet a model


def _quadratic_step(g: np.ndarray, h: np.ndarray, w: np.ndarray, l1: float) -> np.ndarray:
    """The minimum of a quadratic model around w plus l1 |w|_1 without the intercept: by solving, or with l1 by coordinate descent."""
    if not l1:
        return w - np.linalg.lstsq(h, g, rcond=None)[0]
    out, slope = w.copy(), g.copy()  # slope of the quadratic at out
    for _ in range(1000):
        most = 0.0
        for j in range(len(w)):
            if h[j, j] <= 0:
                continue
            target = out[j] - slope[j] / h[j, j]
            new = target if j == 0 else np.sign(target) * max(0.0, abs(target) - l1 / h[j, j])
            if step := new - out[j]:
                slope += step * h[:, j]
                out[j] = new
                most = max(most, abs(step))
        if most < 1e-10:
            break
    return out


def fit_all(rows: DataFrame, models: list[Penalised], tolerance: float = 1e-8) -> list[np.ndarray]:
    """Intercept and weights of each model, by Newton steps that all models share the passes of; steps that don't lessen the loss are halved."""
    out: list[np.ndarray] = [np.zeros(len(m.of.columns) + 1) for m in models]
    width = [1 + len(b) + len(b) ** 2 for b in out]
    chunk: list[int] = []
    for k in range(len(models) + 1):
        if chunk and (k == len(models) or sum(width[j] for j in chunk) + width[k] > PACKET_CELLS):
            _fit_chunk(rows, models, out, chunk, tolerance)
            chunk = []
        if k < len(models):
            chunk.append(k)
    return out


def _fit_chunk(rows: DataFrame, models: list[Penalised], betas: list[np.ndarray], active: list[int], tolerance: float) -> None:
    kept, least = {k: betas[k].copy() for k in active}, {k: np.inf for k in active}
    for _ in range(STEPS):
        packets = _packets(rows, models, betas, active)
        still = []
        for k in active:
            w, m, packet = betas[k], models[k], packets.get(k)
            if packet is None:
                continue  # no rows at all
            n = len(w)
            free = np.concatenate([[0.0], w[1:]])
            loss = packet[0] + m.l2 / 2 * free @ free + m.l1 * np.abs(free).sum()
            if loss > least[k] + 1e-9 * max(1.0, abs(least[k])):
                if np.abs(w - kept[k]).max() > tolerance:
                    betas[k] = (w + kept[k]) / 2
                    still.append(k)
                else:
                    betas[k] = kept[k]
                continue
            kept[k], least[k] = w.copy(), loss
            g = packet[1 : 1 + n] + m.l2 * free
            h = packet[1 + n :].reshape(n, n) + m.l2 * np.diag([0.0] + [1.0] * (n - 1))
            new = _quadratic_step(g, h, w, m.l1)
            if np.abs(new - w).max() > tolerance * max(1.0, np.abs(w).max()):
                betas[k] = new
                still.append(k)
        active = still
        if not active:
            return
    for k in active:
        betas[k] = kept[k]
