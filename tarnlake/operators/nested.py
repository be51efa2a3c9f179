"""Nested cross-validation by subject: an inner search over a grid in each outer fold, with imputation, scaling and feature selection learnt inside each training set.

Logistic and linear models and Gaussian Bayes are fitted for all folds and grid points in shared passes (shared_fits); other kinds are MLlib pipelines, one fit each. Rows are read once and kept in
the checkpoint folder. Inner scores and the area under the curve are ranks in ranges over all held-out rows of a model, without a task that holds a fold.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.columns import number, numeric_columns, require_columns
from tarnlake.functions.held import held
from tarnlake.functions.ordered import running_totals
from tarnlake.operators import folds as by_subject
from tarnlake.operators.models import estimator
from tarnlake.operators.shared_fits import Penalised, Prepared, TrainingSet, best_columns, fit_all, prepared

# The grids' candidates by kind of model and preset.
GRIDS = {
    ("logistic_regression", "compact"): [{"C": [0.01, 0.1, 1.0, 10.0]}],
    ("logistic_regression", "expanded"): [{"penalty": ["l2"], "C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]}, {"penalty": ["l1"], "C": [0.01, 0.1, 1.0, 10.0]}],
    ("svm", "compact"): [{"C": [0.1, 1.0, 10.0]}],
    ("svm", "expanded"): [{"C": [0.01, 0.1, 1.0, 10.0]}],
    ("random_forest", "compact"): [{"max_depth": [None, 4, 8], "min_samples_leaf": [1, 3, 5]}],
    ("random_forest", "expanded"): [{"n_estimators": [100, 200, 500], "max_depth": [None, 4, 8, 12], "min_samples_leaf": [1, 3, 5, 10], "max_features": ["sqrt", "log2", None]}],
    ("naive_bayes", "compact"): [{"var_smoothing": [1e-9, 1e-8, 1e-7]}],
    ("naive_bayes", "expanded"): [{"var_smoothing": [1e-10, 1e-9, 1e-8, 1e-7, 1e-6]}],
    ("gradient_boosting", "compact"): [{"n_estimators": [80, 150], "max_depth": [2, 3, 5], "learning_rate": [0.03, 0.08], "min_child_weight": [3, 8], "gamma": [0, 0.1], "subsample": [0.7, 0.8]}],
    ("gradient_boosting", "expanded"): [{"n_estimators": [50, 80, 100, 150, 200], "max_depth": [2, 3, 4, 5, 6, 7], "learning_rate": [0.03, 0.05, 0.08, 0.1], "min_child_weight": [3, 5, 8, 10], "gamma": [0, 0.05, 0.1, 0.125, 0.2, 0.5], "subsample": [0.6, 0.7, 0.8]}],
    ("linear_regression", "compact"): [{}],
    ("linear_regression", "expanded"): [{}],
}
SHARED = {"logistic_regression", "linear_regression", "naive_bayes"}
#: An MLlib option for each grid name.
MLLIB = {"n_estimators": {"random_forest": "numTrees", "gradient_boosting": "maxIter"}, "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "min_child_weight": "minInstancesPerNode", "max_features": "featureSubsetStrategy", "learning_rate": "stepSize", "gamma": "minInfoGain", "subsample": "subsamplingRate", "C": "regParam"}


def parameter_grid(kind: str, preset: str = "compact") -> list[dict]:
    """Every combination of a preset's candidates, in order."""
    if (kind, preset) not in GRIDS:
        raise ValueError(f"no {preset} grid for {kind}; there are {sorted({k for k, _ in GRIDS})}, compact and expanded")
    return expanded(GRIDS[kind, preset])


def expanded(grid: dict | list[dict]) -> list[dict]:
    """Combinations of a dict of candidates, or of each dict of a list."""
    return [dict(zip(g, values, strict=True)) for g in ([grid] if isinstance(grid, dict) else grid) for values in product(*g.values())]


class NestedResult(NamedTuple):
    """predictions: a row for each row of the table, scored by the model of its outer fold; folds: a row for each outer fold; grid: inner scores; selected: (fold, feature)."""

    predictions: DataFrame
    folds: DataFrame
    grid: DataFrame
    selected: DataFrame


class Scorer(NamedTuple):
    """A fitted model of a shared kind."""

    of: TrainingSet
    beta: np.ndarray | None
    classes: tuple | None = None  # (log share, means, variances) of class 0 and 1
    linear: bool = False

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.of.matrix(x)
        if self.classes is not None:
            a, b = (share - 0.5 * (np.log(2 * math.pi * var) + (z[:, 1:] - mean) ** 2 / var).sum(axis=1) for share, mean, var in self.classes)
            return 1 / (1 + np.exp(np.clip(a - b, -700, 700)))
        eta = z @ self.beta
        return eta if self.linear else 1 / (1 + np.exp(-np.clip(eta, -700, 700)))


def scored(rows: DataFrame, keys: list[str], models: list[tuple[int, Scorer]], held_out: bool) -> DataFrame:
    """(keys, y, model, score) of the rows each model leaves out: those of its inner fold, or with held_out the outer test rows."""
    fields = [rows.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, cells = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for i in (1, 2))
            for name, m in models:
                at = np.flatnonzero(cells[:, m.of.split] == (-1 if held_out else m.of.inner))
                if len(at):
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*[c.take(take) for c in batch.columns[3:]], batch.column(0).take(take), pa.array([name] * len(at), pa.int32()), pa.array(m.score(x[at].astype(float)))], names=[*keys, "y", "model", "score"])

    schema = T.StructType([*fields, T.StructField("y", T.DoubleType()), T.StructField("model", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return rows.select("y", "x", "cells", *keys).mapInArrow(run, schema)


def areas(scores: DataFrame, by: str, label: str = "y", score: str = "score") -> DataFrame:
    """(by, n, auc) of each group's scores by average ranks; null with one class."""
    counted = scores.groupBy(by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones"))
    ranked = running_totals(counted, score, ["n"], [by])
    n1 = F.sum("ones")
    area = F.sum(F.col("ones") * (F.col("below_n") + (F.col("n") + 1) / 2)) - n1 * (n1 + 1) / 2
    return ranked.groupBy(by).agg(F.sum("n").alias("n"), F.try_divide(area, n1 * (F.sum("n") - n1)).alias("auc"))


def explained(scores: DataFrame, by: str) -> DataFrame:
    """(by, n, r2, mae) of each group's predictions."""
    error = F.col("y") - F.col("score")
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.avg(error * error), F.var_pop("y"))).alias("r2"), F.avg(F.abs(error)).alias("mae"))


def _shared_models(rows: DataFrame, ready: Prepared, sets: list[TrainingSet], kind: str, grid: list[dict]) -> list[Scorer]:
    """A fitted model for each training set and grid point."""
    if kind == "naive_bayes":
        out = []
        for t in sets:
            at = (t.split, t.inner + 1)
            mean, var = (ready.class_mean[at][:, t.columns] - t.center) / t.scale, ready.class_var[at][:, t.columns] / t.scale**2
            share = np.log(np.maximum(ready.rows[at], 1e-300) / ready.rows[at].sum())
            most = (ready.std[at][t.columns] / t.scale).max(initial=0.0) ** 2
            out += [Scorer(t, None, tuple((share[c], mean[c], var[c] + g.get("var_smoothing", 1e-9) * most + 1e-300) for c in (0, 1))) for g in grid]
        return out
    linear = kind == "linear_regression"
    wanted = []
    for t in sets:
        for g in grid:
            strength = float(g.get("alpha", 0.0)) if linear else 1.0 / float(g.get("C", 1.0))
            wanted.append(Penalised(t, 0.0 if g.get("penalty") == "l1" else strength, strength if g.get("penalty") == "l1" else 0.0, linear))
    return [Scorer(m.of, b, None, linear) for m, b in zip(wanted, fit_all(rows, wanted), strict=True)]


def mllib_options(kind: str, settings: dict, n: float) -> dict:
    """A grid point as MLlib's options."""
    out = {}
    for name, value in settings.items():
        option = MLLIB[name][kind] if isinstance(MLLIB[name], dict) else MLLIB[name]
        if name == "max_depth" and value is None:
            value = 30
        elif name == "max_features":
            value = value or "all"
        elif name == "C":
            value = 1.0 / (value * n)
        out[option] = value
    return out


def _mllib_scores(rows: DataFrame, keys: list[str], t: TrainingSet, kind: str, task: str, settings: dict, seed: int, name: int, held_out: bool) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    cell = F.col("cells")[t.split]
    columns = [(F.coalesce(F.when(~F.isnan(F.col("x")[int(c)]), F.col("x")[int(c)]), F.lit(float(f))) - float(m)) / float(s) for c, f, m, s in zip(t.columns, t.fill, t.center, t.scale, strict=True)]
    ready = rows.select(*keys, "y", F.col("y").alias("label"), cell.alias("cell"), array_to_vector(F.array(*columns)).alias("features"))
    model = estimator(kind, task, seed, **mllib_options(kind, settings, t.n)).fit(ready.filter(F.col("cell") != -1 if t.inner < 0 else (F.col("cell") != -1) & (F.col("cell") != t.inner)))
    shown = model.transform(ready.filter(F.col("cell") == (-1 if held_out else t.inner)))
    score = F.col("prediction") if task == "regression" else vector_to_array("probability")[1] if "probability" in shown.columns else vector_to_array("rawPrediction")[1]
    return shown.select(*keys, "y", F.lit(name).alias("model"), score.alias("score"))


def nested_cross_validated(df: DataFrame, label: str, subject: str = "patient_id", features: list[str] | None = None, kind: str = "logistic_regression", task: str = "classification", outer: int = 5, inner: int = 4, selection: str = "k_best", n_features: int = 20, grid: dict | list[dict] | None = None, seed: int = 42, keys: list[str] | None = None) -> NestedResult:
    """Out-of-fold scores of every row with the search repeated in each outer fold; see the module's text.

    selection: "none", "k_best" (F), "l1" (weights of an L1 logistic model that aren't 0) or "sequence" (selector.py). Inner scores are the area under the curve, or r2; of equal ones the first grid point wins.
    A label has two classes, of which the greater is the positive one. Rows keep `keys`, by default the subject. Predictions of "svm" are margins, positive for the positive class."""
    keys = [subject] if keys is None else keys
    require_columns(df, [label, subject, *keys, *(features or [])])
    features = numeric_columns(df, (label, subject, *keys)) if features is None else features
    if not features:
        raise ValueError("no numeric features")
    if outer < 2 or inner < 2 or n_features < 1:
        raise ValueError("outer and inner folds are at least 2, n_features at least 1")
    if selection not in {"none", "k_best", "l1", "sequence"}:
        raise ValueError("selection is none, k_best, l1 or sequence")
    classes = task == "classification"
    if classes == (kind == "linear_regression") or not classes and kind in {"logistic_regression", "naive_bayes"} or selection == "l1" and not classes:
        raise ValueError(f"{kind} with {selection} is no {task}")
    points = parameter_grid(kind) if grid is None else expanded(grid)

    subjects = by_subject.subjects_of(df, subject, label)
    if classes:
        values = sorted(r[0] for r in subjects.select("label").distinct().limit(3).collect())
        if len(values) != 2:
            raise ValueError("a classification needs two labels")
    else:
        subjects = subjects.withColumn("label", F.lit(0))
    nested = by_subject.nested_folds(subjects, outer, inner, seed).select(F.col("subject").alias("__subject"), "fold", "cells")
    y = (F.col(label) == values[1]).cast("double") if classes else number(label)
    carried = [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    names = [f"key_{i}" for i in range(len(keys))]
    rows = held(df.join(nested, F.col(subject) == F.col("__subject")).select(y.alias("y"), F.array(*[number(c) for c in features]).alias("x"), "cells", "fold", F.col("__subject").alias("subject"), *carried))

    ready = prepared(rows, outer, inner, len(features), classes)
    columns = _chosen_columns(rows, ready, outer, inner, selection, n_features, features, task, seed)
    inner_sets = [ready.of(s, i, columns[s, i]) for s in range(outer) for i in range(inner)]
    outer_sets = [ready.of(s, -1, columns[s, -1]) for s in range(outer)]
    g = len(points)
    if kind in SHARED:
        fitted = _shared_models(rows, ready, inner_sets + outer_sets, kind, points)
        inside = scored(rows, [], list(enumerate(fitted[: len(inner_sets) * g])), held_out=False)
    else:
        inside = reduce(DataFrame.unionByName, [_mllib_scores(rows, [], t, kind, task, p, seed, k * g + j, False) for k, t in enumerate(inner_sets) for j, p in enumerate(points)])
    measured = areas(inside, "model").select("model", F.col("auc").alias("v")) if classes else explained(inside, "model").select("model", F.col("r2").alias("v"))
    scores = np.full(len(inner_sets) * g, np.nan)
    for r in measured.collect():  # a row for each inner fold and grid point
        scores[r["model"]] = np.nan if r["v"] is None else r["v"]
    by_point = scores.reshape(outer, inner, g)
    defined = ~np.isnan(by_point)
    means = np.where(defined.any(axis=1), np.where(defined, by_point, 0.0).sum(axis=1) / np.maximum(defined.sum(axis=1), 1), -np.inf)
    best = means.argmax(axis=1)
    if kind in SHARED:
        last = [(s, fitted[len(inner_sets) * g + s * g + best[s]]) for s in range(outer)]
        outside = scored(rows, [*names, "subject", "fold"], last, held_out=True)
    else:
        outside = reduce(DataFrame.unionByName, [_mllib_scores(rows, [*names, "subject", "fold"], t, kind, task, points[best[s]], seed, s, True) for s, t in enumerate(outer_sets)])
    predicted = (F.col("score") > (0.0 if kind == "svm" else 0.5)).cast("int") if classes else F.col("score")
    truth = F.col("y").cast("int") if classes else F.col("y")
    outside = held(outside)
    predictions = outside.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "fold", truth.alias("y_true"), predicted.alias("y_pred"), F.col("score").alias("y_score"))

    spark = df.sparkSession
    tested = rows.groupBy("fold").agg(F.countDistinct("subject").alias("n_test_subjects"))
    total = tested.agg(F.sum("n_test_subjects").alias("n_subjects"))
    facts = [(s + 1, json.dumps(points[best[s]], sort_keys=True), float(means[s, best[s]]) if math.isfinite(means[s, best[s]]) else None, [features[c] for c in columns[s, -1]]) for s in range(outer)]
    report = spark.createDataFrame(facts, "fold int, best_params string, inner_best_score double, selected_features array<string>").join(tested, "fold").crossJoin(F.broadcast(total))
    if classes:
        quality = areas(outside, "fold").select("fold", "auc").join(outside.groupBy("fold").agg(F.avg((predicted == truth).cast("double")).alias("accuracy")), "fold")
    else:
        quality = explained(outside, "fold").select("fold", "r2", "mae")
    report = report.join(quality, "fold").withColumn("n_train_subjects", F.col("n_subjects") - F.col("n_test_subjects")).drop("n_subjects")
    table = [(s + 1, i, json.dumps(p, sort_keys=True), None if np.isnan(by_point[s, i, j]) else float(by_point[s, i, j])) for s in range(outer) for i in range(inner) for j, p in enumerate(points)]
    return NestedResult(
        predictions, report, spark.createDataFrame(table, "fold int, inner int, params string, score double"),
        spark.createDataFrame([(s + 1, features[c]) for s in range(outer) for c in columns[s, -1]], "fold int, feature string"),
    )


def _chosen_columns(rows: DataFrame, ready: Prepared, outer: int, inner: int, selection: str, most: int, features: list[str], task: str, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """The columns in use in every training set."""
    sets = [(s, i) for s in range(outer) for i in range(-1, inner)]
    every = np.arange(len(features))
    if selection == "none":
        return dict.fromkeys(sets, every)
    if selection == "k_best":
        return {(s, i): best_columns(ready.score[s, i + 1], most) for s, i in sets}
    if selection == "l1":
        weights = fit_all(rows, [Penalised(ready.of(s, i, every), 0.0, 1.0) for s, i in sets])
        out = {}
        for (s, i), w in zip(sets, weights, strict=True):
            size = np.abs(w[1:])
            out[s, i] = np.flatnonzero(size > 1e-5) if (size > 1e-5).any() else np.array([int(size.argmax())])
        return out
    from tarnlake.operators import selector

    found = {}
    for s, i in sets:
        cell = F.col("cells")[s]
        part = rows.filter((cell != -1) & (cell != i)).select("subject", F.col("y").alias("label"), *[F.col("x")[c].alias(f"f{c}") for c in every.tolist()])
        chosen = selector.fit(part, "label", [f"f{c}" for c in every.tolist()], "subject", selector.Settings(task=task, most_features=most, seed=seed))
        found[s, i] = np.array(sorted(int(c[1:]) for c in chosen.selected))
    return found
