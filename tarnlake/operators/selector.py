"""Sequential feature selection: univariate test, correlation, relevance less redundancy, L1 path.

1. A feature stays if its Mann-Whitney (two classes) or Spearman (regression) p is the threshold or less; p is exact where a class has 8 rows at most and there are no ties, else by the normal
   approximation with tie and continuity corrections.
2. In column order, a feature stays if its absolute rank correlation with each that stays is under a threshold.
3. Greedily, the feature with the largest relevance less mean absolute rank correlation with those chosen: relevance is nearest-neighbour information for classes (information.py), for regression the Gaussian
   information -ln(1 - rho^2) / 2 of the rank correlation.
4. Features whose weight isn't 0 in an L1 model of the standardised features, its strength the best of a path over folds by subject; the strongest alone if all are 0.

Stages 1 to 3 don't depend on the seed, so repeated seeds repeat the last stage only, as splits of the same table whose models share passes (shared_fits).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.columns import long_form, number, require_columns
from tarnlake.functions.held import held
from tarnlake.functions.ordered import order_statistics, running_totals, value_ranks
from tarnlake.operators import folds as by_subject
from tarnlake.operators.information import class_information
from tarnlake.operators.shared_fits import Penalised, TrainingSet, _packets, _quadratic_step, fit_all, prepared

#: Strengths of the L1 path: 20 values of C from 1e-4 to 1e4 for classes; 100 from the least that leaves nothing to a thousandth of it for regression.
CS = np.logspace(-4, 4, 20)
ALPHAS, SPAN = 100, 1e-3


class Settings(NamedTuple):
    task: str = "classification"
    p_threshold: float | None = 0.05
    correlation: float | None = 0.9
    most_features: int | None = 50
    folds: int = 5
    seed: int = 42


class Selection(NamedTuple):
    """selected features, features left after each stage, and weights of the last model."""

    selected: list[str]
    stages: dict[str, list[str]]
    coefficients: dict[str, float]
    seed: int


def exact_tail(u: float, a: int, b: int) -> float:
    """P(U >= u) of Mann-Whitney's U without ties, by counting arrangements."""
    ways = np.zeros((a + 1, a * b + 1))
    ways[0, 0] = 1.0
    for y in range(1, b + 1):  # ways[x, u]: U as a sum of x parts of at most y, a part for each value of the first sample above one of the second
        for x in range(1, a + 1):
            ways[x, y:] += ways[x - 1, : a * b + 1 - y]
    return float(ways.sum(axis=0)[int(math.ceil(u)) :].sum() / math.comb(a + b, a))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d or 1e-300)
            c = 1 + t / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def mann_whitney_p(n1: float, n0: float, u: float, ties: float) -> float | None:
    if not n1 or not n0:
        return None
    most = max(u, n1 * n0 - u)
    if min(n1, n0) <= 8 and not ties:
        return min(1.0, 2 * exact_tail(most, int(n1), int(n0)))
    n = n1 + n0
    spread = math.sqrt(n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1))))
    return 1.0 if not spread else min(1.0, math.erfc((most - n1 * n0 / 2 - 0.5) / spread / math.sqrt(2)))


def spearman_p(n: float, rho: float | None) -> float | None:
    if rho is None or n < 3:
        return None
    return incomplete_beta((n - 2) / 2, 0.5, 1 - min(1.0, rho * rho)) if n > 2 else None


def univariate_tests(df: DataFrame, label: str, features: list[str], task: str = "classification") -> DataFrame:
    """(feature, n, statistic, p_value): U of the greater class, or Spearman's rho. One set of ranges for all features."""
    rows = long_form(df.filter(F.col(label).isNotNull()), [label], features).filter("value is not null")
    if task == "classification":
        counted = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("ones"))
        ranked = running_totals(counted, "value", ["n"], ["feature"])
        n, rank = F.col("n").cast("double"), F.col("below_n") + (F.col("n") + 1) / 2
        sums = ranked.groupBy("feature").agg(F.sum("ones").alias("n1"), F.sum(n - F.col("ones")).alias("n0"), F.sum(F.col("ones") * rank).alias("rank_sum"), F.sum(n * n * n - n).alias("ties"))
        table = sums.select("feature", (F.col("n1") + F.col("n0")).cast("long").alias("n"), (F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2).alias("statistic"), "n1", "n0", "ties")
    else:
        x = value_ranks(rows, "value", ["feature"]).select("feature", "value", F.col("average_rank").alias("rx"))
        y = value_ranks(rows, label, ["feature"]).select("feature", label, F.col("average_rank").alias("ry"))
        ranks = rows.join(x, ["feature", "value"]).join(y, ["feature", label])
        table = ranks.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("statistic")).select("feature", "n", F.when(~F.isnan("statistic"), F.col("statistic")).alias("statistic"), F.lit(0.0).alias("n1"), F.lit(0.0).alias("n0"), F.lit(0.0).alias("ties"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [(mann_whitney_p(r["n1"], r["n0"], r["statistic"], r["ties"]) if task == "classification" else spearman_p(r["n"], r["statistic"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p, pa.float64())], names=["feature", "n", "statistic", "p_value"])

    return table.mapInArrow(run, "feature string, n long, statistic double, p_value double")


def rank_correlations(df: DataFrame, features: list[str]) -> np.ndarray:
    """Spearman's rho of all pairs over rows with all features; NaN with a constant one."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    rows = VectorAssembler(inputCols=features, outputCol="v").transform(df.select(*[number(c).alias(c) for c in features]).dropna())
    return Correlation.corr(rows, "v", "spearman").first()[0].toArray()


def uncorrelated(rho: np.ndarray, threshold: float) -> list[int]:
    """Indices in order, each with absolute rho under the threshold to all that are kept before; NaN isn't under it."""
    kept: list[int] = []
    for i in range(len(rho)):
        if all(abs(rho[i, j]) < threshold for j in kept):
            kept.append(i)
    return kept


def relevant(relevance: np.ndarray, rho: np.ndarray, most: int) -> list[int]:
    """Greedy choice by relevance less mean absolute rho with those chosen; the first of equals."""
    chosen: list[int] = []
    left = list(range(len(relevance)))
    while left and len(chosen) < most:
        scores = [relevance[i] - (np.mean([abs(rho[i, j]) for j in chosen]) if chosen else 0.0) for i in left]
        chosen.append(left.pop(int(np.nanargmax(scores)) if not np.isnan(scores).all() else 0))
    return chosen


def _first_stages(df: DataFrame, label: str, features: list[str], settings: Settings) -> dict[str, list[str]]:
    stages = {}
    left = list(features)
    if settings.p_threshold is not None:
        p = {r["feature"]: r["p_value"] for r in univariate_tests(df, label, left, settings.task).collect()}  # a row a feature
        left = [c for c in left if p.get(c) is not None and p[c] <= settings.p_threshold]
    stages["univariate"] = left
    if not left:
        raise ValueError("the univariate filter removed every feature")
    rho = rank_correlations(df, left) if len(left) > 1 else np.ones((1, 1))
    if settings.correlation is not None:
        at = uncorrelated(rho, settings.correlation)
        left, rho = [left[i] for i in at], rho[np.ix_(at, at)]
    stages["correlation"] = left
    if settings.most_features is not None:
        medians = {r["feature"]: r["quantile"] for r in order_statistics(long_form(df, [], left), "value", [0.5], ["feature"]).collect()}
        whole = df.select(label, *[F.coalesce(number(c), F.lit(medians.get(c, 0.0))).alias(c) for c in left])
        if settings.task == "classification":
            score = {r["feature"]: r["information"] for r in class_information(whole, label, left).collect()}
        else:
            score = {r["feature"]: -0.5 * math.log(max(1e-300, 1 - (r["statistic"] or 0.0) ** 2)) for r in univariate_tests(whole, label, left, "regression").collect()}
        at = relevant(np.array([score.get(c, 0.0) for c in left]), rho, settings.most_features)
        left = [left[i] for i in at]
    stages["relevance"] = left
    return stages


def _path_weights(rows: DataFrame, sets: dict[tuple[int, int], TrainingSet], splits: int, folds: int, task: str) -> list[np.ndarray]:
    """Weights per split at the strength that scores best over its folds, fitted on all rows."""
    from tarnlake.operators.nested import Scorer, areas, scored

    if task == "classification":
        wanted = [Penalised(sets[s, i], 0.0, 1 / c) for s in range(splits) for i in range(folds) for c in CS]
        fitted = fit_all(rows, wanted)
        shown = scored(rows, [], [(k, Scorer(m.of, b)) for k, (m, b) in enumerate(zip(wanted, fitted, strict=True))], held_out=False)
        score = np.full(len(wanted), np.nan)
        for r in areas(shown, "model").collect():  # a row a model
            score[r["model"]] = np.nan if r["auc"] is None else r["auc"]
        each = score.reshape(splits, folds, len(CS))
        defined = ~np.isnan(each)
        best = np.where(defined.any(axis=1), np.where(defined, each, 0.0).sum(axis=1) / np.maximum(defined.sum(axis=1), 1), -np.inf).argmax(axis=1)
        return [b[1:] for b in fit_all(rows, [Penalised(sets[s, -1], 0.0, 1 / CS[best[s]]) for s in range(splits)])]
    # Squares need no passes: the Gram matrices of all rows and of each training set give every fit and every held-out error.
    keys = [(s, i) for s in range(splits) for i in range(-1, folds)]
    models = [Penalised(sets[k], 0.0, 0.0, linear=True) for k in keys]
    packets = _packets(rows, models, [np.zeros(len(m.of.columns) + 1) for m in models], list(range(len(models))))
    size = len(models[0].of.columns) + 1
    gram = {k: (p[0] * 2, p[1 : 1 + size], p[1 + size :].reshape(size, size)) for k, p in zip(keys, (packets[j] for j in range(len(keys))), strict=True)}
    out = []
    for s in range(splits):
        yy, g, h = gram[s, -1]
        n = h[0, 0]
        centred = np.abs(g - g[0] * h[0] / n)[1:]
        alphas = centred.max() / n * np.logspace(0, math.log10(SPAN), ALPHAS)
        error = np.zeros(ALPHAS)
        for i in range(folds):
            y2, gi, hi = gram[s, i]
            w = np.zeros(size)
            for a, alpha in enumerate(alphas):
                w = _quadratic_step(gi + hi @ w, hi, w, alpha * hi[0, 0])
                left_n = max(1.0, n - hi[0, 0])
                error[a] += (yy - y2 + 2 * (g - gi) @ w + w @ (h - hi) @ w) / left_n
        w = np.zeros(size)
        for alpha in alphas[: int(error.argmin()) + 1]:
            w = _quadratic_step(g + h @ w, h, w, alpha * n)
        out.append(w[1:])
    return out


def fit(df: DataFrame, label: str, features: list[str], subject: str, settings: Settings | None = None) -> Selection:
    """The sequence for one seed."""
    return repeated(df, label, features, subject, [(settings or Settings()).seed], settings)[0]


def repeated(df: DataFrame, label: str, features: list[str], subject: str, seeds: list[int], settings: Settings | None = None) -> list[Selection]:
    """The sequence for each seed, which deals the folds of the last stage. A classification's label has two classes, of which the greater is 1."""
    settings = settings or Settings()
    require_columns(df, [label, subject, *features])
    if settings.task not in {"classification", "regression"} or settings.folds < 2 or len(set(seeds)) < len(seeds):
        raise ValueError("task is classification or regression, folds at least 2, and seeds differ")
    classes = settings.task == "classification"
    if classes:
        values = sorted(r[0] for r in df.filter(F.col(label).isNotNull()).select(label).distinct().limit(3).collect())
        if len(values) != 2:
            raise ValueError("a classification needs two labels")
    y = (F.col(label) == values[1]).cast("double") if classes else number(label)
    table = held(df.select(F.col(subject).alias("subject"), y.alias("y"), *[number(c).alias(f"f{i}") for i, c in enumerate(features)]).filter("y is not null"))
    stages = _first_stages(table, "y", [f"f{i}" for i in range(len(features))], settings)
    left = stages["relevance"]
    # Rows of a subject share a fold; a subject with both classes, which a table of many rows may have, counts as its least.
    subjects = table.groupBy("subject").agg((F.min("y") if classes else F.lit(0)).alias("label"))
    cells = None
    for nth, seed in enumerate(seeds):
        one = by_subject.stratified_folds(subjects, settings.folds, seed).select("subject", (F.col("fold") - 1).alias(f"c{nth}"))
        cells = one if cells is None else cells.join(one, "subject")
    dealt = table.join(cells, "subject").select("y", F.array(*left).alias("x"), F.array(*[f"c{n}" for n in range(len(seeds))]).alias("cells"))
    rows = held(dealt)
    ready = prepared(rows, len(seeds), settings.folds, len(left), classes)
    whole = ready.of(0, -1, np.arange(len(left)))
    sets = {(s, i): ready.of(s, i, whole.columns)._replace(fill=whole.fill, center=whole.center, scale=whole.scale) for s in range(len(seeds)) for i in range(-1, settings.folds)}  # scaled on all rows
    name = {f"f{i}": c for i, c in enumerate(features)}
    named = {k: [name[c] for c in v] for k, v in stages.items()}
    out = []
    for seed, w in zip(seeds, _path_weights(rows, sets, len(seeds), settings.folds, settings.task), strict=True):
        selected = [c for c, x in zip(left, w, strict=True) if x] or [left[int(np.abs(w).argmax())]]
        out.append(Selection([name[c] for c in selected], {**named, "l1": [name[c] for c in selected]}, {name[c]: float(x) for c, x in zip(left, w, strict=True)}, seed))
    return out


def as_table(df: DataFrame, runs: list[Selection]) -> DataFrame:
    """(seed, stage, place, feature, coefficient) of every stage; coefficients are the last stage's."""
    rows = [(r.seed, stage, i, c, r.coefficients.get(c) if stage == "l1" else None) for r in runs for stage, kept in r.stages.items() for i, c in enumerate(kept, 1)]
    return df.sparkSession.createDataFrame(rows, "seed int, stage string, place int, feature string, coefficient double")
