"""Tabular models and feature selection over Spark tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import long_form, number, over

#: Differences of coordinates that a task holds at once.
CELLS = 1 << 24


def anova_f(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Per feature: F of a one-way analysis of variance over the groups, with its degrees of freedom. Sums are per group, so rows are read once."""
    per = long_form(df, [group], features).filter(f"value is not null and `{group}` is not null").groupBy("feature", group).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    grand = per.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    sums = per.join(F.broadcast(grand), "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return sums.select("feature", (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), over(over(F.col("between"), F.col("k") - 1), over(F.col("within"), F.col("n") - F.col("k"))).alias("f"))


def gaussian_bayes(df: DataFrame, label: str, features: list[str], keys: list[str], smoothing: float = 1e-9) -> DataFrame:
    """keys, label and the likeliest class of each row under normal features with class means and variances; smoothing times the largest variance is added to each. The smallest of equal classes wins."""
    rows = df.select(*keys, label, *[number(c).alias(c) for c in features])
    most = reduce(lambda a, b: F.greatest(a, b), [F.var_pop(c) for c in features]) if len(features) > 1 else F.var_pop(features[0])
    spread = rows.agg((most * smoothing).alias("eps"), F.count(F.lit(1)).alias("total"))
    classes = rows.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in features]).alias("m"), F.array(*[F.var_pop(c) for c in features]).alias("v")).crossJoin(spread)
    x = F.array(*features)
    scored = rows.withColumn("x", x).crossJoin(F.broadcast(classes))  # a row for each class
    fit = F.zip_with(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.transform("v", lambda v: v + F.col("eps")), lambda d, v: -0.5 * F.ln(2 * math.pi * v) - d / (2 * v))
    score = F.ln(F.col("n") / F.col("total")) + F.aggregate(fit, F.lit(0.0), lambda s, t: s + t)
    return scored.groupBy(*keys, label).agg(F.max_by("class", F.struct(score.alias("score"), (-F.col("class")).alias("small"))).alias("predicted"))


def nearest_neighbours(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, most_queries: int = 20_000) -> DataFrame:
    """(query, neighbour, distance, place) of the k nearest rows to each query by Euclidean distance, itself left out; ties by key.

    Queries are a stated set and go to the tasks in blocks of a bounded number; a task keeps its k best per query, and the best of those are the answer."""
    spark = rows.sparkSession
    blocks = max(1, math.ceil(queries.count() / most_queries))
    parts = []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, F.col(vector).cast("array<double>")).collect()
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in own], dtype=np.int64), np.array([r[1] for r in own], dtype=float)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, points = sent.value
            near = np.full((len(names), k), np.inf)  # the k best so far, by distance, then key
            who = np.full((len(names), k), np.iinfo(np.int64).max)
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                there = np.array(batch.column(1).to_pylist(), dtype=float)
                step = max(1, CELLS // max(1, there.size))
                for at in range(0, len(names), step):
                    own = slice(at, at + step)
                    d = np.sqrt(((points[own, None, :] - there[None, :, :]) ** 2).sum(axis=2))
                    d[names[own, None] == ids[None, :]] = np.inf
                    d, w = np.concatenate([near[own], d], axis=1), np.concatenate([who[own], np.broadcast_to(ids, d.shape)], axis=1)
                    best = np.lexsort((w, d), axis=1)[:, :k]
                    near[own], who[own] = np.take_along_axis(d, best, axis=1), np.take_along_axis(w, best, axis=1)
            query, place = np.nonzero(np.isfinite(near))
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(who[query, place]), pa.array(near[query, place])], names=["query", "neighbour", "distance"])

        parts.append(rows.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(search, "query long, neighbour long, distance double"))
    near = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return near.withColumn("place", place).filter(F.col("place") <= k)


def knn_predict(rows: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """(key, predicted): the commonest label of the k nearest rows, the smallest of equals."""
    near = nearest_neighbours(rows, queries, key, vector, k).join(rows.select(F.col(key).alias("neighbour"), label), "neighbour")
    votes = near.groupBy("query", label).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(F.col("query").alias(key)).agg(F.max_by(label, F.struct("n", (-F.col(label)).alias("small"))).alias("predicted"))


def fold_of(df: DataFrame, subject: str, folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """df with a fold that all rows of a subject share, from a hash of its id."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(subject).cast("string"), F.lit(seed)), F.lit(folds)).cast("int"))


def estimator(kind: str, task: str = "classification", seed: int = 42, **options):
    """An MLlib estimator by name; features and label columns are "features" and "label"."""
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r

    made = {
        ("logistic_regression", "classification"): lambda: c.LogisticRegression(maxIter=100, **options), ("random_forest", "classification"): lambda: c.RandomForestClassifier(seed=seed, **options),
        ("gradient_boosting", "classification"): lambda: c.GBTClassifier(seed=seed, **options), ("svm", "classification"): lambda: c.LinearSVC(**options), ("naive_bayes", "classification"): lambda: c.NaiveBayes(modelType="gaussian", **options),
        ("linear_regression", "regression"): lambda: r.LinearRegression(**options), ("random_forest", "regression"): lambda: r.RandomForestRegressor(seed=seed, **options), ("gradient_boosting", "regression"): lambda: r.GBTRegressor(seed=seed, **options),
    }
    if (kind, task) not in made:
        raise ValueError(f"no {kind} for {task}; there are {sorted({k for k, t in made if t == task})}")
    return made[kind, task]()


def table_pipeline(kind: str, features: list[str], task: str = "classification", scale: bool = True, seed: int = 42, **options):
    """Median imputation, assembly, scaling and a model as one MLlib pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"__{c}" for c in features]
    steps = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="assembled" if scale else "features")]
    return Pipeline(stages=[*steps, *([StandardScaler(withMean=True, inputCol="assembled", outputCol="features")] if scale else []), estimator(kind, task, seed, **options)])


def cross_validated(df: DataFrame, label: str, subject: str, features: list[str], kind: str = "logistic_regression", folds: int = 4, seed: int = 42, keep: int | None = None) -> DataFrame:
    """(subject, fold, y_true, y_pred, y_score) of every row, each scored by a model that saw no row of its subject.

    In each fold the `keep` features of largest F over the training part are used (all, if None)."""
    from pyspark.ml.functions import vector_to_array

    rows = fold_of(df.select(subject, number(label).alias("label"), *[number(c).alias(c) for c in features]).filter("label is not null"), subject, folds, seed).persist()
    out = []
    for f in range(folds):
        train = rows.filter(F.col("fold") != f)
        chosen = features if keep is None else [r[0] for r in anova_f(train, "label", features).orderBy(F.desc_nulls_last("f"), "feature").limit(keep).collect()]
        model = table_pipeline(kind, chosen, seed=seed).fit(train)
        scored = model.transform(rows.filter(F.col("fold") == f))
        out.append(scored.select(subject, "fold", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), vector_to_array("probability")[1].alias("y_score")))
    return reduce(DataFrame.unionByName, out)


def correlation_filter(df: DataFrame, features: list[str], threshold: float = 0.9) -> list[str]:
    """Features in order, each kept if its absolute Spearman correlation with all kept ones is under the threshold; a constant one is not kept after another."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    rows = VectorAssembler(inputCols=features, outputCol="v").transform(df.select(*[number(c).alias(c) for c in features]).dropna())
    rho = np.abs(Correlation.corr(rows, "v", "spearman").first()[0].toArray())  # p x p
    kept: list[int] = []
    for i in range(len(features)):
        if all(rho[i, j] < threshold for j in kept):
            kept.append(i)
    return [features[i] for i in kept]


def relevance_less_redundancy(df: DataFrame, label: str, features: list[str], n: int, bins: int = 10) -> DataFrame:
    """Greedy selection (place, feature, score): mutual information with the label over equal-frequency bins, less mean absolute correlation with those chosen. Ties go to the first feature."""
    from pyspark.ml.feature import QuantileDiscretizer, VectorAssembler
    from pyspark.ml.stat import Correlation

    rows = df.select(F.col(label).cast("string").alias("y"), *[number(c).alias(c) for c in features]).dropna()
    binned = QuantileDiscretizer(numBuckets=bins, inputCols=features, outputCols=[f"b_{c}" for c in features]).fit(rows).transform(rows)
    joint = binned.select("y", *[F.col(f"b_{c}").alias(c) for c in features]).unpivot(["y"], features, "feature", "b").groupBy("feature", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature")
    p = joint.withColumns({"total": F.sum("n").over(w), "pb": F.sum("n").over(Window.partitionBy("feature", "b")), "py": F.sum("n").over(Window.partitionBy("feature", "y"))})
    information = {r[0]: r[1] for r in p.groupBy("feature").agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("pb") * F.col("py")))).alias("mi")).collect()}
    rho = np.abs(Correlation.corr(VectorAssembler(inputCols=features, outputCol="v").transform(rows), "v", "pearson").first()[0].toArray())
    chosen: list[tuple[int, float]] = []
    while len(chosen) < min(n, len(features)):
        left = [i for i in range(len(features)) if i not in {c for c, _ in chosen}]
        scores = [information.get(features[i], 0.0) - (np.mean([rho[i, c] for c, _ in chosen]) if chosen else 0.0) for i in left]
        best = int(np.argmax(scores))
        chosen.append((left[best], float(scores[best])))
    return df.sparkSession.createDataFrame([(i, features[c], s) for i, (c, s) in enumerate(chosen, 1)], "place int, feature string, score double")


def kmeans(df: DataFrame, keys: list[str], vector: str, k: int, seed: int = 42) -> DataFrame:
    """keys and the cluster of each row, from 0; vectors are standardised first."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    return Pipeline(stages=[StandardScaler(withMean=True, inputCol="raw", outputCol="features"), KMeans(k=k, seed=seed, predictionCol="cluster")]).fit(rows).transform(rows).select(*keys, "cluster")
