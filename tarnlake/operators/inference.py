"""Resampled comparisons of models, survival discrimination, batch harmonisation and cluster quality."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import long_form, number, over

#: Chances that a Poisson number of mean 1 is at most 0, 1, ...
STEPS = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(12)])
#: Weights that a task holds at once.
CELLS = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of unsigned 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _weights(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Rows x (n + 1): ones, then n Poisson(1) weights from a hash of row and replicate: the bootstrap for tables too large to draw from by index, the same on every run."""
    replicate = _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    draw = (_mixed(h[:, None] + replicate) >> np.uint64(11)) * 2.0**-53
    return np.concatenate([np.ones((len(h), 1)), np.searchsorted(STEPS, draw, side="right")], axis=1)


_sums = pa.schema([("score", pa.float64()), ("inside", pa.int32()), *[(c, pa.list_(pa.float64())) for c in ("numerator", "cases", "controls")]])


def _rank_sums(batches: Iterator[pa.RecordBatch], n: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Of rows (score, y, h) in order of score, up to three rows of sums over all replicates: the smallest score's, the largest one's, and, marked as inside, those of the scores between them,
    with the weighted pairs among these. Only the sums and a slice of rows are held."""
    ends: list[tuple] = []
    inside, some = np.zeros((3, n + 1)), False
    last = None  # the largest score so far, its cases and controls
    for batch in batches:
        for at in range(0, batch.num_rows, step := max(1, CELLS // (n + 1))):
            s, y, h = (batch.column(i).slice(at, step).to_numpy(zero_copy_only=False) for i in range(3))
            w = _weights(h.view(np.uint64), n, seed)
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            case = (y == 1)[:, None]
            p, q, s = np.add.reduceat(w * case, new), np.add.reduceat(w * ~case, new), s[new]
            if last is not None and last[0] == s[0]:
                p[0] += last[1]
                q[0] += last[2]
            elif last is not None:
                s, p, q = np.append(last[0], s), np.vstack([last[1], p]), np.vstack([last[2], q])
            last = s[-1], p[-1], q[-1]
            whole = slice(0, -1)
            if not ends and len(s) > 1:
                ends.append((s[0], p[0], q[0]))
                whole = slice(1, -1)
            p, q = p[whole], q[whole]
            if len(p):
                below = inside[2] + np.cumsum(q, axis=0) - q
                inside += [(p * (below + q / 2)).sum(axis=0), p.sum(axis=0), q.sum(axis=0)]
                some = True
    if last is not None:
        rows = [(s, 0, np.zeros(n + 1), p, q) for s, p, q in [*ends, last]]
        if some:
            rows.append((ends[0][0], 1, *inside))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _sums, strict=True)], schema=_sums)


def _replicate_aucs(rows: DataFrame, key: str, score: str, n: int, seed: int) -> DataFrame:
    """(replicate, auc) of rows (key, y, score); replicate -1 has the rows themselves.

    Rows are dealt to ranges of score and row hash, so that a score which many rows share is in several tasks, and are read once for all replicates. What is
    left is three rows a range; each adds the controls of the ranges before it."""
    dealt = rows.select(F.col(score).cast("double").alias("score"), F.col("y").cast("double"), F.xxhash64(key).alias("h")).repartitionByRange("score", "h").sortWithinPartitions("score")
    sums = dealt.mapInArrow(lambda it: _rank_sums(it, n, seed), "score double, inside int, numerator array<double>, cases array<double>, controls array<double>")
    each = sums.select("score", "inside", F.posexplode(F.arrays_zip("numerator", "cases", "controls")).alias("at", "x"))
    at = each.groupBy((F.col("at") - 1).alias("replicate"), "score", "inside").agg(F.sum("x.numerator").alias("numerator"), F.sum("x.cases").alias("p"), F.sum("x.controls").alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("replicate").orderBy("score", "inside").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = F.when(F.col("inside") == 1, F.col("numerator")).otherwise(F.col("p") * F.col("q") / 2)
    return at.withColumns({"below": below, "own": own}).groupBy("replicate").agg(over(F.sum(F.col("p") * F.col("below") + F.col("own")), F.sum("p") * F.sum("q")).alias("auc"))


def bootstrap_auc(df: DataFrame, key: str, label: str, score: str, n: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: auc, low, high, n_replicates. One-class replicates have no value and don't count."""
    rows = df.select(key, number(label).alias("y"), number(score).alias("score")).dropna()
    found = _replicate_aucs(rows, key, "score", n, seed)
    tail = (1 - confidence) / 2
    drawn = F.when(F.col("replicate") >= 0, F.col("auc"))
    return found.agg(F.max(F.when(F.col("replicate") < 0, F.col("auc"))).alias("auc"), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high"), F.count(drawn).alias("n_replicates"))


def compared_models(df: DataFrame, key: str, label: str, scores: list[str], n: int = 2000, seed: int = 42) -> DataFrame:
    """Each pair of models on the same replicates: difference of AUC, its 95 % interval and a two-sided sign p."""
    rows = df.select(key, number(label).alias("y"), *[number(s).alias(s) for s in scores]).dropna()
    wide = None
    for s in scores:
        one = _replicate_aucs(rows, key, s, n, seed).withColumnRenamed("auc", f"auc_{s}")
        wide = one if wide is None else wide.join(one, "replicate")
    pairs = []
    for a, b in combinations(scores, 2):
        d = F.col(f"auc_{a}") - F.col(f"auc_{b}")
        boot = F.when(F.col("replicate") >= 0, d)
        p = F.least(F.lit(1.0), 2 * F.least(F.avg((boot <= 0).cast("double")), F.avg((boot >= 0).cast("double"))))
        pairs.append(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.max(F.when(F.col("replicate") < 0, d)).alias("difference"), F.percentile(boot, F.lit(0.025)).alias("low"), F.percentile(boot, F.lit(0.975)).alias("high"), p.alias("p_value")))
    return wide.agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs"))


def time_dependent_auc(df: DataFrame, duration: str, event: str, risk: str, times: list[float]) -> DataFrame:
    """(time, auc): subjects with an event by the time against those still at risk after it, cases weighted by the inverse chance of being uncensored.

    The censoring curve is a table of distinct times; comparisons run over distinct risks per time."""
    rows = df.select(number(duration).alias("t"), F.col(event).cast("int").alias("e"), number(risk).alias("r")).dropna()
    at = rows.groupBy("t").agg(F.count_if(F.col("e") == 0).alias("c"), F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0)).orderBy("t")  # distinct times, not rows
    curve = at.withColumn("risk_set", F.sum("n").over(everything.rowsBetween(0, Window.unboundedFollowing))).withColumn("g", F.coalesce(F.product(1 - F.col("c") / F.col("risk_set")).over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    known = rows.join(curve.select("t", "g"), "t").filter((F.col("e") == 0) | (F.col("g") > 0))
    horizon = known.select("*", F.explode(F.array(*[F.lit(float(x)) for x in times])).alias("time"))
    placed = horizon.withColumn("case", F.when((F.col("t") <= F.col("time")) & (F.col("e") == 1), 1 / F.col("g"))).withColumn("control", (F.col("t") > F.col("time")).cast("double"))
    by_risk = placed.groupBy("time", "r").agg(F.coalesce(F.sum("case"), F.lit(0.0)).alias("p"), F.sum("control").alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("time").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return by_risk.withColumn("below", below).groupBy("time").agg(over(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def harmonised(df: DataFrame, keys: list[str], batch: str, features: list[str], rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """Empirical-Bayes adjustment of batch location and scale, in long form: keys, batch, feature, value, adjusted.

    Values are standardised by the batches' weighted means and the pooled deviation. Per batch, moments over features give the priors; each feature's location and scale in a batch then
    follow by iteration over its own sums, features x batches numbers, whatever the number of rows. A batch of one row keeps its scale. Constant features stay as they are."""
    rows = long_form(df, [*keys, batch], features).filter("value is not null")
    per = rows.groupBy("feature", batch).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    shared = per.groupBy("feature").agg(over(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("grand"), over(F.sum(F.col("n") * F.col("v")), F.sum("n")).alias("pooled"))
    sums = {(r["feature"], r[batch]): r for r in per.join(shared, "feature").filter("pooled > 0").collect()}  # features x batches
    table = []
    for b in sorted({b for _, b in sums}, key=str):
        own = [(f, r) for (f, x), r in sums.items() if x == b]
        z = np.array([(r["m"] - r["grand"]) / np.sqrt(r["pooled"]) for _, r in own])
        n = np.array([r["n"] for _, r in own], float)
        s2 = np.array([r["v"] / r["pooled"] for _, r in own])
        unbiased = np.where(n > 1, s2 * n / np.maximum(n - 1, 1), 1.0)
        centre, spread = z.mean(), z.var(ddof=1) if len(z) > 1 else 1.0
        mean, var = unbiased.mean(), unbiased.var(ddof=1) if len(z) > 1 else 1.0
        lam, theta = ((2 * var + mean**2) / var, (mean * var + mean**3) / var) if var > 0 else (1e6, mean * 1e6)
        gamma, delta = z.copy(), unbiased.copy()
        for _ in range(rounds):
            new = (n * spread * z + delta * centre) / (n * spread + delta) if spread > 0 else np.full_like(z, centre)
            fresh = (theta + 0.5 * (n * s2 + n * (z - new) ** 2)) / (n / 2 + lam - 1)
            step = max(np.abs(new - gamma).max(), np.abs(fresh - delta).max())
            gamma, delta = new, fresh
            if step < tolerance:
                break
        delta = np.where(n > 1, delta, 1.0)
        table += [(f, b, float(r["grand"]), float(np.sqrt(r["pooled"])), float(g), float(np.sqrt(d))) for (f, r), g, d in zip(own, gamma, delta, strict=True)]
    kind = dict(df.dtypes)[batch]
    effects = df.sparkSession.createDataFrame(table, f"feature string, `{batch}` {kind}, grand double, scale double, gamma double, delta double") if table else df.sparkSession.createDataFrame([], f"feature string, `{batch}` {kind}, grand double, scale double, gamma double, delta double")
    adjusted = ((F.col("value") - F.col("grand")) / F.col("scale") - F.col("gamma")) / F.col("delta") * F.col("scale") + F.col("grand")
    return rows.join(effects, ["feature", batch], "left").select(*keys, batch, "feature", "value", F.coalesce(adjusted, "value").alias("adjusted"))


def cluster_quality(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """One row: clusters, rows and the Calinski-Harabasz index, from sums per cluster."""
    per = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(number(c)).alias(f"m_{c}") for c in features], *[F.var_pop(number(c)).alias(f"v_{c}") for c in features])
    grand = df.agg(*[F.avg(number(c)).alias(f"g_{c}") for c in features])
    between = sum((F.pow(F.col(f"m_{c}") - F.col(f"g_{c}"), 2) for c in features[1:]), F.pow(F.col(f"m_{features[0]}") - F.col(f"g_{features[0]}"), 2))
    within = sum((F.col(f"v_{c}") for c in features[1:]), F.col(f"v_{features[0]}"))
    sums = per.crossJoin(F.broadcast(grand)).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_rows"), F.sum(F.col("n") * between).alias("b"), F.sum(F.col("n") * within).alias("w"))
    return sums.select("n_clusters", "n_rows", over(over(F.col("b"), F.col("n_clusters") - 1), over(F.col("w"), F.col("n_rows") - F.col("n_clusters"))).alias("calinski_harabasz"))


def linear_attributions(df: DataFrame, features: list[str], coefficients: list[float]) -> DataFrame:
    """Per feature of a linear model: mean absolute and mean signed contribution, coefficient times distance from the mean, largest first."""
    means = df.agg(*[F.avg(number(c)).alias(f"m_{c}") for c in features])
    parts = [F.lit(float(b)) * (number(c) - F.col(f"m_{c}")) for c, b in zip(features, coefficients, strict=True)]
    one = df.crossJoin(F.broadcast(means)).agg(*[x for c, p in zip(features, parts, strict=True) for x in (F.avg(F.abs(p)).alias(f"a_{c}"), F.avg(p).alias(f"s_{c}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("mean_absolute"), F.col(f"s_{c}").alias("mean_signed")) for c in features]))).orderBy(F.desc("mean_absolute"), "feature")


def nearest_cluster(noise: DataFrame, members: DataFrame, image: str, axes: list[str], cluster: str, within: int = 3) -> DataFrame:
    """noise with the cluster of its nearest member within a distance, the smallest of equals; null beyond. Voxels meet in boxes as wide as the distance, so only neighbours are compared."""
    box = lambda c: F.floor(F.col(c) / within)
    near = noise.select(image, *axes, F.explode(F.array(*[F.array(*[F.lit(d // 3**i % 3 - 1) for i in range(len(axes))]) for d in range(3 ** len(axes))])).alias("d")).select(image, *axes, *[(box(a) + F.col("d")[i]).alias(f"b_{a}") for i, a in enumerate(axes)])
    there = members.select(image, cluster, *[F.col(a).alias(f"m_{a}") for a in axes], *[box(a).alias(f"b_{a}") for a in axes])
    distance = F.sqrt(sum(((F.col(a) - F.col(f"m_{a}")) * (F.col(a) - F.col(f"m_{a}")) for a in axes), F.lit(0)).cast("double"))
    best = near.join(there, [image, *[f"b_{a}" for a in axes]]).withColumn("distance", distance).filter(F.col("distance") <= within).groupBy(image, *axes).agg(F.min_by(cluster, F.struct("distance", cluster)).alias(cluster))
    return noise.join(best, [image, *axes], "left")
