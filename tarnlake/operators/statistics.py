"""Grouped summaries, agreement between readers, scores of predictions, and tests by rank."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import finite, long_form, number, numeric_columns, over, pearson
from tarnlake.functions.ordered import order_statistics, running_totals, value_ranks, with_ranks

# ---------------------------------------------------------------- summaries


def reader_summary(df: DataFrame, subject: str, value: str, cutoff: float, high: str = "H-TSR", low: str = "L-TSR") -> DataFrame:
    """Per subject: median, mean, sample deviation, least, most, readings, range and a label by the median; null subjects are left out."""
    v = number(value)
    out = df.filter(F.col(subject).isNotNull()).groupBy(subject).agg(
        F.median(v).alias("median_value"), F.avg(v).alias("mean_value"), F.stddev_samp(v).alias("std_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.count(F.lit(1)).alias("n_readings")
    )
    return out.withColumn("value_range", F.col("max_value") - F.col("min_value")).withColumn("label", F.when(F.col("median_value") >= cutoff, high).otherwise(low))


def batch_effects(df: DataFrame, batch: str, features: list[str] | None = None) -> DataFrame:
    """Per batch (null is one) and feature: values, mean, sample deviation and share that is missing."""
    features = features or numeric_columns(df, (batch,))
    return long_form(df, [batch], features).groupBy(batch, "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate")
    )


def cell_proportions(cells: DataFrame, sample: str, group: str, kind: str, target: str | None = None) -> DataFrame:
    """Per sample, group and cell type: cells and their share of the sample's; null keys are left out."""
    known = cells.filter(F.col(sample).isNotNull() & F.col(group).isNotNull() & F.col(kind).isNotNull())
    counts = known.groupBy(sample, group, kind).agg(F.count(F.lit(1)).alias("n_cells"))
    shares = counts.withColumn("total_cells", F.sum("n_cells").over(Window.partitionBy(sample, group))).withColumn("proportion", over(F.col("n_cells"), F.col("total_cells")))
    return shares.filter(F.col(kind) == target) if target is not None else shares


def proportion_summary(shares: DataFrame, sample: str, group: str, kind: str) -> DataFrame:
    return shares.groupBy(group, kind).agg(F.countDistinct(sample).alias("n_samples"), F.avg("proportion").alias("mean_proportion"), F.median("proportion").alias("median_proportion"), F.stddev_samp("proportion").alias("std_proportion"))


def feature_statistics(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Per feature over finite values: n, mean, population deviation, least, quartiles, most, skewness, excess kurtosis (0 if constant or under 2 values) and share that is missing."""
    features = features or numeric_columns(df)
    v = F.col("v")
    rows = long_form(df, [], features).withColumn("v", finite("value"))
    flat = (F.coalesce(F.stddev_pop(v), F.lit(0.0)) == 0) | (F.count(v) < 2)
    moments = rows.groupBy("feature").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.when(flat, 0.0).otherwise(F.skewness(v)).alias("skewness"), F.when(flat, 0.0).otherwise(F.kurtosis(v)).alias("kurtosis"), F.avg(v.isNull().cast("double")).alias("missing_rate"),
    )
    ordered = order_statistics(rows.select("feature", "v"), "v", [0.25, 0.5, 0.75], ["feature"])  # from ranges of distinct values, not a map of a feature in one task
    at = lambda share: F.max(F.when(F.col("share") == share, F.col("quantile")))
    quartiles = ordered.groupBy("feature").agg(at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"))
    return moments.join(quartiles, "feature", "left").select("feature", "n", "mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis", "missing_rate")


def constant_features(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    return long_form(df, [], features or numeric_columns(df)).groupBy("feature").agg(F.stddev_samp("value").alias("std"), F.count("value").alias("n")).filter("std = 0")


def correlated_pairs(df: DataFrame, features: list[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """Pairs of features, in column order, whose absolute correlation over rows with both is the threshold or more. One pass for all pairs."""
    features = features or numeric_columns(df)
    rows = df.select(*[number(c).alias(c) for c in features])
    pairs = list(combinations(features, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, correlation double")
    found = rows.agg(*[pearson(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return found.select(F.inline(listed)).filter(F.abs("correlation") >= threshold)


def feature_importance(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """Absolute correlation with the target, or else sample variance."""
    scores = [(F.abs(pearson(number(c), number(target))) if target else F.var_samp(number(c))).alias(c) for c in features]
    return df.agg(*scores).unpivot([], features, "feature", "importance")


def normalised_importance(df: DataFrame, features: list[str], method: str = "variance") -> DataFrame:
    """Population variance, or range, of each feature over rows that have all, divided by the largest."""
    rows = df.select(*[number(c).alias(c) for c in features]).dropna()
    score = {"variance": F.var_pop, "range": lambda c: F.max(c) - F.min(c)}[method]
    found = rows.agg(*[score(c).alias(c) for c in features]).unpivot([], features, "feature", "raw")
    return found.select("feature", over(F.col("raw"), F.max("raw").over(Window.partitionBy(F.lit(0)))).alias("importance"))  # as many rows as features


def selection_stability(runs: DataFrame, run: str, feature: str) -> DataFrame:
    """Per pair of runs: shared features, all features and their Jaccard index; 1 if both are empty."""
    sets = runs.filter(F.col(feature).isNotNull()).select(run, feature).distinct()
    names = runs.select(run).distinct()
    size = sets.groupBy(run).agg(F.count(F.lit(1)).alias("size"))
    sized = names.join(size, run, "left").select(F.col(run), F.coalesce("size", F.lit(0)).alias("size"))
    a, b = sized.select(F.col(run).alias("run_a"), F.col("size").alias("size_a")), sized.select(F.col(run).alias("run_b"), F.col("size").alias("size_b"))
    both = sets.select(F.col(run).alias("run_a"), feature).join(sets.select(F.col(run).alias("run_b"), feature), feature).filter("run_a < run_b").groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("shared"))
    pairs = a.join(b, F.col("run_a") < F.col("run_b")).join(both, ["run_a", "run_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))
    total = F.col("size_a") + F.col("size_b") - F.col("shared")
    return pairs.select("run_a", "run_b", "shared", total.cast("long").alias("total"), F.when(total == 0, 1.0).otherwise(over(F.col("shared"), total)).alias("jaccard"))


def feature_frequency(runs: DataFrame, run: str, feature: str) -> DataFrame:
    """Per feature: runs that selected it, their share, and whether all did."""
    total = runs.agg(F.countDistinct(run).alias("n_runs"))
    counts = runs.filter(F.col(feature).isNotNull()).groupBy(feature).agg(F.countDistinct(run).alias("frequency"))
    return counts.crossJoin(F.broadcast(total)).select(feature, "frequency", over(F.col("frequency"), F.col("n_runs")).alias("rate"), (F.col("frequency") == F.col("n_runs")).alias("consensus"))


# ---------------------------------------------------------------- agreement


def icc(df: DataFrame, subject: str, repeat: str, values: list[str], kind: str = "icc2_1", stable: float = 0.75) -> DataFrame:
    """Intraclass correlation of each value, two-way and single measures, absolute ("icc2_1") or consistent ("icc3_1"), over subjects with every repeat."""
    cells = long_form(df, [subject, repeat], values).filter(F.col(subject).isNotNull() & F.col(repeat).isNotNull()).groupBy("feature", subject, repeat).agg(F.avg("value").alias("y")).filter("y is not null")
    k = cells.groupBy("feature").agg(F.countDistinct(repeat).alias("k"))
    of_subject = cells.groupBy("feature", subject).agg(F.count("y").alias("own"), F.avg("y").alias("row_mean"))
    whole = of_subject.join(F.broadcast(k), "feature").filter("own = k").drop("own")
    cells = cells.join(whole, ["feature", subject])
    of_repeat = cells.groupBy("feature", repeat).agg(F.avg("y").alias("column_mean"))
    grand = cells.groupBy("feature").agg(F.avg("y").alias("grand"), F.countDistinct(subject).alias("n"))
    d = cells.join(F.broadcast(of_repeat), ["feature", repeat]).join(F.broadcast(grand), "feature")
    sums = d.groupBy("feature").agg(
        F.max("n").alias("n_subjects"), F.max("k").alias("n_repeats"), F.sum(F.pow(F.col("row_mean") - F.col("grand"), 2)).alias("rows"), F.sum(F.pow(F.col("column_mean") - F.col("grand"), 2)).alias("columns"),
        F.sum(F.pow(F.col("y") - F.col("row_mean") - F.col("column_mean") + F.col("grand"), 2)).alias("error"),
    )
    n, r = F.col("n_subjects").cast("double"), F.col("n_repeats").cast("double")
    msr, msc, mse = over(F.col("rows"), n - 1), over(F.col("columns"), r - 1), over(F.col("error"), (n - 1) * (r - 1))
    below = msr + (r - 1) * mse + (r * (msc - mse) / n if kind == "icc2_1" else F.lit(0.0))
    value = over(msr - mse, below)
    status = F.when((n < 2) | (r < 2), "insufficient_repeats").when(value >= stable, "stable").otherwise("review")
    return sums.select("feature", "n_subjects", "n_repeats", value.alias("icc"), status.alias("status"))


def reader_kappa(df: DataFrame, subject: str, reader: str, value: str, cutoff: float) -> DataFrame:
    """Cohen's kappa of "at or over the cutoff" for each pair of readers, over subjects that both read (mean of a reader's values)."""
    read = df.groupBy(subject, reader).agg(F.avg(number(value)).alias("v")).filter("v is not null").select(subject, reader, (F.col("v") >= cutoff).cast("double").alias("high"))
    a, b = read.select(subject, F.col(reader).alias("reader_a"), F.col("high").alias("a")), read.select(subject, F.col(reader).alias("reader_b"), F.col("high").alias("b"))
    both = a.join(b, subject).filter("reader_a < reader_b").groupBy("reader_a", "reader_b").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return both.select("reader_a", "reader_b", "n", "agreement", over(F.col("agreement") - chance, 1 - chance).alias("kappa"))


def specimen_comparison(df: DataFrame, subject: str, specimen: str, value: str, kinds: tuple[str, str]) -> DataFrame:
    """One row over subjects with both kinds of specimen: pairs, mean difference (first less second), median absolute difference and Spearman's rho."""
    wide = df.groupBy(subject).pivot(specimen, list(kinds)).agg(F.avg(number(value))).select(F.col(kinds[0]).alias("a"), F.col(kinds[1]).alias("b")).dropna()
    ranked = with_ranks(with_ranks(wide, "a", name="rank_a"), "b", name="rank_b")
    d = F.col("a") - F.col("b")
    return ranked.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(d).alias("mean_difference"), F.median(F.abs(d)).alias("median_absolute_difference"), pearson(F.col("rank_a"), F.col("rank_b")).alias("spearman"))


# ---------------------------------------------------------------- predictions


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the scores' range, closed on the right, the first one from 0.1 % of the range below; empty bins are absent."""
    rows = df.select(number(label).alias("y"), number(score).alias("s")).dropna()
    low, high = F.col("low"), F.col("high")
    span = rows.agg(F.min("s").alias("low"), F.max("s").alias("high"))
    edge = lambda i: F.when(low == high, low - 0.001 * F.abs(low) + 0.002 * F.abs(low) * i / bins).otherwise(low + (high - low) * i / bins - (F.when(i == 0, 0.001 * (high - low)).otherwise(0.0)))
    edges = span.select(F.transform(F.sequence(F.lit(0), F.lit(bins)), edge).alias("edges"))
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(F.size(F.filter("edges", lambda e: e < F.col("s"))) - 1, F.lit(0)))
    out = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_score"), F.avg("y").alias("observed_rate"))
    return out.withColumn("absolute_error", F.abs(F.col("mean_score") - F.col("observed_rate")))


def decision_curve(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Net benefit of acting at each threshold within (0, 1), of acting on all and on none. One aggregate; rows are not multiplied."""
    rows = df.select(number(label).alias("y"), number(score).alias("s")).dropna()
    kept = [t for t in thresholds if 0 < t < 1]
    sums = [x for i, t in enumerate(kept) for x in (F.count_if((F.col("s") >= t) & (F.col("y") == 1)).alias(f"tp{i}"), F.count_if((F.col("s") >= t) & (F.col("y") != 1)).alias(f"fp{i}"))]
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == 1).cast("double")).alias("rate"), *sums)
    listed = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("true_positives"), F.col(f"fp{i}").alias("false_positives"), F.col("n"), F.col("rate")) for i, t in enumerate(kept)])
    odds = F.col("threshold") / (1 - F.col("threshold"))
    return one.select(F.inline(listed)).select(
        "threshold", "true_positives", "false_positives", (over(F.col("true_positives"), F.col("n")) - over(F.col("false_positives"), F.col("n")) * odds).alias("net_benefit"), (F.col("rate") - (1 - F.col("rate")) * odds).alias("treat_all"), F.lit(0.0).alias("treat_none")
    )


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row per averaging: binary (class 1), micro, macro, weighted; precision, recall, f1 and accuracy, 0 for what can't be divided."""
    counts = confusion(df, label, predicted).select(F.col(label).alias("y"), F.col(predicted).alias("p"), "n")
    sides = counts.select("y", F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("own"), F.lit(0).alias("said")).unionByName(counts.select(F.col("p").alias("y"), F.lit(0).alias("tp"), F.lit(0).alias("own"), F.col("n").alias("said")))
    zero = lambda a, b: F.coalesce(over(a, b), F.lit(0.0))
    per = sides.groupBy("y").agg(*[F.sum(c).alias(c) for c in ("tp", "own", "said")])
    per = per.withColumn("precision", zero(F.col("tp"), F.col("said"))).withColumn("recall", zero(F.col("tp"), F.col("own")))
    per = per.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    accuracy = over(F.sum("tp"), F.sum("own"))
    one = per.agg(
        accuracy.alias("accuracy"),
        *[F.coalesce(F.max(F.when(F.col("y") == 1, F.col(c))), F.lit(0.0)).alias(f"binary_{c}") for c in names],
        *[accuracy.alias(f"micro_{c}") for c in names],
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[over(F.sum(F.col(c) * F.col("own")), F.sum("own")).alias(f"weighted_{c}") for c in names],
    )
    listed = F.array(*[F.struct(F.lit(a).alias("average"), "accuracy", *[F.col(f"{a}_{c}").alias(c) for c in names]) for a in ("binary", "micro", "macro", "weighted")])
    return one.select(F.inline(listed))


def regression_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    e = number(label) - number(predicted)
    rows = df.select(number(label).alias("y"), e.alias("e")).dropna()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.avg(F.col("e") * F.col("e")).alias("mse"), (1 - over(F.sum(F.col("e") * F.col("e")), F.count(F.lit(1)) * F.var_pop("y"))).alias("r2"))


# ---------------------------------------------------------------- ranks


def _rank_sums(df: DataFrame, label: Column, value: str) -> DataFrame:
    """One row: n1, n0, rank_sum of label 1 and the tie term, sum of t^3 - t."""
    rows = df.select(label.cast("int").alias("y"), number(value).alias("v")).dropna()
    counted = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    ranked = running_totals(counted, "v", ["n"]).withColumn("rank", F.col("below_n") + (F.col("n") + 1) / 2)
    n = F.col("n").cast("double")
    return ranked.agg(F.sum("ones").alias("n1"), F.sum(F.col("n") - F.col("ones")).alias("n0"), F.sum(F.col("ones") * F.col("rank")).alias("rank_sum"), F.sum(n * n * n - n).alias("ties"))


def auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """One row: n1, n0 and the area under the ROC curve by average ranks; null with one class."""
    n1, n0 = F.col("n1"), F.col("n0")
    return _rank_sums(df, label, score).select("n1", "n0", over(F.col("rank_sum") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def mann_whitney(df: DataFrame, label: Column, value: str) -> DataFrame:
    """One row: n1, n0, U of label 1, and z by the normal approximation with tie and continuity corrections."""
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n0 / 12 * ((n + 1) - over(F.col("ties"), n * (n - 1))))
    return _rank_sums(df, label, value).select("n1", "n0", u.alias("u"), over(F.greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5, spread).alias("z"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = df.select(number(x).alias("x"), number(y).alias("y")).dropna()
    ranked = with_ranks(with_ranks(rows, "x", name="rx"), "y", name="ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), pearson(F.col("rx"), F.col("ry")).alias("rho"))


def benjamini_hochberg(df: DataFrame, p_value: str, name: str = "p_adjusted") -> DataFrame:
    """df with p-values adjusted for the false discovery rate: p n / rank, then the least of it and all of larger p, at most 1. Null stays null and isn't counted.

    A rank is that of the last of equal p-values; equal ones get one result, as they do with any order of ties."""
    p = number(p_value)
    counted = df.select(p.alias("p")).dropna().groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, "p", ["n"])
    total = ranked.agg(F.sum("n").alias("total"))
    raw = ranked.crossJoin(F.broadcast(total)).withColumn("raw", F.col("p") * F.col("total") / (F.col("below_n") + F.col("n")))
    # the least over larger p: ranges of p from the top, each with the least of those above it
    cuts = sorted(set(raw.approxQuantile("p", [i / 64 for i in range(1, 64)], 0.005)))
    placed = raw.withColumn("r", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c < F.col("p"))))
    above = placed.groupBy("r").agg(F.min("raw").alias("m")).select("r", F.min("m").over(Window.partitionBy(F.lit(0)).orderBy("r").rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    inside = Window.partitionBy("r").orderBy("p").rowsBetween(0, Window.unboundedFollowing)
    found = placed.join(F.broadcast(above), "r").select(F.col("p").alias("__p"), F.least(F.min("raw").over(inside), F.col("above"), F.lit(1.0)).alias(name))
    return df.join(found, p == F.col("__p"), "left").drop("__p")


def ordered_changes(df: DataFrame, subject: str, change: str) -> DataFrame:
    """Subjects by change, smallest first, with plot_order from 1; rows without a change are left out. Ties are in order of subject."""
    rows = df.select(subject, number(change).alias("change")).filter("change is not null")
    counted = rows.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    places = running_totals(counted, "change", ["n"]).select(F.col("change").alias("__c"), F.col("below_n"))
    inside = Window.partitionBy("change").orderBy(subject)
    return rows.join(places, F.col("change") == F.col("__c")).select(subject, "change", (F.col("below_n") + F.row_number().over(inside)).alias("plot_order"))


def rank_table(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return value_ranks(df, value, by)
