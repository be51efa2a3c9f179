"""Mutual information of numeric features with a class, from nearest neighbours on a line (Ross's estimator).

For a point of a class with N_c points, r is the distance to its k-th nearest neighbour of that class and m the number of points of any class nearer than r, itself included; the estimate is
psi(N) + mean psi(k) - mean psi(N_c) - mean psi(m), at least 0. Where k or more equal values of the class make r 0, m counts the equal values. Classes with one point are left out; k is at most N_c - 1.

A line needs no search tree. Distinct values of a class are dealt to ranges by quantiles; neighbours are windows within a range, completed at its borders by the nearest values of other ranges, a table of 2 k rows a range.
Counts of points are running totals at the ends of each interval, again by range. No window spans a feature and equal values are one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import long_form

RANGES = 64


def digamma(x: Column) -> Column:
    """psi(x) for x >= 1, to about 1e-11, by the asymptotic series at x + 6."""
    y = x.cast("double") + 6
    z = 1 / (y * y)
    series = F.ln(y) - 1 / (2 * y) - z * (1 / F.lit(12.0) - z * (1 / F.lit(120.0) - z * (1 / F.lit(252.0) - z / 240)))
    return series - reduce(lambda a, b: a + b, [1 / (x + i) for i in range(6)])


def _ranged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with the range of `value` among its feature's cuts."""
    return rows.join(F.broadcast(cuts), "feature").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")  # a row of RANGES numbers a feature


def quantile_cuts(df: DataFrame, features: list[str], ranges: int = RANGES) -> DataFrame:
    """(feature, cuts): cuts of each feature that deal its values about evenly to ranges."""
    found = df.approxQuantile(features, [i / ranges for i in range(1, ranges)], 0.005)
    return df.sparkSession.createDataFrame([(c, sorted(set(q))) for c, q in zip(features, found, strict=True)], "feature string, cuts array<double>")


def class_information(df: DataFrame, label: str, features: list[str], k: int = 3, ranges: int = RANGES) -> DataFrame:
    """(feature, n, information) of each feature, in nats; rows without a label or a value don't count."""
    wide = long_form(df.filter(F.col(label).isNotNull()), [label], features).filter("value is not null").select("feature", F.col(label).alias("class"), "value")
    cuts = quantile_cuts(df.select(*[F.col(c).cast("double") for c in features]), features, ranges)
    counted = _ranged(wide.groupBy("feature", "class", "value").agg(F.count(F.lit(1)).alias("n")), cuts)
    sizes = counted.groupBy("feature", "class").agg(F.sum("n").alias("of_class")).filter("of_class > 1")
    points = counted.join(sizes, ["feature", "class"])

    inside = Window.partitionBy("feature", "class", "range").orderBy("value")
    entry = F.struct("value", "n")
    near = points.withColumns({"before": F.collect_list(entry).over(inside.rowsBetween(-k, -1)), "after": F.collect_list(entry).over(inside.rowsBetween(1, k))})
    border = points.withColumns({"up": F.row_number().over(inside), "down": F.row_number().over(Window.partitionBy("feature", "class", "range").orderBy(F.desc("value")))}).filter((F.col("up") <= k) | (F.col("down") <= k))
    edges = border.groupBy("feature", "class", "range").agg(F.sort_array(F.collect_list(F.when(F.col("up") <= k, entry))).alias("low"), F.sort_array(F.collect_list(F.when(F.col("down") <= k, entry))).alias("high"))
    other = Window.partitionBy("feature", "class").orderBy("range")  # a row a range
    beyond = edges.select("feature", "class", "range", F.flatten(F.collect_list("high").over(other.rowsBetween(Window.unboundedPreceding, -1))).alias("lower"), F.flatten(F.collect_list("low").over(other.rowsBetween(1, Window.unboundedFollowing))).alias("upper"))

    def last(a: Column) -> Column:
        return F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), k)

    both = near.join(beyond, ["feature", "class", "range"])
    both = both.withColumns({"left": last(F.concat("lower", "before")), "right": F.slice(F.concat("after", "upper"), 1, k), "k": F.least(F.lit(k), F.col("of_class") - 1)})
    gaps = F.concat(F.array(F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n"))), F.transform("left", lambda e: F.struct((F.col("value") - e["value"]).alias("d"), e["n"].alias("n"))), F.transform("right", lambda e: F.struct((e["value"] - F.col("value")).alias("d"), e["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("r"))
    reach = F.aggregate(F.sort_array(gaps), start, lambda a, e: F.when(a["seen"] >= F.col("k"), a).otherwise(F.struct((a["seen"] + e["n"]).alias("seen"), e["d"].alias("r"))))["r"]
    radius = both.withColumn("r", reach)
    # The value that set r ends its side exactly; the other side ends at the same distance.
    v, r = F.col("value"), F.col("r")
    at_left = F.exists("left", lambda e: v - e["value"] == r)
    at_right = F.exists("right", lambda e: e["value"] - v == r)
    low = F.when(at_left, F.array_max(F.transform(F.filter("left", lambda e: v - e["value"] == r), lambda e: e["value"]))).otherwise(v - r)
    high = F.when(at_right, F.array_min(F.transform(F.filter("right", lambda e: e["value"] - v == r), lambda e: e["value"]))).otherwise(v + r)
    ends = radius.select("feature", "class", F.col("value").alias("at"), "n", "k", "of_class", F.explode(F.array(F.struct(low.alias("value"), F.lit(-1).alias("sign")), F.struct(high.alias("value"), F.lit(1).alias("sign")))).alias("e"), (r == 0).alias("tied"))

    # Points of all classes and interval ends in one order; an end sees the points below it, and those at it where the interval starts there, or where r is 0.
    total = points.groupBy("feature", "value").agg(F.sum("n").alias("w"))
    probes = _ranged(ends.select("feature", F.col("e.value").alias("value"), F.lit(0).cast("long").alias("w"), "class", "at", "n", "k", "of_class", F.col("e.sign").alias("sign"), "tied"), cuts)
    line = probes.unionByName(_ranged(total, cuts), allowMissingColumns=True)
    within = Window.partitionBy("feature", "range").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = Window.partitionBy("feature", "range", "value")
    earlier = _ranged(total, cuts).groupBy("feature", "range").agg(F.sum("w").alias("w"))
    ladder = cuts.select("feature", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("range")).join(earlier, ["feature", "range"], "left")
    ladder = ladder.select("feature", "range", F.coalesce(F.sum("w").over(Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    seen = line.withColumns({"upto": F.sum("w").over(within), "peers": F.sum("w").over(here)}).filter("sign is not null").join(F.broadcast(ladder), ["feature", "range"])
    upto, below = F.col("base") + F.col("upto"), F.col("base") + F.col("upto") - F.col("peers")
    count = F.when(F.col("tied"), F.when(F.col("sign") > 0, upto).otherwise(-below)).otherwise(F.when(F.col("sign") > 0, below).otherwise(-upto))
    m = seen.groupBy("feature", "class", "at", "n", "k", "of_class").agg(F.sum(count).alias("m"))
    n = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * digamma(F.col(c))) / n
    return m.groupBy("feature").agg(n.alias("n"), F.greatest(digamma(n) + mean("k") - mean("of_class") - mean("m"), F.lit(0.0)).alias("information"))
