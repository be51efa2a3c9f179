"""Running totals and ranks over whole tables without a single-task window.

Equal values are summed first, so that a value that many rows share is one row. The distinct values are dealt to ranges by approximate quantiles, running
totals are formed inside each range, and each range adds the total of those before it, a table of as many rows as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that distinct values are dealt to.
RANGES = 64


def running_totals(df: DataFrame, value: str, totals: list[str], by: list[str] | None = None, ranges: int = RANGES, cuts: list[float] | None = None) -> DataFrame:
    """df, one row per (by, value), with below_<t>: the sum of t over smaller values of the same group. Values are numeric, none null. cuts: those of range_cuts, where a caller has them already."""
    by = by or []
    cuts = range_cuts(df, value, ranges) if cuts is None else cuts
    cut = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    placed = df.withColumn("__range", F.size(F.filter(cut, lambda c: c < F.col(value).cast("double"))))
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "__range").agg(*[F.sum(t).alias(f"__{t}") for t in totals])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__{t}").over(earlier), F.lit(0)).alias(f"__{t}") for t in totals])
    match = F.col("__range") == F.col("__r")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    out = placed.select("*", *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"__in_{t}") for t in totals]).join(sums, match)
    return out.withColumns({f"below_{t}": F.col(f"__in_{t}") + F.col(f"__{t}") for t in totals}).select(*df.columns, *[f"below_{t}" for t in totals])


def range_cuts(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """Values that deal df's to ranges of about as many rows."""
    return sorted(set(df.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.005))) if ranges > 1 else []


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, n, average_rank) of each distinct value; ranks count from 1, ties share the mean. Rows without a value are left out."""
    by = by or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counted, value, ["n"], by).withColumn("average_rank", F.col("below_n") + (F.col("n") + 1) / 2).drop("below_n")


def with_ranks(df: DataFrame, value: str, by: list[str] | None = None, name: str = "average_rank") -> DataFrame:
    """df with the average rank of each row's value; null where the value is."""
    by = by or []
    ranks = value_ranks(df, value, by).select(*[F.col(b).alias(f"__k_{b}") for b in by], F.col(value).alias("__v"), F.col("average_rank").alias(name))
    match = F.col(value) == F.col("__v")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    return df.join(ranks, match, "left").select(*df.columns, name)


def order_statistics(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, share, quantile): exact percentiles of each group with linear interpolation between neighbouring values, without a task that holds a group.

    Distinct values are counted first, so a value of a third of all rows is one row; positions are found among running totals of ranges. Rows without a value are left out."""
    by = by or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_totals(counted, value, ["__n"], by)
    total = counted.groupBy(*by).agg(F.sum("__n").alias("__total"))
    match = F.lit(True)
    for b in by:
        match = match & placed[b].eqNullSafe(F.col(f"__g_{b}"))
    wanted = placed.join(F.broadcast(total.withColumnsRenamed({b: f"__g_{b}" for b in by})) if not by else total.withColumnsRenamed({b: f"__g_{b}" for b in by}), match)
    first, last = F.col("below___n"), F.col("below___n") + F.col("__n") - 1
    position = F.col("share") * (F.col("__total") - 1)
    listed = wanted.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    low, high = F.floor(position), F.ceil(position)
    near = listed.filter(((first <= low) & (low <= last)) | ((first <= high) & (high <= last)))
    under = F.max(F.when((first <= low) & (low <= last), F.col(value).cast("double")))
    above = F.max(F.when((first <= high) & (high <= last), F.col(value).cast("double")))
    part = F.first(position - low)
    return near.groupBy(*by, "share").agg((under + part * (above - under)).alias("quantile"))
