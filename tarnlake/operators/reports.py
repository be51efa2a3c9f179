"""Summaries of runs over many inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.columns import number, over


def run_summary(results: DataFrame, error: str, amount: str) -> DataFrame:
    """One row: results, successes, failures, success rate, and least, most, mean, population deviation and sum of an amount over the successes."""
    ok = F.col(error).isNull()
    v = F.when(ok, number(amount))
    return results.agg(F.count(F.lit(1)).alias("n_results"), F.count_if(ok).alias("n_succeeded"), F.count_if(~ok).alias("n_failed"), over(F.count_if(ok), F.count(F.lit(1))).alias("success_rate"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sum(v).alias("sum"))


def error_counts(results: DataFrame, error: str) -> DataFrame:
    return results.filter(F.col(error).isNotNull()).groupBy(error).agg(F.count(F.lit(1)).alias("n"))


def usage(results: DataFrame, by: list[str], error: str) -> DataFrame:
    """Per value of each column and over all, in one pass: results and failures. A null column is one that a row's grouping leaves out."""
    sets = [[c] for c in by] + [[]]
    return results.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(error).isNotNull()).alias("n_failed"))


def majority(votes: DataFrame, vote: str, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """One row: votes, share of true ones, the majority's side ("3D" on true) and whether votes are mixed."""
    share = F.avg(F.col(vote).cast("double"))
    return votes.filter(F.col(vote).isNotNull()).agg(F.count(F.lit(1)).alias("n"), share.alias("share"), F.when(share >= 0.5, "3D").otherwise("2D").alias("side"), ((share > low) & (share < high)).alias("mixed"))


def most(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n rows of the largest values, ties by key."""
    return df.orderBy(F.desc_nulls_last(value), key).limit(n)
