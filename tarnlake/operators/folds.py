"""Folds by subject: all rows of a subject share one, labels are spread evenly, and a seed gives the same folds everywhere.

A subject's place is that of the first 52 bits of md5("seed:subject") among the subjects of its label; places are dealt in turn. Ranks come from ranges, so no window spans the subjects.
Splits are nested: for each outer fold the other subjects are dealt anew to inner folds, with the seed plus the outer fold. The outer folds count from 1, inner ones from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.ordered import running_totals


def place_number(seed: Column, subject: Column) -> Column:
    """52 bits of a hash, as a double that holds them exactly."""
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), subject.cast("string"))), 1, 13), 16, 10).cast("double")


def subjects_of(df: DataFrame, subject: str, label: str | None) -> DataFrame:
    """(subject, label) of each subject, checked: no null subject or label, one label a subject."""
    kind = F.col(label) if label else F.lit(0)
    found = df.groupBy(F.col(subject).alias("subject")).agg(F.min(kind).alias("label"), F.max(kind).alias("most"), F.count(F.when(kind.isNull(), 1)).alias("missing"))
    wrong = found.filter("subject is null or missing > 0 or label <> most").limit(1).collect()
    if wrong:
        raise ValueError(f"{subject} and {label} can't be null, and a subject needs one label; see {wrong[0]['subject']!r}")
    return found.select("subject", "label")


def stratified_folds(subjects: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """(subject, label, fold) with folds from 1."""
    rows = subjects.withColumn("at", place_number(F.lit(seed), F.col("subject")))
    counted = rows.groupBy("label", "at").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counted, "at", ["n"], ["label"]).select(F.col("label").alias("__l"), F.col("at").alias("__a"), "below_n")
    return rows.join(placed, (F.col("label") == F.col("__l")) & (F.col("at") == F.col("__a"))).select("subject", "label", (F.col("below_n") % folds + 1).cast("int").alias("fold"))


def nested_folds(subjects: DataFrame, outer: int, inner: int, seed: int = 42) -> DataFrame:
    """(subject, label, fold, cells): cells[f - 1] is the subject's inner fold where f is the outer test fold, and -1 where the subject is in that test fold."""
    first = stratified_folds(subjects, outer, seed)
    every = first.withColumn("outer", F.explode(F.sequence(F.lit(1), F.lit(outer)))).filter("outer <> fold")
    every = every.withColumn("at", place_number(F.lit(seed) + F.col("outer"), F.col("subject")))
    counted = every.groupBy("outer", "label", "at").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counted, "at", ["n"], ["outer", "label"]).select(F.col("outer").alias("__o"), F.col("label").alias("__l"), F.col("at").alias("__a"), "below_n")
    dealt = every.join(placed, (F.col("outer") == F.col("__o")) & (F.col("label") == F.col("__l")) & (F.col("at") == F.col("__a")))
    cells = F.map_from_entries(F.collect_list(F.struct("outer", (F.col("below_n") % inner).cast("int").alias("cell"))))
    return dealt.groupBy("subject", "label", "fold").agg(cells.alias("m")).select("subject", "label", "fold", F.transform(F.sequence(F.lit(1), F.lit(outer)), lambda f: F.coalesce(F.col("m")[f], F.lit(-1))).alias("cells"))


def inner_fold_table(nested: DataFrame) -> DataFrame:
    """nested_folds as rows (subject, outer, inner), inner -1 for the outer test fold's subjects."""
    return nested.select("subject", F.posexplode("cells").alias("pos", "inner")).select("subject", (F.col("pos") + 1).alias("outer"), "inner")
