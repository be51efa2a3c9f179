"""Many tables of one subject each row, joined by the subject's id; cohorts; files matched by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.columns import numeric_columns, require_columns

HOWS = ("inner", "left", "right", "outer")
FILLS = ("zero", "mean", "median", None)


def prefixed(df: DataFrame, id_column: str, prefix: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns named <prefix>_<column>, but for the id and those that are so named already."""
    return df.select(id_column, *[F.col(c).alias(c if c.startswith(f"{prefix}_") else f"{prefix}_{c}") for c in df.columns if c != id_column and c not in drop])


def filled(df: DataFrame, id_column: str, fill: str | None) -> DataFrame:
    """Missing numbers replaced by zero, or by their column's mean or median; other columns stay."""
    if fill not in FILLS:
        raise ValueError(f"fill is one of {FILLS}")
    columns = numeric_columns(df, (id_column,))
    if fill is None or not columns:
        return df
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in columns}
    if fill == "zero":
        return df.withColumns({c: F.coalesce(known[c], F.lit(0).cast(df.schema[c].dataType)) for c in columns})
    centre = F.avg if fill == "mean" else F.median
    centres = df.agg(*[centre(known[c]).alias(f"__{c}") for c in columns])  # one row
    return df.crossJoin(F.broadcast(centres)).withColumns({c: F.coalesce(known[c].cast("double"), F.col(f"__{c}")) for c in columns}).select(*df.columns)


def fuse(tables: dict[str, DataFrame], id_column: str = "patient_id", how: str = "inner", fill: str | None = None, drop: tuple[str, ...] = (), prefix: bool = True) -> DataFrame:
    """Left-deep equi-joins on the id, null ids matching each other; each table's columns carry its name. An id that repeats multiplies rows."""
    if how not in HOWS:
        raise ValueError(f"how is one of {HOWS}")
    if not tables:
        raise ValueError("no tables")
    for df in tables.values():
        require_columns(df, [id_column])
    named = [prefixed(df, id_column, name, drop) if prefix else df.drop(*drop) for name, df in tables.items()]

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed(id_column, "__id")
        key = F.coalesce(F.col(id_column), F.col("__id")).alias(id_column)
        return a.join(b, F.col(id_column).eqNullSafe(F.col("__id")), "full" if how == "outer" else how).select(key, *[c for c in a.columns if c != id_column], *[c for c in b.columns if c != "__id"])

    return filled(reduce(joined, named), id_column, fill)


def cohort_overlap(cohorts: dict[str, DataFrame], id_column: str) -> DataFrame:
    """Ids in more than one cohort and how many have them; null ids are ignored."""
    tagged = reduce(DataFrame.unionByName, [df.select(id_column).withColumn("cohort", F.lit(name)) for name, df in cohorts.items()])
    return tagged.filter(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.countDistinct("cohort").alias("n_cohorts")).filter("n_cohorts > 1")


def assert_disjoint(cohorts: dict[str, DataFrame], id_column: str) -> None:
    if shown := [str(r[0]) for r in cohort_overlap(cohorts, id_column).orderBy(id_column).limit(5).collect()]:
        raise ValueError(f"cohorts share ids: {', '.join(shown)}")


def split_by_subject(df: DataFrame, id_column: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with `part`, "train" or "test", the same for all rows of a subject, from a hash of its id."""
    draw = F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("part", F.when(draw < test_share, "test").otherwise("train"))


def rows_of(df: DataFrame, subjects: DataFrame, id_column: str, present: bool = True) -> DataFrame:
    """The rows of df whose subject is (or isn't) among the subjects."""
    return df.join(subjects.select(id_column).distinct(), id_column, "left_semi" if present else "left_anti")


def matched_by_name(items: DataFrame, files: DataFrame, stem_column: str, file_column: str, rules: list[str]) -> DataFrame:
    """items with the file whose name comes from the first rule that gives one, and that rule's place from 1; null where none does. A rule has {} for the stem."""
    candidates: list[Column] = [F.struct(F.lit(i).alias("rule"), F.concat(F.lit(rule.split("{}")[0]), F.col(stem_column), F.lit(rule.split("{}")[1])).alias("name")) for i, rule in enumerate(rules, 1)]
    tried = items.select(stem_column, F.explode(F.array(*candidates)).alias("c")).select(stem_column, "c.*").distinct()
    best = tried.join(files.select(F.col(file_column).alias("name")).distinct(), "name").groupBy(stem_column).agg(F.min(F.struct("rule", "name")).alias("best"))
    return items.join(best, stem_column, "left").select(*items.columns, F.col("best.name").alias("matched_file"), F.col("best.rule").alias("rule"))
