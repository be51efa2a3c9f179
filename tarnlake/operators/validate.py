"""Checks of tables: each is one pass that counts what is wrong, or lists the rows that are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.columns import number, over, require_columns


def _repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys occur more than once."""
    return df.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_keys"))


def survival_problems(df: DataFrame, duration: str, event: str, subject: str = "patient_id") -> DataFrame:
    """One row: n_rows, missing_values, negative_durations, bad_events, repeated_keys."""
    require_columns(df, [duration, event, subject])
    nulls = reduce(Column.__or__, [F.col(c).isNull() for c in (duration, event, subject)])
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(nulls).alias("missing_values"), F.count_if(number(duration) < 0).alias("negative_durations"),
        F.count_if(~F.col(event).cast("int").isin(0, 1)).alias("bad_events"),
    )
    return counts.crossJoin(_repeats(df.select(subject), [subject]))


def reading_problems(df: DataFrame, subject: str = "patient_id", reader: str = "reader_id", item: str = "slide_id", value: str = "tsr_percent") -> DataFrame:
    """One row for tables of percentages by subject, reader and item: n_rows, missing_values, out_of_range, repeated_keys."""
    require_columns(df, [subject, reader, item, value])
    nulls = reduce(Column.__or__, [F.col(c).isNull() for c in (subject, reader, item, value)])
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(nulls).alias("missing_values"), F.count_if(~number(value).between(0, 100)).alias("out_of_range"))
    return counts.crossJoin(_repeats(df, [subject, reader, item]))


def treatment_problems(df: DataFrame, subject: str, treatment: str, outcome: str) -> DataFrame:
    """One row: n_rows, missing_values, repeated_keys."""
    require_columns(df, [subject, treatment, outcome])
    nulls = reduce(Column.__or__, [F.col(c).isNull() for c in (subject, treatment, outcome)])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(nulls).alias("missing_values")).crossJoin(_repeats(df.select(subject), [subject]))


def raise_on(problems: DataFrame) -> None:
    """An error that names what a one-row report counts, but for n_rows."""
    if found := {k: v for k, v in problems.first().asDict().items() if k != "n_rows" and v}:
        raise ValueError(f"invalid table: {found}")


def incomplete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where any of the columns is null or empty text."""
    require_columns(df, columns)
    return df.filter(reduce(Column.__or__, [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNull() for c in columns]))


def missing_types(df: DataFrame, column: str, required: list[str]) -> DataFrame:
    wanted = df.sparkSession.createDataFrame([(x,) for x in required], f"{column} string")
    return wanted.join(df.select(column), column, "left_anti")


def marker_lists(df: DataFrame, cell_type: str = "cell_type", markers: str = "markers") -> DataFrame:
    """cell type, its markers (split at commas, trimmed, empty ones dropped) and whether there are none."""
    listed = F.filter(F.transform(F.split(F.coalesce(F.col(markers), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(cell_type, listed.alias("marker_list")).withColumn("no_markers", F.size("marker_list") == 0)


def sequencing_quality(df: DataFrame, sample: str, total: str, mapped: str, genes: str) -> DataFrame:
    """sample, the counts, mapping_rate (null without reads) and qc_issue: more reads mapped than there are, else no reads, else empty."""
    reads, own = number(total), number(mapped)
    issue = F.when(own > reads, "mapped reads exceed total reads").when(reads <= 0, "non-positive total reads").otherwise("")
    return df.select(sample, reads.alias("total"), own.alias("mapped"), number(genes).alias("genes"), F.when(reads > 0, over(own, reads)).alias("mapping_rate"), issue.alias("qc_issue"))


def stage_size_conflicts(df: DataFrame, stage: str = "t_stage", diameter: str = "tumor_diameter_cm", small_most: float = 2.0, large_least: float = 4.0) -> DataFrame:
    """Rows whose stage and size disagree, with reasons joined by "; ": T1 over the small bound, T3 up to the large one."""
    name, size = F.replace(F.upper(F.col(stage)), F.lit(" "), F.lit("")), number(diameter)
    reasons = F.concat_ws("; ", F.when(name.startswith("T1") & (size > small_most), f"T1 with diameter over {small_most:g}"), F.when(name.startswith("T3") & (size <= large_least), f"T3 with diameter up to {large_least:g}"))
    return df.withColumn("issue", reasons).filter("issue <> ''")


def enrichment_problems(df: DataFrame, p_value: str) -> DataFrame:
    """One row: n_rows, not_numeric, out_of_range."""
    p = number(p_value)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(p.isNull()).alias("not_numeric"), F.count_if(~p.between(0, 1)).alias("out_of_range"))


def missing_fields(df: DataFrame, json_column: str, paths: list[str]) -> DataFrame:
    """df with the dotted paths that its document lacks; null, "", [] and {} are missing."""
    def gone(path: str) -> Column:
        value = F.get_json_object(json_column, f"$.{path}")
        return F.when(value.isNull() | F.trim(value).isin("", "[]", "{}", "null"), path)

    found = F.filter(F.array(*[gone(p) for p in paths]), lambda x: x.isNotNull())
    return df.withColumn("missing", found).withColumn("complete", F.size("missing") == 0)


def metadata_mismatches(expression: DataFrame, metadata: DataFrame, gene: str = "gene_id", sample: str = "sample_id") -> DataFrame:
    """(kind, name): samples on one side only, repeated genes and repeated samples. Sample columns of the expression table are its columns but for the gene."""
    names = expression.sparkSession.createDataFrame([(c,) for c in expression.columns if c != gene], f"{sample} string")
    parts = [
        (names.join(metadata.select(sample), sample, "left_anti"), sample, "not_in_metadata"), (metadata.select(sample).distinct().join(names, sample, "left_anti"), sample, "not_in_expression"),
        (expression.groupBy(gene).count().filter("count > 1"), gene, "repeated_gene"), (metadata.groupBy(sample).count().filter("count > 1"), sample, "repeated_sample"),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name")) for df, c, kind in parts])
