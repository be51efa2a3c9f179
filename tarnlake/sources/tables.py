"""Tables by path or as they are, with the library's rule for missing numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating-point column."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)})


def as_table(spark: SparkSession, table: DataFrame | str, schema: str | T.StructType | None = None) -> DataFrame:
    """A DataFrame as it is, or one read by its path's suffix: .csv, .json, .orc, else Parquet."""
    if isinstance(table, DataFrame):
        return without_nan(table)
    kind = next((k for k in ("csv", "json", "orc") if table.rstrip("/").endswith(f".{k}")), "parquet")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return without_nan(reader.csv(table, header=True, inferSchema=schema is None) if kind == "csv" else getattr(reader, kind)(table))


def save_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Written by the path's suffix, as as_table reads it."""
    kind = next((k for k in ("csv", "json", "orc") if path.rstrip("/").endswith(f".{k}")), "parquet")
    df.write.mode(mode).csv(path, header=True) if kind == "csv" else getattr(df.write.mode(mode), kind)(path)
