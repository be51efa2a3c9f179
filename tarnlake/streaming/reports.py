"""Streaming forms: records that arrive as files, and reports that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """Records of files that appear below a path."""
    return spark.readStream.schema(schema).format(kind).load(path)


def status_counts(records: DataFrame, status: str, time: str | None = None, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Records per status, and per window of event time if a time column is named; rows later than `late` are left out."""
    if time is None:
        return records.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return records.withWatermark(time, late).groupBy(F.window(time, window), status).agg(F.count(F.lit(1)).alias("n"))


def once_per_key(records: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first record of each key within the watermark."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> StreamingQuery:
    """Processes what is there, writes it exactly once, and ends."""
    return df.writeStream.format(kind).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
