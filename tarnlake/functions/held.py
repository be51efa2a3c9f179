"""Tables read in many passes: computed once and kept in the shared checkpoint folder, so lost executors lose nothing."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def held(df: DataFrame) -> DataFrame:
    """df, computed once by checkpoint() below spark.checkpoint.dir; only where that is unset and Spark is local, as in tests, below a new temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        context.setCheckpointDir(path)
    return df.checkpoint()
