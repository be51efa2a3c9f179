"""Tables that cut lineage: written to the shared folder that the cluster names, then read again."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and Spark is local, as in tests, a new temporary folder, which is then set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; it is deleted when the session's Python ends."""
    path = f"{shared_dir(spark)}/tarnlake/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df, computed once and read from Parquet in the shared folder. Lost executors lose none of it.

    narrow: rows are a few numbers, so that tasks are four a core, or 32, at most, each with several partitions after each other. An executor starts processes for each file that it writes, and
    a loop over small tables else writes thousands of files of a few rows."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(32, 4 * spark.sparkContext.defaultParallelism))
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of text in the whole column, from one scan."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def parts(total: int, each: int, least: int = 8) -> int:
    return max(least, math.ceil(total / each))


def quoted(name: str) -> str:
    """A column's name as one name, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _maybe_in(keys: list[Column], keyed: DataFrame, table: DataFrame, names: list[str], bits: int) -> tuple[DataFrame, DataFrame]:
    """keyed in two parts: rows whose keys may be in table, and rows whose keys surely aren't. A bitmap of hashes tells, in pieces of 4 KB that are broadcast: bits / 8 bytes at most."""
    span = 32768  # what bitmap_construct_agg holds
    place = F.pmod(F.xxhash64(*[F.col(n) for n in names]), F.lit(bits))
    pieces = table.select(place.alias("at")).groupBy((F.col("at") / span).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % span).alias("bitmap"))
    there = keyed.withColumn("at", F.pmod(F.xxhash64(*keys), F.lit(bits))).withColumn("piece", (F.col("at") / span).cast("int")).join(F.broadcast(pieces), "piece", "left")
    byte = "cast(conv(hex(substring(bitmap, cast(at % 32768 / 8 as int) + 1, 1)), 16, 10) as int)"
    marked = there.withColumn("maybe", F.expr(f"coalesce(shiftright({byte}, cast(at % 8 as int)) & 1, 0)"))
    return tuple(marked.filter(f"maybe = {m}").drop("at", "piece", "bitmap", "maybe") for m in (1, 0))


def rows_that_stay(docs: DataFrame, keys: dict[str, Column], rows: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """docs without the rows whose keys have no row of `rows` that stays; of several rows with the keys of one that stays, just one.

    keys: expressions over docs; rows: a row for each row of docs that takes part, with columns named alike and `stays`. Nulls are equal to each other, so ids may repeat or be null.
    Whole rows aren't shuffled to be kept: those whose keys' hash is in no place of a bitmap of the keys to drop stay as they are, the others meet the keys in a join, which decides.
    The bitmap has 16 bits a key, most_bits (32 MB broadcast) at most; with more keys than that serves, more of the rows go through the join."""
    names = list(keys)
    of_key = rows.groupBy(*names).agg(F.max(F.col("stays").cast("int")).alias("stays"), F.count(F.lit(1)).alias("n"))
    to = [f"to_{nth}" for nth in range(len(names))]
    of_key = staged(of_key.filter("stays = 0 or n > 1").select(*[F.col(k).alias(t) for k, t in zip(names, to, strict=True)], "stays"), "not-staying")
    n_keys, n_repeated = of_key.agg(F.count(F.lit(1)), F.coalesce(F.sum("stays"), F.lit(0))).first()
    if not n_keys:
        return docs
    own = [f"key_{nth}" for nth in range(len(names))]
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in zip(own, keys.values(), strict=True)])
    bits = max(32768, min(most_bits, 1 << (16 * n_keys - 1).bit_length()))
    maybe, surely_not = _maybe_in([F.col(k) for k in own], whole, of_key, to, bits)
    same = [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(own, to, strict=True)]
    out = surely_not.select("row.*").unionByName(maybe.join(of_key.drop("stays"), same, "left_anti").select("row.*"))
    if not n_repeated:
        return out
    repeated = of_key.filter("stays = 1").drop("stays")
    again = maybe.join(repeated, same, "left_semi").groupBy(*own).agg(F.min_by("row", F.to_json("row")).alias("row"))  # maps have no order, their text does
    return out.unionByName(again.select("row.*"))


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended first; the folder is the cluster's to clear then
            return
