"""Whether a volume is for slice-wise (2-D) or whole (3-D) processing, from a table of its slices, with the reasons and the suggestions that follow.

A row is a slice: volume, position along the axis, pixels, distance between slices. Only narrow profiles of slices meet by volume; of the pixels just the sampled slices move, by volume and place, so that a volume with most
of the rows is no task of its own. Rows without volume or position are left out; of several slices at one position the one with the smallest hash counts. Null and NaN pixels are missing. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.columns import over
from tarnlake.operators.voxels import let, mean, total, values


def slice_profiles(slices: DataFrame, volume: str, position: str, image: str, spacing: str) -> DataFrame:
    """Per slice: volume, position, hash, spacing, pixels, and of those present n, mean, m2 and m3 (sums of powers about the mean), least, most and zeros."""
    pixels = F.coalesce(values(image), F.array().cast("array<double>"))
    rows = slices.filter(F.col(volume).isNotNull() & F.col(position).isNotNull())
    rows = rows.select(F.col(volume).alias("volume"), F.col(position).alias("position"), F.xxhash64(image).alias("hash"), F.col(spacing).cast("double").alias("spacing"), pixels.alias("pixels"))
    rows = rows.withColumn("a", F.filter("pixels", lambda x: x.isNotNull() & ~F.isnan(x))).withColumn("mean", mean(F.col("a")))

    def power(k: int) -> Column:
        return let(F.struct("a", "mean"), lambda p: total(p["a"], lambda x: F.pow(x - p["mean"], F.lit(k))))

    zeros = F.size(F.filter("a", lambda x: x == 0))
    facts = F.struct("spacing", F.size("pixels").alias("pixels"), F.size("a").alias("n"), "mean", power(2).alias("m2"), power(3).alias("m3"), F.array_min("a").alias("least"), F.array_max("a").alias("most"), zeros.alias("zeros"))
    return rows.select("volume", "position", "hash", facts.alias("facts")).groupBy("volume", "position").agg(F.min("hash").alias("hash"), F.min_by("facts", "hash").alias("facts")).select("volume", "position", "hash", "facts.*")


def sampled_places(n: Column, ratio: float) -> Column:
    """Evenly spread places of the first n, both ends included: a share of `ratio`, two at least."""
    count = F.greatest(F.lit(2), F.floor(n * F.lit(ratio))).cast("int")
    even = let(F.struct(n.alias("n"), count.alias("m")), lambda p: F.transform(F.sequence(F.lit(0), p["m"] - 1), lambda i: F.when(i == p["m"] - 1, p["n"] - 1).otherwise(F.floor(i * ((p["n"] - 1) / (p["m"] - 1)))).cast("int")))
    return F.when(n > 1, even).otherwise(F.array().cast("array<int>"))


def _variation(slices: DataFrame, profiles: DataFrame, volume: str, position: str, image: str, ratio: float) -> DataFrame:
    """Per volume with pairs of neighbouring sampled slices that can be compared: their number and mean of 1 - |correlation|."""
    by_volume = Window.partitionBy("volume")
    placed = profiles.select("volume", "position", "hash", "mean", "m2", (F.row_number().over(by_volume.orderBy("position")) - 1).alias("place"), F.count(F.lit(1)).over(by_volume).alias("of"), ((F.col("n") == F.col("pixels")) & (F.col("least") < F.col("most"))).alias("whole"))
    every = placed.filter("place = 0").select("volume", sampled_places(F.col("of").cast("int"), ratio).alias("at"))
    links = every.select("volume", F.inline(F.zip_with("at", F.slice("at", 2, 1 << 30), lambda x, y: F.struct(x.alias("place"), y.alias("following"))))).select("volume", "place", "following")
    chosen = placed.filter("whole").join(links, ["volume", "place"])
    pixels = slices.select(F.col(volume).alias("volume"), F.col(position).alias("position"), F.xxhash64(image).alias("hash"), values(image).alias("a"))
    held = pixels.join(chosen, ["volume", "position", "hash"]).dropDuplicates(["volume", "place"])  # equal hashes, equal pixels
    first = held.select("volume", F.col("following").alias("to"), F.col("a").alias("x"), F.col("mean").alias("mx"), F.col("m2").alias("sx"))
    second = held.select("volume", F.col("place").alias("to"), F.col("a").alias("y"), F.col("mean").alias("my"), F.col("m2").alias("sy"))
    both = first.join(second, ["volume", "to"]).filter(F.size("x") == F.size("y"))
    moment = let(F.struct("x", "y", "mx", "my"), lambda p: total(F.zip_with(p["x"], p["y"], lambda x, y: (x - p["mx"]) * (y - p["my"]))))
    return both.select("volume", (1 - F.abs(moment / F.sqrt(F.col("sx") * F.col("sy")))).alias("v")).groupBy("volume").agg(F.count("v").alias("n_pairs"), F.avg("v").alias("variation"))


def dimension_analysis(slices: DataFrame, volume: str, position: str, image: str, spacing: str, min_slices: int = 30, max_spacing: float = 5.0, min_variation: float = 0.1, ratio: float = 0.1) -> DataFrame:
    """Per volume: whether two of three hold (enough slices; slices near enough, a null spacing isn't; neighbouring sampled slices differ enough, which also holds where no two of several can be compared), its content, its slices' spread, and suggestions.

    Skewness and signal_to_noise of a volume of one value, and statistics of one without pixels, are null. ratio: over 0, 1 at most."""
    if not 0 < ratio <= 1:
        raise ValueError("ratio has to be over 0 and 1 at most")
    profiles = slice_profiles(slices, volume, position, image, spacing)
    std, span = F.sqrt(over(F.col("m2"), F.col("n"))), F.col("most") - F.col("least")
    whole = profiles.groupBy("volume").agg(
        F.count(F.lit(1)).alias("n_slices"), F.max("spacing").alias("spacing"), F.sum("n").alias("n_pixels"), over(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("centre"), F.min("least").alias("min"), F.max("most").alias("max"), over(F.sum("zeros"), F.sum("n")).alias("sparsity"),
        F.stddev_pop("mean").alias("mean_variation"), F.stddev_pop(std).alias("std_variation"), F.stddev_pop(span).alias("range_variation"), F.avg(std).alias("mean_std"), F.avg(span).alias("mean_span"),
    )
    d = F.col("mean") - F.col("centre")
    spread = profiles.join(whole.select("volume", "centre", "mean_std", "std_variation", "mean_span"), "volume").groupBy("volume").agg(
        F.sum(F.col("m2") + F.col("n") * d * d).alias("m2"), F.sum(F.col("m3") + 3 * d * F.col("m2") + F.col("n") * d * d * d).alias("m3"),
        F.count(F.when(std > F.col("mean_std") + F.col("std_variation"), 1)).alias("high_variance_slices"), F.count(F.when(span < F.col("mean_span") * 0.5, 1)).alias("low_signal_slices"),
    )
    rows = whole.join(spread, "volume").join(_variation(slices, profiles, volume, position, image, ratio), "volume", "left")
    var = over(F.col("m2"), F.col("n_pixels"))
    rows = rows.withColumns({"mean": F.col("centre"), "std": F.sqrt(var), "skewness": over(over(F.col("m3"), F.col("n_pixels")), F.when(F.col("m2") > 0, F.pow(var, F.lit(1.5)))), "signal_to_noise": over(var + F.col("centre") * F.col("centre"), var), "effective_bits": F.floor(F.log2(F.col("max") - F.col("min") + 1)).cast("int")})
    enough, near = F.col("n_slices") >= min_slices, F.coalesce(F.col("spacing") <= max_spacing, F.lit(False))
    differ = (F.col("n_slices") > 1) & F.coalesce(F.col("variation") >= min_variation, F.lit(True))
    votes = enough.cast("int") + near.cast("int") + differ.cast("int")
    rows = rows.withColumn("is_3d", votes >= 2)
    named = lambda pairs: F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in pairs])
    # fixed values: names of reasons and suggestions
    reasons = named([("slices", enough), ("spacing", near), ("variation", differ)])
    prepare = named([("log_transform", F.col("skewness") > 2), ("contrast_enhancement", F.col("std") / (F.col("mean") + 1e-8) < 0.1), ("interpolation", F.col("spacing") > 3.0)])
    suited = named([("3d_unet", F.col("is_3d")), ("3d_vnet", F.col("is_3d")), ("cascade_3d", F.col("is_3d") & (F.col("n_slices") > 64)), ("2d_unet", ~F.col("is_3d")), ("2d_attention_unet", ~F.col("is_3d")), ("slice_ensemble", ~F.col("is_3d"))])
    confidence = F.when(F.abs(F.col("n_slices") - min_slices) > 10, "high").otherwise("medium")
    return rows.select(
        F.col("volume").alias(volume), "n_slices", "spacing", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "variation", "is_3d", reasons.alias("reasons"), confidence.alias("confidence"), prepare.alias("preparation"), suited.alias("models"),
        "mean", "std", "min", "max", "skewness", "signal_to_noise", "effective_bits", "sparsity", "mean_variation", "std_variation", "range_variation", "high_variance_slices", "low_signal_slices",
    )


def batch_recommendation(analysed: DataFrame) -> DataFrame:
    """One row over all volumes: how many are for each way, the way of most (2-D of equals) with its share, whether both are common enough to choose by volume. No row without volumes."""
    n, three = F.count(F.lit(1)), F.count(F.when(F.col("is_3d"), 1))
    rows = analysed.agg(n.alias("n_volumes"), three.alias("n_3d"), F.count(F.when(F.col("confidence") == "high", 1)).alias("n_high")).filter("n_volumes > 0")
    most = F.greatest(F.col("n_3d"), F.col("n_volumes") - F.col("n_3d"))
    share = F.col("n_3d") / F.col("n_volumes")
    return rows.select("n_volumes", "n_3d", "n_high", F.when(F.col("n_3d") * 2 > F.col("n_volumes"), "3D").otherwise("2D").alias("approach"), (most / F.col("n_volumes")).alias("share"), ((share > 0.3) & (share < 0.7)).alias("mixed"))
