"""Image operators on rows that hold a whole image as an array of values in row order.

Everything per image is an array expression, so that images are neither exploded nor shuffled. Masks are arrays of the same length, foreground over 0. A missing (null or NaN) value is no foreground.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.columns import over

ZERO = 0.0


def let(value: Column, f) -> Column:
    """f of a value that is computed once per row, even where f uses it inside a lambda."""
    return F.transform(F.array(value), f)[0]


def values(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(ZERO), lambda s, x: s + f(x))


def mean(a: Column) -> Column:
    return over(total(a), F.size(a))


def variance(a: Column, centre: Column) -> Column:
    """Population variance about a given mean."""
    return let(F.struct(a.alias("a"), centre.alias("c")), lambda p: over(total(p["a"], lambda x: (x - p["c"]) * (x - p["c"])), F.size(p["a"])))


def quantile(a: Column, p: float) -> Column:
    """Linear between the sorted values."""
    s, h = F.array_sort(a), (F.size(a) - 1) * F.lit(p)
    low = F.floor(h).cast("int")
    return F.when(F.size(a) > 0, s[low] + (h - low) * (s[F.least(low + 1, F.size(a) - 1)] - s[low]))


def foreground(image: Column, mask: Column | None = None) -> Column:
    """Values of the region of interest."""
    if mask is None:
        return F.filter(image, lambda x: ~F.isnan(x) & (x > 0))
    inside = F.zip_with(image, mask, lambda x, m: F.when(m > 0, x))
    return F.filter(inside, lambda x: x.isNotNull() & ~F.isnan(x))


def roi_statistics(df: DataFrame, image: str, keys: list[str]) -> DataFrame:
    """Per image, of its foreground: voxels, share, mean, population deviation, least, most, sum and energy."""
    rows = df.select(*keys, values(image).alias("a")).withColumn("roi", foreground(F.col("a"))).withColumn("m", mean(F.col("roi")))
    roi = F.col("roi")
    return rows.select(*keys, F.size(roi).alias("n_voxels"), over(F.size(roi), F.size("a")).alias("share"), F.col("m").alias("mean"), F.sqrt(variance(roi, F.col("m"))).alias("std"), F.array_min(roi).alias("min"), F.array_max(roi).alias("max"), total(roi).alias("sum"), total(roi, lambda x: x * x).alias("energy"))


def bounding_box(df: DataFrame, image: str, keys: list[str], width: int) -> DataFrame:
    """Per image with foreground: least and most row and column of it, and its centre."""
    at = F.filter(F.transform(values(image), lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    rows = df.select(*keys, at.alias("at")).filter(F.size("at") > 0)
    row, col = F.transform("at", lambda i: F.floor(i / width).cast("int")), F.transform("at", lambda i: i % width)
    return rows.select(*keys, row.alias("r"), col.alias("c")).select(*keys, *[f("r").alias(f"{n}_row") for n, f in (("min", F.array_min), ("max", F.array_max))], *[f("c").alias(f"{n}_col") for n, f in (("min", F.array_min), ("max", F.array_max))], mean(F.col("r").cast("array<double>")).alias("centre_row"), mean(F.col("c").cast("array<double>")).alias("centre_col"))


def with_normalised(df: DataFrame, image: str, method: str, name: str = "normalised", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with the image scaled by zscore (population), minmax, percentile (clipped, then minmax) or robust (median and quartile range); a constant image becomes 0.

    Its statistics are formed once per image, not once per voxel."""
    a = F.col("__a")
    needs = {
        "zscore": (mean(a), F.sqrt(variance(a, mean(a)))), "minmax": (F.array_min(a), F.array_max(a) - F.array_min(a)),
        "percentile": (quantile(a, low), quantile(a, high) - quantile(a, low)), "robust": (quantile(a, 0.5), quantile(a, 0.75) - quantile(a, 0.25)),
    }
    shift, by = needs[method]
    clip = method == "percentile"

    def scaled(p: Column) -> Column:
        def one(x: Column) -> Column:
            x = F.least(F.greatest(x, p["shift"]), p["shift"] + p["by"]) if clip else x
            return F.when(p["by"] == 0, 0.0).otherwise(F.try_divide(x - p["shift"], p["by"]))

        return F.transform(p["a"], one)

    rows = df.withColumn("__a", values(image))
    return rows.withColumn(name, let(F.struct(a.alias("a"), shift.alias("shift"), by.alias("by")), scaled)).drop("__a")


def windowed(a: Column, level: float, width: float, top: float = 255.0) -> Column:
    """Values of the window clipped and scaled to 0..top."""
    low, high = level - width / 2, level + width / 2
    return F.transform(a, lambda x: (F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / (high - low) * top)


def image_quality(df: DataFrame, reference: str, other: str, keys: list[str]) -> DataFrame:
    """Per pair: mean squared error, peak signal-to-noise over the reference's range (infinite if equal), signal-to-noise of the other, and contrast of its foreground against the rest."""
    rows = df.select(*keys, values(reference).alias("a"), values(other).alias("b"))
    rows = rows.withColumn("mse", over(total(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))), F.size("a"))).withColumn("range", F.array_max("a") - F.array_min("a"))
    rows = rows.withColumn("mb", mean(F.col("b"))).withColumn("sb", F.sqrt(variance(F.col("b"), F.col("mb"))))
    rows = rows.withColumn("roi", F.filter("b", lambda x: x > 0)).withColumn("rest", F.filter("b", lambda x: x <= 0)).withColumn("m1", mean(F.col("roi"))).withColumn("m0", mean(F.col("rest")))
    noise = F.sqrt(variance(F.col("roi"), F.col("m1")) + variance(F.col("rest"), F.col("m0")))
    psnr = F.when(F.col("mse") == 0, float("inf")).otherwise(20 * F.log10("range") - 10 * F.log10("mse"))
    return rows.select(*keys, "mse", psnr.alias("psnr"), over(F.col("mb"), F.col("sb")).alias("snr"), over(F.abs(F.col("m1") - F.col("m0")), noise).alias("cnr"))


def overlap(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Per pair of masks: voxels of either and both, Dice and Jaccard; 1 where both are empty."""
    both = total(F.zip_with(values(a), values(b), lambda x, y: ((x > 0) & (y > 0)).cast("double")))
    size = lambda c: total(values(c), lambda x: (x > 0).cast("double"))
    rows = df.select(*keys, size(a).cast("long").alias("n_a"), size(b).cast("long").alias("n_b"), both.cast("long").alias("n_both"))
    either = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return rows.withColumn("dice", F.when(F.col("n_a") + F.col("n_b") == 0, 1.0).otherwise(over(2 * F.col("n_both"), F.col("n_a") + F.col("n_b")))).withColumn("jaccard", F.when(either == 0, 1.0).otherwise(over(F.col("n_both"), either)))


def quantised(a: Column, levels: int) -> Column:
    """0 to levels - 1 over the image's range."""
    def level(p: Column) -> Column:
        low, high = p["low"], p["high"]
        return F.transform(p["a"], lambda x: F.when(high == low, 0).otherwise(F.least(F.floor(F.try_divide(x - low, high - low) * levels).cast("int"), F.lit(levels - 1))))

    return let(F.struct(a.alias("a"), F.array_min(a).alias("low"), F.array_max(a).alias("high")), level)


def cooccurrence(df: DataFrame, image: str, keys: list[str], width: int, levels: int = 8) -> DataFrame:
    """Per image, of grey levels beside each other in a row: contrast, dissimilarity, homogeneity and energy (sum of squared shares)."""
    rows = df.select(*keys, quantised(values(image), levels).alias("q"))
    pairs = F.filter(F.transform("q", lambda x, i: F.when(i % width < width - 1, F.struct(x.alias("x"), F.get("q", i + 1).alias("y")))), lambda p: p.isNotNull())
    rows = rows.select(*keys, pairs.alias("p"))
    n, d = F.size("p"), (lambda p: (p["x"] - p["y"]).cast("double"))
    twice = F.aggregate("p", F.lit(ZERO), lambda s, p: s + F.size(F.filter("p", lambda o: o == p)))
    return rows.select(*keys, over(total(F.col("p"), lambda p: d(p) * d(p)), n).alias("contrast"), over(total(F.col("p"), lambda p: F.abs(d(p))), n).alias("dissimilarity"), over(total(F.col("p"), lambda p: 1 / (1 + d(p) * d(p))), n).alias("homogeneity"), over(twice, n * n).alias("energy"))


def histogram_entropy(df: DataFrame, image: str, keys: list[str], bins: int = 16) -> DataFrame:
    """Per image: occupied bins of its range, entropy in bits, and the fullest bin (the lowest of equals)."""
    rows = df.select(*keys, quantised(values(image), bins).alias("q"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter("q", lambda x: x == b)))
    rows = rows.select(*keys, F.size("q").alias("n"), counts.alias("h"))
    share = lambda c: F.try_divide(c.cast("double"), F.col("n"))
    entropy = -total(F.col("h"), lambda c: F.when(c > 0, share(c) * F.log2(F.when(c > 0, share(c)))).otherwise(0.0))
    return rows.select(*keys, F.size(F.filter("h", lambda c: c > 0)).alias("occupied"), entropy.alias("entropy"), (F.array_position("h", F.array_max("h")) - 1).cast("int").alias("mode_bin"))


def slice_variation(df: DataFrame, image: str, keys: list[str], width: int) -> DataFrame:
    """Per image: mean over its rows' means, their population deviation, and the mean absolute step from one row to the next."""
    slices = F.transform(F.sequence(F.lit(0), (F.size("a") / width).cast("int") - 1), lambda i: mean(F.slice("a", i * width + 1, width)))
    rows = df.select(*keys, values(image).alias("a")).select(*keys, slices.alias("s")).withColumn("m", mean(F.col("s")))
    steps = F.zip_with(F.slice("s", 2, 100_000), F.slice("s", 1, F.size("s") - 1), lambda x, y: F.abs(x - y))
    return rows.select(*keys, F.size("s").alias("n_slices"), F.col("m").alias("mean"), F.sqrt(variance(F.col("s"), F.col("m"))).alias("std"), mean(steps).alias("mean_step"))


def local_means(df: DataFrame, image: str, keys: list[str], width: int, radius: int = 1) -> DataFrame:
    """Per foreground voxel: its place, and mean and number of the foreground voxels within the kernel's box."""
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]

    def around(i: Column) -> Column:
        row, col = F.floor(i / width), i % width
        found = [F.when((row + dy >= 0) & (col + dx >= 0) & (col + dx < width), F.get("a", (i + dy * width + dx).cast("int"))) for dy, dx in offsets]
        return F.filter(F.array(*found), lambda x: x > 0)

    rows = df.select(*keys, values(image).alias("a")).select(*keys, F.inline(F.filter(F.transform("a", lambda x, i: F.struct(i.alias("pos"), (x > 0).alias("inside"), around(i).alias("near"))), lambda v: v["inside"])))
    return rows.select(*keys, "pos", F.size("near").alias("n_near"), mean(F.col("near")).alias("local_mean"))


def cluster_characteristics(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """Per cluster and feature: rows, their share of all, mean, population deviation, least and most."""
    from tarnlake.functions.columns import long_form

    n = df.agg(F.count(F.lit(1)).alias("all_rows"))
    out = long_form(df, [cluster], features).groupBy(cluster, "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.crossJoin(F.broadcast(n)).withColumn("percent", over(100 * F.col("n"), F.col("all_rows"))).drop("all_rows")


def mad_normalised(df: DataFrame, image: str, name: str = "normalised") -> DataFrame:
    """df with values less the median over 1.4826 times the median absolute deviation; 0 where that is 0."""
    def spread(p: Column) -> Column:
        return F.struct(p["a"].alias("a"), p["m"].alias("m"), (1.4826 * quantile(F.transform(p["a"], lambda x: F.abs(x - p["m"])), 0.5)).alias("d"))

    def scaled(p: Column) -> Column:
        return F.transform(p["a"], lambda x: F.when(p["d"] == 0, 0.0).otherwise(F.try_divide(x - p["m"], p["d"])))

    rows = df.withColumn("__a", values(image))
    middle = F.struct(F.col("__a").alias("a"), quantile(F.col("__a"), 0.5).alias("m"))
    return rows.withColumn(name, let(let(middle, spread), scaled)).drop("__a")


def clipped_to_percentiles(df: DataFrame, image: str, low: float = 0.01, high: float = 0.99, name: str = "clipped") -> DataFrame:
    rows = df.withColumn("__a", values(image))
    bounds = F.struct(F.col("__a").alias("a"), quantile(F.col("__a"), low).alias("lo"), quantile(F.col("__a"), high).alias("hi"))
    return rows.withColumn(name, let(bounds, lambda p: F.transform(p["a"], lambda x: F.least(F.greatest(x, p["lo"]), p["hi"])))).drop("__a")


def central_crop(a: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """The middle rows and columns of an image."""
    top, left = (height - to_height) // 2, (width - to_width) // 2
    return F.flatten(F.array(*[F.slice(a, (top + r) * width + left + 1, to_width) for r in range(to_height)]))


def centre_of_mass(df: DataFrame, image: str, keys: list[str], width: int, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Per image with foreground: its voxels' mean place times the spacing, and their area."""
    box = bounding_box(df, image, keys, width)
    n = df.select(*keys, F.size(F.filter(values(image), lambda x: x > 0)).alias("n"))
    return box.join(n, keys).select(*keys, (F.col("centre_row") * spacing[0]).alias("row"), (F.col("centre_col") * spacing[1]).alias("col"), (F.col("n") * spacing[0] * spacing[1]).alias("area"))


def voxel_table(df: DataFrame, image: str, keys: list[str], width: int, step: int = 1) -> DataFrame:
    """A row for every step-th foreground voxel in row order: its place among them, row, column and value."""
    inside = F.filter(F.transform(values(image), lambda x, i: F.struct(F.floor(i / width).cast("int").alias("row"), (i % width).alias("col"), x.alias("value"))), lambda v: v["value"] > 0)
    return df.select(*keys, F.posexplode(inside).alias("place", "v")).filter(F.col("place") % step == 0).select(*keys, "place", "v.row", "v.col", "v.value")


def intensity_features(df: DataFrame, image: str, keys: list[str]) -> DataFrame:
    """Per image with foreground, first-order statistics of it: mean, median, least, most, range, deviation, variance, mean absolute deviation, root mean square, energy, quartile range, skewness and raw kurtosis (0 if constant)."""
    roi, m, v = F.col("roi"), F.col("m"), F.col("v")
    rows = df.select(*keys, foreground(values(image)).alias("roi")).filter(F.size("roi") > 0).withColumn("m", mean(roi)).withColumn("v", variance(roi, m))
    n = F.size("roi")
    about = lambda f: let(F.struct(roi.alias("a"), m.alias("c")), lambda p: over(total(p["a"], lambda x: f(x - p["c"])), F.size(p["a"])))
    moment = lambda k: about(lambda d: F.pow(d, F.lit(float(k))))
    return rows.select(
        *keys, m.alias("mean"), quantile(roi, 0.5).alias("median"), F.array_min(roi).alias("min"), F.array_max(roi).alias("max"), (F.array_max(roi) - F.array_min(roi)).alias("range"), F.sqrt(v).alias("std"), v.alias("variance"),
        about(F.abs).alias("mean_absolute_deviation"), F.sqrt(over(total(roi, lambda x: x * x), n)).alias("root_mean_square"), total(roi, lambda x: x * x).alias("energy"), (quantile(roi, 0.75) - quantile(roi, 0.25)).alias("quartile_range"),
        F.when(v == 0, 0.0).otherwise(F.try_divide(moment(3), F.pow(v, F.lit(1.5)))).alias("skewness"), F.when(v == 0, 0.0).otherwise(F.try_divide(moment(4), v * v)).alias("kurtosis"),
    )
