"""Histograms: grouped sums per image and colour, with an exact-to-coarse switch per image.

Sums are additive, so the coarse histogram is an aggregate of the exact one and pixels are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr as E

KEY = ["k0", "k1", "k2", "k3"]
SUMS = ["n", "sr", "sg", "sb", "sa", "sar", "sag", "sab"]
#: Distinct colours up to which an image keeps exact bins; bins that loops may look at.
EXACT_LIMIT, SAMPLE_CAP = 32768, 4096


def exact_bins(pixels: DataFrame) -> DataFrame:
    a = F.col("a")
    return pixels.groupBy("image_id", *[F.col(c).alias(k) for c, k in zip(E.CHANNELS, KEY)]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in E.CHANNELS], *[F.sum(a * F.col(c)).alias(f"sa{c}") for c in "rgb"]
    )


def coarse_bins(pixels: DataFrame) -> DataFrame:
    """Bins of the coarse grid, straight from pixels."""
    a = F.col("a")
    return pixels.groupBy("image_id", *E.coarse_key_of(*E.CHANNELS)).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in E.CHANNELS], *[F.sum(a * F.col(c)).alias(f"sa{c}") for c in "rgb"]
    )


def coarsen(bins: DataFrame) -> DataFrame:
    """Exact bins brought to the grid of 16 levels a channel."""
    keyed = bins.select("image_id", *E.coarse_key_of(*KEY), *SUMS)
    return keyed.groupBy("image_id", *KEY).agg(*[F.sum(s).alias(s) for s in SUMS])


def histogram(pixels: DataFrame, limit: int = EXACT_LIMIT) -> DataFrame:
    """Exact bins for images of at most ``limit`` distinct colours, coarse ones for the others; and ``exact``."""
    exact = exact_bins(pixels)
    many = exact.groupBy("image_id").agg((F.count(F.lit(1)) <= limit).alias("exact"))
    both = exact.join(many, "image_id")
    coarse = E.coarse_key_of(*KEY)
    keyed = both.select("image_id", "exact", *[F.when(F.col("exact"), F.col(k)).otherwise(c).alias(k) for k, c in zip(KEY, coarse)], *SUMS)
    return keyed.groupBy("image_id", "exact", *KEY).agg(*[F.sum(s).alias(s) for s in SUMS])


def finalise(bins: DataFrame) -> DataFrame:
    """Adds mean alpha's zone and each bin's ordinal in key order within its image."""
    zone = E.zone_of(E.round_half_up("sa", "n"))
    return bins.withColumn("zone", zone).withColumn("bin_ord", F.row_number().over(Window.partitionBy("image_id").orderBy(*KEY)).cast("bigint") - 1)


def bin_means(bins: DataFrame) -> DataFrame:
    """Mean colour and premultiplied mean of each bin."""
    mean = [E.round_half_up(f"s{c}", "n").alias(c) for c in E.CHANNELS]
    pre = [E.round_half_up(f"sa{c}", "n").alias(f"p{i}") for i, c in enumerate("rgb")] + [E.round_half_up(255 * F.col("sa"), "n").alias("p3")]
    return bins.select("*", *mean, *pre)


def centroids(bins: DataFrame, by: list[str]) -> DataFrame:
    """Alpha-weighted mean colour of each group of bins; a transparent one is all zero."""
    got = bins.groupBy(*by).agg(*[F.sum(s).alias(s) for s in ("n", "sa", "sar", "sag", "sab")])
    a = E.round_half_up("sa", "n")
    colour = [F.when(a == 0, 0).otherwise(E.round_half_up(f"sa{c}", F.greatest("sa", F.lit(1)))).cast("bigint").alias(c) for c in "rgb"]
    return got.select(*by, "n", *colour, a.alias("a"))


def alpha_mass(bins: DataFrame) -> DataFrame:
    return bins.groupBy("image_id", E.round_half_up("sa", "n").alias("alpha")).agg(F.sum("n").alias("mass"))


def quantile_seeds(mass: DataFrame, k: int = 8) -> DataFrame:
    """Interior alphas where the running mass crosses (2t - 1) / 2k of the whole."""
    inner = mass.where("alpha between 1 and 254")
    one, run = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("alpha").rowsBetween(Window.unboundedPreceding, 0)
    got = inner.select("image_id", "alpha", F.sum("mass").over(run).alias("upto"), F.sum("mass").over(one).alias("total"), F.least(F.count(F.lit(1)).over(one), F.lit(k)).alias("k"), "mass")
    crossed = lambda x: E.div(2 * F.col("k") * x + F.col("total"), 2 * F.col("total"))
    return got.where(crossed(F.col("upto")) > crossed(F.col("upto") - F.col("mass"))).select("image_id", "alpha")


def stride_sample(bins: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """Every ceil(n / cap)-th bin in key order, from the first."""
    size = bins.groupBy("image_id").agg(F.ceil(F.count(F.lit(1)) / cap).cast("bigint").alias("__step"))
    return bins.join(size, "image_id").where(F.col("bin_ord") % F.col("__step") == 0).drop("__step")


def zone_counts(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", E.zone_of().alias("zone")).agg(F.count(F.lit(1)).alias("n"))


def guard(pixels: DataFrame) -> DataFrame:
    got = pixels.groupBy("image_id").agg(F.sum((F.col("a") == 255).cast("bigint")).alias("opaque"), F.count(F.lit(1)).alias("total"))
    return got.withColumn("fires", E.guard_fires("opaque", "total"))
