"""Nearest palette entries.

Ties take the lowest index.  A palette holds at most 256 entries an image, so it travels as one
array row per image; nothing is broadcast that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.operators import histogram as H

P = ["p0", "p1", "p2", "p3"]
Q = ["q0", "q1", "q2", "q3"]


def seed_palette(bins: DataFrame, per_zone: int) -> DataFrame:
    """The heaviest bins of each zone (ties: lowest packed colour) as palette entries, zones in order."""
    means = bins.select("image_id", "zone", "n", *[E.round_half_up(f"s{c}", "n").alias(c) for c in E.CHANNELS])
    means = means.select("image_id", "zone", "n", *[F.when(F.col("zone") == 0, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in E.CHANNELS])
    distinct = means.groupBy("image_id", "zone", *E.CHANNELS).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("image_id", "zone").orderBy(F.desc("n"), E.packed()))
    top = distinct.withColumn("rank", rank).where(F.col("rank") <= per_zone)
    idx = F.row_number().over(Window.partitionBy("image_id").orderBy("zone", "rank")).cast("bigint") - 1
    return top.select("image_id", idx.alias("idx"), *E.CHANNELS)


def entries(palette: DataFrame) -> DataFrame:
    """Palettes as one row per image: an array of (idx, zone, q0..q3), at most 256 long."""
    e = F.struct("idx", E.zone_of().alias("zone"), *[c.alias(q) for c, q in zip(E.premultiplied(), Q)])
    return palette.groupBy("image_id").agg(F.sort_array(F.collect_list(e)).alias("entries"))


def closest(among, point: list = P):
    """Struct (d2, idx) of the nearest of some entries; ties take the lowest index; null of none."""
    return F.array_min(F.transform(among, lambda e: F.struct(E.distance(point, [e[q] for q in Q]).alias("d2"), e["idx"].alias("idx"))))


def served(points: DataFrame, palette: DataFrame, fallback: bool = False) -> DataFrame:
    """The points (image_id, zone, p0..p3 and whatever else) with idx and d2 of the nearest entry of
    their zone.

    Palettes come as one array per image, so neither points nor entries multiply.  A point whose zone
    has no entry keeps null; with ``fallback`` a visible one takes the nearest entry that isn't
    transparent, or any if all are; a transparent one never gains visibility.
    """
    both = points.join(entries(palette), "image_id", "left")
    found = closest(F.filter("entries", lambda e: e["zone"] == F.col("zone")))
    if fallback:
        seen = F.filter("entries", lambda e: e["zone"] != 0)
        found = F.when(found.isNotNull() | (F.col("zone") == 0), found).when(F.size(seen) > 0, closest(seen)).otherwise(closest(F.col("entries")))
    return both.withColumn("__m", found).select(*points.columns, F.col("__m.idx").alias("idx"), F.col("__m.d2").alias("d2"))


def nearest(points: DataFrame, palette: DataFrame, keys: list[str]) -> DataFrame:
    """For each point its keys, and idx and d2 of the nearest entry of its zone (null without one)."""
    return served(points, palette).select("image_id", *keys, "idx", "d2")


def nearest_with_fallback(points: DataFrame, palette: DataFrame, keys: list[str]) -> DataFrame:
    return served(points, palette, True).select("image_id", *keys, "idx", "d2")


def unmatched(assigned: DataFrame) -> DataFrame:
    """Points that no entry could take, per image; none where all is well."""
    return assigned.where("idx is null").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


def featured(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("zone", E.zone_of()).select("*", *E.premultiplied())


def colours(pixels: DataFrame) -> DataFrame:
    """Distinct colours with zone and premultiplied feature."""
    return featured(pixels.select("image_id", *E.CHANNELS).distinct())


def remap(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Index of every pixel by its own colour: no exchange of pixels but the join's by image."""
    return served(featured(pixels.select("image_id", "pos", "y", "x", *E.CHANNELS)), palette, True).select("image_id", "pos", "y", "x", "idx")


def remap_bins(pixels: DataFrame, bins: DataFrame, palette: DataFrame) -> DataFrame:
    """Index of every pixel by its bin: bins (from ``histogram``, with ``exact``) go to entries by their
    premultiplied means, pixels to bins by key."""
    keys = ["image_id", *H.KEY]
    points = H.bin_means(bins.withColumn("zone", E.zone_of(E.round_half_up("sa", "n"))))
    found = served(points, palette, True).select(*keys, "exact", "idx")
    mode = found.select("image_id", "exact").distinct()
    key = [F.when(F.col("exact"), F.col(c)).otherwise(k).alias(n) for c, k, n in zip(E.CHANNELS, E.coarse_key_of(*E.CHANNELS), H.KEY)]
    return pixels.join(mode, "image_id").select("image_id", "pos", "y", "x", *key).join(found.drop("exact"), keys, "left").select("image_id", "pos", "y", "x", "idx")


def colour_frequency(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels per entry, zeros kept, from counted colours (image_id, k0..k3, n): pixels aren't read again."""
    named = featured(colours.select("image_id", "n", *[F.col(k).alias(c) for k, c in zip(H.KEY, E.CHANNELS)]))
    n = served(named, palette, True).groupBy("image_id", "idx").agg(F.sum("n").alias("n"))
    return palette.select("image_id", "idx").join(n, ["image_id", "idx"], "left").select("image_id", "idx", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def frequency(assigned: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels per entry, zeros kept."""
    n = assigned.groupBy("image_id", "idx").agg(F.count(F.lit(1)).alias("n"))
    return palette.select("image_id", "idx").join(n, ["image_id", "idx"], "left").select("image_id", "idx", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def cleanup(assigned: DataFrame, palette: DataFrame) -> DataFrame:
    """Used entries, equal colours collapsed to the first used index, renumbered in order: idx to new_idx."""
    used = palette.join(assigned.select("image_id", "idx").distinct(), ["image_id", "idx"], "left_semi")
    first = F.min("idx").over(Window.partitionBy("image_id", *E.CHANNELS))
    return used.withColumn("first", first).select("image_id", "idx", *E.CHANNELS, (F.dense_rank().over(Window.partitionBy("image_id").orderBy("first")).cast("bigint") - 1).alias("new_idx"))


def refine_step(bins: DataFrame, palette: DataFrame) -> DataFrame:
    """One Lloyd step: the centroid of each entry's bins; entries without bins stay as they are."""
    sums = served(bins, palette).groupBy("image_id", "idx").agg(*[F.sum(s).alias(s) for s in ("n", "sa", "sar", "sag", "sab")])
    a = F.when(E.zone_of("a") == 2, 255).when(E.zone_of("a") == 0, 0).otherwise(E.round_half_up("sa", "n")).cast("bigint")
    moved = palette.join(sums, ["image_id", "idx"], "left")
    still = F.col("n").isNull() | (F.col("a") == 0)
    return moved.select("image_id", "idx", *[F.when(still, F.col(c)).otherwise(E.round_half_up(f"sa{c}", F.greatest("sa", F.lit(1)))).cast("bigint").alias(c) for c in "rgb"], F.when(still, F.col("a")).otherwise(a).alias("a"))


def worst_served(bins: DataFrame, palette: DataFrame) -> DataFrame:
    """Per zone the bin farthest from its entry (ties: lowest packed mean)."""
    best = F.min(F.struct((-F.col("d2")).alias("minus"), E.packed().alias("packed"), F.col("bin_ord"))).alias("m")
    return served(bins, palette).groupBy("image_id", "zone").agg(best).select("image_id", "zone", F.col("m.bin_ord").alias("bin_ord"), (-F.col("m.minus")).alias("d2"), F.col("m.packed").alias("packed"))


def slots(bins: DataFrame, reps: DataFrame, ladder: DataFrame) -> DataFrame:
    """Bins by nearest representative (plain RGB; ties: the first) and ladder level of their zone (ties:
    the lower), with the sums of each slot and the first bin in it.

    bins: means r, g, b, a with zone and sums; reps: image_id, rep, rr, rg, rb (at most 256 an image);
    ladder: image_id, level (at most 10).  A zone without a level takes the bin's own alpha.  The
    transparent bins are one slot, of representative -1 and level 0.
    """
    r = reps.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rep", "rr", "rg", "rb"))).alias("reps"))
    steps = ladder.groupBy("image_id").agg(F.sort_array(F.collect_list("level")).alias("levels"))
    both = bins.join(r, "image_id", "left").join(steps, "image_id", "left")
    rep = F.array_min(F.transform("reps", lambda e: F.struct(E.distance(["r", "g", "b"], [e["rr"], e["rg"], e["rb"]]).alias("d"), e["rep"].alias("rep"))))["rep"]
    level = F.array_min(F.transform(F.filter("levels", lambda x: E.zone_of(x) == F.col("zone")), lambda x: F.struct(F.abs(x - F.col("a")).alias("d"), x.alias("level"))))["level"]
    clear = F.col("zone") == 0
    keyed = both.select("image_id", "zone", "bin_ord", F.when(clear, -1).otherwise(rep).cast("bigint").alias("rep"), F.when(clear, 0).otherwise(F.coalesce(level, "a")).cast("bigint").alias("level"), *[s for s in H.SUMS if s in ("n", "sa", "sar", "sag", "sab")])
    return keyed.groupBy("image_id", "rep", "level").agg(F.min("zone").alias("zone"), *[F.sum(s).alias(s) for s in ("n", "sa", "sar", "sag", "sab")], F.min("bin_ord").alias("first_ord"))


def rank_slots(found: DataFrame) -> DataFrame:
    """Order in which slots become entries: the transparent one, the heaviest of each zone, then all
    others by mass; ties by packed centroid, then by first bin."""
    a = E.round_half_up("sa", "n")
    colour = [F.when(a == 0, 0).otherwise(E.round_half_up(f"sa{c}", F.greatest("sa", F.lit(1)))).cast("bigint").alias(c) for c in "rgb"]
    named = found.select("image_id", "rep", "level", "zone", "n", "first_ord", *colour, a.alias("a"))
    by = [F.desc("n"), E.packed(), "first_ord"]
    head = F.row_number().over(Window.partitionBy("image_id", "zone").orderBy(*by)) == 1
    placed = named.withColumn("head", head)
    first = F.when(F.col("head"), F.col("zone")).otherwise(3)
    return placed.select("*", (F.row_number().over(Window.partitionBy("image_id").orderBy(first, *by)).cast("bigint") - 1).alias("rank"))


def error_by_size(pixels: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """Sum of squared differences of each image under every size: entries of rank below k in their
    zone, for k from 1 to ``most``; one pass over the pixels.  ranked: image_id, rank, r, g, b, a."""
    e = F.struct("rank", E.zone_of().alias("zone"), *[c.alias(q) for c, q in zip(E.premultiplied(), Q)])
    held = ranked.groupBy("image_id").agg(F.sort_array(F.collect_list(e)).alias("entries"))
    seen = featured(pixels.select("image_id", *E.CHANNELS)).join(held, "image_id")
    far = lambda k: F.array_min(F.transform(F.filter("entries", lambda x: (x["zone"] == F.col("zone")) & (x["rank"] < k)), lambda x: E.distance(P, [x[q] for q in Q])))
    errors = [F.sum(far(k).cast("decimal(38,0)")).alias(f"e{k}") for k in range(1, most + 1)]
    wide = seen.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *errors)
    sizes = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"e{k}").alias("total")) for k in range(1, most + 1)]))
    return wide.select("image_id", "n", sizes.alias("s")).select("image_id", "n", "s.k", "s.total")


def squared_error(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sum of squared premultiplied differences and number of pixels per image, joined on position."""
    r = right.select("image_id", "pos", *[c.alias(q) for c, q in zip(E.premultiplied(), Q)])
    both = left.select("image_id", "pos", *E.premultiplied()).join(r, ["image_id", "pos"])
    return both.groupBy("image_id").agg(F.sum(E.distance(P, Q).cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))


def paint(assigned: DataFrame, palette: DataFrame) -> DataFrame:
    return assigned.join(palette, ["image_id", "idx"]).select("image_id", "pos", "y", "x", *E.CHANNELS)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pixels that aren't the same on both sides, or are missing on one."""
    r = right.select("image_id", "pos", *[F.col(c).alias(f"o_{c}") for c in E.CHANNELS])
    both = left.select("image_id", "pos", *E.CHANNELS).join(r, ["image_id", "pos"], "full_outer")
    same = F.lit(True)
    for c in E.CHANNELS:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    return both.where(~same).select("image_id", "pos")
