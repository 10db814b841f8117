"""Registered queries: pixel operators over relations derived from the tables, and their SQL.

Two relations of pixels: one image per hundred vectors (16 pixels a row, a row per vector), and
scenes, which add drawn images with few colours, flat stretches, ramps, shadows and transparency.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.operators import assign, dither, orders, pack, palette, raster, regions, search
from tessera.operators import histogram as H
from tessera.plans.oracles import DRAWN, ORACLES, SCENES
from tessera.plans.quantize import Options, ceiling, quantize
from tessera.sources import png

__all__ = ["ORACLES", "QUERIES", "flagship"]

LIMIT, CAP, PER_ZONE, QUALITY, WIDTH = 1000, 256, 8, 60.0, 32
Source = Callable[[SparkSession, str], DataFrame]


def pixels(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(E.div("vec_id", F.lit(100)).alias("image_id"), (F.col("vec_id") % 100).alias("y"), "label", "embedding")
    wide = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
    level = lambda k: F.floor((F.element_at("embedding", (4 * F.col("x") + k + 1).cast("int")).cast("double") + 1.0) * 128).cast("bigint")
    a = F.when(F.col("label") < 2, 0).when(F.col("label") < 5, 255).otherwise(level(3)).cast("bigint")
    return wide.select("image_id", (F.col("y") * 16 + F.col("x")).alias("pos"), "y", "x", level(0).alias("r"), level(1).alias("g"), level(2).alias("b"), a.alias("a"))


def drawn(spark: SparkSession, d: str) -> DataFrame:
    """One image per 48 parts, a row per part."""
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey div 48 as m", "p_partkey % 48 as y")
    wide = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
    by_kind = lambda i: "cast(case m % 8 " + " ".join(f"when {k} then {kind[i].replace('//', 'div')}" for k, kind in enumerate(DRAWN)) + " end as bigint)"
    return wide.selectExpr("m + 1000000 as image_id", "y * 16 + x as pos", "y", "x", *[f"{by_kind(i)} as {c}" for i, c in enumerate("rgba")])


def scenes(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).unionByName(drawn(spark, d))


def coarse(px: DataFrame) -> DataFrame:
    return H.finalise(H.coarse_bins(px))


def pal(px: DataFrame) -> DataFrame:
    return assign.seed_palette(coarse(px), PER_ZONE)


def assigned(px: DataFrame) -> DataFrame:
    return assign.remap(px, pal(px))


def indexed(px: DataFrame) -> DataFrame:
    p = pal(px)
    return pack.indexed(assign.remap(px, p), p)


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages as bytes, for the filters."""
    return spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("image_id"), F.col("html").cast("binary").alias("body"))


def variant_table(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select((F.col("o_custkey") % 200).alias("image_id"), F.col("o_orderkey").alias("gen"), F.col("o_orderpriority").alias("palette"), F.floor(F.col("o_totalprice") / 100).cast("bigint").alias("len"))


def noise_mask(spark: SparkSession) -> DataFrame:
    rows = spark.range(3 * 64).select(E.div("id", F.lit(64)).alias("channel"), E.div(F.col("id") % 64, F.lit(8)).alias("my"), (F.col("id") % 8).alias("mx"))
    rank = (F.col("my") * 37 + F.col("mx") * 11 + F.col("channel") * 23 + F.col("my") * F.col("mx")) % 64
    return rows.select("channel", "my", "mx", ((rank.cast("double") + 0.5) / 64.0 - 0.5).alias("noise"))


def headers(spark: SparkSession, d: str) -> DataFrame:
    """Image headers derived from parts."""
    p = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    return p.select(k.alias("image_id"), (k * 37 % 40000).alias("width"), (F.col("p_size") * 811 % 36000).cast("bigint").alias("height"), F.element_at(F.array(*map(F.lit, (1, 2, 4, 8, 16, 3))), (k % 6 + 1).cast("int")).cast("bigint").alias("depth"), (k % 8).alias("color_type"), (k % 3).alias("interlace"))


def _samples():
    return F.when(F.col("color_type").isin(0, 3), 1).when(F.col("color_type") == 2, 3).when(F.col("color_type") == 4, 2).when(F.col("color_type") == 6, 4)


def valid_headers(spark, d):
    deep = F.col("depth")
    ok = F.when(F.col("color_type") == 0, deep.isin(1, 2, 4, 8, 16)).when(F.col("color_type") == 3, deep.isin(1, 2, 4, 8)).when(F.col("color_type").isin(2, 4, 6), deep.isin(8, 16)).otherwise(False)
    reason = F.when((F.col("width") < 1) | (F.col("height") < 1), "dimensions").when(_samples().isNull(), "colour type").when(~ok, "bit depth").when(F.col("interlace") > 1, "interlace").otherwise("ok")
    return headers(spark, d).withColumn("verdict", reason)


def geometry(spark, d):
    passes = spark.createDataFrame([(0, 0, 0, 8, 8), (1, 4, 0, 8, 8), (2, 0, 4, 4, 8), (3, 2, 0, 4, 4), (4, 0, 2, 2, 4), (5, 1, 0, 2, 2), (6, 0, 1, 1, 2)], "pass bigint, x0 bigint, y0 bigint, dx bigint, dy bigint")
    h = valid_headers(spark, d).where("verdict = 'ok'")
    laced = h.where("interlace = 1").join(F.broadcast(passes)).unionByName(h.where("interlace = 0").select("*", *[F.lit(v).cast("bigint").alias(n) for n, v in (("pass", 0), ("x0", 0), ("y0", 0), ("dx", 1), ("dy", 1))]))
    size = lambda whole, start, step: E.div(F.greatest(F.col(whole) - F.col(start), F.lit(0)) + F.col(step) - 1, F.col(step))
    got = laced.withColumn("columns", size("width", "x0", "dx")).withColumn("rows", size("height", "y0", "dy")).where("columns > 0 and rows > 0")
    return got.withColumn("row_bytes", E.div(F.col("columns") * F.col("depth") * _samples() + 7, F.lit(8)))


def limits(spark, d):
    g = geometry(spark, d).groupBy("image_id", "width", "height").agg(F.sum(F.col("rows") * (1 + F.col("row_bytes"))).alias("scan"))
    most = 64 << 20
    why = F.when((F.col("width") > 32768) | (F.col("height") > 32768), "dimension").when(F.col("width") * F.col("height") > most, "pixels").when(F.col("scan") > most * 8, "scanlines").otherwise("ok")
    return g.select("image_id", "scan", why.alias("verdict"))


def framed(spark: SparkSession, d: str) -> DataFrame:
    """Pages as chunks: length, kind, body and checksum."""
    four = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    body, kind = F.coalesce(F.col("html"), F.lit("")).cast("binary"), F.lit("tEXt").cast("binary")
    crc = F.crc32(F.concat(kind, body))
    whole = F.concat(four(F.octet_length(body).cast("bigint")), kind, body, four(crc))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", crc.alias("crc"), F.sha2(whole, 256).alias("sha"), F.length(whole).cast("bigint").alias("n"))


def report(spark: SparkSession, d: str) -> DataFrame:
    """The seven fields for each image's shortest variant, against half its mean length."""
    v = variant_table(spark, d)
    size = v.groupBy("image_id").agg(E.div(F.sum("len"), 2 * F.count(F.lit(1))).alias("bytes_in"), F.count_distinct("palette").alias("palette_size"))
    best = orders.smallest(v).join(size, "image_id").select("image_id", "bytes_in", F.col("len").alias("bytes_out"), "palette_size")
    kept = orders.never_worse(best).join(best.select("image_id", "bytes_in", "palette_size"), "image_id")
    candidate = F.when(F.col("fallback"), "input-verbatim").otherwise("encoded")
    held = F.struct(F.lit("tessera.report/1").alias("schema_version"), "bytes_in", F.col("bytes").alias("bytes_out"), "palette_size", candidate.alias("candidate"), F.lit("guarded").alias("guard"), F.col("fallback").alias("never_worse_fallback"))
    return kept.select("image_id", F.to_json(held).alias("report"))


def fewest(px: DataFrame) -> DataFrame:
    """Fewest entries per zone whose mean squared error stays under a quality's ceiling, every number
    from 1 to 8 tried in one pass; else the most, marked as fallback."""
    p = pal(px).withColumn("zone", E.zone_of())
    ranked = p.select("image_id", (F.row_number().over(Window.partitionBy("image_id", "zone").orderBy("idx")) - 1).alias("rank"), *E.CHANNELS)
    mse = F.col("total").cast("double") / (F.col("n") * 4 * 255**4).cast("double")
    tried = assign.error_by_size(px, ranked, PER_ZONE).withColumn("passes", mse <= ceiling(QUALITY))
    return tried.groupBy("image_id").agg(F.coalesce(F.min(F.when(F.col("passes"), F.col("k"))), F.max("k")).alias("k"), (~F.bool_or("passes")).alias("fallback"))


def ladder(bins: DataFrame) -> DataFrame:
    """Ends that occur, and the quantile seeds between them."""
    mass = H.alpha_mass(bins)
    return mass.where("alpha in (0, 255)").select("image_id", "alpha").unionByName(H.quantile_seeds(mass)).select("image_id", F.col("alpha").alias("level"))


def slots(px: DataFrame) -> DataFrame:
    reps = pal(px).where("a > 0").select("image_id", F.col("idx").alias("rep"), F.col("r").alias("rr"), F.col("g").alias("rg"), F.col("b").alias("rb"))
    b = coarse(px)
    return assign.slots(H.bin_means(b).drop("p0", "p1", "p2", "p3"), reps, ladder(b))


def fitted(px: DataFrame) -> DataFrame:
    return palette.fit_palettes(H.histogram(px), 32)


def diffused(px: DataFrame) -> DataFrame:
    p = pal(px)
    return dither.floyd_steinberg(px, p, regions.direct(regions.classify(px, p)))


def strengths(px: DataFrame) -> DataFrame:
    base = assign.served(assign.featured(px), pal(px)).select("image_id", "pos", "d2")
    return regions.adaptive_strength(px, base)


def candidates(px: DataFrame) -> DataFrame:
    return orders.smallest(pack.pack_images(indexed(px), pack.ORDERS + pack.MORE_ORDERS, pack.FILTERS))


def files(px: DataFrame) -> DataFrame:
    """The images as baseline files."""
    made = pack.encoded(indexed(px), lambda idx, colours, _: [(0, "", "", pack.write_indexed(idx, colours))])
    return made.select("image_id", F.col("bytes").alias("content"))


def _rows(images: DataFrame, schema: str, of: Callable[[int, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """Rows that a function makes of each indexed image."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                idx = np.frombuffer(r["indices"], np.uint8).reshape(r["height"], r["width"]).astype(np.int64)
                made = of(r["image_id"], idx, np.frombuffer(r["palette"], np.uint8).reshape(-1, 4).astype(np.int64))
                yield pa.RecordBatch.from_pylist([dict(zip(names, m)) for m in made], schema=kinds)

    simple = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    kinds = pa.schema([(n, simple[f.split(" ")[1]]) for n, f in zip(names, schema.split(", "))])
    return images.mapInArrow(run, schema)


def round_trip(px: DataFrame) -> DataFrame:
    """Pixels and digest of each image after it was written, filtered, and read again."""

    def of(name: int, idx: np.ndarray, colours: np.ndarray) -> list[tuple]:
        back = png.decode(pack.encode(idx, colours, "residual")).rgba
        return [(name, back.size // 4, hashlib.sha256(back.tobytes()).hexdigest())]

    return _rows(indexed(px), "image_id bigint, n bigint, sha string", of)


def trial(px: DataFrame) -> DataFrame:
    """Row filters that trial compression chooses."""
    return _rows(indexed(px), "image_id bigint, filters array<bigint>", lambda name, idx, p: [(name, pack.trial(pack.all_filters(pack.packed_rows(idx, pack.depth_for(len(p))))))])


def greedy(px: DataFrame) -> DataFrame:
    """Orders by chains: old index at each new place."""
    chains = ("color-locality", "spatial-adjacency", "alpha-color-locality", "alpha-spatial-adjacency", "packed-frequency")
    return _rows(indexed(px), "image_id bigint, strategy string, old array<bigint>", lambda name, idx, p: [(name, o, pack.order(o, p, idx)) for o in chains])


def oklab_fitted(px: DataFrame) -> DataFrame:
    """Palettes in the Oklab space, an image at a time."""
    return _oklab(px, "image_id bigint, idx bigint, r bigint, g bigint, b bigint, a bigint", lambda name, p, idx: [np.full(len(p), name), np.arange(len(p)), *p.T])


def oklab_assigned(px: DataFrame) -> DataFrame:
    return _oklab(px, "image_id bigint, pos bigint, idx bigint", lambda name, p, idx: [np.full(idx.size, name), np.arange(idx.size), idx.ravel()])


def _oklab(px: DataFrame, schema: str, columns) -> DataFrame:
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def work(rows: pa.Table) -> pa.Table:
        p, idx, _ = raster.candidate(raster.image_of(rows), 32, "oklab", limit=LIMIT)
        return pa.table([pa.array(c, pa.int64()) for c in columns(rows["image_id"][0].as_py(), p, idx)], names=names)

    return px.select("image_id", "y", "x", *E.CHANNELS).groupBy("image_id").applyInArrow(work, schema)


def counted(px: DataFrame) -> DataFrame:
    return assign.colour_frequency(H.exact_bins(px), pal(px))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Pixels to bins, a palette from the heaviest bins, nearest entries, and their frequencies."""
    return counted(pixels(spark, d))


def served_by_soft(px: DataFrame) -> DataFrame:
    """Colours to the nearest entry that isn't opaque, in another zone if need be; -1 where there is none."""
    found = assign.nearest_with_fallback(assign.colours(px), pal(px).where("a <> 255"), list(E.CHANNELS))
    return found.withColumns({c: F.coalesce(c, F.lit(-1).cast("bigint")) for c in ("idx", "d2")})


def _pre(px: DataFrame) -> DataFrame:
    return px.select("image_id", "pos", *E.premultiplied(), E.packed().alias("packed"))


#: Queries on a relation of pixels.
ON_PIXELS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "pixel_relation": lambda px: px,
    "zone_counts": H.zone_counts,
    "guard_predicate": H.guard,
    "premult_features": _pre,
    "exact_histogram": lambda px: H.finalise(H.exact_bins(px)),
    "preclip_histogram": coarse,
    "mode_switch": lambda px: H.finalise(H.histogram(px, LIMIT)),
    "bin_means": lambda px: H.bin_means(coarse(px)).select("image_id", "bin_ord", *E.CHANNELS, "p0", "p1", "p2", "p3"),
    "zone_centroids": lambda px: H.centroids(coarse(px), ["image_id", "zone"]),
    "alpha_mass": lambda px: H.alpha_mass(coarse(px)),
    "alpha_quantile_seeds": lambda px: H.quantile_seeds(H.alpha_mass(coarse(px))),
    "stride_sample": lambda px: H.stride_sample(coarse(px), 100).select("image_id", "bin_ord", "n"),
    "distinct_zones": lambda px: px.select("image_id", E.zone_of().alias("zone")).distinct(),
    "seed_palette": pal,
    "nearest_entry_zone": lambda px: assign.nearest(assign.colours(px), pal(px), list(E.CHANNELS)),
    "nearest_with_fallback": served_by_soft,
    "remap_join": assigned,
    "remap_bins": lambda px: assign.remap_bins(px, H.histogram(px, LIMIT), pal(px)),
    "palette_frequency": counted,
    "palette_cleanup": lambda px: assign.cleanup(assigned(px), pal(px)),
    "refine_one_step": lambda px: assign.refine_step(H.bin_means(coarse(px)).drop(*E.CHANNELS), pal(px)),
    "worst_served": lambda px: assign.worst_served(H.bin_means(coarse(px)), pal(px)),
    "slot_cooccurrence": slots,
    "rank_slots": lambda px: assign.rank_slots(slots(px)),
    "local_gradient": regions.local_gradient,
    "adaptive_strength": strengths,
    "flat_seeds": regions.flat_seeds,
    "hard_edge": lambda px: regions.hard_edges(px, pal(px)).select("image_id", "pos", "hard"),
    "region_classes": lambda px: regions.classify(px, pal(px)).select("image_id", "pos", "class"),
    "region_directives": lambda px: regions.direct(regions.classify(px, pal(px))),
    "class_counts": lambda px: regions.class_counts(regions.classify(px, pal(px))),
    "unit_strength": lambda px: regions.unit_strength(regions.classify(px, pal(px))),
    "bit_packing": lambda px: orders.packed_rows(assigned(px).withColumn("idx", F.col("idx") % 16), 4),
    "order_frequency": lambda px: orders.by_frequency(pal(px), counted(px)),
    "order_luminance": lambda px: orders.by_luminance(pal(px)),
    "order_channel": lambda px: orders.by_channels(pal(px)),
    "order_alpha_first": lambda px: orders.alpha_first(pal(px)),
    "order_alpha_frequency": lambda px: orders.alpha_frequency(pal(px), counted(px)),
    "order_transparent_front": lambda px: orders.transparent_front(pal(px)),
    "spatial_adjacency": lambda px: orders.adjacency(assigned(px)),
    "byte_cooccurrence": lambda px: orders.byte_neighbours(assigned(px), 4),
    "mse": lambda px: assign.squared_error(px, assign.paint(assigned(px), pal(px))).select("image_id", F.col("total").cast("bigint").alias("total"), "n"),
    "fewest_colors": fewest,
    "identity_check": lambda px: assign.differences(px, assign.paint(assigned(px), pal(px))),
    "png_roundtrip": round_trip,
    "trial_deflate": trial,
    "greedy_orders": greedy,
    "fs_dither": diffused,
    "palette_fit": fitted,
    "pack_search": candidates,
    "pack_search_wide": lambda px: orders.smallest(search.search_images(indexed(px))),
    "seam_search": lambda px: search.seam_images(indexed(px), memory=True),
    "quantize_files": lambda px: quantize(files(px), Options(colours=32, adaptive="off")).drop("content"),
    "quantize_files_dithered": lambda px: quantize(files(px), Options(colours=32)).drop("content"),
    "oklab_palette": oklab_fitted,
    "oklab_remap": oklab_assigned,
}


def _on(source: Source, f: Callable[[DataFrame], DataFrame]) -> Source:
    return lambda spark, d: f(source(spark, d))


QUERIES: dict[str, Source] = {
    **{name: _on(pixels, f) for name, f in ON_PIXELS.items()},
    **{f"scene_{name}": _on(scenes, ON_PIXELS[name]) for name in SCENES},
    "bluenoise_remap": lambda s, d: dither.ordered_remap(pixels(s, d), pal(pixels(s, d)), noise_mask(s), 24),
    "row_filters": lambda s, d: orders.filtered(pages(s, d), "body", WIDTH).withColumn("f", F.hex("f")),
    "filter_residual": lambda s, d: orders.scores(pages(s, d), "body", WIDTH),
    "best_filter": lambda s, d: orders.best_filters(pages(s, d), "body", WIDTH),
    "best_variant": lambda s, d: orders.smallest(variant_table(s, d)),
    "finalists": lambda s, d: orders.finalists(variant_table(s, d)),
    "never_worse": lambda s, d: orders.never_worse(orders.smallest(variant_table(s, d)).select("image_id", F.lit(30).cast("bigint").alias("bytes_in"), F.col("len").alias("bytes_out"))),
    "header_validation": valid_headers,
    "adam7_geometry": lambda s, d: geometry(s, d).select("image_id", "pass", "columns", "rows", "row_bytes"),
    "resource_limits": limits,
    "chunk_framing": framed,
    "json_report": report,
}
