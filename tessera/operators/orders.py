"""Palette orders and index rows as windows and grouped sums; row filters value by value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.operators import pack


def ranked(palette: DataFrame, *keys) -> DataFrame:
    """new_idx of each entry under the given keys; ties by index."""
    return palette.select("image_id", "idx", (F.row_number().over(Window.partitionBy("image_id").orderBy(*keys, "idx")).cast("bigint") - 1).alias("new_idx"))


def by_frequency(palette: DataFrame, counts: DataFrame) -> DataFrame:
    return ranked(palette.join(counts, ["image_id", "idx"]), F.desc("n"))


def by_luminance(palette: DataFrame) -> DataFrame:
    return ranked(palette, E.luminance())


def by_channels(palette: DataFrame) -> DataFrame:
    return ranked(palette, *E.CHANNELS)


def alpha_first(palette: DataFrame) -> DataFrame:
    return ranked(palette, F.col("a") == 255, "a")


def alpha_frequency(palette: DataFrame, counts: DataFrame) -> DataFrame:
    """Non-opaque entries by frequency and alpha, then opaque ones by frequency."""
    return ranked(palette.join(counts, ["image_id", "idx"]), F.col("a") == 255, F.desc("n"), F.when(F.col("a") != 255, F.col("a")))


def transparent_front(palette: DataFrame) -> DataFrame:
    """The one transparent entry first, for images whose only non-opaque entry it is; others have no row."""
    one = Window.partitionBy("image_id")
    marked = palette.withColumn("soft", F.sum((F.col("a") != 255).cast("bigint")).over(one)).withColumn("clear", F.sum((F.col("a") == 0).cast("bigint")).over(one))
    return ranked(marked.where("soft = 1 and clear = 1"), F.col("a") != 0)


def adjacency(assigned: DataFrame) -> DataFrame:
    """How often two different entries touch to the right or below, both ways."""
    right = F.lead("idx").over(Window.partitionBy("image_id", "y").orderBy("x"))
    below = F.lead("idx").over(Window.partitionBy("image_id", "x").orderBy("y"))
    sides = assigned.select("image_id", "idx", right.alias("on_right"), below.alias("below"))
    pairs = sides.select("image_id", "idx", F.explode(F.array("on_right", "below")).alias("other")).where("other <> idx")
    both = pairs.select("image_id", F.explode(F.array(F.struct(F.col("idx").alias("i"), F.col("other").alias("j")), F.struct(F.col("other").alias("i"), F.col("idx").alias("j")))).alias("e"))
    return both.groupBy("image_id", F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.count(F.lit(1)).alias("n"))


def byte_neighbours(assigned: DataFrame, depth: int) -> DataFrame:
    """How often two different entries share a packed byte, both ways."""
    keyed = assigned.select("image_id", "y", "x", "idx", E.div("x", F.lit(8 // depth)).alias("byte"))
    other = keyed.select("image_id", "y", "byte", F.col("x").alias("x2"), F.col("idx").alias("j"))
    pairs = keyed.withColumnRenamed("idx", "i").join(other, ["image_id", "y", "byte"]).where("x <> x2 and i <> j")
    return pairs.groupBy("image_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def packed_rows(assigned: DataFrame, depth: int) -> DataFrame:
    """Bytes of index rows, most significant bits first, zero padded."""
    per = 8 // depth
    shift = F.pow(F.lit(2.0), (per - 1 - F.col("x") % per) * depth).cast("bigint")
    return assigned.groupBy("image_id", "y", E.div("x", F.lit(per)).alias("x")).agg(F.sum(F.col("idx") * shift).alias("v"))


def _lines(images: DataFrame, column: str, width: int, schema: str, make) -> DataFrame:
    """Columns that ``make(name, filtered)`` gives of each binary value as rows of ``width`` bytes, the
    last one padded with zeros; ``filtered`` is (5, rows, width).  No exchange: a value has its rows."""
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(body or b"", np.uint8)
                for lo, rows, above in _parts(raw, width):
                    made = make(name, lo, pack.all_filters(rows, above), len(raw))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=names)

    return images.select("image_id", F.col(column)).mapInArrow(run, schema)


def _parts(raw: np.ndarray, width: int, most: int = 4096):
    """A value's rows, ``most`` at a time, with the row above each part."""
    n = -(-len(raw) // width)
    rows = np.zeros((n, width), np.uint8)
    rows.ravel()[: len(raw)] = raw
    for lo in range(0, n, most):
        yield lo, rows[lo : lo + most], rows[lo - 1] if lo else np.zeros(width, np.uint8)


def filtered(images: DataFrame, column: str, width: int) -> DataFrame:
    """Every row under each of the five row filters: y, filter, f (the bytes that the value has there)."""

    def make(name: int, lo: int, every: np.ndarray, size: int):
        k, n, _ = every.shape
        y = np.repeat(np.arange(lo, lo + n), k)
        f = [every[j, i].astype(np.uint8).tobytes()[: max(0, size - (lo + i) * width)] for i in range(n) for j in range(k)]
        return np.full(k * n, name), y, np.tile(np.arange(k), n), pa.array(f, pa.binary())

    return _lines(images, column, width, "image_id bigint, y bigint, filter bigint, f binary", make)


def _scored(every: np.ndarray, lo: int, size: int) -> np.ndarray:
    """(5, rows): sum of residuals over the bytes that the value has."""
    _, n, width = every.shape
    there = (np.arange(lo, lo + n) * width)[:, None] + np.arange(width) < size
    return (np.where(every < 128, every, 256 - every) * there).sum(2)


def scores(images: DataFrame, column: str, width: int) -> DataFrame:
    def make(name: int, lo: int, every: np.ndarray, size: int):
        found = _scored(every, lo, size)
        k, n = found.shape
        return np.full(k * n, name), np.repeat(np.arange(lo, lo + n), k), np.tile(np.arange(k), n), found.T.ravel()

    return _lines(images, column, width, "image_id bigint, y bigint, filter bigint, score bigint", make)


def best_filters(images: DataFrame, column: str, width: int) -> DataFrame:
    """The filter of least residual for each row; ties take the lowest."""

    def make(name: int, lo: int, every: np.ndarray, size: int):
        found = _scored(every, lo, size)
        return np.full(found.shape[1], name), np.arange(lo, lo + found.shape[1]), found.argmin(0), found.min(0)

    return _lines(images, column, width, "image_id bigint, y bigint, filter bigint, score bigint", make)


def smallest(variants: DataFrame) -> DataFrame:
    """The shortest variant of each image; ties take the first generated."""
    best = F.min(F.struct("len", "gen")).alias("m")
    return variants.groupBy("image_id").agg(best).select("image_id", F.col("m.gen").alias("gen"), F.col("m.len").alias("len"))


def finalists(variants: DataFrame, most: int = 3) -> DataFrame:
    """Variants in order of (len, gen), the first of each palette, at most ``most`` an image."""
    first = F.row_number().over(Window.partitionBy("image_id", "palette").orderBy("len", "gen"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("len", "gen"))
    return variants.withColumn("f", first).where("f = 1").withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most).select("image_id", "palette", "gen", "len", "rank")


def never_worse(results: DataFrame) -> DataFrame:
    """The input where the result isn't shorter (a tie takes the input)."""
    kept = F.col("bytes_out") < F.col("bytes_in")
    return results.select("image_id", F.when(kept, F.col("bytes_out")).otherwise(F.col("bytes_in")).alias("bytes"), (~kept).alias("fallback"))
