"""Region classes and dither directives.

Gradients and seeds are windows over rows and columns.  The whole classifier needs neighbours of
neighbours and stretches of one colour, so it is one function per image.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import DataError
from tessera.functions import expr as E
from tessera.functions.numbers import ratio
from tessera.operators import palette as K
from tessera.operators import raster

P = ["p0", "p1", "p2", "p3"]
#: Least step of a hard edge, its ratio to the step beyond, alpha of a shadow.
EDGE_STEP, EDGE_RATIO, SHADOW = 1020, 4, 64
#: Class, region, barrier, strength as a ratio.
DIRECTIVES = (
    ("transparent", "none", False, 0, 1), ("protected-exact", "none", True, 0, 1), ("flat", "none", False, 0, 1), ("hard-edge", "none", True, 0, 1),
    ("texture", "none", False, 0, 1), ("gradient-opaque", "dither", False, 1, 1), ("gradient-alpha", "dither", False, 3, 4), ("soft-shadow", "dither", False, 1, 2),
)
NAMES = [d[0] for d in DIRECTIVES]
BANDING, GRAIN = ("gradient-opaque", "gradient-alpha", "soft-shadow"), ("texture", "flat")


def along_row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("image_id", "x").orderBy("y")


#: Sides in the order of ties: left, right, up, down.
SIDES = (("on_left", along_row, 1), ("on_right", along_row, -1), ("above", along_column, 1), ("below", along_column, -1))


def _featured(pixels: DataFrame) -> DataFrame:
    here = pixels.select("image_id", "pos", "y", "x", *E.CHANNELS, E.zone_of().alias("zone"), *E.premultiplied())
    return here.withColumn("f", F.struct(*P, "zone", E.packed().alias("colour")))


def _neighbours(frame: DataFrame) -> DataFrame:
    return frame.select("*", *[F.lag("f", step).over(w()).alias(s) for s, w, step in SIDES])


def local_gradient(pixels: DataFrame) -> DataFrame:
    """Greatest squared feature distance to a side neighbour."""
    got = _neighbours(_featured(pixels))
    parts = [F.coalesce(E.distance([f"f.{p}" for p in P], [f"{s}.{p}" for p in P]), F.lit(0)) for s, _, _ in SIDES]
    return got.select("image_id", "pos", F.greatest(*parts).alias("gradient"))


def adaptive_strength(pixels: DataFrame, baseline: DataFrame) -> DataFrame:
    """Strength e / (e + g) of each pixel, unreduced; 0/1 where both are 0.  baseline: pos and d2."""
    got = local_gradient(pixels).join(baseline.select("image_id", "pos", F.col("d2").alias("e")), ["image_id", "pos"])
    total = F.col("e") + F.col("gradient")
    return got.select("image_id", "pos", F.when(total == 0, 0).otherwise(F.col("e")).cast("bigint").alias("num"), F.when(total == 0, 1).otherwise(total).cast("bigint").alias("den"))


def flat_seeds(pixels: DataFrame) -> DataFrame:
    """Whether all existing side neighbours have the pixel's very colour."""
    got = _neighbours(_featured(pixels))
    same = F.lit(True)
    for s, _, _ in SIDES:
        same = same & (F.col(s).isNull() | (F.col(f"{s}.colour") == F.col("f.colour")))
    return got.select("image_id", "pos", same.alias("seed"))


def _steps(f: np.ndarray) -> np.ndarray:
    """(4, h, w): greatest channel difference to each side; -1 beyond the border."""
    out = np.full((4, *f.shape[:2]), -1, np.int64)
    across, down = np.abs(f[:, 1:] - f[:, :-1]).max(-1), np.abs(f[1:] - f[:-1]).max(-1)
    out[0, :, 1:], out[1, :, :-1], out[2, 1:], out[3, :-1] = across, across, down, down
    return out


def _moved(v: np.ndarray, side: int, fill) -> np.ndarray:
    """What each pixel's neighbour on a side has."""
    out = np.full_like(v, fill)
    if side == 0:
        out[:, 1:] = v[:, :-1]
    elif side == 1:
        out[:, :-1] = v[:, 1:]
    elif side == 2:
        out[1:] = v[:-1]
    else:
        out[:-1] = v[1:]
    return out


def _stretches(colour: np.ndarray) -> np.ndarray:
    """A label for each 4-connected stretch of one colour.

    Runs of rows are joined downward: each takes the least label it touches, labels jump to their
    own labels, until nothing changes.
    """
    h, w = colour.shape
    new = np.ones((h, w), bool)
    new[:, 1:] = colour[:, 1:] != colour[:, :-1]
    run = (np.cumsum(new.ravel()) - 1).reshape(h, w)
    touch = colour[1:] == colour[:-1]
    a, b = run[:-1][touch], run[1:][touch]
    label = np.arange(run[-1, -1] + 1)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            far = label[label]
            if np.array_equal(far, label):
                break
            label = far
        if np.array_equal(label, before):
            return label[run]


def parts_of(rgba: np.ndarray, palette: np.ndarray) -> dict[str, np.ndarray]:
    """The classifier's tests of each pixel: transparent, protected, seed, flat, hard, rough."""
    c = rgba.astype(np.int64)
    f = K.feature(c)
    zones, kinds = K.zone(c[..., 3]), K.zone(palette[:, 3])
    for z in (1, 2):
        if (zones == z).any() and not (kinds == z).any():
            raise DataError("palette has no entry in the source pixel's alpha zone")
    colour, own = K.pack(c), K.pack(palette)
    # the features of visible colours differ where the colours do
    protected = np.isin(colour, own) & (zones != 0)
    free = (zones != 0) & ~protected
    steps = _steps(f)
    seed = np.ones(colour.shape, bool)
    boundary = np.zeros(colour.shape, bool)
    for side in range(4):
        there = steps[side] >= 0
        seed &= ~there | (_moved(colour, side, -1) == colour)
        boundary |= there & (_moved(zones, side, -1) != zones)
    label = _stretches(colour)
    flat = free & np.isin(label, np.unique(label[seed & free]))
    largest, toward = steps.max(0), steps.argmax(0)
    more = np.zeros(colour.shape, np.int64)
    facing = (1, 0, 3, 2)
    for side in range(4):
        here = np.delete(steps, side, 0).max(0)
        beyond = _moved(np.delete(steps, facing[side], 0).max(0), side, 0)
        more = np.where(toward == side, np.maximum(np.maximum(here, beyond), 0), more)
    hard = boundary | ((largest >= EDGE_STEP) & (more * EDGE_RATIO <= largest))
    rough = np.zeros(colour.shape, bool)
    if min(colour.shape) > 1:
        s = f[..., :3].sum(-1)
        across, down = np.sign(s[:, 1:] - s[:, :-1]), np.sign(s[1:] - s[:-1])
        at = (across[:-1] * across[1:] < 0) | (down[:, :-1] * down[:, 1:] < 0)
        rough = np.pad(at, ((0, 1), (0, 1)), mode="edge")
    return {"transparent": zones == 0, "protected": protected, "seed": seed, "flat": flat, "hard": hard, "rough": rough, "opaque": zones == 2, "shadow": c[..., 3] < SHADOW}


def classes_of(rgba: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Number (in the order of DIRECTIVES) of each pixel's class."""
    p = parts_of(rgba, palette)
    tests = [p["transparent"], p["protected"], p["flat"], p["hard"], p["rough"], p["opaque"], p["shadow"]]
    return np.select(tests, [NAMES.index(n) for n in ("transparent", "protected-exact", "flat", "hard-edge", "texture", "gradient-opaque", "soft-shadow")], NAMES.index("gradient-alpha"))


def gradient_of(rgba: np.ndarray) -> np.ndarray:
    """Greatest squared feature distance of each pixel to a side neighbour."""
    f = K.feature(rgba.astype(np.int64))
    out = np.zeros(rgba.shape[:2], np.int64)
    for axis in (0, 1):
        d = np.diff(f, axis=axis)
        d = (d * d).sum(-1)
        first, last = ((slice(None), slice(0, -1)), (slice(None), slice(1, None))) if axis else ((slice(0, -1),), (slice(1, None),))
        out[first] = np.maximum(out[first], d)
        out[last] = np.maximum(out[last], d)
    return out


def strength_of(classes: np.ndarray) -> tuple[int, int]:
    """Banding pixels to all that band or are grainy, in lowest terms; 0/1 without any."""
    n = np.bincount(classes.ravel(), minlength=len(NAMES)).tolist()
    banding, grain = (sum(n[NAMES.index(k)] for k in names) for names in (BANDING, GRAIN))
    return ratio(banding, banding + grain)


def _mapped(pixels: DataFrame, palette: DataFrame, out: str, of: Callable[[np.ndarray, np.ndarray], list[np.ndarray | pa.Array] | None], nothing: list) -> DataFrame:
    """Columns of each pixel by one function of its whole image; ``nothing`` where the palette can't serve it."""
    names = ["image_id", "pos", "y", "x", *(x.split(" ")[0] for x in out.split(", "))]

    def make(name: int, rows: pa.Table, entries: np.ndarray) -> pa.Table:
        rgba = raster.image_of(rows)
        h, w = rgba.shape[:2]
        pos = np.arange(h * w)
        try:
            made = of(rgba, entries)
        except DataError:
            made = [pa.nulls(h * w, k) for k in nothing]
        columns = [np.full(h * w, name), pos, pos // w, pos % w, *made]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    return raster.per_image(pixels, palette, ["y", "x", "r", "g", "b", "a"], "image_id bigint, pos bigint, y bigint, x bigint, " + out, make)


def classify(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Class of each pixel, by one function per image; null for images with a visible pixel whose alpha
    zone has no palette entry."""
    return _mapped(pixels, palette, "class string", lambda rgba, p: [pa.array(NAMES).take(pa.array(classes_of(rgba, p).ravel()))], [pa.string()])


def hard_edges(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Whether each pixel lies at a hard edge, whatever its class; null as in ``classify``."""
    return _mapped(pixels, palette, "hard boolean", lambda rgba, p: [parts_of(rgba, p)["hard"].ravel()], [pa.bool_()])


def directives(spark) -> DataFrame:
    return spark.createDataFrame(list(DIRECTIVES), "class string, region string, barrier boolean, num bigint, den bigint")


def direct(classes: DataFrame) -> DataFrame:
    """Directive of each pixel by its class; the table has eight rows."""
    return classes.join(F.broadcast(directives(classes.sparkSession)), "class").select("image_id", "pos", "region", "barrier", "num", "den")


def class_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("image_id", "class").agg(F.count(F.lit(1)).alias("n"))


def unit_strength(classes: DataFrame) -> DataFrame:
    """Banding pixels to all that band or are grainy, in lowest terms; 0/1 without any."""
    got = classes.groupBy("image_id").agg(*[F.sum(F.col("class").isin(*names).cast("bigint")).alias(k) for k, names in (("banding", BANDING), ("grain", GRAIN))])
    total, n = F.col("banding") + F.col("grain"), F.col("banding")
    # Euclid's steps: a count of pixels is below 2**37, so 55 halvings of the smaller part are enough
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(55)), F.struct(n.alias("a"), total.alias("b")), lambda p, _: F.struct(F.when(p["b"] == 0, p["a"]).otherwise(p["b"]).alias("a"), F.when(p["b"] == 0, p["b"]).otherwise(F.try_mod(p["a"], p["b"])).alias("b")))
    got = got.select("image_id", n.alias("n"), total.alias("total"), pair["a"].alias("g"))
    return got.select("image_id", F.when(F.col("n") == 0, 0).otherwise(E.div("n", F.greatest("g", F.lit(1)))).cast("bigint").alias("num"), F.when(F.col("n") == 0, 1).otherwise(E.div("total", F.greatest("g", F.lit(1)))).cast("bigint").alias("den"))
