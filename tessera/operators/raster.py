"""One whole image at a time, on numpy arrays: bins, palette, and indices, with notes on how.

An image is decoded, reduced and encoded inside one task, so nothing of it is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import DataError
from tessera.operators import histogram as H
from tessera.operators import oklab
from tessera.operators import palette as P

SPACES = ("srgb", "oklab")


@dataclass
class Bins:
    """Bins in key order, and each pixel's bin."""

    sums: dict[str, np.ndarray]
    keys: np.ndarray
    exact: bool
    own: np.ndarray


def coarse_keys(colours: np.ndarray) -> np.ndarray:
    a = colours[:, 3]
    alpha = np.where(a == 0, 0, np.where(a == 255, 15, 1 + (a - 1) * 14 // 254))
    return np.concatenate([colours[:, :3] * 16 // 256, alpha[:, None]], 1)


def bins(rgba: np.ndarray, limit: int = H.EXACT_LIMIT, lab: bool = False) -> Bins:
    """Bins of an (h, w, 4) image: its colours, or their coarse keys if there are more than ``limit``.

    ``lab`` adds the sums of Oklab features, pixel by pixel.
    """
    flat = np.ascontiguousarray(rgba.reshape(-1, 4)).view(">u4").ravel().astype(np.uint32)
    packed, own, n = np.unique(flat, return_inverse=True, return_counts=True)
    colours = np.stack([(packed >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)
    exact, at = len(packed) <= limit, np.arange(len(packed))
    keys = colours
    if not exact:
        keys, at = np.unique(coarse_keys(colours), axis=0, return_inverse=True)
        at = at.ravel()
    r, g, b, a = colours.T
    add = lambda x: np.bincount(at, x * n.astype(float), len(keys)).astype(np.int64)
    sums = {"n": add(np.ones(len(n))), "sr": add(r), "sg": add(g), "sb": add(b), "sa": add(a), "sar": add(a * r), "sag": add(a * g), "sab": add(a * b)}
    own = at[own].astype(np.int32)
    if lab:
        f, place = oklab.feature(colours), np.searchsorted(packed, flat)
        sums |= {k: np.bincount(own, f[place, i], len(keys)) for i, k in enumerate(oklab.FEATURES)}
    return Bins(sums, keys, exact, own)


@dataclass
class Notes:
    """What the stages did."""

    sampled_pixels: int
    initial_bins: int
    refined_palette_entries: int
    alpha_note: str
    exact_path: bool
    palette_init_pairs: int
    refinement_iterations: int
    hidden_rgb_policy: str


#: The two notes on transparency.
SOFT, SOLID = "alpha preserved via tRNS (extremes exact; interior quantized)", "source fully opaque; no tRNS emitted"


def candidate(rgba: np.ndarray, colours: int, space: str = "srgb", hidden: str = P.HIDDEN[0], limit: int = H.EXACT_LIMIT) -> tuple[np.ndarray, np.ndarray, Notes]:
    """Palette, index of every pixel (h, w) by its bin, and notes."""
    if not 1 <= colours <= 256:
        raise DataError("colours must be between 1 and 256")
    if space not in SPACES:
        raise DataError(f"unknown colour space {space}")
    got = bins(rgba, limit, space == "oklab")
    fitted = (oklab if space == "oklab" else P).fit(got.sums, colours, got.exact, hidden)
    indices = assign(got, fitted.palette, space)[got.own].reshape(rgba.shape[:2])
    note = SOFT if (rgba[..., 3] < 255).any() else SOLID
    notes = Notes(got.own.size, len(got.keys), len(fitted.palette), note, fitted.exact_path, fitted.pairs, fitted.rounds, hidden)
    return fitted.palette, indices, notes


def assign(got: Bins, palette: np.ndarray, space: str = "srgb") -> np.ndarray:
    """Each bin's entry."""
    s = got.sums
    zones, kinds = P.zone(P.half_up(s["sa"], s["n"])), P.zone(palette[:, 3])
    if space == "oklab":
        return P.serve(oklab.means(s), zones, oklab.feature(palette), kinds)[0]
    points = np.stack([P.half_up(s[f"sa{c}"], s["n"]) for c in "rgb"] + [P.half_up(255 * s["sa"], s["n"])], -1)
    return P.serve(points, zones, P.feature(palette), kinds)[0]


def squared_error(source: np.ndarray, painted: np.ndarray) -> int:
    """Sum of squared premultiplied differences."""
    total = 0
    a, b = source.reshape(-1, 4), painted.reshape(-1, 4)
    for lo in range(0, len(a), 1 << 20):
        d = P.feature(a[lo : lo + (1 << 20)].astype(np.int64)) - P.feature(b[lo : lo + (1 << 20)].astype(np.int64))
        total += int((d * d).sum())
    return total


def mse(source: np.ndarray, painted: np.ndarray) -> float:
    """Mean squared premultiplied difference, between 0 and 1."""
    return squared_error(source, painted) / (source.size // 4 * 4 * 255**4)


def checked(n: int, width: int, height: int) -> None:
    """An image has as many pixels as its sides say."""
    if width < 1 or height < 1 or width * height != n:
        raise DataError(f"{n} pixels don't fill {width} x {height}")


def image_of(rows: pa.Table, names: tuple[str, ...] = ("r", "g", "b", "a"), kind=np.uint8) -> np.ndarray:
    """Columns of pixel rows (y, x) as an array (h, w, columns), in the order of positions."""
    y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
    h, w = int(y.max()) + 1, int(x.max()) + 1
    checked(len(y), w, h)
    order = np.argsort(y * w + x, kind="stable")
    return np.stack([rows[c].to_numpy()[order].astype(kind) for c in names], -1).reshape(h, w, len(names))


def entries_of(rows: pa.Table) -> np.ndarray:
    """A palette's rows as an array in index order."""
    rows = rows.sort_by("idx")
    return np.stack([rows[c].to_numpy() for c in "rgba"], -1).astype(np.int64).reshape(-1, 4)


def per_image(pixels: DataFrame, palette: DataFrame, columns: list[str], out: str, make: Callable[[int, pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    """``make(image_id, pixel rows, palette)`` of each image that has pixels: one exchange by image.

    Rows that don't fill a rectangle are no image; they end the job.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table | None:
        return make(left["image_id"][0].as_py(), left, entries_of(right)) if left.num_rows else pa.table({k: [] for k in names}).cast(empty)

    names = [part.split(" ")[0] for part in out.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    empty = pa.schema([(n, kinds[part.split(" ")[1]]) for n, part in zip(names, out.split(", "))])
    # either side may come from the other: new names for the same columns keep them apart
    left, right = (f.select(*[F.col(c).alias(c) for c in ("image_id", *of)]) for f, of in ((pixels, columns), (palette, ("idx", "r", "g", "b", "a"))))
    return left.groupBy("image_id").cogroup(right.groupBy("image_id")).applyInArrow(work, out)
