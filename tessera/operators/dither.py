"""Dithering: a relational ordered remap, and error diffusion as one function per image."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import DataError, InternalError, IoError
from tessera.functions import expr as E
from tessera.operators import assign, raster
from tessera.operators import palette as P

#: Forward offsets and weights of the diffusion kernel, over 16; the shares of a channel's
#: own noise and of the common one; the greatest feature; sides of the published masks.
KERNEL = ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1))
OWN, SHARED, MOST, SIDE = 0.25, 0.75, 65025, 64
#: Seed and SHA-256 of the published mask of each channel.
MASKS = (
    (20260719, "8ee801878fd37cc52fbb2993fa4d7c5b4ace02f2fccc04a0c28dabf13111b0d8"),
    (20260720, "80aba5e8dc5cbef7b1c04acfc3e3b0d6193375a74ef007cf8a26d604ae2522cc"),
    (20260721, "cb2706b65c956f52369fd05ccb0c73fef52774c185cb39fffa7ff8dc79258139"),
)
#: Parameters of the void-and-cluster method for masks made here.
SIGMA, RADIUS, ONES = 1.5, 5, 0.1
NO_ENTRY = "palette has no entry in the source pixel's alpha zone"
CACHED = 500_000


# -- masks --------------------------------------------------------------------------------------


def read_mask(raw: bytes, seed: int, digest: str) -> np.ndarray:
    """A published mask file: its digest, seed and number of ranks tested."""
    if (found := hashlib.sha256(raw).hexdigest()) != digest:
        raise InternalError(f"mask of seed {seed} has SHA-256 {found}, not {digest}")
    got = json.loads(raw)
    if got.get("seed") != seed or len(got.get("ranks_row_major", ())) != SIDE * SIDE:
        raise InternalError(f"mask of seed {seed} has another seed or shape")
    return np.array(got["ranks_row_major"], np.int64).reshape(SIDE, SIDE)


def read_masks(paths: Sequence[str]) -> np.ndarray:
    """The published masks of red, green and blue as ranks (3, 64, 64)."""
    try:
        return np.stack([read_mask(Path(p).read_bytes(), *spec) for p, spec in zip(paths, MASKS, strict=True)])
    except OSError as e:
        raise IoError(f"cannot read {e.filename}: {e.strerror}") from None


@lru_cache(maxsize=8)
def void_and_cluster(seed: int, side: int = SIDE) -> np.ndarray:
    """Ranks of a square mask by the void-and-cluster method on a torus.

    A tenth of the cells, chosen at random, is evened out by moving the tightest one to the largest
    void until that changes nothing.  Ranks fall from there as tightest cells go, and rise as largest
    voids fill.
    """
    n = side * side
    d = np.arange(-RADIUS, RADIUS + 1)
    bump = np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (2 * SIGMA**2))
    on, energy = np.zeros((side, side), bool), np.zeros((side, side))

    def flip(cell: int) -> None:
        y, x = divmod(cell, side)
        sign = -1.0 if on[y, x] else 1.0
        on[y, x] = not on[y, x]
        energy[np.ix_((y + d) % side, (x + d) % side)] += sign * bump

    def tightest() -> int:
        return int(np.where(on, energy, -np.inf).argmax())

    def largest_void() -> int:
        return int(np.where(on, np.inf, energy).argmin())

    for cell in np.random.default_rng(seed).permutation(n)[: max(1, int(n * ONES))].tolist():
        flip(cell)
    for _ in range(n):
        out = tightest()
        flip(out)
        gap = largest_void()
        flip(gap)
        if gap == out:
            break
    start_on, start_energy, count = on.copy(), energy.copy(), int(on.sum())
    ranks = np.zeros((side, side), np.int64)
    for rank in range(count - 1, -1, -1):
        cell = tightest()
        flip(cell)
        ranks.flat[cell] = rank
    on[:], energy[:] = start_on, start_energy
    for rank in range(count, n):
        cell = largest_void()
        flip(cell)
        ranks.flat[cell] = rank
    return ranks


def own_masks() -> np.ndarray:
    """Masks of the three channels made here, with the published seeds; ranks differ from the published ones."""
    return np.stack([void_and_cluster(seed) for seed, _ in MASKS])


# -- ordered dithering --------------------------------------------------------------------------


def noise_of(ranks: np.ndarray) -> np.ndarray:
    """Ranks of a mask as noise between -1/2 and 1/2."""
    return (ranks.astype(float) + 0.5) / float(ranks[0].size) - 0.5


def amplitude(colours: int) -> float:
    return 255.0 / float(colours) ** (1.0 / 3.0)


def ordered(rgba: np.ndarray, palette: np.ndarray, ranks: np.ndarray, colours: int, num: int = 1, den: int = 1) -> np.ndarray:
    """Index of every pixel: noise on each channel, mostly common to the three, times alpha, rounded
    with ties to even, clamped; then the nearest entry of the zone."""
    if not 1 <= colours <= 256:
        raise DataError("colours must be between 1 and 256")
    if den <= 0 or num < 0:
        raise DataError("strength must be a nonnegative ratio")
    h, w = rgba.shape[:2]
    noise, scale = noise_of(ranks) * amplitude(colours), float(num) / float(den)
    luma = (noise[0] + noise[1] + noise[2]) / 3.0
    out = np.empty((h, w), np.int64)
    kinds, entries = P.zone(palette[:, 3]), P.feature(palette)
    for y in range(h):
        row = rgba[y].astype(np.int64)
        at = np.arange(w) % ranks.shape[2]
        line = y % ranks.shape[1]
        parts = [np.clip(np.rint((row[:, c] + scale * (OWN * noise[c, line, at] + SHARED * luma[line, at])) * row[:, 3]), 0, MOST).astype(np.int64) for c in range(3)]
        out[y] = in_zone(np.stack([*parts, 255 * row[:, 3]], -1), P.zone(row[:, 3]), entries, kinds)[0]
    return out


def in_zone(points: np.ndarray, zones: np.ndarray, entries: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point's own zone and the distance; a zone without entries is an error."""
    if not np.isin(zones, kinds).all():
        raise DataError(NO_ENTRY)
    return P.serve(points, zones, entries, kinds)


def ordered_remap(pixels: DataFrame, palette: DataFrame, mask: DataFrame, entries: int, num: int = 1, den: int = 1) -> DataFrame:
    """The same in relational form; mask: channel, my, mx, noise (fixed size), noise in -0.5..0.5.
    Points of a zone without entries have no index (null)."""
    side = mask.agg(F.max("my")).first()[0] + 1
    size, scale = amplitude(entries), float(num) / float(den)
    wide = mask.groupBy("my", "mx").pivot("channel", [0, 1, 2]).agg(F.first(F.col("noise") * size))
    placed = pixels.withColumn("my", F.col("y") % side).withColumn("mx", F.col("x") % side).join(F.broadcast(wide), ["my", "mx"])
    luma = (F.col("0") + F.col("1") + F.col("2")) / 3.0
    moved = [F.rint((F.col(c) + scale * (OWN * F.col(str(i)) + SHARED * luma)) * F.col("a")) for i, c in enumerate("rgb")]
    points = placed.select("image_id", "pos", E.zone_of().alias("zone"), *[F.greatest(F.lit(0.0), F.least(F.lit(float(MOST)), m)).cast("bigint").alias(f"p{i}") for i, m in enumerate(moved)], (255 * F.col("a")).alias("p3"))
    return assign.nearest(points, palette, ["pos"]).select("image_id", "pos", "idx")


# -- diffusion ----------------------------------------------------------------------------------


@dataclass
class Directives:
    """Where errors may pass, by pixel: region, barrier, and strength as a ratio."""

    region: np.ndarray
    barrier: np.ndarray
    num: np.ndarray
    den: np.ndarray

    @classmethod
    def uniform(cls, shape: tuple[int, int], num: int, den: int) -> Directives:
        zero = np.zeros(shape, np.int64)
        return cls(zero, zero.astype(bool), zero + num, zero + den)

    @classmethod
    def from_hook(cls, rgba: np.ndarray, hook: Callable[[int, int, tuple[int, ...]], tuple]) -> Directives:
        """By a caller's function of x, y and pixel, which gives (region, barrier, num, den)."""
        h, w = rgba.shape[:2]
        got = [hook(x, y, tuple(rgba[y, x].tolist())) for y in range(h) for x in range(w)]
        names: dict = {}
        region = np.array([names.setdefault(g[0], len(names)) for g in got]).reshape(h, w)
        return cls(region, *(np.array([g[i] for g in got]).reshape(h, w) for i in (1, 2, 3)))


@dataclass
class Evidence:
    """What a diffusion did."""

    scan: str = "serpentine"
    strengths: tuple[tuple[int, int], ...] = ((1, 1),)
    transported_edges: int = 0
    discarded_edges: int = 0
    changed: int = 0


class Nearest(dict):
    """Entry and error of clamped features of one zone; forgets all when full."""

    def __init__(self, entries: np.ndarray, names: np.ndarray):
        self.entries, self.twice, self.norm, self.names = entries, 2 * entries, (entries * entries).sum(1), names.tolist()
        self.rows = entries.tolist()

    def __missing__(self, v: tuple[int, int, int, int]) -> tuple:
        if len(self) > CACHED:
            self.clear()
        at = int((self.norm - self.twice @ np.array(v)).argmin())
        e = self.rows[at]
        self[v] = made = (self.names[at], v[0] - e[0], v[1] - e[1], v[2] - e[2], v[3] - e[3])
        return made


def round_away(n: int, d: int) -> int:
    return (abs(n) + d // 2) // d * (1 if n >= 0 else -1)


def diffuse(rgba: np.ndarray, palette: np.ndarray, directives: Directives | None = None, *, serpentine: bool = True) -> np.ndarray:
    return diffuse_with_evidence(rgba, palette, directives, serpentine=serpentine)[0]


def diffuse_with_evidence(rgba: np.ndarray, palette: np.ndarray, directives: Directives | None = None, *, serpentine: bool = True) -> tuple[np.ndarray, Evidence]:
    """Floyd-Steinberg over premultiplied features of an (h, w, 4) image.

    Errors pass only inside a zone and a region, and never across a barrier; each takes the sender's
    strength and is rounded half away from zero.  Without directives they pass everywhere in full.
    """
    h, w = rgba.shape[:2]
    colours = rgba.astype(np.int64)
    source, entries = P.feature(colours), P.feature(palette)
    zones, kinds = P.zone(colours[..., 3]), P.zone(palette[:, 3])
    base, _ = in_zone(source.reshape(-1, 4), zones.ravel(), entries, kinds)
    by_zone = [Nearest(entries[kinds == z], np.flatnonzero(kinds == z)) for z in range(3)]
    d = directives or Directives.uniform((h, w), 1, 1)
    if any(x.shape != (h, w) for x in (d.region, d.barrier, d.num, d.den)):
        raise DataError("there must be a directive for every pixel")
    if (d.den <= 0).any() or (d.num < 0).any():
        raise DataError("directives need a nonnegative strength with a positive denominator")
    # what may pass between two pixels depends on one number of each; a barrier matches nothing
    _, region = np.unique(d.region, return_inverse=True)
    place = np.where(d.barrier, -1, region.reshape(h, w) * 3 + zones)
    out = np.zeros((h, w), np.int64)
    below = [0] * (4 * w)
    transported = discarded = 0
    for y in range(h):
        here, below = below, [0] * (4 * w)
        back = serpentine and y % 2
        lands = place[y].tolist()
        under = place[y + 1].tolist() if y + 1 < h else None
        zone, feats, num, den = zones[y].tolist(), source[y].ravel().tolist(), d.num[y].tolist(), d.den[y].tolist()
        row = [0] * w
        for x in range(w - 1, -1, -1) if back else range(w):
            i = 4 * x
            v = [feats[i + k] + here[i + k] for k in range(4)]
            chosen, e0, e1, e2, e3 = by_zone[zone[x]][tuple([0 if t < 0 else MOST if t > MOST else t for t in v])]
            row[x] = chosen
            land, scale, over = lands[x], num[x], 16 * den[x]
            half = over // 2
            for dx, dy, weight in KERNEL:
                nx = x - dx if back else x + dx
                if not 0 <= nx < w or dy and under is None:
                    continue
                if land < 0 or (under if dy else lands)[nx] != land:
                    discarded += 1
                    continue
                transported += 1
                share = weight * scale
                if not share:
                    continue
                to, j = (below if dy else here), 4 * nx
                for k, e in ((0, e0), (1, e1), (2, e2), (3, e3)):
                    if e > 0:
                        to[j + k] += (e * share + half) // over
                    elif e:
                        to[j + k] -= (half - e * share) // over
        out[y] = row
    pairs = tuple(sorted({(int(a), int(b)) for a, b in np.unique(np.stack([d.num.ravel(), d.den.ravel()], 1), axis=0)}))
    return out, Evidence("serpentine" if serpentine else "raster", pairs, transported, discarded, int((out.ravel() != base).sum()))


def floyd_steinberg(pixels: DataFrame, palette: DataFrame, directives: DataFrame | None = None, *, serpentine: bool = True) -> DataFrame:
    """Index of every pixel by error diffusion; images run in parallel, each in one function.

    directives: image_id, pos, region, barrier, num, den; without them errors pass everywhere.  An
    image with a pixel whose zone has no entry has null indices; the others go on.
    """
    columns = ["pos", "y", "x", *E.CHANNELS]
    full = pixels.select("image_id", *columns)
    if directives is not None:
        full = full.join(directives.select("image_id", "pos", "region", "barrier", "num", "den"), ["image_id", "pos"])
        columns += ["region", "barrier", "num", "den"]

    def make(name: int, rows: pa.Table, entries: np.ndarray) -> pa.Table:
        rgba = raster.image_of(rows)
        h, w = rgba.shape[:2]
        given = None
        if len(columns) > 7:
            code = rows["region"].combine_chunks().dictionary_encode().indices.fill_null(-1)
            rows = rows.set_column(rows.schema.get_field_index("region"), "region", code)
            region, barrier, num, den = np.moveaxis(raster.image_of(rows, ("region", "barrier", "num", "den"), np.int64), -1, 0)
            given = Directives(region, barrier.astype(bool), num, den)
        try:
            idx = pa.array(diffuse(rgba, entries, given, serpentine=serpentine).ravel())
        except DataError:
            idx = pa.nulls(h * w, pa.int64())
        return pa.table({"image_id": np.full(h * w, name), "pos": np.arange(h * w), "idx": idx})

    return raster.per_image(full, palette, columns, "image_id bigint, pos bigint, idx bigint", make)
