"""Palette fitting: greedy and iterative steps over at most 4096 bins, one Arrow function per image."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.errors import DataError, InternalError
from tessera.operators import histogram as H

#: Bounds of the fit, and what the colour of transparent pixels becomes.
LADDER_LEVELS, LADDER_ROUNDS, REPRESENTATIVES, POLISH, REFINE = 8, 32, 32, 4, 8
HIDDEN = ("canonicalize-black", "preserve-mean")


@dataclass
class Fitted:
    """A palette and how it came about."""

    palette: np.ndarray
    exact_path: bool  # the bins themselves
    pairs: int  # entries before refinement
    rounds: int = 0


def half_up(n, d):
    return (2 * n + d) // (2 * d)


def zone(a):
    return np.where(a == 0, 0, np.where(a == 255, 2, 1))


def pack(c: np.ndarray) -> np.ndarray:
    return ((c[..., 0] * 256 + c[..., 1]) * 256 + c[..., 2]) * 256 + c[..., 3]


def feature(c: np.ndarray) -> np.ndarray:
    return np.concatenate([c[..., :3] * c[..., 3:], 255 * c[..., 3:]], -1)


def square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a[:, None, :] - b[None, :, :]
    return (d * d).sum(-1)


def alpha_ladder(alpha: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Alpha levels: 0 and 255 where they occur, and up to eight between by one-dimensional Lloyd."""
    mass = np.bincount(alpha, n, 256).astype(np.int64)
    ends = [a for a in (0, 255) if mass[a]]
    inner = np.flatnonzero(mass[1:255]) + 1
    if not len(inner):
        return np.array(ends, np.int64)
    m, k = mass[inner], min(LADDER_LEVELS, len(inner))
    marks = (2 * np.arange(1, k + 1) - 1) * m.sum()
    levels = np.unique(inner[np.searchsorted(2 * k * np.cumsum(m), marks)])
    for _ in range(LADDER_ROUNDS):
        own = np.abs(inner[:, None] - levels[None]).argmin(1)
        w, s = np.bincount(own, m, len(levels)).astype(np.int64), np.bincount(own, m * inner, len(levels)).astype(np.int64)
        new = np.unique(np.where(w > 0, half_up(s, np.maximum(w, 1)), levels))
        if np.array_equal(new, levels):
            break
        levels = new
    return np.array(sorted({*ends, *levels.tolist()}), np.int64)


def representatives(colours: np.ndarray, weight: np.ndarray, cap: int, levels: int) -> np.ndarray:
    """Farthest-point seeds by weighted distance, then a few weighted Lloyd rounds."""
    seen = weight > 0
    items, w = colours[seen], weight[seen]
    if not len(items):
        return np.zeros((1, 3), np.int64)
    k = min(max(REPRESENTATIVES, -(-cap // max(1, levels))), cap, len(items))
    key = (items[:, 0] * 256 + items[:, 1]) * 256 + items[:, 2]
    chosen = [int(np.lexsort((key, -w))[0])]
    near = ((items - items[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        gain = w * near
        if gain.max() == 0:
            break
        ties = np.flatnonzero(gain == gain.max())
        chosen.append(int(ties[key[ties].argmin()]))
        near = np.minimum(near, ((items - items[chosen[-1]]) ** 2).sum(1))
    reps = items[chosen]
    for _ in range(POLISH):
        own = square(items, reps).argmin(1)
        total = np.bincount(own, w, len(reps)).astype(np.int64)
        sums = np.stack([np.bincount(own, w * items[:, c], len(reps)) for c in range(3)], 1).astype(np.int64)
        new = np.where(total[:, None] > 0, half_up(sums, np.maximum(total, 1)[:, None]), reps)
        if np.array_equal(new, reps):
            break
        reps = new
    return reps


def centroid(sa, sar, sag, sab, n) -> np.ndarray:
    a = half_up(sa, n)
    rgb = [np.where(a == 0, 0, half_up(s, np.maximum(sa, 1))) for s in (sar, sag, sab)]
    return np.stack([*rgb, a], -1)


def sample_of(n: int) -> np.ndarray:
    return np.arange(0, n, max(1, -(-n // H.SAMPLE_CAP)))


def fit(bins: dict[str, np.ndarray], colours: int, exact: bool, hidden: str = HIDDEN[0]) -> Fitted:
    """A palette of at most ``colours`` entries from bins in key order."""
    palette, done = start(bins, colours, exact, hidden)
    if done or not len(palette):
        return Fitted(palette, True, len(palette))
    few = {k: v[sample_of(len(bins["n"]))] for k, v in bins.items()}
    means = np.stack([half_up(few[f"s{c}"], few["n"]) for c in "rgba"], -1)
    points = np.stack([half_up(few[f"sa{c}"], few["n"]) for c in "rgb"] + [half_up(255 * few["sa"], few["n"])], -1)
    refined, rounds = refine(palette, points, zone(means[:, 3]), means, feature, lambda rows: centroid(*(few[s][rows].sum() for s in ("sa", "sar", "sag", "sab", "n"))))
    return Fitted(refined, False, len(palette), rounds)


def nearest_rows(colours: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Nearest representative of each colour; ties take the first."""
    return np.concatenate([square(colours[i : i + 4096], reps).argmin(1) for i in range(0, len(colours), 4096)]) if len(colours) else np.empty(0, np.int64)


def start(bins: dict[str, np.ndarray], colours: int, exact: bool, hidden: str = HIDDEN[0]) -> tuple[np.ndarray, bool]:
    """The palette before refinement, and whether it is exact (the bins themselves).

    Bins go to slots of representative and ladder level of their zone.  The transparent slot comes
    first, then the heaviest slot of each zone, then all others by mass (ties by packed centroid,
    then first appearance), each with its members' centroid; equal centroids all stay.
    """
    if hidden not in HIDDEN:
        raise DataError(f"unknown hidden colour policy {hidden}")
    n = bins["n"]
    means = np.stack([half_up(bins[f"s{c}"], n) for c in "rgba"], -1)
    zones = zone(means[:, 3])
    if exact and len(n) <= colours:
        return means, True
    sample = sample_of(len(n))
    points = np.stack([half_up(bins[f"sa{c}"], n) for c in "rgb"] + [half_up(255 * bins["sa"], n)], -1)
    ladder = alpha_ladder(means[:, 3], n)
    level_zone = zone(ladder)
    visible = sample[(zones[sample] != 0) & (bins["sa"][sample] > 0)]
    reps = representatives(means[visible, :3], bins["sa"][visible], colours, int((level_zone != 0).sum()))
    entries: list[np.ndarray] = []
    clear = np.flatnonzero(zones == 0)
    if len(clear):
        seen = [half_up(bins[f"s{c}"][clear].sum(), n[clear].sum()) for c in "rgb"] if hidden == "preserve-mean" else [0, 0, 0]
        entries.append(np.array([*seen, 0], np.int64))
    rows = np.flatnonzero(zones != 0)
    if len(rows):
        level = means[rows, 3].copy()
        for z in (1, 2):
            own = np.flatnonzero(zones[rows] == z)
            if len(own) and (level_zone == z).any():
                steps = ladder[level_zone == z]
                level[own] = steps[np.abs(steps[None, :] - level[own, None]).argmin(1)]
        slots, first, at = np.unique(nearest_rows(means[rows, :3], reps) * 256 + level, return_index=True, return_inverse=True)
        add = lambda x: np.bincount(at, x[rows].astype(float), len(slots)).astype(np.int64)
        mass = add(n)
        colour = centroid(add(bins["sa"]), add(bins["sar"]), add(bins["sag"]), add(bins["sab"]), mass)
        slot_zone = zone(slots % 256)
        order = np.lexsort((first, pack(colour), -mass)).tolist()
        taken: list[int] = []
        for z in np.unique(zones[rows]):
            of_zone = [i for i in order if slot_zone[i] == z]
            if of_zone and len(entries) + len(taken) < colours:
                taken.append(of_zone[0])
        taken += [i for i in order if i not in set(taken)]
        entries += [colour[i] for i in taken][: max(0, colours - len(entries))]
    palette = np.array(entries, np.int64).reshape(-1, 4)
    return fill(palette, means[sample], points[sample], n[sample], zones[sample], colours), False


def fill(palette, means, points, n, zones, colours) -> np.ndarray:
    """While there is room, add the mean of the bin with the greatest weighted distance to its zone's entries."""
    near = np.full(len(n), -1, np.int64)
    for z in (1, 2):
        rows, own = np.flatnonzero(zones == z), palette[zone(palette[:, 3]) == z]
        if len(rows) and len(own):
            near[rows] = square(points[rows], feature(own)).min(1)
    have = {tuple(e) for e in palette.tolist()}
    key = pack(means)
    while len(palette) < colours:
        gain = np.where(near > 0, n * near, 0)
        ok = gain > 0
        pick = None
        for i in np.lexsort((zones, key, -gain)):
            if not ok[i]:
                break
            if tuple(means[i].tolist()) not in have:
                pick = i
                break
        if pick is None:
            break
        palette = np.concatenate([palette, means[pick][None]])
        have.add(tuple(means[pick].tolist()))
        rows = np.flatnonzero((zones == zones[pick]) & (near >= 0))
        near[rows] = np.minimum(near[rows], ((points[rows] - feature(means[pick][None])[0]) ** 2).sum(1))
    return palette


def candidates(z: int, kinds: np.ndarray) -> np.ndarray:
    """Entries that may take a point of zone z: those of its zone; for a visible point without any, all
    visible ones, or the only entry there is."""
    inside = np.flatnonzero(kinds == z)
    if not len(inside) and z:
        inside = np.flatnonzero(kinds != 0) if len(kinds) > 1 else np.arange(len(kinds))
    if not len(inside):
        raise InternalError("no palette entry can take a bin")
    return inside


def serve(points: np.ndarray, zones: np.ndarray, entries: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry of its zone (ties: the first) and the distance, with the fallback of
    ``candidates``.  Real features are compared as ``nearest_real`` does."""
    own, far = np.zeros(len(points), np.int64), np.zeros(len(points), points.dtype)
    for z in np.unique(zones):
        rows, inside = np.flatnonzero(zones == z), candidates(z, kinds)
        for lo in range(0, len(rows), 4096):
            part = rows[lo : lo + 4096]
            if points.dtype.kind == "f":
                at, far[part] = nearest_real(points[part], entries[inside])
            else:
                d = square(points[part], entries[inside])
                at, far[part] = d.argmin(1), d.min(1)
            own[part] = inside[at]
    return own, far


def powered(a, b) -> float:
    """Squared distance by the power function, summed from the left."""
    return sum(((x - y) ** 2.0 for x, y in zip(a, b)), 0.0)


def nearest_real(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point and the distance, by the power function.

    Products differ from it in the last place at most, so they settle all but near ties.
    """
    d = square(points, entries)
    best = d.min(1)
    near = d <= (best * (1 + 1e-12))[:, None] + 5e-324
    at = d.argmin(1)
    p, e = points.tolist(), entries.tolist()
    for i in np.flatnonzero(near.sum(1) > 1).tolist():
        at[i] = min(np.flatnonzero(near[i]).tolist(), key=lambda j: (powered(p[i], e[j]), j))
    return at, np.array([powered(x, e[j]) for x, j in zip(p, at.tolist())])


def refine(palette: np.ndarray, points: np.ndarray, zones: np.ndarray, spare: np.ndarray, feature_of, centre_of) -> tuple[np.ndarray, int]:
    """At most eight Lloyd rounds, and their number.  An entry without bins moves to the ``spare`` colour
    of its zone's worst-served bin; if the zone is served perfectly it goes, unless it is the zone's last."""
    kinds, key, rounds = zone(palette[:, 3]), pack(spare), 0
    while rounds < REFINE:
        rounds += 1
        own, far = serve(points, zones, feature_of(palette), kinds)
        worst = {}
        for z in np.unique(zones).tolist():
            rows = np.flatnonzero(zones == z)
            ties = rows[far[rows] == far[rows].max()]
            worst[z] = far[ties[0]], spare[ties[key[ties].argmin()]]
        left, kept, moved, changed = np.bincount(kinds, minlength=3), [], palette.copy(), False
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(len(palette) + 1))
        for i, z in enumerate(kinds.tolist()):
            rows = order[cuts[i] : cuts[i + 1]]
            if z and len(rows):
                moved[i] = centre_of(rows)
                moved[i, 3] = 255 if z == 2 else moved[i, 3]
                changed |= bool((moved[i] != palette[i]).any())
            elif z and z in worst and worst[z][0] > 0:
                moved[i], changed = worst[z][1], True
            elif z and left[z] > 1:
                left[z] -= 1
                changed = True
                continue
            kept.append(i)
        palette, kinds = moved[kept], kinds[kept]
        if not changed:
            break
    return palette, rounds


def fit_palettes(bins: DataFrame, colours: int = 256, hidden: str = HIDDEN[0]) -> DataFrame:
    """Palettes of all images, each from its bins: image_id, exact, k0..k3 and sums, as the histogram gives them."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in H.KEY])
        got = fit({s: table[s].to_numpy() for s in H.SUMS}, colours, table["exact"][0].as_py(), hidden).palette
        return pa.table({"image_id": pa.array([table["image_id"][0].as_py()] * len(got), pa.int64()), "idx": pa.array(range(len(got)), pa.int64())} | {c: pa.array(got[:, i], pa.int64()) for i, c in enumerate("rgba")})

    return bins.groupBy("image_id").applyInArrow(work, "image_id bigint, idx bigint, r bigint, g bigint, b bigint, a bigint")
