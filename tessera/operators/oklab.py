"""Palettes in the Oklab space: the same start, refined and assigned by premultiplied Oklab distance.

Reals are used in one order throughout: powers by the C library, a bin's features added pixel by
pixel, so an image gives the same bytes wherever it runs.  That takes an image's pixels in their
order, so it works on whole images and not on pixel rows.
"""

from __future__ import annotations

import numpy as np

from tessera.functions import expr as E
from tessera.operators import palette as P

FEATURES = ("fl", "fa", "fb", "fw")
#: The published inverse matrices of the Oklab colour space.
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))

LINEAR = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in (v / 255.0 for v in range(256))]


def dot(row, xs) -> float:
    return row[0] * xs[0] + row[1] * xs[1] + row[2] * xs[2]


def root(v: float) -> float:
    return 0.0 if v == 0 else abs(v) ** (1.0 / 3.0) * (1.0 if v > 0 else -1.0)


def to_lab(r: int, g: int, b: int) -> tuple[float, float, float]:
    linear = LINEAR[r], LINEAR[g], LINEAR[b]
    roots = [root(dot(row, linear)) for row in E.TO_LMS]
    return tuple(dot(row, roots) for row in E.TO_LAB)


def from_linear(v: float) -> int:
    v = min(max(v, 0.0), 1.0)
    x = 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1.0 / 2.4) - 0.055
    return int(min(max((x * 255.0 + 0.5) // 1.0, 0.0), 255.0))


def from_lab(lab) -> tuple[int, int, int]:
    cubes = [x * x * x for x in (dot(row, lab) for row in FROM_LAB)]
    return tuple(from_linear(dot(row, cubes)) for row in FROM_LMS)


def feature(colours: np.ndarray) -> np.ndarray:
    """Premultiplied Oklab features of 8-bit colours; transparent ones are all zero."""
    out = np.zeros((len(colours), 4))
    for i, (r, g, b, a) in enumerate(colours.tolist()):
        if a:
            w = a / 255.0
            lab = to_lab(r, g, b)
            out[i] = w * lab[0], w * lab[1], w * lab[2], w
    return out


def centre(n: int, sa: int, fl: float, fa: float, fb: float) -> np.ndarray:
    """The 8-bit colour of summed features: alpha from its integer mean, the rest through the inverse."""
    a = int(P.half_up(int(sa), int(n)))
    if not a or not sa:
        return np.zeros(4, np.int64)
    w = float(sa) / 255.0
    return np.array([*from_lab((fl / w, fa / w, fb / w)), a], np.int64)


def added(b: dict[str, np.ndarray], rows: np.ndarray) -> list:
    """Sums over bins, from the first to the last."""
    return [int(b["n"][rows].sum()), int(b["sa"][rows].sum()), *(sum(b[f][rows].tolist(), 0.0) for f in FEATURES[:3])]


def fit(b: dict[str, np.ndarray], colours: int, exact: bool, hidden: str = P.HIDDEN[0]) -> P.Fitted:
    """A palette of at most ``colours`` entries from bins in key order with summed features."""
    palette, done = P.start(b, colours, exact, hidden)
    if done or not len(palette):
        return P.Fitted(palette, True, len(palette))
    few = {k: v[P.sample_of(len(b["n"]))] for k, v in b.items()}
    zones = P.zone(P.half_up(few["sa"], few["n"]))
    spare = np.stack([centre(*x) for x in zip(*(few[k].tolist() for k in ("n", "sa", *FEATURES[:3])))])
    spare[zones == 2, 3] = 255
    refined, rounds = P.refine(palette, means(few), zones, spare, feature, lambda rows: centre(*added(few, rows)))
    return P.Fitted(refined, False, len(palette), rounds)


def means(b: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([b[f] for f in FEATURES], -1) / b["n"].astype(float)[:, None]
