"""Document quality: plain rules, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows, flattened into numpy node arrays and
scored for a whole batch at once.  On chosen features the score may only fall as the feature grows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, fields, map_documents

#: The symbols that are counted, and white space between words.
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
CONTINUED = bytes(range(0x80, 0xC0))
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = UPPER + bytes(range(97, 123))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features, and the direction in which quality may move as each grows (0: either).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "distinct": 0, "upper": 0,
    "bangs": -1, "bars": -1, "digits": 0, "stutter": -1, "lines": 0, "stops": 0, "commas": 0,
}
MOST_ROWS = 10_000


def statistics(raw: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five counts and the features of one text; an empty text has zeros throughout."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0), (0.0,) * len(FEATURES)
    chars = len(raw.translate(None, SPACE + CONTINUED))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeats += i + 3 - max(i, end)
                end = i + 3
    upper = len(raw) - len(raw.translate(None, UPPER))
    letters = len(raw) - len(raw.translate(None, LETTERS))
    features = (
        np.log1p(n), chars / n, symbols / n, dups / len(lines), repeats / n, len(set(words)) / n, upper / max(letters, 1),
        raw.count(b"!") / n, raw.count(b"|") / n, (len(raw) - len(raw.translate(None, DIGITS))) / chars,
        sum(map(eq, words, words[1:])) / n, len(lines) / n, raw.count(b".") / n, raw.count(b",") / n,
    )
    return (n, chars, symbols, dups, repeats), tuple(map(float, features))


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


@dataclass
class Trees:
    """Flattened trees: inner nodes hold a feature, a threshold and two children; leaves lead to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    cut: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boost regression trees on the logistic loss over histograms of quantile bins.

    A split of a constrained feature needs child values in the right order, and both subtrees are
    held to their side of the children's midpoint, so the whole score is monotone in the feature.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate0 / (1 - rate0)))
    score = np.full(n, base)
    f, t, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(f)
        f.append(0), t.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)

        def best_value(a, b, lo, hi):
            return np.clip(rate * a / (b + ridge), lo, hi)

        def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            v = float(best_value(total_g, total_h, lo, hi))
            if level == depth or total_h < 2 * least:
                score[rows] += v
                return leaf(v)
            best = (1e-6, None)
            for j in range(width):
                if not len(edges[j]):
                    continue
                k = len(edges[j]) + 1
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], k))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], k))[:-1]
                gr, hr = total_g - gl, total_h - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
                ok = (hl >= least) & (hr >= least)
                if monotone[j]:
                    ok &= monotone[j] * (best_value(gr, hr, lo, hi) - best_value(gl, hl, lo, hi)) >= 0
                gain = np.where(ok, gain, -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], j, at, float(best_value(gl[at], hl[at], lo, hi)), float(best_value(gr[at], hr[at], lo, hi)))
            if best[1] is None:
                score[rows] += v
                return leaf(v)
            _, j, at, vl, vr = best
            mid = (vl + vr) / 2
            i = leaf(0.0)
            goes = binned[rows, j] <= at
            bounds = ((lo, hi), (lo, hi)) if not monotone[j] else ((lo, mid), (mid, hi)) if monotone[j] > 0 else ((mid, hi), (lo, mid))
            f[i], t[i] = j, float(edges[j][at])
            left[i] = grow(rows[goes], level + 1, *bounds[0])
            right[i] = grow(rows[~goes], level + 1, *bounds[1])
            return i

        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
    return Trees(np.array(f), np.array(t), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def train(docs: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS, lost: float = 0.003, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees | None:
    """Fit on at most ``most_rows`` labelled rows (those of the smallest hashes of their ids).

    The cut is 0.5, or lower if out-of-fold scores would reject more than ``lost`` of the good rows.
    Without rows of both labels there is no model (None).  Labels other than 0 and 1 and null ids are
    left out; an id labelled twice counts as good if it is so once.  A labelled id of many rows gives
    at most ``most_rows`` rows in all.  Ids may be of any type with an order.
    """
    picked = (
        labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("bigint").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    )
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "__id")

    def make():
        def kernel(texts: pa.Array) -> dict:
            got = [statistics(x) for x in as_bytes(texts)]
            return {"x": [s for _, s in got], "failed": [bool(base_failed(c[0], c[4])) for c, _ in got]}

        return kernel

    made = map_documents(known, make, fields("x array<double>, failed boolean"), keep=("__id", "__y"))
    rows = made.where("not failed").orderBy("__id", F.xxhash64("x")).limit(most_rows).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows["__y"].to_pylist(), float)
    if len(y) < 20 or y.min() == y.max():
        return None
    monotone = np.array(list(FEATURES.values()))
    folds = np.arange(len(y)) % 3
    out = np.empty(len(y))
    for k in range(3):
        out[folds == k] = fit(x[folds != k], y[folds != k], monotone).probability(x[folds == k])
    model = fit(x, y, monotone)
    model.cut = float(min(0.5, np.quantile(out[y == 1], lost, method="lower")))
    return model


def judge(docs: DataFrame, model: Trees | None, *, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_quality, kept.

    ``kept`` is false where the rules fail, else the model's verdict (true without a model).  Null
    and empty texts have zero counts and fail the rules.  Texts of any length are counted whole; a
    probability at the cut is kept.  Repeated rows get equal results; no rows give none.  Other input
    columns are dropped unless kept; those named like an output give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        trees = shared.value

        def kernel(texts: pa.Array) -> dict:
            got = [statistics(x) for x in as_bytes(texts)]
            counts = np.array([c for c, _ in got], np.int64).reshape(-1, 5)
            x = np.array([s for _, s in got], float).reshape(-1, len(FEATURES))
            failed = base_failed(counts[:, 0], counts[:, 4])
            p = trees.probability(x) if trees else np.ones(len(x))
            kept = ~failed & (p >= trees.cut if trees else True)
            return dict(zip(COUNTS, counts.T)) | {"base_failed": failed, "p_quality": p, "kept": kept}

        return kernel

    out = fields(", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, p_quality double, kept boolean")
    return map_documents(docs, make, out, text_col=text_col, keep=keep)
