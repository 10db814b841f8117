"""Toxicity by a classifier chain: each category's linear model also sees the earlier categories' scores.

Categories are columns of the labels.  Where these have none, they are found in the toxic rows:
groups of rows that share words, by spherical k-means over the words that tell toxic rows apart.
The last link of the chain is the label itself.

The models are logistic regressions on the presence of chosen words and of chosen character n-grams
of words, which inflected and compound words share.  While training, a later model sees out-of-fold
probabilities of the earlier ones, that is what they say of rows they weren't fitted on, as will be
the case for new texts.  The verdict's cut is fitted to out-of-fold probabilities of whole chains.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_text, fields, map_documents

WORD = re.compile(r"[^\W\d_]+")
MOST_ROWS, MOST_WORDS, MOST_GRAMS = 10_000, 2_000, 500
GRAMS = (3, 4, 5, 6)
GROUPS = 2


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def grams_of(word: str) -> list[str]:
    """Character n-grams of a word with its borders; some occur again."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]


class Features(dict):
    """Features of each word; forgets all when full."""

    def __init__(self, index: dict[str, int]):
        self.words = {x: i for x, i in index.items() if x[0] != " "}
        self.grams = {x[1:]: i for x, i in index.items() if x[0] == " "}
        self.heads = {x[: GRAMS[0]] for x in self.grams}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        grams, heads, least, marked = self.grams, self.heads, GRAMS[0], f"<{word}>"
        made = [self.words[word]] if word in self.words else []
        for i in range(len(marked) - least + 1):
            if marked[i : i + least] in heads:
                made += [grams[g] for n in GRAMS if i + n <= len(marked) and (g := marked[i : i + n]) in grams]
        self[word] = made = tuple(made)
        return made

    def of(self, words: set[str]) -> list[int]:
        return sorted(set().union(*map(self.__getitem__, words)))


def names_of(categories: Sequence[str] = (), groups: int = GROUPS) -> tuple[str, ...]:
    """The chain's links in order."""
    return (*(categories or [f"group_{i + 1}" for i in range(groups)]), "toxic")


@dataclass
class Chain:
    names: tuple[str, ...]
    index: dict[str, int]  # n-grams with a space before them
    weights: np.ndarray  # category x (words and n-grams, earlier categories)
    bias: np.ndarray
    cut: float = 0.5

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((i for r in rows for i in r), np.int64)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return chained(self.weights, self.bias, flat, of, len(rows))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def chained(weights: np.ndarray, bias: np.ndarray, flat: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    k = len(bias)
    size = weights.shape[1] - k
    p = np.zeros((n, k))
    for c in range(k):
        margin = bias[c] + np.bincount(of, weights[c, flat], n) + p[:, :c] @ weights[c, size : size + c]
        p[:, c] = sigmoid(margin)
    return p


def fit_linear(flat, of, n, size, extra, y, *, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse presence features and dense extra columns, by Adam on all rows."""
    w, v, b = np.zeros(size), np.zeros(extra.shape[1]), 0.0
    params = np.concatenate([w, v, [b]])
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, v, b = params[:size], params[size:-1], params[-1]
        p = sigmoid(b + np.bincount(of, w[flat], n) + extra @ v)
        e = (p - y) / n
        grad = np.concatenate([np.bincount(flat, e[of], size), e @ extra, [e.sum()]]) + ridge * params
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        params = params - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return np.concatenate([params[:size], params[size:-1]]), float(params[-1])


def fit_chain(names: tuple[str, ...], index: dict[str, int], flat, of, n: int, y: np.ndarray, *, folds: int = 3) -> Chain:
    """``y`` has a column per category, in the chain's order."""
    size, k = len(index), y.shape[1]
    weights, bias = np.zeros((k, size + k)), np.zeros(k)
    seen, fold = np.zeros((n, k)), np.arange(n) % folds
    for c in range(k):
        w, bias[c] = fit_linear(flat, of, n, size, seen[:, :c], y[:, c])
        weights[c, : size + c] = w
        for f in range(folds if c + 1 < k else 0):
            inside, new = fold != f, np.cumsum(fold != f) - 1
            own = inside[of]
            w, b = fit_linear(flat[own], new[of[own]], int(inside.sum()), size, seen[inside, :c], y[inside, c])
            margin = b + np.bincount(of, w[flat], n) + seen[:, :c] @ w[size:]
            seen[~inside, c] = sigmoid(margin)[~inside]
    return Chain(names, index, weights, bias)


class Vocabulary:
    """Words of the labelled rows, and the n-grams of each word."""

    def __init__(self, lists: pa.ListArray):
        coded = pc.dictionary_encode(lists.flatten())
        self.words = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.of = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        ids: dict[str, int] = {}
        flat, ends = array("i"), [0]
        for w in self.words:
            flat.extend([ids.setdefault(g, len(ids)) for g in grams_of(w)])
            ends.append(len(flat))
        self.grams = list(ids)
        self.sizes = np.diff(ends)
        self.flat = np.array(flat, np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def present(self, chosen: np.ndarray | None = None, step: int = 64):
        """Distinct (n-gram, row) pairs, ``step`` rows at a time, of the chosen n-grams or all."""
        cuts = np.searchsorted(self.of, np.arange(0, (self.of[-1] if len(self.of) else -1) + step + 1, step))
        for a, b in zip(cuts, cuts[1:]):
            codes, sizes = self.codes[a:b], self.sizes[self.codes[a:b]]
            at = np.repeat(self.starts[codes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            grams, rows = self.flat[at], np.repeat(self.of[a:b], sizes)
            if chosen is not None:
                kept = chosen[grams]
                grams, rows = grams[kept], rows[kept]
            pairs = np.unique(rows.astype(np.int64) * len(self.grams) + grams)
            yield (pairs % len(self.grams)).astype(np.int32), (pairs // len(self.grams)).astype(np.int32)


def strongest(a: np.ndarray, b: np.ndarray, toxic: float, clean: float, most: int) -> np.ndarray:
    """Numbers of the features of greatest chi-square, from the toxic and clean rows that have them."""
    n, c, d = toxic + clean, toxic - a, clean - b
    chi = (a * d - b * c) ** 2 * n / np.maximum((a + b) * (c + d) * toxic * clean, 1e-9)
    chi[a + b < min(5, max(2, n // 100))] = 0
    chosen = np.argsort(-chi, kind="stable")[:most]
    return chosen[chi[chosen] > 0]


def grouped(codes: np.ndarray, of: np.ndarray, y: np.ndarray, words: np.ndarray, groups: int, rounds: int = 20) -> np.ndarray:
    """A column for each group: which toxic rows belong to it, by the presence of words that are commoner
    in toxic rows.  Rows without such a word belong to none.  Larger groups come first."""
    out = np.zeros((len(y), groups))
    place = np.full(int(codes.max(initial=-1)) + 1, -1)
    place[words] = np.arange(len(words))
    at, toxic = place[codes], y == 1
    a, b = (np.bincount(at[(at >= 0) & (toxic[of] == k)], minlength=len(words)) for k in (True, False))
    place[words[a * (~toxic).sum() <= b * toxic.sum()]] = -1
    at = place[codes]
    rows, own = np.flatnonzero(toxic), np.flatnonzero((at >= 0) & toxic[of])
    x = np.zeros((len(rows), len(words)), np.float32)
    x[np.searchsorted(rows, of[own]), at[own]] = 1
    x *= np.log1p(len(rows) / np.maximum(x.sum(0), 1))
    size = np.sqrt((x * x).sum(1))
    rows, x = rows[size > 0], x[size > 0] / size[size > 0, None]
    if not len(rows):
        return out
    centres = x[[int(x.sum(1).argmax())]]
    while len(centres) < min(groups, len(rows)):
        centres = np.concatenate([centres, x[[int((x @ centres.T).max(1).argmin())]]])
    own = np.full(len(rows), -1)
    for _ in range(rounds):
        now = (x @ centres.T).argmax(1)
        if np.array_equal(now, own):
            break
        own = now
        sums = np.stack([x[own == k].sum(0) for k in range(len(centres))])
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
    order = np.argsort(-np.bincount(own, minlength=groups), kind="stable")
    out[rows, np.argsort(order)[own]] = 1
    return out


def fit_rows(lists: pa.ListArray, y: np.ndarray, named: np.ndarray | None, names: tuple[str, ...], folds: int, most_words: int, most_grams: int) -> tuple[Chain, np.ndarray]:
    """The chain of all rows, and the probabilities that chains without a row's fold give the row.

    Such a chain chooses its features, and finds its groups, without that fold as well.  ``named`` has
    the columns of given categories.
    """
    n, fold, known = len(y), np.arange(len(y)) % folds, Vocabulary(lists)
    codes, of = known.codes, known.of
    # a column per fold and label, so that what a fold leaves is a sum of columns
    group = fold * 2 + y.astype(np.int64)
    word_counts = np.stack([np.bincount(codes[group[of] == g], minlength=len(known.words)) for g in range(2 * folds)])
    gram_counts = np.zeros((2 * folds, len(known.grams)), np.int32)
    for grams, rows in known.present():
        for g in range(2 * folds):
            gram_counts[g] += np.bincount(grams[group[rows] == g], minlength=len(known.grams)).astype(np.int32)
    picks = []
    for out in (None, *range(folds)):
        kept = [k for k in range(folds) if k != out]
        inside = fold != out if out is not None else np.ones(n, bool)
        toxic = y[inside].sum()
        best = []
        for counts, most in ((word_counts, most_words), (gram_counts, most_grams)):
            a, b = (counts[[2 * k + label for k in kept]].sum(0).astype(float) for label in (1, 0))
            best.append(strongest(a, b, toxic, inside.sum() - toxic, most))
        picks.append((inside, *best))
    del gram_counts
    wanted = np.zeros(len(known.grams), bool)
    for _, _, grams in picks:
        wanted[grams] = True
    parts = list(known.present(wanted))
    gram, gram_of = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (list(zip(*parts)) or [(), ()]))
    chosen = [[*(known.words[i] for i in words), *(" " + known.grams[i] for i in grams)] for _, words, grams in picks]
    sizes = len(known.words), len(known.grams)
    del known, parts, lists  # fitting needs the numbers alone
    held, chain = np.zeros(n), None
    for (inside, words, grams), features in zip(picks, chosen):
        index = {name: i for i, name in enumerate(features)}
        to_word, to_gram = (np.full(k, -1, np.int32) for k in sizes)
        to_word[words], to_gram[grams] = np.arange(len(words)), len(words) + np.arange(len(grams))
        flat, rows = np.concatenate([to_word[codes], to_gram[gram]]), np.concatenate([of, gram_of])
        rows, flat = rows[flat >= 0], flat[flat >= 0]
        own, new = inside[rows], np.cumsum(inside, dtype=np.int32) - 1
        here = inside[of]
        finer = named[inside] if named is not None else grouped(codes[here], new[of[here]], y[inside], words, len(names) - 1)
        fitted = fit_chain(names, index, flat[own], new[rows[own]], int(inside.sum()), np.column_stack([finer, y[inside]]))
        if chain is None:
            chain = fitted
        else:
            held[~inside] = chained(fitted.weights, fitted.bias, flat, rows, n)[~inside, -1]
    return chain, held


def fit_cut(p: np.ndarray, y: np.ndarray, lost: float) -> float:
    """The cut that rejects at most a share ``lost`` of the clean rows, and the most toxic ones.

    It lies in the middle, by log odds, between the clean row that has to stay and the toxic row
    next above it.
    """
    clean = np.sort(p[y == 0])[::-1]
    least = clean[min(int(lost * len(clean)), len(clean) - 1)]
    above = p[(y == 1) & (p > least)]
    if not len(above):
        return float(max(0.5, np.nextafter(least, 2)))
    a, b = (np.log(x / (1 - x)) for x in np.clip([least, above.min()], 1e-12, 1 - 1e-12))
    return float(np.clip(sigmoid((a + b) / 2), np.nextafter(least, 2), above.min()))


def train(
    docs: DataFrame, labels: DataFrame, *, categories: Sequence[str] = (), groups: int = GROUPS, most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS,
    lost: float = 0.003, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Chain | None:
    """Fit the chain on at most ``most_rows`` labelled rows (those of the smallest hashes of their ids).

    ``categories`` names 0/1 columns of the labels, the links before the last; without any, ``groups``
    are found in the toxic rows.  Words and n-grams are those with the strongest chi-square against the
    label, in five rows or more.  The cut rejects at most a share ``lost`` of the clean rows by
    out-of-fold scores.  Labels other than 0 and 1 and null ids are left out, null categories count as
    0, an id labelled twice has a label if it has it once.  A labelled id of many rows gives at most
    ``most_rows`` rows in all.  Without rows of both labels there is no model (None).
    """
    marks = {"__y": label_col} | {f"__c{i}": c for i, c in enumerate(categories)}
    picked = (
        labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(k) for k, c in marks.items()])
        .orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    )
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "__id")

    def make():
        return lambda texts: {"words": [sorted(words_of(t)) for t in as_text(texts)]}

    made = map_documents(known, make, fields("words array<string>"), keep=("__id", *marks))
    rows = made.orderBy("__id", F.xxhash64("words")).limit(most_rows).toArrow().combine_chunks()
    y = np.array(rows["__y"].to_pylist(), float)
    if len(y) < 20 or y.min() == y.max():
        return None
    named = np.stack([np.array(rows[f"__c{i}"].to_pylist(), float) for i in range(len(categories))], 1) if categories else None
    lists = [rows["words"].combine_chunks()]
    del rows
    model, held = fit_rows(lists.pop(), y, named, names_of(categories, groups), 3, most_words, most_grams)
    model.cut = fit_cut(held, y, lost)
    return model


def judge(docs: DataFrame, model: Chain | None, *, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """Adds a probability for each link of the chain (p_group_1, p_group_2, p_toxic if categories weren't
    given) and toxic (the last one at the model's cut or above).

    Null and empty texts have no features and get the models' base rates.  Texts of any length are read
    whole.  Without a model all are 0 and nothing is toxic.  Repeated rows get equal results; no rows
    give none.  Input columns other than those of ``keep`` are dropped, and one of those named like an
    output gives way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = model.names if model else names_of()

    def make():
        chain = shared.value
        known = Features(chain.index if chain else {})

        def kernel(texts: pa.Array) -> dict:
            p = chain.probabilities([known.of(words_of(t)) for t in as_text(texts)]) if chain else np.zeros((len(texts), len(names)))
            return {f"p_{c}": p[:, i] for i, c in enumerate(names)} | {"toxic": p[:, -1] >= chain.cut if chain else np.zeros(len(p), bool)}

        return kernel

    out = fields(", ".join(f"p_{c} double" for c in names) + ", toxic boolean")
    return map_documents(docs, make, out, text_col=text_col, keep=keep)
