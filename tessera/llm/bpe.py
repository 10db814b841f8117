"""Byte-level BPE by speculation: greedy longest matches, vectorised pair checks, exact merging of the rest.

A merge list is a proper BPE when every token is made by one merge whose parts are older than it.
Then a segmentation is the BPE result exactly when no adjacent pair of its tokens would have merged
across their common border, and that depends on the two tokens alone.  So the encoder

1. proposes the greedy longest-match segmentation of each new word,
2. tests every distinct adjacent pair with numpy, for all words at once,
3. runs real merging only on words with a pair that fails.

Words are cached per worker under a bound, so a frequent word costs one dictionary look-up.
Null text encodes as the empty text; the empty text has no ids and decodes to the empty text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Callable
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import as_text, fields, map_documents

#: Characters with the Unicode property White_Space.
WHITE = r"\t-\r \x85\xa0  -     　"
#: The word pattern of the byte-level pre-tokenizer.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
BORDER = "\u0100"
NEVER = np.int64(1 << 40)
LONG_WORD = 48
CACHED = 600_000  # words and pieces that a worker keeps, 150 bytes each
ENDS = ".,;:!?"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Unsafe(Exception):
    """A piece that can't be encoded apart from its neighbours."""


class Pieces(dict):
    """Encoded form of ' ' + piece (or the bare piece), for pieces without white space at an end."""

    def __missing__(self, piece: str) -> bytes:
        raise Unsafe(piece)


def tested(got: dict) -> dict:
    """The file's model, if this method gives its results: byte-level BPE without a normaliser, ranks by
    merges alone, special tokens found as they stand.  Anything else is refused by name."""
    model, split = got.get("model") or {}, got.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or "merges" not in model:
        raise ValueError("the tokenizer's model isn't BPE")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or split.get("use_regex", True) is not True:
        raise ValueError("the tokenizer's pre-tokenizer isn't the byte-level word pattern")
    if got.get("normalizer"):
        raise ValueError("the tokenizer has a normalizer")
    for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"):
        if model.get(name) and not (name == "unk_token" and any(t["content"] == model[name] for t in got.get("added_tokens", ()))):
            raise ValueError(f"the tokenizer's model has {name}")
    for t in got.get("added_tokens", ()):
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or (t.get("normalized") and not t.get("special")):
            raise ValueError(f"the tokenizer's token {t['content']!r} isn't matched as it stands")
    if (got.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("the tokenizer's decoder isn't byte-level")
    return model


class SpeculativeBpe:
    def __init__(self, spec: bytes, most_cached: int = CACHED):
        got = json.loads(spec)
        model = tested(got)
        back = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in got["added_tokens"]}
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if all(c in back for c in token) and token not in self.special}
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.token_bytes[i] = token
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = (vocab[bytes(back[c] for c in t)] for t in (a, b))
            z = vocab[self.token_bytes[x] + self.token_bytes[y]]
            self.merge.setdefault((x, y), (r, z))
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        long = np.array([z for z in vocab.values() if len(self.token_bytes[z]) > 1], np.int64)
        parts = np.maximum(self.rank[self.left[long]], self.rank[self.right[long]])
        if (self.rank[long] < 0).any() or (parts >= self.rank[long]).any():
            raise ValueError("some token of the tokenizer isn't made by one merge of older parts")
        order = sorted(self.merge.items())
        self.pair_key = np.array([(x << 20) | y for (x, y), _ in order], np.int64)
        self.pair_rank = np.array([r for _, (r, _) in order], np.int64)
        self.pair_made = np.array([z for _, (_, z) in order], np.int64)
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.length = np.array([len(t) for t in self.token_bytes], np.int64)
        self.trie = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.trie.add_word(token.decode("latin-1"), i)
        self.trie.make_automaton()
        self.most_cached = most_cached
        self.spaced, self.bare, self.words = Pieces(), Pieces(), {}
        self.known = np.empty(0, np.int64)
        self.known_fits = np.empty(0, bool)
        self.exact_merges = 0

    # -- verification -------------------------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: merging their joined bytes gives these two tokens again.

        Walks the tokens that stand at the border while either side is built: the right edge of a
        and the left edge of b.  A border merge of rank m happens if it comes before the merge that
        takes its left part away, and not after the one that takes its right part (equal merges run
        from left to right).
        """
        fits = np.ones(len(a), bool)
        x, x_end, rows = a.copy(), np.full(len(a), NEVER), np.arange(len(a))
        while len(rows):
            y, y_end, sub = b[rows].copy(), np.full(len(rows), NEVER), np.arange(len(rows))
            while len(sub):
                key = (x[sub] << 20) | y
                at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
                m = np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)
                fits[rows[sub[(m < x_end[sub]) & (m <= y_end) & (m < NEVER)]]] = False
                more = self.left[y] >= 0
                y_end, y, sub = self.rank[y[more]], self.left[y[more]], sub[more]
            more = (self.right[x] >= 0) & fits[rows]
            x_end, x, rows = self.rank[x[more]], self.right[x[more]], rows[more]
        return fits

    def _fits(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.empty(0, bool)
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        seen = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        fits = np.empty(len(distinct), bool)
        if seen.any():
            fits[seen] = self.known_fits[at[seen]]
        new = distinct[~seen]
        if len(new):
            fits[~seen] = made = self.compatible(new >> 20, new & 0xFFFFF)
            if len(self.known) > 4 * self.most_cached:
                self.known, self.known_fits = np.empty(0, np.int64), np.empty(0, bool)
            self.known = np.concatenate([self.known, new])
            self.known_fits = np.concatenate([self.known_fits, made])
            order = np.argsort(self.known, kind="stable")
            self.known, self.known_fits = self.known[order], self.known_fits[order]
        return fits[back]

    # -- exact merging ------------------------------------------------------------------------

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging of one word by a heap, for words of any length."""
        ids, merge = [self.byte_id[b] for b in word], self.merge
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = z, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merge.get((z, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, z, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := merge.get((ids[before[i]], z))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], z, m[1]))
        return [x for x, lives in zip(ids, alive) if lives]

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], NEVER), self.pair_made[at]

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many short words side by side: each round does every word's next merge."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        name, ends = np.arange(len(words)), np.cumsum(sizes)
        rank, made = self._pair_ranks(ids, np.append(ids[1:], 0))
        rank[ends - 1] = NEVER
        while len(name):
            starts = ends - sizes
            least = np.minimum.reduceat(rank, starts)
            over = least >= NEVER
            if over.any():
                packed, four = ids.astype("<u4").tobytes(), ends * 4
                for i, a, b in zip(name[over].tolist(), (starts[over] * 4).tolist(), four[over].tolist()):
                    out[i] = packed[a:b]
                stays = np.repeat(~over, sizes)
                ids, rank, made = ids[stays], rank[stays], made[stays]
                name, sizes, least = name[~over], sizes[~over], least[~over]
                if not len(name):
                    break
                ends = np.cumsum(sizes)
                starts = ends - sizes
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            owner = np.searchsorted(starts, hits, "right") - 1
            at = hits[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each word
            ids[at] = made[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            last = (at + 1) == ends - 1
            ids, rank, made = ids[stays], rank[stays], made[stays]
            at -= np.arange(len(at))
            sizes = sizes - 1
            ends = np.cumsum(sizes)
            rank[at[last]] = NEVER
            right = at[~last]
            rank[right], made[right] = self._pair_ranks(ids[right], ids[right + 1])
            left = at[at > ends - sizes] - 1
            rank[left], made[left] = self._pair_ranks(ids[left], ids[left + 1])
        return out

    # -- words --------------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        if not words:
            return []
        raw = [w if w.isascii() else w.encode().decode("latin-1") for w in words]
        ends, ids = np.fromiter(chain.from_iterable(self.trie.iter_long(BORDER.join(raw))), np.int64).reshape(-1, 2).T.copy()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        of = np.searchsorted(starts, ends, "right") - 1
        whole = np.bincount(of, self.length[ids], len(raw)) == sizes
        inner = of[1:] == of[:-1]
        pairs = ((ids[:-1] << 20) | ids[1:])[inner]
        bad = of[1:][inner][~self._fits(pairs)]
        whole[bad] = False
        first = np.searchsorted(of, np.arange(len(raw) + 1))
        packed = ids.astype("<u4").tobytes()
        cuts = (first * 4).tolist()
        out = [packed[a:b] for a, b in zip(cuts, cuts[1:])]
        failed = np.flatnonzero(~whole)
        self.exact_merges += len(failed)
        short = failed[sizes[failed] <= LONG_WORD].tolist()
        if short:
            for i, made in zip(short, self.merge_short([raw[i].encode("latin-1") for i in short])):
                out[i] = made
        for i in failed[sizes[failed] > LONG_WORD].tolist():
            out[i] = np.array(self.merge_long(raw[i].encode("latin-1")), "<u4").tobytes()
        return out

    def _learn(self, missing: dict[str, None]) -> None:
        """Put the words into the cache."""
        if len(self.words) + len(missing) > self.most_cached:
            self.words.clear()
        words = list(missing)
        self.words.update(zip(words, self.encode_words(words)))

    def _plain(self, text: str) -> bytes:
        """A text without special tokens, by the word pattern."""
        words = WORDS.findall(text)
        known = self.words
        missing = {w: None for w in words if w not in known}
        if missing:
            self._learn(missing)
            known = self.words
            if any(w not in known for w in words):  # the cache was emptied
                self._learn({w: None for w in words if w not in known})
                made = dict(zip(u := list(dict.fromkeys(words)), self.encode_words(u)))
                return b"".join([made[w] for w in words])
        return b"".join([known[w] for w in words])

    def prepare(self, texts: list[str]) -> None:
        """Learn the space-separated pieces of a batch at once.

        A space between two characters that aren't white space always begins a word, so such pieces
        can be encoded apart.  Others are left out and take the word pattern over their whole text.
        """
        if len(self.spaced) + len(self.bare) > self.most_cached:
            self.spaced.clear()
            self.bare.clear()
        spaced, bare = set(), set()
        for text in texts:
            pieces = text.split(" ")
            bare.add(pieces[0])
            spaced.update(pieces[1:])
        for cache, new, lead in ((self.spaced, spaced.difference(self.spaced), " "), (self.bare, bare.difference(self.bare), "")):
            single, ended, other = [], [], []
            for p in new:
                if p.isalpha():
                    if len(p) <= 400:
                        single.append(p)
                elif p and len(p) <= 400 and not p[0].isspace() and not p[-1].isspace():
                    (ended if p[-1] in ENDS and p[:-1].isalpha() else other).append(p)
            if not (single or ended or other):
                continue
            split = [WORDS.findall(lead + p) for p in other]
            words = list({w for ws in split for w in ws}.union([lead + p for p in single], [lead + p[:-1] for p in ended], ENDS))
            made = dict(zip(words, self.encode_words(words)))
            cache.update(zip(single, [made[lead + p] for p in single]))
            cache.update(zip(ended, [made[lead + p[:-1]] + made[p[-1]] for p in ended]))
            cache.update(zip(other, [b"".join([made[w] for w in ws]) for ws in split]))

    def _by_pieces(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        try:
            return self.bare[head] + b"".join(map(self.spaced.__getitem__, rest))
        except Unsafe:
            return self._plain(text)

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers."""
        plain = [t for t in texts if not (self._specials and self._specials.search(t))] if self._specials else texts
        self.prepare(plain)
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self._specials and self._specials.search(text):
                parts = [np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self._specials.split(text) if p]
                out.append(b"".join(parts))
            else:
                out.append(self._by_pieces(text))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _made(digest: str, read: Callable[[], bytes], most_cached: int) -> SpeculativeBpe:
    return SpeculativeBpe(read(), most_cached)


class Spec:
    """A tokenizer file's content, sent to the executors once; its size is fixed (about 1.5 MB)."""

    def __init__(self, spark, path: str, most_cached: int = CACHED):
        content = Path(path).read_bytes()
        self.most_cached = most_cached
        self.digest = hashlib.sha256(content).hexdigest()
        self.shared = spark.sparkContext.broadcast(content)

    def __call__(self) -> bytes:
        return self.shared.value

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other) -> bool:
        return isinstance(other, Spec) and other.digest == self.digest

    def encoder(self) -> SpeculativeBpe:
        return _made(self.digest, self, self.most_cached)


def transcode(docs: DataFrame, tokenizer: str, *, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """Encode each whole text and decode its ids again: columns ids array<int>, decoded string.

    ``tokenizer`` is the path of a byte-level BPE file.  Null text counts as empty: no ids, "".
    Special tokens in a text get their own ids, as the file's library does by default.  Words and texts
    of any length are encoded whole; equal ranks merge from the left.  Repeated rows give repeated
    results; no rows give none.  Input columns other than those of ``keep`` are dropped, and one of
    those named like an output gives way.  A file that this method can't serve is refused.
    """
    spec = Spec(docs.sparkSession, tokenizer)

    def make():
        bpe = spec.encoder()

        def kernel(texts: pa.Array) -> dict:
            packed = bpe.encode_bytes(as_text(texts))
            flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            cuts = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            values, back = flat.tolist(), bpe.token_bytes
            pieces = [b"".join(map(back.__getitem__, values[a:b])).decode("utf-8", "replace") for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            return {"ids": pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)), "decoded": pieces}

        return kernel

    return map_documents(docs, make, fields("ids array<int>, decoded string"), text_col=text_col, keep=keep)
