"""Exact Jaccard join of documents on word n-grams by signature trees.

Documents with equal sets collapse to classes.  Any two sets that reach the similarity share a
token among their prefixes under one global order of tokens; the order puts tokens that a fixed-size
count sketch of the whole corpus finds frequent last, so a passage in many documents is no
candidate.  A prefix token is posted under the size of its set and the next one, in steps of the
similarity, so only sets of fitting sizes meet.  Most postings are alone: chunks of documents send
theirs to hash ranges as compressed arrays, and a filter of those found twice spares the others any
further way.  All classes with a posting form a group, named by its least class.

In each group a signature tree holds, per node, the OR of its members' token bitmaps and their
range of sizes.  A dual traversal drops node pairs whose sizes can't match or whose greatest
possible overlap is too small, and skips pairs already known to lie together.  A first pass over
bitmaps alone leaves clusters of possible partners; a second one over the sets of those decides
every pair exactly.

A group above a block goes in two steps.  Each of its blocks is first compared with one member, the
head; what links to the head needs no comparison among itself.  Only the loose rest meets all
blocks, a task for each pair of blocks.  So a family of near copies costs work in proportion to its
size, and no link is lost.  What goes on are spanning links, never all pairs.

Tokens and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import TEXT, as_bytes, fields, map_documents, slices
from tessera.llm.ngramlm import HASHES, delta, mix, undelta
from tessera.storage import keep, read, remove, write

U64 = np.uint64
SKETCH_BITS, SEGMENT_BITS = 22, 16
LEAF, FAN = 16, 8
SIGNATURE_BLOCK, SET_BLOCK = 4096, 512
#: Binary logarithms of a filter's bits: at least and at most (32 MB); and bits for each entry.
FILTER_LEAST, FILTER_MOST, FILTER_EACH = 16, 28, 16
#: Tokens of a chunk or a range, and ranges at least.
RANGE_TOKENS, LEAST_RANGES = 1 << 20, 64


# -- sets ---------------------------------------------------------------------------------------


def shingles(text: bytes, n: int) -> np.ndarray:
    """Distinct n-word windows as sorted hashes; fewer words make one; no words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, U64)
    h = np.frombuffer(b"".join(map(HASHES.__getitem__, words)), "<u8")
    k = min(n, len(h))
    out = h[: len(h) - k + 1] ^ U64(0x5851F42D4C957F2D * k & (1 << 64) - 1)
    for i in range(1, k):
        out = mix(out, h[i : len(h) - k + 1 + i])
    return np.unique(out)


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """Bits of the tokens' low parts in ``width`` bits (a power of two, 64 at least), as 64-bit words."""
    at = (tokens & U64(width - 1)).astype(np.int64)
    bits = np.zeros(width, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def width_for(n: int) -> int:
    return max(64, 1 << (max(n, 1) - 1).bit_length())


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """A wider bitmap brought to ``width`` bits."""
    return np.bitwise_or.reduce(words.reshape(-1, width // 64), 0)


def prefix(tokens: np.ndarray, order: np.ndarray, num: int, den: int) -> np.ndarray:
    n = len(tokens)
    p = n - -(-num * n // den) + 1
    cls = order[(tokens >> U64(64 - SKETCH_BITS)).astype(np.int64)]
    return tokens[np.lexsort((tokens, cls))[:p]]


# -- signature trees ----------------------------------------------------------------------------


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Tree:
    """Levels of nodes over members sorted by size: OR of bitmaps, sizes, most tokens lost to shared bits."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, maps: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.members, self.sizes, self.maps = members[order], sizes[order], maps[order]
        self.lost = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        cuts = np.arange(0, len(order), LEAF)
        level = [np.bitwise_or.reduceat(self.maps, cuts), np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.lost, cuts)]
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), FAN)
            level = [f.reduceat(x, cuts) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level)]
            self.levels.append(level)


def possible(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Node pairs (or member pairs) that may hold a matching pair: sizes within the ratio, and the
    greatest overlap - shared bits and tokens lost to shared bits - enough for the least sizes."""
    maps_a, least_a, most_a, lost_a = a
    maps_b, least_b, most_b, lost_b = b
    ok = (num * least_a[i] <= den * most_b[j]) & (num * least_b[j] <= den * most_a[i])
    k = np.flatnonzero(ok)
    step = max(1, (1 << 21) // maps_a.shape[1])
    for lo in range(0, len(k), step):
        s = k[lo : lo + step]
        overlap = np.bitwise_count(maps_a[i[s]] & maps_b[j[s]]).sum(1, dtype=np.int64) + np.minimum(lost_a[i[s]], lost_b[j[s]])
        overlap = np.minimum(overlap, np.minimum(most_a[i[s]], most_b[j[s]]))
        ok[s] = (num + den) * overlap >= num * (least_a[i[s]] + least_b[j[s]])
    return ok


def traverse(a: Tree, b: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk both trees together; yields per pair of leaves the member positions that may match."""
    same = a is b
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i = j = np.zeros(1, np.int64)

    def children(x: np.ndarray, level: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kids = (x[:, None] * FAN + np.arange(FAN)).ravel()
        of = np.repeat(np.arange(len(x)), FAN)
        there = kids < len(level[0])
        return kids[there], of[there]

    while True:
        ok = possible(a.levels[la], b.levels[lb], i, j, num, den)
        i, j = i[ok], j[ok]
        if la == 0 and lb == 0:
            break
        if la >= lb:
            la -= 1
            i, of = children(i, a.levels[la])
            j = j[of]
            if same:
                lb -= 1
                j, of = children(j, b.levels[lb])
                i = i[of]
                keep = i <= j
                i, j = i[keep], j[keep]
        else:
            lb -= 1
            j, of = children(j, b.levels[lb])
            i = i[of]
    ma, mb = ([t.maps, t.sizes, t.sizes, t.lost] for t in (a, b))
    for x, y in zip(i.tolist(), j.tolist()):
        p = np.arange(x * LEAF, min((x + 1) * LEAF, len(a.members)))
        q = np.arange(y * LEAF, min((y + 1) * LEAF, len(b.members)))
        p, q = np.repeat(p, len(q)), np.tile(q, len(p))
        if same and x == y:
            keep = p < q
            p, q = p[keep], q[keep]
        ok = possible(ma, mb, p, q, num, den)
        if ok.any():
            yield a.members[p[ok]], b.members[q[ok]]


def near_head(head: np.ndarray, size: int, sizes: np.ndarray, maps: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which members may match one other, by bitmaps alone."""
    ok, widths = np.zeros(len(sizes), bool), np.array([len(m) for m in maps])
    for words in np.unique(widths).tolist():
        rows, least = np.flatnonzero(widths == words), min(words, len(head))
        own = np.stack([fold(maps[r], 64 * least) for r in rows] + [fold(head, 64 * least)])
        n = np.append(sizes[rows], size)
        side = [own, n, n, n - np.bitwise_count(own).sum(1, dtype=np.int64)]
        at = np.arange(len(rows))
        ok[rows] = possible(side, side, at, np.full(len(rows), len(rows)), num, den)
    return ok


def link(rid: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], sides: np.ndarray | None, num: int, den: int, accept: Callable[[int, int], bool] | None) -> list[tuple[int, int]]:
    """Spanning links among members (or between two sides only), by trees per bitmap width.

    Without ``accept`` every possible pair links; with it those that it confirms.  Bitmaps of two
    widths meet wherever sizes of theirs can be within the ratio.
    """
    union, links = Union(len(sizes)), []
    widths = np.array([64 * len(m) for m in maps])

    def tree(rows: np.ndarray, width: int) -> Tree | None:
        return Tree(rows, sizes[rows], np.stack([fold(maps[r], width) for r in rows])) if len(rows) else None

    def walk(a: Tree | None, b: Tree | None) -> None:
        if a is None or b is None:
            return
        for p, q in traverse(a, b, num, den):
            for x, y in zip(p.tolist(), q.tolist()):
                if rid[x] != rid[y] and union.find(x) != union.find(y) and (accept is None or accept(x, y)):
                    union.join(x, y)
                    links.append((x, y))

    sets = [np.arange(len(sizes))] if sides is None else [np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)]
    every = np.unique(widths).tolist()
    for width in every:
        trees = [tree(r[widths[r] == width], width) for r in sets]
        walk(trees[0], trees[-1])
        for more in every:
            if more > width and more * num < 2 * width * den:
                wider = [tree(r[widths[r] == more], width) for r in sets]
                walk(trees[0], wider[-1])
                if sides is not None:
                    walk(trees[1], wider[0])
    return links


# -- running over groups ------------------------------------------------------------------------


def per_group(frame: DataFrame, keys: list[str], out: list[T.StructField], work: Callable[[pa.Table], dict[str, list] | None]) -> DataFrame:
    """Apply ``work`` to the rows of each key, many groups to a task, streaming over sorted rows."""
    n = len(keys)
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: dict[str, list] = {k: [] for k in names}

        def flush():
            got = work(pa.Table.from_batches(held)) if held else None
            for k in names if got else ():
                made[k].extend(got[k])

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(made[k]) if made[k] else pa.array([], pa.int64()) for k in names], names=names)
            for k in names:
                made[k] = []
            return batch

        last = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]
            changes = np.zeros(max(batch.num_rows - 1, 0), bool)
            for c in columns:
                changes |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key = tuple(c[a] for c in columns)
                if key != last:
                    flush()
                    held, last = [], key
                held.append(batch.slice(a, b - a))
            if len(made[names[0]]) > 20_000:
                yield full()
        flush()
        if made[names[0]]:
            yield full()

    frame = frame.select(*keys, *[c for c in frame.columns if c not in keys])
    return frame.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, T.StructType(out))


def beside(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join on a key that may be hot in ``many``.

    Joining on the key's complement gives either side an exchange of its own; adaptive execution can
    split such an exchange at a hot key, but not one that an aggregate below shares.
    """
    right = one.withColumnRenamed(key, "__key")
    return many.join(right, F.bitwise_not(F.col(key)) == F.bitwise_not(F.col("__key")), how).drop("__key")


MET = fields("key bigint, rid bigint, near boolean")


def over_groups(members: DataFrame, key: str, most: int, rows: DataFrame, out: list[T.StructField], work, meet, star) -> DataFrame:
    """``work`` on every group of ``members`` (key, rid, distinct) with the columns that ``rows`` has by rid.

    A group above ``most`` is cut into blocks.  ``meet`` says which rows of a block are near the
    group's head (its least rid, marked by side 1); ``star`` makes output of those.  The loose ones
    meet all blocks, two sides to a task.
    """
    zero = lambda *names: [F.lit(0).cast("bigint").alias(n) for n in names]
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min("rid").alias("__head")).where(F.col("__n") > most)
    big = keep(sizes.select(key, "__head", F.ceil(F.col("__n") / most).cast("bigint").alias("__blocks")))
    order = [key, "i", "j", "side", "rid"]
    if big.isEmpty():
        return per_group(members.select(key, *zero("i", "j", "side"), "rid").join(rows, "rid"), [key, "i", "j"], out, work)
    placed = beside(members, big, key, "left")
    small = placed.where("__blocks is null").select(key, *zero("i", "j", "side"), "rid")
    large = placed.where("__blocks is not null").withColumn("__own", F.pmod(F.xxhash64("rid"), F.col("__blocks")))
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    heads = big.select(key, blocks("__blocks").alias("i"), *zero("j"), F.lit(1).cast("bigint").alias("side"), F.col("__head").alias("rid"))
    first = large.where(F.col("rid") != F.col("__head")).select(key, F.col("__own").alias("i"), *zero("j", "side"), "rid").unionByName(heads)
    met = keep(per_group(first.select(*order).join(rows, "rid"), [key, "i", "j"], MET, meet))
    loose = met.where("not near").select(F.col("key").alias(key), "rid")
    some = loose.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("bigint").alias("__loose"))
    left = beside(beside(loose, some, key), big, key).select(key, F.pmod(F.xxhash64("rid"), F.col("__loose")).alias("i"), blocks("__blocks").alias("j"), *zero("side"), "rid")
    right = beside(large, some, key).select(key, blocks("__loose").alias("i"), F.col("__own").alias("j"), F.lit(1).cast("bigint").alias("side"), "rid")
    tasks = small.select(*order).unionByName(left.select(*order)).unionByName(right.select(*order))
    return per_group(tasks.join(rows, "rid"), [key, "i", "j"], out, work).unionByName(star(met, big, key))


# -- the operator -------------------------------------------------------------------------------


def _token_order(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """Class of each sketch cell: 0 for what chance explains, else rising with the number of documents."""

    def sketch(batches):
        cells, seen = np.zeros(1 << SKETCH_BITS, np.uint32), False
        for batch in (part for whole in batches for part in slices(whole, 0)):
            for text in as_bytes(batch.column(0)):
                at = (shingles(text, n) >> U64(64 - SKETCH_BITS)).astype(np.int64)
                seen |= len(at) > 0
                np.add.at(cells, at, np.uint32(1))
        if seen:
            parts = cells.reshape(-1, 1 << SEGMENT_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["part", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << SEGMENT_BITS, np.uint32)
        for x in table["cells"].to_pylist():
            total += np.frombuffer(zstandard.decompress(x), np.uint32)
        return pa.table({"part": [table["part"][0].as_py()], "cells": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    kind = T.StructType(fields("part bigint, cells binary"))
    rows = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(sketch, kind).groupBy("part").applyInArrow(add, kind).collect()
    cells = np.zeros((1 << SKETCH_BITS - SEGMENT_BITS, 1 << SEGMENT_BITS), np.uint32)
    for r in rows:
        cells[r.part] = np.frombuffer(zstandard.decompress(r.cells), np.uint32)
    cells = cells.ravel()
    mean = cells.mean()
    usual = mean + 4 * mean**0.5 + 8
    return np.where(cells > usual, 1 + np.log2(np.maximum(cells, 1) / usual).astype(np.int64), 0).astype(np.uint8)


def _classes(docs: DataFrame, n: int, num: int, den: int, order: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per document: n_shingles, rid (its class; null without words), prefix tokens and bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def make():
        cls = shared.value

        def kernel(texts: pa.Array) -> dict:
            out: dict[str, list] = {"n_shingles": [], "rid": [], "prefix": [], "map": []}
            for text in as_bytes(texts):
                t = shingles(text, n)
                row = (len(t), class_of(t), prefix(t, cls, num, den).view(np.int64), bitmap(t, width_for(len(t))).tobytes()) if len(t) else (0, None, [], None)
                for column, value in zip(out.values(), row):
                    column.append(value)
            return out

        return kernel

    keyed = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias(TEXT), *_row_keys(id_col, text_col))
    return map_documents(keyed, make, fields("n_shingles bigint, rid bigint, prefix array<bigint>, map binary"), text_col=TEXT, keep=(id_col, *KEYS))


def _filter_at(hashes: np.ndarray, width: int) -> np.ndarray:
    return (hashes.astype(np.int64).view(U64) >> U64(64 - width)).astype(np.int64)


def _bits_of(frame: DataFrame) -> tuple[np.ndarray, int]:
    """A filter of the hashes ``h`` of a kept frame, sixteen bits for each up to 32 MB, built from parts
    in parallel; and the binary logarithm of its size.  Beyond that size more passes than needs to."""
    width = min(FILTER_MOST, max(FILTER_LEAST, (FILTER_EACH * frame.count()).bit_length()))

    def fill(table: pa.Table) -> pa.Table:
        at = np.unique(_filter_at(table["h"].to_numpy(), width))
        return pa.table({"bits": pa.array([zstandard.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)], pa.binary())})

    rows = frame.select("h", F.shiftrightunsigned("h", 64 - 6).alias("part")).groupBy("part").applyInArrow(fill, "bits binary").collect()
    bits = np.zeros(1 << width, bool)
    for r in rows:
        bits[np.cumsum(np.frombuffer(zstandard.decompress(r.bits), "<u4"))] = True
    return np.packbits(bits), width


def _passes(found: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    packed, width = found
    at = _filter_at(hashes, width)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _posted(batch: pa.RecordBatch, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and hash of each posting of (rid, n_shingles, prefix) rows: every token under two sizes."""
    lists, step = batch.column(2), max(np.log(den / num), 1e-9) * (1 + 1e-9)
    lengths = pc.list_value_length(lists).to_numpy()
    size = np.repeat(np.floor(np.log(batch.column(1).to_numpy()) / step).astype(U64), lengths)
    rid, tokens = np.repeat(batch.column(0).to_numpy(), lengths), lists.flatten().to_numpy().view(U64)
    return np.tile(rid, 2), np.concatenate([mix(tokens, size), mix(tokens, size + U64(1))])


def _postings(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(rid, token) of the postings that two classes may share; classes: rid, n_shingles, prefix.

    The ranges see hashes of eight bits more than all postings take to count: one in 256 or so passes
    as shared that isn't.
    """
    total = 2 * (classes.agg(F.sum(F.size("prefix").cast("bigint"))).first()[0] or 0)
    width = min(64, total.bit_length() + 8)
    bits = (max(LEAST_RANGES, -(-total // RANGE_TOKENS)) - 1).bit_length()
    width = max(width, bits, FILTER_LEAST)

    def ask(batches):
        held, size = [], 0

        def full():
            rid, tokens = (np.concatenate(x) for x in zip(*held))
            tokens = tokens >> U64(64 - width)
            order = np.lexsort((rid, tokens))
            rid, tokens = rid[order], tokens[order]
            new = np.append(True, tokens[1:] != tokens[:-1])
            twice = np.logical_or.reduceat(np.append(False, ~new[1:] & (rid[1:] != rid[:-1])), np.flatnonzero(new))
            tokens = tokens[new]
            cuts = [*np.searchsorted(tokens, np.arange(1 << bits, dtype=U64) << U64(width - bits)).tolist(), len(tokens)]
            rows = [(r, delta(tokens[a:b]), np.packbits(twice[a:b]).tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["part", "tokens", "twice"])

        for batch in batches:
            held.append(_posted(batch, num, den))
            size += len(held[-1][0])
            if size >= RANGE_TOKENS:
                yield full()
                held, size = [], 0
        if size:
            yield full()

    def shared(table: pa.Table) -> pa.Table:
        got = [undelta(t) for t in table["tokens"].to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: len(g)] for b, g in zip(table["twice"].to_pylist(), got)])
        tokens, at, n = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
        return pa.table({"h": (tokens[(n > 1) | (np.bincount(at, twice, len(tokens)) > 0)] << U64(64 - width)).view(np.int64)})

    asked = classes.mapInArrow(ask, T.StructType(fields("part bigint, tokens binary, twice binary")))
    found = classes.sparkSession.sparkContext.broadcast(_bits_of(keep(asked.groupBy("part").applyInArrow(shared, "h bigint"))))

    def post(batches):
        seen: set[int] = set()
        for batch in batches:
            new = [i for i, r in enumerate(batch.column(0).to_pylist()) if r not in seen and not seen.add(r)]
            rid, tokens = _posted(batch.take(pa.array(new, pa.int64())), num, den)
            ok = _passes(found.value, tokens)
            yield pa.RecordBatch.from_arrays([pa.array(rid[ok], pa.int64()), pa.array(tokens[ok].view(np.int64))], names=["rid", "token"])

    return classes.mapInArrow(post, T.StructType(fields("rid bigint, token bigint")))


def _sets(docs: DataFrame, n: int, found: tuple[np.ndarray, int], id_col: str, text_col: str) -> DataFrame:
    """The sets of the documents whose hashed id passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(found)
    out = T.StructType(fields("rid bigint, tokens binary"))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = np.flatnonzero(_passes(shared.value, batch.column(0).to_numpy(zero_copy_only=False)))
            made = [t for t in (shingles(x, n) for x in as_bytes(batch.column(1).take(pa.array(rows)))) if len(t)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(t) for t in made], pa.int64()), pa.array([t.tobytes() for t in made], pa.binary())], names=out.names)

    return docs.select(F.xxhash64(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, out)


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """Least member (root) of each node (rid) that has a link, by alternating large and small stars."""
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path, before = None, None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = beside(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = beside(large, least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, path = path, write(small.select("e.u", "e.v").where("u <> v").distinct())
        if last:
            remove(spark, last)
        edges = read(spark, path, "u bigint, v bigint")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "rid")
        before = now


KEYS = ("__k1", "__k2")


def _row_keys(id_col: str, text_col: str) -> list:
    """96 bits that tell rows of different ids or texts apart."""
    of = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")]
    return [f(*of).alias(k) for f, k in zip((F.xxhash64, F.hash), KEYS)]


def _solve(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Of every row the id, keys, n_shingles and rid (its class; null without words), kept; and of every
    rid the root of its component."""
    if not 0 < num <= den:
        raise ValueError("the similarity must lie above 0 and not above 1")
    order = _token_order(docs, n, text_col)
    every = keep(_classes(docs, n, num, den, order, id_col, text_col))
    worded = every.where("rid is not null")
    posted = keep(_postings(worded.select("rid", "n_shingles", "prefix"), num, den))
    groups = posted.groupBy("token").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("token", "lo")
    members = keep(beside(posted, groups, "token").select("lo", "rid").distinct())
    maps = worded.groupBy("rid").agg(F.first("n_shingles").alias("n"), F.first("map").alias("map"))

    def named(rid: np.ndarray, lo: int, task: int) -> np.ndarray:
        return mix(mix(rid.astype(np.int64).view(U64), np.full(len(rid), lo, np.int64).view(U64)), np.full(len(rid), task, U64)).view(np.int64)

    def columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        return rows["rid"].to_numpy(), rows["n"].to_numpy(), [np.frombuffer(m, "<u8") for m in rows["map"].to_pylist()]

    def cluster(rows: pa.Table) -> dict[str, list] | None:
        side, i, j, lo = (rows[c].to_numpy() for c in ("side", "i", "j", "lo"))
        rid, sizes, bits = columns(rows)
        links = link(rid, sizes, bits, side if side.any() else None, num, den, None) if len(rid) > 1 else []
        if not links:
            return None
        union = Union(len(rid))
        for x, y in links:
            union.join(x, y)
        seen = sorted({x for pair in links for x in pair})
        names = np.array([union.find(x) for x in seen])
        return {"cluster": named(rid[names], lo[0], (int(i[0]) << 32) + int(j[0]) + 1).tolist(), "rid": rid[seen].tolist()}

    def meet_maps(rows: pa.Table) -> dict[str, list]:
        rid, sizes, bits = columns(rows)
        side, head = rows["side"].to_numpy() == 1, int(rows["side"].to_numpy().argmax())
        near = near_head(bits[head], sizes[head], sizes, bits, num, den)
        return {"key": rows["lo"].to_numpy()[~side].tolist(), "rid": rid[~side].tolist(), "near": near[~side].tolist()}

    def star_of_maps(met: DataFrame, big: DataFrame, key: str) -> DataFrame:
        name = F.xxhash64(F.lit("star"), "lo").alias("cluster")
        return met.where("near").select(F.col("key").alias("lo"), "rid").union(big.select("lo", F.col("__head"))).select(name, "rid")

    out = fields("cluster bigint, rid bigint")
    clusters = keep(over_groups(members, "lo", SIGNATURE_BLOCK, maps, out, cluster, meet_maps, star_of_maps).distinct())
    reps = worded.groupBy("rid").agg(F.min(id_col).alias("rep"))
    involved = clusters.select("rid").distinct().join(reps, "rid").select(F.xxhash64("rep").alias("h")).distinct()
    sets = _sets(docs, n, _bits_of(keep(involved)), id_col, text_col).groupBy("rid").agg(F.first("tokens").alias("tokens"))

    def same(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return den * both >= num * (len(x) + len(y) - both)

    def decide(rows: pa.Table) -> dict[str, list] | None:
        tokens = [np.frombuffer(t, "<u8") for t in rows["tokens"].to_pylist()]
        rid, side = rows["rid"].to_numpy(), rows["side"].to_numpy()
        bits = [bitmap(t, 4 * width_for(len(t))) for t in tokens]
        links = link(rid, np.array([len(t) for t in tokens]), bits, side if side.any() else None, num, den, lambda x, y: same(tokens[x], tokens[y])) if len(rid) > 1 else []
        return {"a": [int(rid[x]) for x, _ in links], "b": [int(rid[y]) for _, y in links]} if links else None

    def meet_sets(rows: pa.Table) -> dict[str, list]:
        side, rid = rows["side"].to_numpy() == 1, rows["rid"].to_numpy()
        tokens = [np.frombuffer(t, "<u8") for t in rows["tokens"].to_pylist()]
        head = tokens[int(side.argmax())]
        near = [same(head, t) for t, s in zip(tokens, side) if not s]
        return {"key": rows["cluster"].to_numpy()[~side].tolist(), "rid": rid[~side].tolist(), "near": near}

    def star_of_sets(met: DataFrame, big: DataFrame, key: str) -> DataFrame:
        return beside(met.where("near").select(F.col("key").alias("cluster"), "rid"), big, "cluster").select(F.col("__head").alias("a"), F.col("rid").alias("b"))

    links = keep(over_groups(clusters, "cluster", SET_BLOCK, sets, fields("a bigint, b bigint"), decide, meet_sets, star_of_sets))
    return every, connected(links, "a", "b")


def components(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with n_shingles and component_id, the least id reachable by links.

    Two documents link when den * intersection >= num * union of their sets of distinct n-word
    windows (ASCII letters lower-cased; fewer words make one window); 0 < num <= den, or it raises.
    Null texts and texts without words have empty sets and link with nothing.  A row with a null id
    takes the least id of its component, null if there is none.  Rows may repeat an id or be
    repeated whole: each gives a row of its own, and texts of one id link by their sets alone.  Ids
    may be of any type with an order.  Texts of any length are taken whole; ties of similarity at
    the bound link.  No rows give none.  Input columns other than the id are dropped, whatever their
    names.
    """
    every, roots = _solve(docs, n, num, den, id_col, text_col)
    worded = every.where("rid is not null")
    least = worded.groupBy("rid").agg(F.min(id_col).alias("rep")).join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    named = beside(least.select("rid", "root"), least.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("rid", "component_id")
    with_words = beside(worded.select(id_col, "n_shingles", "rid"), named, "rid").select(id_col, "n_shingles", "component_id")
    return with_words.unionByName(every.where("rid is null").select(id_col, "n_shingles", F.col(id_col).alias("component_id")))


def keep_one(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows with their columns, of each component one row: the one of the least id (null ids
    last), among texts of that id any one.  Of rows with the same id and text any one stays.  Rows
    whose text has no words all stay.  An id that stands for several texts may stay in several
    components.  Otherwise as ``components``.
    """
    every, roots = _solve(docs, n, num, den, id_col, text_col)
    rows = every.where("rid is not null").select("rid", *KEYS, F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("name"))
    placed = beside(rows, roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    best = placed.groupBy("root").agg(F.min(F.struct("nameless", "name", *KEYS)).alias("best"))
    gone = beside(placed, best, "root").where(~(F.col(KEYS[0]) == F.col(f"best.{KEYS[0]}")) | ~(F.col(KEYS[1]) == F.col(f"best.{KEYS[1]}")))
    gone = keep(gone.select(*KEYS).distinct())
    repeated = keep(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEYS))
    # only rows that a filter of the keys lets pass have to meet the keys themselves
    keyed = docs.select(*[f"`{c}`" for c in docs.columns], *_row_keys(id_col, text_col))
    found = docs.sparkSession.sparkContext.broadcast(_bits_of(gone.union(repeated).withColumnRenamed(KEYS[0], "h")))
    at = len(docs.columns)

    def flag(batches):
        for batch in batches:
            passes = _passes(found.value, batch.column(at).to_numpy(zero_copy_only=False))
            yield batch.append_column("__doubt", pa.array(passes))

    flagged = keyed.mapInArrow(flag, T.StructType([*keyed.schema.fields, *fields("__doubt boolean")]))
    columns = [f"`{c}`" for c in docs.columns]
    left = flagged.where("__doubt").join(gone, list(KEYS), "left_anti")
    left = left if repeated.isEmpty() else left.dropDuplicates(list(KEYS))
    return flagged.where("not __doubt").select(*columns).unionByName(left.select(*columns))
