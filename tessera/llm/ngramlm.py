"""N-gram language model by deleted interpolation.

P(w | u) mixes the maximum-likelihood estimates c(uw)/c(u), c(w)/N and 1/(V+1).  The weights depend
on how often the context u was seen (buckets of doubling counts) and are learned by
expectation-maximisation on held-out counts: each sixteenth of each chunk of the training texts is
set aside in turn, and its own counts are deleted from the estimates that score it.  For the learning, ratios of
probabilities are rounded to quarters of a doubling, so each is off by 9 % at most; scores use
exact ratios.

Counts never meet in one place.  The partitions of the scan are cut into chunks; a chunk asks each
hash range for the counts of its distinct n-grams and sends its own along; a range adds up and
answers every chunk in the order asked.  So what is shuffled are compressed arrays of distinct
n-grams, a frequent n-gram costs one entry a chunk, and only weights, N and V ever reach the driver.
A chunk grows with the square root of the input, so that messages keep their size and their number
grows in proportion to the input; at 100 TB a chunk is some 600 MB of text.

Words are told apart by 64-bit hashes.  Bigrams are told apart by hashes of 18 bits more than the
input's size has, 64 at most: one in 250,000 shares its hash with another.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_type, as_bytes, fields, slices
from tessera.storage import keep

CHUNK_BYTES, MESSAGE_BYTES = 8 << 20, 4 << 10
LEAST_RANGES = 64
BUCKETS = 24
BLOCKS = 16  # parts of a chunk that are set aside in turn
GRID, LEVELS = 4, 400  # cells of the held-out statistics: per doubling of a probability ratio, and in all
#: Weights (bigram, unigram, uniform) where nothing was held out.
DEFAULT = (0.5, 0.4, 0.1)
U64 = np.uint64


class Hashes(dict):
    """64-bit hash of each word; forgets all when full."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 120_000:
            self.clear()
        self[word] = made = hashlib.blake2b(word, digest_size=8).digest()
        return made


HASHES = Hashes()
START, END = (np.frombuffer(hashlib.blake2b(x, digest_size=8).digest(), "<u8")[0] for x in (b" start", b" end"))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        x = (a * U64(0x9E3779B97F4A7C15)) ^ ((b << U64(31)) | (b >> U64(33)))
        x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
        return x ^ (x >> U64(32))


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the number of tokens of each text."""
    end, parts, sizes = END.tobytes(), [], []
    for text in texts:
        words = text.lower().split()
        parts.append(b"".join(map(HASHES.__getitem__, words)) + end)
        sizes.append(len(words) + 1)
    return np.frombuffer(b"".join(parts), "<u8"), np.array(sizes, np.int64)


def shrink(x: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes(), 1)


def grow(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def delta(x: np.ndarray) -> bytes:
    return shrink(np.diff(x, prepend=U64(0)))


def undelta(data: bytes) -> np.ndarray:
    return np.cumsum(grow(data, "<u8"), dtype=U64)


@dataclass(frozen=True)
class Plan:
    """How an input of some size is cut."""

    chunk_bytes: int
    range_bits: int
    pair_bits: int

    @classmethod
    def of(cls, size: int, chunk_bytes: int = CHUNK_BYTES) -> Plan:
        chunk = max(chunk_bytes, int((size * MESSAGE_BYTES) ** 0.5))
        return cls(chunk, (max(LEAST_RANGES, -(-size // chunk)) - 1).bit_length(), min(64, max(40, size.bit_length() + 18)))


class Chunk:
    """The n-grams of some documents: distinct hashes in order, and where each token's lies."""

    def __init__(self, words: np.ndarray, word_at: np.ndarray, sizes: np.ndarray, held: np.ndarray, pair_bits: int):
        self.words, self.word_at, self.sizes, self.held, self.pair_bits = words, word_at, sizes, held, pair_bits
        self.starts = np.cumsum(sizes) - sizes
        before, context = np.empty_like(word_at), np.empty(len(word_at), U64)
        before[1:], context[1:] = word_at[:-1], words[word_at[:-1]]
        # a word's count is also its count as context; texts begin where one ended
        before[self.starts], context[self.starts] = np.searchsorted(words, END), START
        self.pairs, first, self.pair_at = np.unique(mix(context, words[word_at]) >> U64(64 - pair_bits), return_index=True, return_inverse=True)
        self.pair_word, self.pair_context = word_at[first], before[first]
        trains = np.repeat(~held, sizes)
        self.word_counts = np.bincount(word_at[trains], minlength=len(words))
        self.pair_counts = np.bincount(self.pair_at[trains], minlength=len(self.pairs))

    @classmethod
    def read(cls, texts: list[bytes], held: np.ndarray, pair_bits: int) -> Chunk:
        tokens, sizes = hashed(texts)
        words, word_at = np.unique(tokens, return_inverse=True)
        return cls(words, word_at, sizes, held, pair_bits)

    def digest(self) -> int:
        return zlib.crc32(self.pairs.tobytes(), zlib.crc32(self.words.tobytes()))

    def coded(self) -> dict[str, bytes]:
        """Words numbered by frequency, and the texts as numbers."""
        order = np.argsort(-np.bincount(self.word_at, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        return {"words": delta(self.words), "ranks": shrink(rank), "stream": shrink(rank[self.word_at]), "sizes": shrink(self.sizes.astype("<u4")), "held": np.packbits(self.held).tobytes()}

    @classmethod
    def from_coded(cls, row: dict, pair_bits: int) -> Chunk:
        sizes, rank = grow(row["sizes"], "<u4").astype(np.int64), grow(row["ranks"], "<u4")
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        held = np.unpackbits(np.frombuffer(row["held"], np.uint8))[: len(sizes)].astype(bool)
        return cls(undelta(row["words"]), order[grow(row["stream"], "<u4")], sizes, held, pair_bits)


def _cuts(hashes: np.ndarray, width: int, bits: int) -> list[int]:
    """Where each of 2**bits equal ranges of ``width``-bit hashes begins, and the end."""
    return [*np.searchsorted(hashes, np.arange(1 << bits, dtype=U64) << U64(width - bits)).tolist(), len(hashes)] if bits else [0, len(hashes)]


ASK = fields("part bigint, chunk bigint, digest bigint, words binary, word_counts binary, pairs binary, pair_counts binary")
TELL = fields("chunk bigint, digest bigint, part bigint, words binary, pairs binary, tokens bigint, types bigint")
CODED = fields("chunk bigint, digest bigint, ids binary, words binary, ranks binary, stream binary, sizes binary, held binary")
READY = [*CODED, *fields("word_totals binary, pair_totals binary")]
CELLS = fields("cell bigint, n bigint")


def _batch(names: list[T.StructField], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, arrow_type(f.dataType)) for c, f in zip(columns, names)], names=[f.name for f in names])


def _chunked(docs: DataFrame, held_out, plan: Plan, id_col: str, text_col: str, out: list[T.StructField], make) -> DataFrame:
    """``make(number, ids, chunk)`` of each chunk: consecutive rows of a partition up to the plan's bytes."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), text.alias("text"))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        parts, held, size = [], [], 0

        def full():
            nonlocal number, parts, held, size
            ids = pa.chunked_array([p.column(0) for p in parts])
            chunk = Chunk.read([x for p in parts for x in as_bytes(p.column(2))], np.concatenate(held), plan.pair_bits)
            yield from make(number, ids, chunk)
            number, parts, held, size = number + 1, [], [], 0

        for batch in (part for whole in batches for part in slices(whole, 2, plan.chunk_bytes // 8)):
            parts.append(batch)
            held.append(batch.column(1).to_numpy(zero_copy_only=False))
            size += batch.column(2).nbytes
            if size >= plan.chunk_bytes:
                yield from full()
        if sum(p.num_rows for p in parts):
            yield from full()

    return frame.mapInArrow(run, T.StructType(out))


def ask(number: int, chunk: Chunk, plan: Plan) -> pa.RecordBatch:
    """One message to each range: the chunk's distinct n-grams there and its own training counts."""
    w, p, digest = _cuts(chunk.words, 64, plan.range_bits), _cuts(chunk.pairs, plan.pair_bits, plan.range_bits), chunk.digest()
    counts = lambda x: shrink(x.astype("<u4"))
    return _batch(ASK, [
        (r, number, digest, delta(chunk.words[a:b]), counts(chunk.word_counts[a:b]), delta(chunk.pairs[c:d]), counts(chunk.pair_counts[c:d]))
        for r, (a, b, c, d) in enumerate(zip(w, w[1:], p, p[1:]))
    ])


def code(number: int, ids: pa.ChunkedArray, chunk: Chunk) -> pa.RecordBatch:
    sink, table = pa.BufferOutputStream(), pa.table({"id": ids})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    row = {"chunk": number, "digest": chunk.digest(), "ids": sink.getvalue().to_pybytes()} | chunk.coded()
    return _batch(CODED, [tuple(row[f.name] for f in CODED)])


def _added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """Each asker's totals in its own order; all tokens; all types that occur in training."""
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    return np.split(total[at], cuts), int(total.sum()), int((total > 0).sum())


def tell(table: pa.Table) -> pa.Table:
    got = table.to_pylist()
    words, n, v = _added([undelta(g["words"]) for g in got], [grow(g["word_counts"], "<u4") for g in got])
    pairs, _, _ = _added([undelta(g["pairs"]) for g in got], [grow(g["pair_counts"], "<u4") for g in got])
    part = got[0]["part"]
    rows = [(g["chunk"], g["digest"], part, shrink(w.astype("<u8")), shrink(p.astype("<u8")), 0, 0) for g, w, p in zip(got, words, pairs)]
    return pa.Table.from_batches([_batch(TELL, [*rows, (-1, 0, part, None, None, n, v)])])


def answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """A coded chunk with the totals of its words and pairs, in order."""
    rows = []
    for row in left.to_pylist():
        got = sorted(right.select(["digest", "part", "words", "pairs"]).to_pylist(), key=lambda g: g["part"])
        if {g["digest"] for g in got} != {row["digest"]}:
            raise RuntimeError("the documents came in another order when read again; write them to a table first")
        words, pairs = (np.concatenate([grow(g[k], "<u8") for g in got]) for k in ("words", "pairs"))
        rows.append((*(row[f.name] for f in CODED), shrink(words), shrink(pairs)))
    return pa.Table.from_batches([_batch(READY, rows)])


def bucket(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the floor of the count's binary logarithm."""
    return np.minimum(np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


@dataclass
class Model:
    tokens: int
    types: int
    weights: np.ndarray  # bucket x (bigram, unigram, uniform)

    def probabilities(self, pair, word, context) -> tuple[np.ndarray, np.ndarray, float]:
        p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
        return p2, word / max(self.tokens, 1), 1 / (self.types + 1)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _ready(row: dict, pair_bits: int) -> tuple[Chunk, np.ndarray, np.ndarray]:
    chunk = Chunk.from_coded(row, pair_bits)
    words, pairs = (grow(row[k], "<u8").astype(np.int64) for k in ("word_totals", "pair_totals"))
    return chunk, words, pairs


def held_out_cells(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """How often the chunk's training tokens fall into each cell of (bucket, bigram ratio, unigram
    ratio), by the counts of all documents but their block's."""
    half = LEVELS // 2
    level = lambda p, p0: np.where(p > 0, np.clip(np.rint(GRID * np.log2(np.maximum(p, 1e-300) / p0)) + half, 1, LEVELS - 1), 0).astype(np.int64)
    block = np.repeat(np.where(chunk.held, -1, np.arange(len(chunk.sizes)) % BLOCKS), chunk.sizes)
    cells, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in range(min(BLOCKS, len(chunk.sizes))):
        here = np.flatnonzero(block == b)
        left = words - np.bincount(chunk.word_at[here], minlength=len(words))
        n = np.bincount(chunk.pair_at[here], minlength=len(pairs))
        own = np.flatnonzero(n)
        context = left[chunk.pair_context[own]]
        p2, p1, p0 = Model(model.tokens - len(here), model.types, model.weights).probabilities(pairs[own] - n[own], left[chunk.pair_word[own]], context)
        cells.append((bucket(context) * LEVELS + level(p2, p0)) * LEVELS + level(p1, p0))
        times.append(n[own])
    cell, at = np.unique(np.concatenate(cells), return_inverse=True)
    return cell, np.bincount(at, np.concatenate(times), len(cell)).astype(np.int64)


def learn(cells: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM for the weights of each bucket; the weights over all buckets count as ten more events."""
    b, q2, q1 = cells // LEVELS**2, cells // LEVELS % LEVELS, cells % LEVELS
    ratio = np.stack([np.where(q > 0, 2.0 ** ((q - LEVELS // 2) / GRID), 0) for q in (q2, q1)] + [np.ones(len(cells))], 1)
    weights = np.tile(DEFAULT, (BUCKETS, 1)).astype(float)
    for _ in range(rounds if len(cells) else 0):
        got = weights[b] * ratio
        share = got / got.sum(1, keepdims=True) * n[:, None]
        all_ = share.sum(0) / share.sum()
        sums = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], 1) + 10 * all_
        weights = sums / sums.sum(1, keepdims=True)
    weights = np.maximum(weights, 1e-6)
    weights[0, 0] = 0.0  # no bigram estimate without a context
    return weights / weights.sum(1, keepdims=True)


SCORES = fields("held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_chunk(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, model: Model) -> list[pa.Array]:
    context = words[chunk.pair_context]
    p2, p1, p0 = model.probabilities(pairs, words[chunk.pair_word], context)
    w = model.weights[bucket(context)]
    by_pair = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
    by_word = np.log10((words + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
    added = lambda x: pa.array(np.add.reduceat(x, chunk.starts))
    known = added((words > 0).astype(np.int64)[chunk.word_at])
    return [pa.array(chunk.held), pa.array(chunk.sizes), known, pa.array(np.full(len(chunk.sizes), model.tokens)), added(by_word[chunk.word_at]), added(by_pair[chunk.pair_at])]


def score(docs: DataFrame, *, held_out=None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Train on the texts that aren't held out, then score all of them.

    Adds to the id: held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams) and
    score (log10 probability of the text under the mixture, its end included).  ``held_out`` is a
    boolean column; by default rows whose crc32 of the id as text leaves 1 modulo 5.  Null text
    counts as empty: only the end is scored.  A null id counts as training.  Repeated rows train
    and are scored each for itself.  A very long text is held whole, alone in its chunk if need be.
    Scores of equal texts are equal; nothing is ranked, so ties need no rule.  With nothing to train
    on, probabilities are uniform over the one unknown type.  No rows give none.  Other input
    columns are dropped, whatever their names.

    The documents are read twice and have to come in the same partitions and order, as files do; if
    they don't, the job fails and says so.
    """
    if held_out is None:
        held_out = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 1
    plan = Plan.of(docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0, chunk_bytes)
    asked = _chunked(docs, held_out, plan, id_col, text_col, ASK, lambda number, ids, chunk: [ask(number, chunk, plan)])
    told = keep(asked.groupBy("part").applyInArrow(tell, T.StructType(TELL)))
    total = told.where("chunk < 0").agg(F.sum("tokens"), F.sum("types")).first()
    model = Model(total[0] or 0, total[1] or 0, np.tile(DEFAULT, (BUCKETS, 1)))
    coded = _chunked(docs, held_out, plan, id_col, text_col, CODED, lambda number, ids, chunk: [code(number, ids, chunk)])
    answers = told.where("chunk >= 0").select("chunk", "digest", "part", "words", "pairs")
    ready = keep(coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answered, T.StructType(READY)))

    def cells_of(batches):
        for row in _rows(batches):
            yield _batch(CELLS, list(zip(*(x.tolist() for x in held_out_cells(*_ready(row, plan.pair_bits), model)))))

    cells = ready.mapInArrow(cells_of, T.StructType(CELLS)).groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    model.weights = learn(cells["cell"].to_numpy(), cells["n"].to_numpy().astype(float))
    out = T.StructType([docs.select(f"`{id_col}`").schema.fields[0], *SCORES])

    def scored(batches):
        for row in _rows(batches):
            ids = pa.ipc.open_stream(row["ids"]).read_all()["id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, *score_chunk(*_ready(row, plan.pair_bits), model)], names=out.names)

    return ready.mapInArrow(scored, out)
