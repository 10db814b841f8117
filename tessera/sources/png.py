"""PNG files as relations: pixels and properties out of binary files, errors as rows.

Limits are tested from the header, before anything is inflated.  A bad file never ends the job.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import DataError, Fault, IoError

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Limits, samples and depths by colour type, and the seven interlace passes (x0, y0, dx, dy).
MOST_FILE, MOST_SIDE, MOST_PIXELS = 256 << 20, 32768, 64 << 20
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Names of the conversions by colour type, and of those that come on top.
CONVERSIONS = {
    0: "gray:replicate-sample-to-rgb", 2: "truecolor:alpha-255", 3: "palette:plte-lookup",
    4: "gray-alpha:replicate-gray-to-rgb;alpha-passthrough", 6: "rgba:passthrough",
}
SUB_BYTE, ROUNDED = "gray-sub-byte-scale:v*255//(2^bit_depth-1)", "16-to-8-rounding:(v*255+32767)//65535"
KEYED, BY_ENTRY = "trns:colorkey-binary-alpha(native-source-sample-match)", "trns:palette-entry-alpha(default-255)"
LACED = "adam7:seven-pass-reassembly"


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


@dataclass
class Image:
    width: int
    height: int
    depth: int
    colour: int
    interlaced: bool
    rgba: np.ndarray
    palette: list[tuple[int, ...]] | None = None
    transparency: bytes | None = None
    gamma: int | None = None
    profile: tuple[str, int] | None = None
    conversions: list[str] = field(default_factory=list)


def passes(width: int, height: int, interlaced: bool) -> list[tuple[int, ...]]:
    """(x0, y0, dx, dy, columns, rows) of each pass that has pixels."""
    grid = PASSES if interlaced else ((0, 0, 1, 1),)
    got = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in grid]
    return [p for p in got if p[4] > 0 and p[5] > 0]


def row_bytes(columns: int, depth: int, colour: int) -> int:
    return (columns * depth * SAMPLES[colour] + 7) // 8


def header(body: bytes, most_pixels: int = MOST_PIXELS) -> tuple[int, ...]:
    if len(body) != 13:
        raise DataError("IHDR must have 13 bytes")
    w, h, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", body)
    if not w or not h:
        raise DataError("image dimensions must be positive")
    if colour not in SAMPLES:
        raise DataError(f"unknown colour type {colour}")
    if depth not in DEPTHS[colour]:
        raise DataError(f"bit depth {depth} isn't legal for colour type {colour}")
    if packing or filtering:
        raise DataError("unknown compression or filter method")
    if interlace > 1:
        raise DataError("unknown interlace method")
    if w > MOST_SIDE or h > MOST_SIDE:
        raise DataError("image dimension over the limit")
    if w * h > most_pixels:
        raise DataError("pixel count over the limit")
    if sum(r * (1 + row_bytes(c, depth, colour)) for *_, c, r in passes(w, h, bool(interlace))) > most_pixels * 8:
        raise DataError("scanline bytes over the limit")
    return w, h, depth, colour, interlace


@dataclass
class Parsed:
    """What the chunks of a file say, before anything is inflated."""

    header: tuple[int, ...] = ()
    palette: bytes | None = None
    transparency: bytes | None = None
    gamma: int | None = None
    profile: tuple[str, int] | None = None
    data: list[bytes] = field(default_factory=list)


def profile_of(body: bytes) -> tuple[str, int]:
    """Name and compressed size of a colour profile."""
    name, zero, rest = body.partition(b"\0")
    if not name or not zero:
        raise DataError("malformed iCCP chunk: missing profile name terminator")
    if not rest or rest[0]:
        raise DataError("unsupported iCCP compression method")
    return name.decode("latin-1"), len(rest) - 1


def walk(data: bytes):
    """Kinds and bodies of all chunks in order, each with its frame and checksum tested."""
    at = len(SIGNATURE)
    while at < len(data):
        if at + 12 > len(data):
            raise DataError("truncated chunk framing")
        n, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + n > len(data):
            raise DataError(f"truncated {kind!r} chunk")
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise DataError(f"CRC mismatch in {kind!r} chunk")
        at += 12 + n
        yield kind, body, at


def parse(data: bytes, most_pixels: int = MOST_PIXELS) -> Parsed:
    """Placement and number of the chunks tested: a header first and once, at most one palette and
    transparency, an empty end that is last, no unknown critical chunk.  Of repeated gamma and
    profile chunks the last counts; unknown ancillary ones are passed over."""
    if data[: len(SIGNATURE)] != SIGNATURE:
        raise DataError("missing PNG signature")
    got = Parsed()
    for kind, body, after in walk(data):
        if not got.header and kind != b"IHDR":
            raise DataError("first chunk must be IHDR")
        if kind == b"IHDR":
            if got.header:
                raise DataError("duplicate IHDR chunk")
            got.header = header(body, most_pixels)
        elif kind == b"PLTE":
            if got.palette is not None:
                raise DataError("duplicate PLTE chunk")
            got.palette = body
        elif kind == b"tRNS":
            if got.transparency is not None:
                raise DataError("duplicate tRNS chunk")
            got.transparency = body
        elif kind == b"gAMA":
            if len(body) != 4:
                raise DataError("gAMA chunk must be 4 bytes")
            got.gamma = int.from_bytes(body, "big")
        elif kind == b"iCCP":
            got.profile = profile_of(body)
        elif kind == b"IDAT":
            got.data.append(body)
        elif kind == b"IEND":
            if body:
                raise DataError("IEND chunk must be empty")
            if after != len(data):
                raise DataError("trailing bytes after the IEND chunk")
            return got
        elif not kind[0] & 32:
            raise DataError(f"unknown critical chunk {kind!r}")
    raise DataError("missing IEND chunk")


def inflate(data: bytes, want: int) -> bytes:
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, want + 1)
    except zlib.error as e:
        raise DataError(f"bad zlib stream: {e}") from None
    if len(out) > want:
        raise DataError("image data too long")
    if not z.eof:
        raise DataError("truncated image data" if not z.unconsumed_tail else "image data too long")
    if z.unused_data:
        raise DataError("bytes after the zlib stream")
    if len(out) != want:
        raise DataError("image data too short")
    return out


def defilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of filter byte and samples, undone from the top.

    Sub rows are running sums along the row, runs of Up rows running sums down the columns.  In runs
    of Average and Paeth a sample needs its left and upper neighbours, so runs of any size to speak
    of go by anti-diagonals, whose samples are independent.
    """
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise DataError(f"unknown filter {int(kinds.max())}")
    subs = np.flatnonzero(kinds == 1)
    if len(subs):
        out[subs] = np.cumsum(out[subs].reshape(len(subs), -1, bpp), 1, dtype=np.uint8).reshape(len(subs), -1)
    family = np.array([0, 0, 2, 3, 3], np.uint8)[kinds]
    edges = np.flatnonzero(family[1:] != family[:-1]) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)]):
        if family[lo : lo + 1] == 2:
            first = max(lo - 1, 0)
            out[first:hi] = np.cumsum(out[first:hi], 0, dtype=np.uint8)
        elif family[lo : lo + 1] == 3:
            above = out[lo - 1] if lo else np.zeros_like(out[0])
            work = _diagonals if (hi - lo) * out.shape[1] > 600 * (hi - lo + out.shape[1] // bpp) else _by_sample
            out[lo:hi] = work(out[lo:hi], above, kinds[lo:hi], bpp)
    return out


def _by_sample(raw: np.ndarray, above: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    up, out = [0] * bpp + above.tolist(), []
    for kind, line in zip(kinds.tolist(), raw):
        got = [0] * bpp + line.tolist()
        for i in range(bpp, len(got)):
            a, b, c = got[i - bpp], up[i], up[i - bpp]
            if kind == 3:
                p = (a + b) // 2
            else:
                da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                p = a if da <= db and da <= dc else b if db <= dc else c
            got[i] = got[i] + p & 255
        out.append(got[bpp:])
        up = got
    return np.array(out, np.uint8)


def _diagonals(raw: np.ndarray, above: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    h, w = len(raw), raw.shape[1] // bpp
    grid = np.zeros((h + 1, w + 1, bpp), np.int16)
    grid[0, 1:] = above.reshape(w, bpp)
    raw, mean = raw.reshape(h, w, bpp), (kinds == 3)[:, None]
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, c = grid[y + 1, x], grid[y, x + 1], grid[y, x]
        da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        p = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        grid[y + 1, x + 1] = (raw[y, x] + np.where(mean[y], (a + b) >> 1, p)) & 255
    return grid[1:, 1:].astype(np.uint8).reshape(h, -1)


def samples(rows: np.ndarray, columns: int, depth: int, channels: int) -> np.ndarray:
    if depth == 16:
        return rows.reshape(len(rows), -1, 2).view(">u2")[..., 0].astype(np.uint16)
    if depth == 8:
        return rows.astype(np.uint16)
    bits = np.unpackbits(rows, axis=1)[:, : columns * channels * depth].reshape(len(rows), -1, depth)
    return bits.astype(np.uint16) @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint16)


def to_rgba(values: np.ndarray, depth: int, colour: int, palette, transparency) -> np.ndarray:
    """Samples (rows, columns, channels) as 8-bit RGBA.

    A colour key is compared with the samples as they are, before rounding; a key beyond the depth's
    range matches nothing.
    """
    if colour == 3:
        idx = values[..., 0]
        if idx.size and int(idx.max()) >= len(palette):
            raise DataError(f"palette index {int(idx.max())} out of range ({len(palette)} entries)")
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(transparency or b"")] = list(transparency or b"")
        return np.concatenate([np.array(palette, np.uint8), alpha[:, None]], 1)[idx]
    eight = ((values.astype(np.uint32) * 255 + 32767) // 65535 if depth == 16 else values * (255 // ((1 << depth) - 1))).astype(np.uint8)
    rgb = eight[..., :3] if colour in (2, 6) else np.repeat(eight[..., :1], 3, -1)
    if colour in (4, 6):
        alpha = eight[..., -1:]
    elif transparency is not None:
        key = np.frombuffer(transparency, ">u2").astype(np.uint16)
        alpha = np.where((values == key).all(-1), 0, 255).astype(np.uint8)[..., None]
    else:
        alpha = np.full((*values.shape[:2], 1), 255, np.uint8)
    return np.concatenate([rgb, alpha], -1)


def conversions(depth: int, colour: int, interlaced: bool, keyed: bool) -> list[str]:
    """What was done to the samples, in order; ``keyed``: a transparency chunk was applied."""
    every = (
        (CONVERSIONS[colour], True), (SUB_BYTE, colour == 0 and depth < 8), (ROUNDED, depth == 16),
        (KEYED, keyed and colour in (0, 2)), (BY_ENTRY, keyed and colour == 3), (LACED, interlaced),
    )
    return [name for name, holds in every if holds]


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> Image:
    if len(data) > MOST_FILE:
        raise DataError(f"input over {MOST_FILE} bytes")
    got = parse(data, most_pixels)
    w, h, depth, colour, interlace = got.header
    if not got.data:
        raise DataError("missing IDAT chunk")
    palette, trns = None, got.transparency
    if got.palette is not None:
        if len(got.palette) % 3 or not 3 <= len(got.palette) <= 768:
            raise DataError("PLTE must hold 1 to 256 entries of 3 bytes")
        palette = [tuple(got.palette[i : i + 3]) for i in range(0, len(got.palette), 3)]
    if colour == 3 and palette is None:
        raise DataError("palette image without PLTE chunk")
    if colour in (4, 6):
        trns = None
    elif trns is not None and (len(trns) > len(palette) if colour == 3 else len(trns) != (2, None, 6)[colour]):
        raise DataError("tRNS length doesn't fit the colour type")
    grid = passes(w, h, bool(interlace))
    raw = inflate(b"".join(got.data), sum(r * (1 + row_bytes(c, depth, colour)) for *_, c, r in grid))
    rgba, at, n = np.zeros((h, w, 4), np.uint8), 0, SAMPLES[colour]
    for x0, y0, dx, dy, columns, rows in grid:
        size = 1 + row_bytes(columns, depth, colour)
        block = np.frombuffer(raw, np.uint8, rows * size, at).reshape(rows, size)
        at += rows * size
        values = samples(defilter(block, max(1, n * depth // 8)), columns, depth, n).reshape(rows, columns, n)
        rgba[y0::dy, x0::dx] = to_rgba(values, depth, colour, palette, trns)
    return Image(w, h, depth, colour, bool(interlace), rgba, palette, trns, got.gamma, got.profile, conversions(depth, colour, bool(interlace), trns is not None))


def read_file(path: str) -> bytes:
    """A single file, never more of it than the limit and one byte."""
    try:
        with Path(path).open("rb") as f:
            data = f.read(MOST_FILE + 1)
    except OSError as e:
        raise IoError(f"cannot read {path}: {e.strerror}") from None
    if len(data) > MOST_FILE:
        raise DataError(f"cannot decode {path}: input over {MOST_FILE} bytes")
    return data


def read_files(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Files as image_id, path, length, content; the id follows from the path.

    The content of files over the limit is never read: it is null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = [F.xxhash64("path").alias("image_id"), "path", "length"]
    small = files.where(F.col("length") <= MOST_FILE).select(*named, "content")
    return small.unionByName(files.where(F.col("length") > MOST_FILE).select(*named, F.lit(None).cast("binary").alias("content")))


DECODED = pa.schema([
    ("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32()), ("color_type", pa.int32()), ("interlaced", pa.bool_()), ("rgba", pa.binary()),
    ("plte", pa.binary()), ("trns", pa.binary()), ("gama", pa.int64()), ("iccp", pa.struct([("name", pa.string()), ("profile_bytes", pa.int64())])),
    ("conversions", pa.list_(pa.string())), ("error_kind", pa.string()), ("error_message", pa.string()),
])


def decode_images(images: DataFrame, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row per image: size, properties, RGBA bytes, or an error with its kind and message."""
    schema = ("image_id bigint, width int, height int, depth int, color_type int, interlaced boolean, rgba binary, plte binary, trns binary, gama bigint, "
              "iccp struct<name:string,profile_bytes:bigint>, conversions array<string>, error_kind string, error_message string")

    def row(name: int, data: bytes | None) -> dict:
        try:
            if data is None:
                raise DataError(f"no content, or more than {MOST_FILE} bytes")
            i = decode(data, most_pixels)
        except Fault as e:
            return {"image_id": name, "error_kind": e.kind, "error_message": e.message}
        return {
            "image_id": name, "width": i.width, "height": i.height, "depth": i.depth, "color_type": i.colour, "interlaced": i.interlaced, "rgba": i.rgba.tobytes(),
            "plte": i.palette and bytes(x for c in i.palette for x in c), "trns": i.transparency, "gama": i.gamma,
            "iccp": i.profile and dict(zip(("name", "profile_bytes"), i.profile)), "conversions": i.conversions,
        }

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_pylist([row(name, data.as_py())], schema=DECODED)

    content = F.when(F.length("content") <= MOST_FILE, F.col("content")).alias("content")
    return images.select("image_id", content).mapInArrow(run, schema)


def pixels(decoded: DataFrame) -> DataFrame:
    """Pixels of decoded images: image_id, pos, y, x, r, g, b, a."""

    def run(batches):
        for batch in batches:
            for name, w, rgba in zip(*(batch.column(i).to_pylist() for i in range(3))):
                v = np.frombuffer(rgba, np.uint8).reshape(-1, 4)
                for lo in range(0, len(v), 1 << 18):
                    part = v[lo : lo + (1 << 18)].astype(np.int64)
                    pos = np.arange(lo, lo + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), name)), *(pa.array(x) for x in (pos, pos // w, pos % w, *part.T))], names=["image_id", "pos", "y", "x", "r", "g", "b", "a"])

    return decoded.where("error_kind is null").select("image_id", "width", "rgba").mapInArrow(run, "image_id bigint, pos bigint, y bigint, x bigint, r bigint, g bigint, b bigint, a bigint")
