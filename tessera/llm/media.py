"""PNG images in binary columns: written and read with zlib and numpy, and hashed by low cosine frequencies."""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.errors import DataError
from tessera.llm.common import as_bytes, fields, map_documents
from tessera.sources import png

WIDTH = 64
SMALL, LOW = 32, 8


def filter_rows(rows: np.ndarray) -> np.ndarray:
    """Each row behind its filter byte: of None, Sub and Up the one with the least sum of absolute
    residuals; ties take the first."""
    signed = rows.view(np.int8)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    sums = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for x in (signed, sub, up)])
    best = sums.argmin(0)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = np.where((best == 0)[:, None], rows, np.where((best == 1)[:, None], sub, up))
    return out


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A grayscale image of 8-bit samples."""
    height, width = samples.shape
    body = zlib.compress(filter_rows(samples).tobytes(), level)
    return png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + png.chunk(b"IDAT", body) + png.chunk(b"IEND", b"")


def read_png(data: bytes, most_bytes: int = 1 << 31) -> np.ndarray:
    """Samples as (height, width, samples per pixel) of an 8-bit, not interlaced image.

    Tests the signature, every chunk's CRC-32, the order of chunks, and the exact inflated length.
    ``most_bytes`` bounds what a header may ask to inflate; a longer image is refused, not cut.
    """
    if data[: len(png.SIGNATURE)] != png.SIGNATURE:
        raise DataError("no signature")
    header, body, ended = None, [], False
    for kind, piece, _ in png.walk(data):
        if ended or (kind == b"IHDR") != (header is None):
            raise DataError("chunk out of place")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", piece) if len(piece) == 13 else (0,) * 7
        elif kind == b"IDAT":
            body.append(piece)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32 and kind != b"PLTE":
            raise DataError("unknown critical chunk")
    if header is None or not ended or not body:
        raise DataError("incomplete")
    width, height, depth, colour, packing, filtering, interlace = header
    if depth != 8 or colour not in png.SAMPLES or packing or filtering or interlace or not width or not height:
        raise DataError("form not taken")
    bpp = png.SAMPLES[colour]
    want = height * (1 + width * bpp)
    if want > most_bytes:
        raise DataError("too large")
    raw = png.inflate(b"".join(body), want)
    return png.defilter(np.frombuffer(raw, np.uint8).reshape(height, -1), bpp).reshape(height, width, bpp)


@functools.lru_cache(maxsize=1)
def cosines() -> np.ndarray:
    """The first LOW rows of the cosine transform of SMALL points."""
    k, n = np.arange(LOW)[:, None], np.arange(SMALL)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SMALL))


def shrink(gray: np.ndarray) -> np.ndarray:
    """Means over a SMALL x SMALL grid of blocks; sides shorter than the grid repeat samples."""
    for axis in (0, 1):
        n = gray.shape[axis]
        if n < SMALL:
            gray = np.take(gray, np.arange(SMALL) * n // SMALL, axis)
        else:
            cuts = np.arange(SMALL) * n // SMALL
            size = np.diff(np.append(cuts, n))
            gray = np.add.reduceat(gray, cuts, axis) / (size[:, None] if axis == 0 else size[None, :])
    return gray


def cosine_hash(gray: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies lie above the median of all but the constant one."""
    c = cosines()
    low = np.round(c @ shrink(gray.astype(np.float64)) @ c.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def to_samples(raw: bytes) -> np.ndarray:
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    return np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH)


def store_as_png(docs: DataFrame, *, text_col: str = "text", keep=("doc_id",), level: int = 6) -> DataFrame:
    """Adds media (binary): the UTF-8 bytes of a text, padded with zeros to a positive multiple of 64,
    as a grayscale image 64 wide, and n_bytes, their unpadded number.  Null text counts as empty (64
    zeros); texts of any length are stored whole; equal texts and repeated rows give equal images; of
    filters that leave equal residuals the first is taken; no rows give none.  Input columns other than
    those of ``keep`` are dropped, and one of those named like an output gives way."""

    def make():
        def kernel(texts: pa.Array) -> dict:
            raw = as_bytes(texts)
            return {"media": [write_png(to_samples(x), level) for x in raw], "n_bytes": [len(x) for x in raw]}

        return kernel

    return map_documents(docs, make, fields("media binary, n_bytes bigint"), text_col=text_col, keep=keep)


def read_images(images: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Adds payload (binary, the samples), feature (hex of the cosine hash) and error.

    A null or damaged image gives null payload and feature and says why in error; the job goes on.
    Colour images are hashed by the mean of their samples; frequencies equal to the median count as not
    above it.  Columns named like the outputs give way.  Images of over 2 GiB of samples are refused.
    """
    out = fields("payload binary, feature string, error string")
    names = {f.name for f in out}
    kept = [c for c in images.columns if c not in names]
    schema = images.select(*[f"`{c}`" for c in kept]).schema
    at = kept.index(media_col)

    def run(batches):
        for batch in batches:
            payload, feature, error = [], [], []
            for data in batch.column(at).to_pylist():
                try:
                    if data is None:
                        raise DataError("null")
                    samples = read_png(data)
                    made = samples.tobytes(), cosine_hash(samples.mean(2) if samples.shape[2] > 1 else samples[:, :, 0]).hex(), None
                except DataError as e:
                    made = None, None, str(e)
                for column, value in zip((payload, feature, error), made):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary()), pa.array(feature, pa.string()), pa.array(error, pa.string())], names=[*kept, *(f.name for f in out)])

    for f in out:
        schema = schema.add(f)
    return images.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)
