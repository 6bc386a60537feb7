"""Media columns: texts as 8-bit grey PNG images in a binary column, read back chunk by chunk, with perceptual hashes.

``encode`` stores each payload as an image 64 samples wide; ``decode`` checks the signature and every chunk's CRC,
inflates the IDAT chunks, undoes the five PNG row filters with numpy and hashes the lowest frequencies of a cosine
transform. Both are narrow: no shuffle, memory of one Arrow batch.

Defined results: a null text is an empty one, and an empty one is 64 zero bytes; repeated rows give repeated rows; a
null id is kept; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

WIDTH = 64
#: Fixed values of the PNG format: signature, chunk layout, filter numbers.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """A grey image, 64 wide, with the one of the filters None, Sub and Up whose residues are least."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (rows, sub, up)]
    kind = int(np.argmin(cost))
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = (rows, sub, up)[kind]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo PNG row filters of one-byte pixels. Runs of None, Sub and Up go at once, the other two row by row."""
    out = np.empty_like(lines)
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    above = np.zeros(lines.shape[1], np.uint8)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        kind, part = int(kinds[a]), lines[a:b]
        if kind == NONE:
            out[a:b] = part
        elif kind == SUB:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == UP:
            np.cumsum(part, axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        elif kind in (AVERAGE, PAETH):
            for r in range(a, b):
                row, left, corner = np.empty_like(above), 0, 0
                for x, (v, u) in enumerate(zip(lines[r].tolist(), above.tolist(), strict=True)):
                    if kind == AVERAGE:
                        guess = (left + u) // 2
                    else:
                        p = left + u - corner
                        near = (abs(p - left), abs(p - u), abs(p - corner))
                        guess = (left, u, corner)[near.index(min(near))]
                    left, corner = (v + guess) & 255, u
                    row[x] = left
                out[r] = above = row
        else:
            raise ValueError(f"unknown row filter {kind}")
        above = out[b - 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit grey PNG; raises ValueError on a wrong signature, checksum, order or size."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, shape, ended = 8, [], None, False
    while at < len(data):
        if ended or at + 12 > len(data):
            raise ValueError("data after the end or a cut chunk")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, rest) != (8, 0, [0, 0, 0]):
                raise ValueError("only 8-bit grey images without interlace")
            shape = height, width
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or shape is None:
        raise ValueError("no end or no header")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if raw.size != shape[0] * (shape[1] + 1):
        raise ValueError("size of the image data")
    lines = raw.reshape(shape[0], shape[1] + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


_SIDE, _LOW = 32, 8
_COS = np.sqrt(2 / _SIDE) * np.cos(np.pi * (2 * np.arange(_SIDE)[None, :] + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE))
_COS[0] = np.sqrt(1 / _SIDE)


def dct_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the image, shrunk to 32 x 32, exceed their median."""
    h, w = pixels.shape
    p = pixels.astype(np.float64)
    for size, axis in ((h, 0), (w, 1)):
        if size >= _SIDE:
            edge = np.arange(_SIDE) * size // _SIDE
            width = np.diff(np.append(edge, size))
            p = np.add.reduceat(p, edge, axis=axis) / (width[:, None] if axis == 0 else width)
        else:
            p = np.take(p, np.arange(_SIDE) * size // _SIDE, axis=axis)
    low = np.round(_COS @ p @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            media = [encode_png(t + b"\0" * (-len(t) % WIDTH if t else WIDTH)) for t in texts]
            yield pa.record_batch([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """Adds to (id, n_bytes, media): payload (read back), dct_hash binary. A damaged image fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pixels = [decode_png(m) for m in b.column(2).to_pylist()]
            cols = [pa.array([p.tobytes() for p in pixels], pa.binary()), pa.array(map(dct_hash, pixels), pa.binary())]
            yield pa.record_batch([*b.columns, *cols], ["id", "n_bytes", "media", "payload", "dct_hash"])

    return media.select("id", "n_bytes", "media").mapInArrow(run, "id long, n_bytes long, media binary, payload binary, dct_hash binary")


def op2_query(spark, sf_dir):
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.selectExpr(
        "id AS doc_id", "n_bytes", "CAST(octet_length(payload) AS BIGINT) AS payload_bytes", "sha2(payload, 256) AS payload_sha256",
        "crc32(substring(payload, -64, 64)) AS tail_crc32", "CAST(octet_length(media) AS BIGINT) AS media_bytes", "sha2(media, 256) AS media_sha256", "lower(hex(dct_hash)) AS feature",
    )
