"""Media columns: texts' bytes stored as PNG images, read back with checks, and hashed perceptually.

The payload becomes an 8-bit greyscale PNG of 64 samples a row. Reading walks the chunks, tests every
checksum, inflates the image data and undoes the row filters with numpy. The feature is a 64-bit hash
of the signs of the lowest frequencies of a 32 by 32 cosine transform of the image's block means.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandlake.llm.common import slices

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SIDE, _LOW = 32, 8
_COSINE = np.sqrt(2 / _SIDE) * np.cos(np.pi * (2 * np.arange(_SIDE) + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE))


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes of the text (null: empty) and zero bytes up to a positive multiple of WIDTH."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return data + b"\0" * (WIDTH - len(data) if not data else -len(data) % WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit greyscale PNG; the rows' filter (none, sub or up) is that of the least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    zero = np.zeros_like(rows[:1])
    tries = {0: rows, 1: np.diff(rows, axis=1, prepend=zero[:, :1].repeat(len(rows), 0)), 2: np.diff(rows, axis=0, prepend=zero)}
    cost = {k: int(np.abs(v[:256].view(np.int8).astype(np.int16)).sum()) for k, v in tries.items()}
    kind = min(cost, key=lambda k: (cost[k], k))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, tries[kind]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of one byte each from filtered rows; all five filters of the format."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lines)], strict=True):
        kind = int(kinds[a])
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].tolist() if y else [0] * out.shape[1]
                row, left, corner = out[y].tolist(), 0, 0
                for x, up in enumerate(above):
                    if kind == 3:
                        guess = (left + up) >> 1
                    else:
                        p = left + up - corner
                        guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    left, corner = (row[x] + guess) & 255, up
                    row[x] = left
                out[y] = row
        elif kind:
            raise ValueError(f"unknown row filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples (rows by columns) of an 8-bit greyscale PNG; ValueError if anything does not hold."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, size = 8, [], None
    while True:
        if at + 12 > len(data):
            raise ValueError("cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", part)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale")
            size = (height, width)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + n
    if size is None:
        raise ValueError("no header")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(lines) != size[0] * (size[1] + 1):
        raise ValueError("image data of another size")
    return _unfilter(lines.reshape(size[0], size[1] + 1))


def cosine_hash(image: np.ndarray) -> int:
    """64-bit hash: which of the 8 by 8 lowest frequencies (the mean left out) exceed their median."""
    image = np.repeat(image, -(-_SIDE // len(image)), axis=0) if len(image) < _SIDE else image
    ys = np.arange(_SIDE + 1) * len(image) // _SIDE
    xs = np.arange(_SIDE) * image.shape[1] // _SIDE
    across = np.add.reduceat(image, xs, axis=1, dtype=np.int64)
    small = np.add.reduceat(across, ys[:-1], axis=0) / np.diff(ys)[:, None]
    low = np.round((_COSINE @ small @ _COSINE.T).ravel(), 6)  # else noise decides where rows are equal
    low[0] = 0
    return int(np.packbits(low > np.median(low[1:])).view(">u8")[0])


def media_columns(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    media binary) for every row; all but media_* and n_bytes are computed from the bytes read back.

    Null text is stored as an empty one; equal texts give equal values; without with_media the
    image column is left out. Other columns of docs are ignored; an empty table gives an empty one.
    """
    fields = {"n_bytes": (T.LongType(), pa.int64()), "payload_bytes": (T.LongType(), pa.int64()), "payload_sha256": (T.StringType(), pa.string()), "tail_crc32": (T.LongType(), pa.int64()), "media_bytes": (T.LongType(), pa.int64()), "media_sha256": (T.StringType(), pa.string()), "feature": (T.StringType(), pa.string())}
    if with_media:
        fields["media"] = (T.BinaryType(), pa.binary())
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(k, v[0]) for k, v in fields.items())])
    names = schema.names

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                n = len(text.encode("utf-8", "surrogatepass")) if text else 0
                media = encode_png(payload_of(text))
                image = decode_png(media)
                back = image.tobytes()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), f"{cosine_hash(image):016x}", *([media] * with_media)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields.values(), strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(store, schema)
