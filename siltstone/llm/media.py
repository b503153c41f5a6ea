"""Media columns: texts as PNG samples in binary columns, read back and hashed by their low cosine frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import SLICE, map_texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
LEVEL = 1
SIDE, LOW = 32, 8


class BadImage(ValueError):
    """The bytes are no PNG that this reader takes, or one of its checksums is wrong."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG of ``payload``, whose length is a positive multiple of ``width``; one filter for all rows.

    The filter (none, sub or up) is the one with the smallest sum of absolute differences.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    if not rows.size:
        raise BadImage("an image needs a row")
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = [int(np.minimum(x, -x).sum(dtype=np.int64)) for x in (rows, sub, up)]
    kind = cost.index(min(cost))
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0], out[:, 1:] = kind, (rows, sub, up)[kind]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kinds and bodies up to IEND, with lengths and checksums tested; nothing may follow."""
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (length,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + length], data[at + 8 + length : at + 12 + length]
        if len(body) < length or struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))) != crc:
            raise BadImage(f"checksum of {kind!r}")
        at += 12 + length
        yield kind, body
        if kind == b"IEND":
            if body or at != len(data):
                raise BadImage("something follows the end")
            return
    raise BadImage("cut short")


def _size(body: bytes) -> tuple[int, int]:
    if len(body) != 13:
        raise BadImage("a header has 13 bytes")
    width, height, *form = struct.unpack(">IIBBBBB", body)
    if form != [8, 0, 0, 0, 0] or not 0 < width < 2**31 or not 0 < height < 2**31:
        raise BadImage("not a grey 8-bit image")
    return width, height


def decode(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG that isn't interlaced: signature, order, sizes and checksums are tested, all five filters undone.

    The header comes first and once, the parts of the data in a row; data is inflated to the header's size and not beyond it.
    """
    if data[:8] != SIGNATURE:
        raise BadImage("no signature")
    size, parts, closed = None, [], False
    for i, (kind, body) in enumerate(_chunks(data)):
        if (kind == b"IHDR") != (i == 0):
            raise BadImage("the header comes first and once")
        if kind == b"IHDR":
            size = _size(body)
        elif kind == b"IDAT":
            if closed:
                raise BadImage("data in two places")
            parts.append(body)
        else:
            closed = bool(parts)
            if kind != b"IEND" and not kind[0] & 32:
                raise BadImage(f"unknown chunk {kind!r}")
    width, height = size
    whole, inflate = height * (width + 1), zlib.decompressobj()
    try:
        raw = np.frombuffer(inflate.decompress(b"".join(parts), whole + 1), np.uint8)
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if raw.size != whole or not inflate.eof or inflate.unused_data:
        raise BadImage("samples missing or too many")
    return unfilter(raw.reshape(height, width + 1))


def _swept(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of average (3) and Paeth (4) filters undone along diagonals: all samples whose left, upper and corner ones are known at once."""
    n, width = rows.shape
    out = np.zeros((n + 1, width + 1), np.int32)
    out[0, 1:] = above
    average = kinds == 3
    for d in range(n + width - 1):
        i = np.arange(max(0, d - width + 1), min(n, d + 1))
        j = d - i
        left, up, corner = out[i + 1, j], out[i, j + 1], out[i, j]
        p = left + up - corner
        to_left, to_up, to_corner = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[i + 1, j + 1] = (rows[i, j] + np.where(average[i], (left + up) >> 1, paeth)) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(raw: np.ndarray) -> np.ndarray:
    """Runs of rows with one kind of filter are undone together, those that look left and up along their diagonals."""
    kinds, rows = raw[:, 0], raw[:, 1:]
    if (kinds > 4).any():
        raise BadImage(f"filter {int(kinds.max())}")
    out = np.empty_like(rows)
    group = np.minimum(kinds, 3)
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(kinds)]
    above = np.zeros(rows.shape[1], np.uint8)
    for a, b in zip(starts, starts[1:], strict=False):
        part = rows[a:b]
        if group[a] == 0:
            out[a:b] = part
        elif group[a] == 1:
            out[a:b] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif group[a] == 2:
            out[a:b] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        else:
            out[a:b] = _swept(kinds[a:b], part, above)
        above = out[b - 1]
    return out


_COS = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5)[None, :] * np.arange(LOW)[:, None])


def shrink(samples: np.ndarray) -> np.ndarray:
    """Means of a SIDE x SIDE grid of cells over the image; a cell holds one sample at least."""
    out = samples.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        a = np.arange(SIDE) * n // SIDE
        b = np.maximum(a + 1, (np.arange(SIDE) + 1) * n // SIDE)
        total = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        width = (b - a).reshape((-1, 1) if axis == 0 else (1, -1))
        out = (total.take(b, axis) - total.take(a, axis)) / width
    return out


def feature(samples: np.ndarray) -> str:
    """64 bits as hex: which of the LOW x LOW lowest cosine coefficients lie over their median, the mean left out of it."""
    low = (_COS @ shrink(samples) @ _COS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def stored_form(text: str | None) -> tuple[int, bytes]:
    """A text's bytes, and the image of its payload: the bytes with zeros up to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return len(raw), encode(raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH)))


def read_back(media: bytes) -> tuple:
    """From an image alone: payload bytes, their digest, the checksum of the last 64, the image's size and digest, and its feature."""
    samples = decode(media)
    back = samples.tobytes()
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)


COLUMNS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes of the text, and its PNG in the binary column ``media``.

    Null is stored as the empty text, which is one row of 64 zeros. Equal texts give equal images, repeated rows a row each, an empty
    table none. Columns other than the two named aren't read.
    """

    def make():
        def work(texts):
            rows = [stored_form(x) for x in texts]
            return {"n_bytes": [n for n, _ in rows], "media": [m for _, m in rows]}

        return work

    return map_texts(docs, [id_col], text_col, make, "n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """``stored`` with what its binary column ``media`` says when it is read; a null image gives nulls, a bad one raises BadImage."""
    schema = StructType([*stored.schema.fields, *StructType.fromDDL(SCHEMA).fields])
    arrow, at = to_arrow_schema(StructType.fromDDL(SCHEMA)), stored.columns.index("media")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                rows = [(None,) * len(COLUMNS) if m is None else read_back(m) for m in batch.column(at).to_pylist()]
                made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return stored.mapInArrow(read, schema)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the text's PNG in the binary column ``media``, and what was read back from that column.

    Rows are those of ``store_media``; the columns come from ``read_media``.
    """
    return read_media(store_media(docs, id_col, text_col)).select(F.col(f"`{id_col}`"), "n_bytes", *COLUMNS, "media")
