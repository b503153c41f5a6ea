"""Media columns: round trips, the reader against broken and odd images, the feature against a plain cosine transform."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from siltstone.llm import media

from test_operators import EDGES, documents, got


def test_media(spark):
    texts = EDGES + ["x" * 64, "x" * 63, "x" * 65]
    df = documents(spark, texts, feature="z", media="y", n_bytes="w")
    out = got(media.media_columns(df))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        samples = media.decode(bytes(r["media"]))
        assert samples.tobytes() == payload
        if len(payload) < 100_000:
            assert r["feature"] == plain_feature(samples)
    assert out[10]["feature"] == out[11]["feature"]
    assert media.media_columns(df.where("false")).count() == 0
    twice = media.media_columns(df.unionByName(df))
    assert twice.count() == 2 * len(texts) and twice.distinct().count() == len(texts)


def test_columns_are_read_from_the_stored_column(spark):
    stored = media.store_media(documents(spark, ["some text", "other"]))
    swapped = stored.selectExpr("doc_id", "n_bytes", "CASE WHEN doc_id = 0 THEN NULL ELSE media END AS media")
    rows = got(media.read_media(swapped))
    assert rows[0]["payload_bytes"] is None and rows[1]["payload_sha256"] == hashlib.sha256(b"other" + b"\0" * 59).hexdigest()


def plain_feature(samples):
    """Cell means of a 32 x 32 grid, their cosine transform by its definition, bits over the median of all but the first."""
    h, w = samples.shape
    cells = np.zeros((32, 32))
    for y in range(32):
        for x in range(32):
            y0, x0 = y * h // 32, x * w // 32
            cells[y, x] = samples[y0 : max(y0 + 1, (y + 1) * h // 32), x0 : max(x0 + 1, (x + 1) * w // 32)].mean()
    low = []
    for u in range(8):
        for v in range(8):
            cu = [math.cos(math.pi / 32 * (y + 0.5) * u) for y in range(32)]
            cv = [math.cos(math.pi / 32 * (x + 0.5) * v) for x in range(32)]
            low.append(round(sum(cells[y, x] * cu[y] * cv[x] for y in range(32) for x in range(32)), 6))
    rest = sorted(low[1:])
    bits = "".join("1" if x > rest[31] else "0" for x in low)
    return f"{int(bits, 2):016x}"


def paeth(a, b, c):
    p = a + b - c
    return a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c


@pytest.mark.parametrize("kinds", [(0, 1, 2, 3, 4), (3, 4), (4,), (3,), (4, 4, 4, 1)])
def test_all_filters_are_undone(kinds):
    rng = np.random.default_rng(0)
    for shape in ((25, 9), (1, 1), (3, 40), (70, 2)):
        x = rng.integers(0, 256, shape).astype(int)
        raw = np.zeros((shape[0], shape[1] + 1), np.uint8)
        for i in range(shape[0]):
            kind = kinds[i * 7 % len(kinds)]
            raw[i, 0] = kind
            for j in range(shape[1]):
                a, b, c = x[i, j - 1] if j else 0, x[i - 1, j] if i else 0, x[i - 1, j - 1] if i and j else 0
                raw[i, j + 1] = (x[i, j] - (0, a, b, (a + b) // 2, paeth(a, b, c))[kind]) % 256
        assert (media.unfilter(raw) == x).all()


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


HEAD = struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)
DATA = zlib.compress(bytes([0, 1, 2, 0, 3, 4]))
SIGN = b"\x89PNG\r\n\x1a\n"
GOOD = [(b"IHDR", HEAD), (b"tEXt", b"x"), (b"IDAT", DATA[:5]), (b"IDAT", DATA[5:]), (b"tIME", b""), (b"IEND", b"")]


def image(parts):
    return SIGN + b"".join(chunk(*p) for p in parts)


def test_a_good_image_of_another_writer():
    assert media.decode(image(GOOD)).tolist() == [[1, 2], [3, 4]]


@pytest.mark.parametrize("parts", [
    GOOD[1:], [GOOD[1], GOOD[0], *GOOD[2:]], [GOOD[0], *GOOD], [*GOOD[:3], GOOD[0], *GOOD[3:]], [(b"IHDR", HEAD[:-1]), *GOOD[1:]], [(b"IHDR", b""), *GOOD[1:]],
    [*GOOD[:3], GOOD[4], *GOOD[3:]], GOOD[:-1], [*GOOD, GOOD[1]], [*GOOD[:-1], (b"IEND", b"x")], [GOOD[0], GOOD[-1]], [*GOOD[:2], (b"PLTE", b"abc"), *GOOD[2:]],
    [GOOD[0], (b"IDAT", zlib.compress(bytes(7))), GOOD[-1]], [GOOD[0], (b"IDAT", zlib.compress(bytes(5))), GOOD[-1]], [GOOD[0], (b"IDAT", zlib.compress(bytes(10**7))), GOOD[-1]],
    [GOOD[0], (b"IDAT", DATA + b"tail"), GOOD[-1]], [GOOD[0], (b"IDAT", DATA[:-2]), GOOD[-1]], [GOOD[0], (b"IDAT", zlib.compress(bytes([5, 1, 2, 0, 3, 4]))), GOOD[-1]],
    [(b"IHDR", struct.pack(">IIBBBBB", 0, 2, 8, 0, 0, 0, 0)), *GOOD[1:]], [(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)), *GOOD[1:]], [(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 1)), *GOOD[1:]],
])
def test_order_and_sizes_are_tested(parts):
    with pytest.raises(media.BadImage):
        media.decode(image(parts))


def test_broken_images_are_refused():
    good = media.encode(bytes(range(128)))
    for bad in (b"", good[:-5], good + b"x", *(good[:i] + bytes([good[i] ^ 5]) + good[i + 1 :] for i in range(len(good)))):
        with pytest.raises(media.BadImage):
            media.decode(bad)
