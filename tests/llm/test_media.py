"""Operator 2: decoders, exact area means, payload round trips."""

import hashlib
import io
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pavewise.llm import media


def test_netpbm_forms():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(grey))[:, :, 0] == grey).all()
    assert (media.decode(b"P2 # note\n4 3\n15\n" + " ".join(map(str, grey.ravel())).encode())[:, :, 0] == grey).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 0 1\n")[:, :, 0].tolist() == [[0, 255, 0], [255, 255, 0]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b00100000]))[:, :, 0].tolist() == [[0, 255, 0], [255, 255, 0]]
    assert media.decode(b"P6\n1 2\n255\n" + bytes(range(6))).tolist() == [[[0, 1, 2]], [[3, 4, 5]]]
    assert media.decode(b"P3\n1 1\n255\n7 8 9").tolist() == [[[7, 8, 9]]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[[258]]]
    for bad in (b"", b"P5", b"P5\n4 4\n255\n\x00", b"GIF89a", b"P9\n"):
        with pytest.raises(ValueError):
            media.decode(bad)


def bmp(bits, rows, table=b"", flip=1):
    head = struct.pack("<IiiHHIIiiII", 40, 2, 2 * flip, 1, bits, 0, len(rows), 0, 0, len(table) // 4, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(table) + len(rows), 0, 0, 54 + len(table)) + head + table + rows


def test_bmp_forms():
    want = [[[1, 2, 3], [4, 5, 6]], [[7, 8, 9], [10, 11, 12]]]
    line = lambda px: b"".join(bytes(p[::-1]) for p in px) + b"\0\0"
    assert media.decode(bmp(24, line(want[1]) + line(want[0]))).tolist() == want
    assert media.decode(bmp(24, line(want[0]) + line(want[1]), flip=-1)).tolist() == want
    table = bytes([3, 2, 1, 0, 6, 5, 4, 0])
    assert media.decode(bmp(8, bytes([1, 0, 0, 0, 0, 1, 0, 0]), table)).tolist() == [[[1, 2, 3], [4, 5, 6]], [[4, 5, 6], [1, 2, 3]]]
    assert media.decode(bmp(1, bytes([0b10000000, 0, 0, 0, 0b01000000, 0, 0, 0]), table)).tolist() == [[[1, 2, 3], [4, 5, 6]], [[4, 5, 6], [1, 2, 3]]]


def test_bmp_masks_and_first_form():
    px = np.array([[0x00030201, 0x00060504], [0x00090807, 0x000C0B0A]], "<u4")
    head = struct.pack("<IiiHHIIiiII", 40, 2, -2, 1, 32, 3, 16, 0, 0, 0, 0)
    raw = b"BM" + struct.pack("<IHHI", 82, 0, 0, 66) + head + struct.pack("<III", 0xFF, 0xFF00, 0xFF0000) + px.tobytes()
    assert media.decode(raw).tolist() == [[[1, 2, 3], [4, 5, 6]], [[7, 8, 9], [10, 11, 12]]]
    five = np.array([[0x7C00, 0x03E0], [0x001F, 0x4210]], "<u2")
    raw = b"BM" + struct.pack("<IHHI", 62, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, -2, 1, 16, 0, 8, 0, 0, 0, 0) + five.tobytes()
    assert media.decode(raw).tolist() == [[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [132, 132, 132]]]
    table = bytes([3, 2, 1, 6, 5, 4])
    raw = b"BM" + struct.pack("<IHHI", 40, 0, 0, 32) + struct.pack("<IHHHH", 12, 2, 2, 1, 1) + table + bytes([0b10000000, 0, 0, 0, 0b01000000, 0, 0, 0])
    assert media.decode(raw).tolist() == [[[1, 2, 3], [4, 5, 6]], [[4, 5, 6], [1, 2, 3]]]


def test_area_resize_is_exact(monkeypatch):
    monkeypatch.setattr(media, "BLOCK", 3)
    x = np.random.default_rng(0).integers(0, 256, (7, 10, 2))
    big = x.repeat(6, 0).repeat(9, 1)  # 42 x 90: a multiple of 6 x 9 cells
    got = media.area_resize(x, 6, 9)
    want = big.reshape(6, 7, 9, 10, 2).mean((1, 3))
    assert np.allclose(got, want)


def plain_means(x, height, width):
    """Area means one cell at a time, from each sample's share of it."""
    h, w = x.shape
    share = lambda n, parts, i, k: max(0.0, min((i + 1) * n / parts, k + 1) - max(i * n / parts, k))
    rows = np.array([[share(h, height, i, k) for k in range(h)] for i in range(height)])
    cols = np.array([[share(w, width, i, k) for k in range(w)] for i in range(width)])
    return rows @ x @ cols.T / (h / height * (w / width))


def plain_feature(pad):
    x = np.frombuffer(pad, np.uint8).reshape(-1, 64).astype(float)
    cells = np.round(plain_means(x, 8, 9), 6)
    bits = "".join("1" if a < b else "0" for row in cells for a, b in zip(row, row[1:], strict=False))
    means = np.rint(plain_means(np.rint(plain_means(x, 16, 16)), 4, 4)).astype(int)
    return f"{int(bits, 2):016x}" + "".join(f"{v:02x}" for v in means.ravel())


def test_payload_query(odd, none, texts):
    got = media.payload_features(media.store_texts(odd)).collect()
    want = Counter()
    for i, t in texts:
        raw = t.encode()
        rows = max(1, -(-len(raw) // 64))
        pad = raw.ljust(rows * 64, b"\0")
        pic = b"P5\n64 %d\n255\n" % rows + pad
        want[(i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), len(pic), hashlib.sha256(pic).hexdigest(), plain_feature(pad))] += 1
    assert Counter(map(tuple, got)) == want
    assert media.payload_features(media.store_texts(none)).count() == 0


def test_tiles(spark):
    pic = media.encode_pgm(np.tile(np.arange(64, dtype=np.uint8), (64, 1)))
    rows = spark.createDataFrame([(1, pic), (2, b"junk"), (3, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.tiles(rows, 16).collect()}
    assert got[1]["dhash"] == "ff" * 8 and (got[1]["height"], got[1]["channels"]) == (64, 1)
    assert np.load(io.BytesIO(got[1]["tile"])).shape == (16, 16, 1)
    assert got[2]["tile"] is None and got[3]["dhash"] is None
