"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized, tiled as NPY, with difference hashes.

Resizing averages areas by an integral image: sums up to every pixel corner, read between corners by linear
interpolation, which is exact for pixels of constant value. Any size maps to any other in time linear in the pixels.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavewise.llm.common import documents, pick, prepare, stored

ROW = 64  # samples in a row of a byte payload's picture
SIDE = 16  # of a payload picture's tile
BLOCK = 4096  # rows of a picture that are summed up at once
TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode(raw: bytes) -> np.ndarray:
    """Samples as (height, width, channels) uint8, or uint16 where a Netpbm file's maximum is over 255.

    Netpbm P1 to P6; BMP without compression at 1, 4, 8, 16, 24 or 32 bits, or with bit masks. A bitmap's samples are 0 and 255. Other bytes,
    and files cut short, raise ValueError.
    """
    if raw[:1] == b"P" and raw[1:2] in b"123456" and len(raw) > 2:
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at, head = raw[1] - ord("0"), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        if not (m := TOKEN.match(raw, at)):
            raise ValueError("header cut short")
        head.append(int(m[1]))
        at = m.end()
    (w, h), top = head[:2], head[2] if len(head) > 2 else 1
    channels = 3 if kind in (3, 6) else 1
    n = w * h * channels
    if kind == 4:
        lines = np.frombuffer(raw, np.uint8, h * (-(-w // 8)), at + 1).reshape(h, -1)
        return ((1 - np.unpackbits(lines, axis=1)[:, :w]) * 255).astype(np.uint8)[:, :, None]
    if kind == 1:
        digits = np.array([c - 48 for c in re.sub(rb"#[^\n]*", b"", raw[at:]) if c in b"01"][:n], np.uint8)
        return ((1 - digits.reshape(h, w)) * 255).astype(np.uint8)[:, :, None]
    kind_of = np.dtype(np.uint8 if top < 256 else ">u2")
    if kind in (2, 3):
        samples = np.array(re.sub(rb"#[^\n]*", b"", raw[at:]).split()[:n], np.int64)
    else:
        samples = np.frombuffer(raw, kind_of, n, at + 1)
    return samples.reshape(h, w, channels).astype(np.uint8 if top < 256 else np.uint16)


def _bmp(raw: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<II", raw, 10)
    if head == 12:  # the first form: 16-bit sizes, and a table of three bytes a colour
        w, h, _, bits = struct.unpack_from("<HHHH", raw, 18)
        packed, colours, wide = 0, 0, 3
    else:
        w, h, _, bits, packed = struct.unpack_from("<iiHHI", raw, 18)
        colours, wide = struct.unpack_from("<I", raw, 46)[0], 4
    if packed not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or packed == 3 and bits not in (16, 32):
        raise ValueError("BMP of a kind that is not read here")
    flip, h = h > 0, abs(h)
    stride = (w * bits + 31) // 32 * 4
    lines = np.frombuffer(raw, np.uint8, stride * h, start).reshape(h, stride)
    lines = lines[::-1] if flip else lines
    if bits == 16 or packed == 3:
        masks = struct.unpack_from("<III", raw, 54) if packed == 3 else (0x7C00, 0x03E0, 0x001F)
        words = np.ascontiguousarray(lines[:, : w * bits // 8]).view(f"<u{bits // 8}").astype(np.uint32)
        return np.stack([_field(words, m) for m in masks], 2)
    if bits >= 24:
        return np.ascontiguousarray(lines[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1])
    table = np.frombuffer(raw, np.uint8, wide * (colours or 1 << bits), 14 + head).reshape(-1, wide)[:, 2::-1]
    index = lines if bits == 8 else np.unpackbits(lines, axis=1) if bits == 1 else np.stack([lines >> 4, lines & 15], 2).reshape(h, -1)
    if index[:, :w].size and index[:, :w].max() >= len(table):
        raise ValueError("a colour that the table lacks")
    return table[index[:, :w]]


def _field(words: np.ndarray, mask: int) -> np.ndarray:
    """The bits under a mask as samples of 0 to 255; an empty mask gives 0."""
    if not mask:
        return np.zeros(words.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return np.rint(((words & np.uint32(mask)) >> np.uint32(low)) * (255.0 / most)).astype(np.uint8)


def encode_pgm(samples: np.ndarray) -> bytes:
    """P5 of a (height, width) uint8 array."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, as float64; (height, width, channels).

    The integral image is built by blocks of rows and kept only at the target's corners, so besides the samples memory
    holds one block.
    """
    h, w, c = samples.shape

    def corner(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * (size / parts)
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    (xs, fx), (ys, fy) = corner(w, width), corner(h, height)
    total, done = np.zeros((height + 1, width + 1, c)), np.zeros((width + 1, c))
    for top in range(0, h, BLOCK):
        sums = np.zeros((len(block := samples[top : top + BLOCK]), w + 1, c))
        np.cumsum(block, axis=1, dtype=np.float64, out=sums[:, 1:])
        lines = sums[:, xs] * (1 - fx)[:, None] + sums[:, xs + 1] * fx[:, None]  # each row's integral at the target's columns
        upto = np.concatenate([done[None], done + np.cumsum(lines, axis=0)])
        for i in np.flatnonzero((ys >= top) & (ys < top + len(block))):
            total[i] = upto[ys[i] - top] + fy[i] * lines[ys[i] - top]
        done = upto[-1]
    return np.diff(np.diff(total, axis=0), axis=1) / (h / height * (w / width))


def difference_hash(samples: np.ndarray) -> str:
    """16 hex digits: for 8 rows of 9 cells of the grey picture, whether each cell is darker than its right one."""
    cells = np.round(area_resize(samples.mean(axis=2, keepdims=True), 8, 9)[:, :, 0], 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(samples), allow_pickle=False)
    return out.getvalue()


def tiles(df: DataFrame, side: int = 32, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, height, width, channels, dhash, tile): the picture's size, hash and a side x side NPY tile (uint8 means).

    Null media, and bytes that can't be decoded, give a row with nulls but for doc_id; pictures without pixels too.
    """
    prepare(df.sparkSession)
    rows = pick(df, doc_id=id_col, media=media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                try:
                    samples = decode(raw or b"")
                    if not samples.size:
                        raise ValueError("no pixels")
                    tile = np.clip(np.rint(area_resize(samples, side, side)), 0, 65535).astype(samples.dtype)
                    out.append((*samples.shape, difference_hash(samples), npy(tile)))
                except (ValueError, struct.error, IndexError):
                    out.append((None,) * 5)
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 3 + [pa.string(), pa.binary()], strict=True)]], ["doc_id", "height", "width", "channels", "dhash", "tile"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, height int, width int, channels int, dhash string, tile binary")


def payload_media(text: Column) -> Column:
    """A text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, as the samples of a P5 picture 64 wide."""
    size = F.greatest(F.ceil(F.octet_length(text) / ROW), F.lit(1))
    pad = F.unhex(F.repeat(F.lit("00"), (size * ROW - F.octet_length(text)).cast("int")))
    return F.concat(F.concat(F.lit(f"P5\n{ROW} "), size.cast("string"), F.lit("\n255\n")).cast("binary"), text.cast("binary"), pad)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) written to the shared folder and read back; built by column expressions alone.

    Null and empty texts are one block of padding, a very long text is one tall picture; repeated rows and a null doc_id
    stay; an empty table gives none. Extra columns, whatever their names, are not looked at.
    """
    docs = documents(df, id_col, text_col)
    return stored(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), payload_media(F.col("text")).alias("media")), "media")


def stored_tiles(df: DataFrame) -> DataFrame:
    """Digests of stored payload pictures (doc_id, n_bytes, media) with their difference hash and NPY tile, written to the
    shared folder and read back."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(2).to_pylist():
                samples = decode(raw)
                payload = samples.data
                tile = np.rint(area_resize(samples, SIDE, SIDE)).astype(np.uint8)
                out.append((samples.size, hashlib.sha256(payload).hexdigest(), zlib.crc32(samples[-1].tobytes()), len(raw), hashlib.sha256(raw).hexdigest(), difference_hash(samples), npy(tile)))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)]], ["doc_id", "n_bytes", *NAMES])

    kind = df.schema["doc_id"].dataType.simpleString()
    return stored(df.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary"), "media-tiles")


NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dhash", "tile"]
KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def payload_features(df: DataFrame) -> DataFrame:
    """Digests of stored payload pictures (doc_id, n_bytes, media): what is read back, its form, and the feature.

    The feature is the difference hash and the 4 x 4 area means of the NPY tile as it is read back, in hex; equal texts
    have equal features. Null and empty texts were stored as one row of 64 samples 0; repeated rows give equal rows, an
    empty table none. Of a very long text a task holds the bytes and one block of rows.
    """
    rows = stored_tiles(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = [np.load(io.BytesIO(t), allow_pickle=False) for t in batch.column("tile").to_pylist()]
            means = [np.rint(area_resize(t, 4, 4)).astype(np.uint8).tobytes().hex() for t in tiles]
            feature = pa.array([d + m for d, m in zip(batch.column("dhash").to_pylist(), means, strict=True)], pa.string())
            yield pa.record_batch([*[batch.column(c) for c in kept], feature], [*kept, "feature"])

    kept = ["doc_id", "n_bytes", *NAMES[:5]]
    kind = df.schema["doc_id"].dataType.simpleString()
    return rows.select(*kept, "dhash", "tile").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
