"""Texts as images: Netpbm and BMP in, NPY tiles and difference hashes out.

A payload is stored as an 8-bit image (PGM, PPM or BMP). The stored bytes are parsed into a NumPy
array, resized by area with an integral image, and the tile is written as NPY; its difference hash
is the feature. Readers and writers are this module's own and take nothing but bytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hold, map_texts

#: Samples in a row of the stored image; tile height and width (one column more than hash bits in a row); rows summed at once.
WIDTH, TILE, BAND = 64, (8, 9), 1 << 12


def write_netpbm(pixels: np.ndarray) -> bytes:
    """P5 for (height, width) samples, P6 for (height, width, 3)."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if pixels.ndim == 2 else 6, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def read_netpbm(stored: bytes) -> np.ndarray:
    """P5 and P6 with 8-bit samples; comments in the header are passed over."""
    fields, at = [], 0
    while len(fields) < 4:
        while stored[at : at + 1].isspace():
            at += 1
        if stored[at : at + 1] == b"#":
            at = stored.index(b"\n", at) + 1
            continue
        end = at
        while end < len(stored) and not stored[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the header breaks off")
        fields.append(stored[at:end])
        at = end
    kind, w, h, most = fields[0], *map(int, fields[1:])
    if kind not in (b"P5", b"P6") or not 0 < most < 256:
        raise ValueError(f"not an 8-bit binary Netpbm: {kind!r}, {most}")
    depth = 3 if kind == b"P6" else 1
    pixels = np.frombuffer(stored, np.uint8, w * h * depth, at + 1)
    return pixels.reshape((h, w, 3) if depth == 3 else (h, w))


def write_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey with a palette, or 24-bit from (height, width, 3) in red, green, blue; bottom row first, rows padded to 4 bytes."""
    h, w = pixels.shape[:2]
    bits = 8 if pixels.ndim == 2 else 24
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) if bits == 8 else np.zeros((0, 4), np.uint8)
    if bits == 8:
        palette = palette.copy()
        palette[:, 3] = 0
    line = pixels.reshape(h, -1) if bits == 8 else pixels[:, :, ::-1].reshape(h, -1)
    rows = np.zeros((h, (line.shape[1] + 3) // 4 * 4), np.uint8)
    rows[:, : line.shape[1]] = line
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, rows.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + rows[::-1].tobytes()


def read_bmp(stored: bytes) -> np.ndarray:
    """Uncompressed 8-bit (by its palette; grey ones become two-dimensional) and 24-bit; either row order."""
    if stored[:2] != b"BM":
        raise ValueError("not a BMP")
    start, size, w, h, _, bits, packing, _, _, _, used = struct.unpack("<IIiiHHIIiiI", stored[10:50])
    if bits not in (8, 24) or packing:
        raise ValueError(f"{bits} bits with compression {packing} aren't read")
    up, h = h > 0, abs(h)
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(stored, np.uint8, stride * h, start).reshape(h, stride)[:, : w * bits // 8]
    rows = rows[::-1] if up else rows
    if bits == 24:
        return rows.reshape(h, w, 3)[:, :, ::-1]
    palette = np.frombuffer(stored, np.uint8, 4 * (used or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][rows]
    return palette[rows]


def read_image(stored: bytes) -> np.ndarray:
    return read_bmp(stored) if stored[:2] == b"BM" else read_netpbm(stored)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the source area of each target pixel, by an integral image with linear interpolation at fractional borders.

    The integral image is made band by band; only the rows next to a border are kept."""
    h, w = pixels.shape[:2]
    grey = pixels if pixels.ndim == 2 else pixels.astype(np.uint16).sum(2) // 3

    def borders(n, parts):
        x = np.arange(parts + 1) * n / parts
        low = np.minimum(x.astype(np.int64), n)
        return low, np.minimum(low + 1, n), x - low

    top, below, part = borders(h, height)
    wanted = np.unique(np.concatenate([top, below]))
    kept = np.zeros((len(wanted), w + 1))
    carry = np.zeros(w + 1, np.int64)
    for s in range(0, h, BAND):
        band = np.zeros((min(BAND, h - s) + 1, w + 1), np.int64)
        band[0] = carry
        np.cumsum(np.cumsum(grey[s : s + BAND], axis=1, dtype=np.int64), axis=0, out=band[1:, 1:])
        band[1:, 1:] += carry[1:]
        here = (wanted > s) & (wanted <= s + len(band) - 1)
        kept[here] = band[wanted[here] - s]
        carry = band[-1].copy()
    at = {y: i for i, y in enumerate(wanted.tolist())}
    lines = np.array([kept[at[a]] * (1 - f) + kept[at[b]] * f for a, b, f in zip(top.tolist(), below.tolist(), part.tolist(), strict=True)])
    left, right, part = borders(w, width)
    corners = lines[:, left] * (1 - part) + lines[:, right] * part
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / ((h / height) * (w / width))


def difference_hash(tile: np.ndarray) -> str:
    """A bit for each pair of neighbours in a row: is the right one brighter."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def as_image(payload: bytes, width: int = WIDTH, form: str = "pgm") -> bytes:
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    return write_bmp(pixels) if form == "bmp" else write_netpbm(pixels)


def image_features(stored: bytes, tile: tuple[int, int] = TILE) -> tuple[np.ndarray, bytes, str]:
    """(decoded pixels, NPY bytes of the resized tile, difference hash) of a stored image."""
    pixels = read_image(stored)
    small = np.rint(area_resize(pixels, *tile)).astype(np.uint8)
    return pixels, npy(small), difference_hash(small)


def form_of(payload: bytes) -> str:
    """The format that a payload is stored in where both are used, by its checksum, so equal payloads go into one."""
    return ("pgm", "bmp")[zlib.crc32(payload) & 1]


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text", form: str = "both", with_media: bool = False) -> DataFrame:
    """Each text as a stored image and what is read back from it.

    Returns (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, form, tile[,
    media]): tile is the NPY file of the resized image, which feature hashes. The payload is the UTF-8 text with bytes 0 up to a positive multiple of WIDTH, so a null or
    empty text is one row of zeros; the digests are of what the decoder gives back. Equal texts give equal values;
    repeated rows stay; other columns are not carried; nothing is shuffled. form: pgm, bmp, or both, see form_of.
    """
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "form": "string", "tile": "binary"}
    names |= {"media": "binary"} if with_media else {}

    def work():
        hold("media")

        def run(texts):
            cols = [[] for _ in names]
            for t in texts:
                raw = t.encode()
                payload = raw + b"\0" * ((-len(raw)) % WIDTH or WIDTH * (not raw))
                kind = form_of(payload) if form == "both" else form
                stored = as_image(payload, form=kind)
                pixels, tile, feature = image_features(stored)
                back = pixels.tobytes()
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{feature}:{hashlib.sha256(tile).hexdigest()[:16]}", kind, tile, stored)
                for c, x in zip(cols, row[: len(names)], strict=True):
                    c.append(x)
            return cols

        return run

    return map_texts(df, key, text, work, ", ".join(f"{a} {b}" for a, b in names.items()), [pa.field(a, kinds[b]) for a, b in names.items()]).withColumnRenamed("key", key)
