"""Pictures as packed rows: device-independent bitmaps in, PNG out, and what JPEG markers say."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from .fax import MAX_PIXELS, FaxError, fax_rows

# Kinds of bitmap compression.
PLAIN, RLE8, RLE4, FIELDS = 0, 1, 2, 3


@dataclass
class Raster:
    """bits is 1, 4, 8 (indices into the palette) or 24 (red, green, blue)."""

    width: int
    height: int
    bits: int
    palette: list[tuple[int, int, int]]
    rows: bytes
    mask: bool = False

    def as_mask(self) -> None:
        """Of a bitmap of one bit that is drawn by `and`: black is what the mask paints, whichever way its palette goes."""
        if self.palette[1] == (0, 0, 0):
            self.rows = bytes(np.bitwise_not(np.frombuffer(self.rows, np.uint8)))
        self.mask = True

    @property
    def stride(self) -> int:
        return (self.width * self.bits + 7) // 8

    def ink(self) -> int:
        """How many pixels are black."""
        rows = np.frombuffer(self.rows, np.uint8)
        if self.bits == 24:
            return int((rows.reshape(-1, 3) == 0).all(axis=1).sum())
        black = np.array([c == (0, 0, 0) for c in self.palette] + [False] * ((1 << self.bits) - len(self.palette)))
        if self.bits == 8:
            return int(black[rows].sum())
        packed = np.unpackbits(rows.reshape(self.height, self.stride), axis=1)[:, : self.width * self.bits]
        if self.bits == 1:
            return int(black[packed].sum())
        return int(black[packed.reshape(self.height, self.width, 4) @ np.array([8, 4, 2, 1])].sum())

    @property
    def bilevel(self) -> bool:
        return self.bits == 1 and sorted(self.palette) == [(0, 0, 0), (255, 255, 255)]


def fax(data: bytes, width: int, height: int) -> Raster | None:
    try:
        return Raster(width, height, 1, [(255, 255, 255), (0, 0, 0)], fax_rows(data, width, height))
    except FaxError:
        return None


@dataclass
class DibHeader:
    size: int
    width: int
    height: int
    bits: int
    compression: int
    colours: int
    bottom_up: bool

    @property
    def bits_at(self) -> int:
        """Where pixels begin when they follow header and palette at once."""
        masks = 12 if self.compression == FIELDS and self.size == 40 else 0
        return self.size + masks + 4 * self.colours


def dib_header(info: bytes) -> DibHeader | None:
    if len(info) < 40:
        return None
    size, w, h, _, bits, compression, _, _, _, used, _ = struct.unpack_from("<IiiHHIIiiII", info)
    if not 40 <= size <= 256 or w <= 0 or not h or bits not in (1, 4, 8, 16, 24, 32):
        return None
    colours = used if used else 1 << bits if bits <= 8 else 0
    return DibHeader(size, w, abs(h), bits, compression, min(colours, 256), h > 0)


def _palette(info: bytes, h: DibHeader) -> list[tuple[int, int, int]]:
    at = h.bits_at - 4 * h.colours
    whole = info[at : at + 4 * h.colours]
    colours = [(whole[k + 2], whole[k + 1], whole[k]) for k in range(0, len(whole) - 3, 4)]
    return (colours + [(0, 0, 0)] * (1 << h.bits))[: 1 << h.bits]


def _source_rows(bits: bytes, stride: int, used: int, h: DibHeader) -> np.ndarray:
    """Rows from the top. The first row that the data lacks, and those below it, stay zero."""
    out = np.zeros((h.height, used), np.uint8)
    have = np.frombuffer(bits, np.uint8)
    for y in range(h.height):
        at = stride * (h.height - 1 - y if h.bottom_up else y)
        if at + used > len(have):
            break
        out[y] = have[at : at + used]
    return out


def _scaled(pixels: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    return ((pixels & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * 255 // top


def _true_colour(info: bytes, bits: bytes, h: DibHeader) -> bytes:
    step = h.bits // 8
    src = _source_rows(bits, (h.width * h.bits + 31) // 32 * 4, h.width * step, h).reshape(h.height, h.width, step)
    if h.bits == 24:
        return src[:, :, ::-1].tobytes()
    pixels = np.ascontiguousarray(src).view("<u2" if step == 2 else "<u4")[:, :, 0].astype(np.uint32)
    masks = (0x7C00, 0x3E0, 0x1F) if step == 2 else (0xFF0000, 0xFF00, 0xFF)
    if h.compression == FIELDS and len(info) >= 52:
        masks = struct.unpack_from("<3I", info, 40)
    return np.stack([_scaled(pixels, m) for m in masks], axis=2).astype(np.uint8).tobytes()


def _run_lengths(src: bytes, h: DibHeader, nibbles: bool) -> np.ndarray | None:
    """Indices as the runs lay them, first row first; None where a step or literal run is cut off."""
    out = np.zeros((h.height, h.width), np.uint8)

    def lay(values: np.ndarray) -> None:
        room = values[: max(h.width - x, 0)]
        out[y, x : x + len(room)] = room

    split = lambda raw: np.stack([raw >> 4, raw & 15], axis=1).reshape(-1) if nibbles else raw
    at, x, y = 0, 0, 0
    while at + 1 < len(src) and y < h.height:
        n, code = src[at], src[at + 1]
        at += 2
        if n:
            lay(np.resize(split(np.array([code], np.uint8)), n))
            x += n
        elif code == 0:
            x, y = 0, y + 1
        elif code == 1:
            break
        elif code == 2:
            if at + 2 > len(src):
                return None
            x, y, at = x + src[at], y + src[at + 1], at + 2
        else:
            size = (code + 1) // 2 if nibbles else code
            if at + size > len(src):
                return None
            lay(split(np.frombuffer(src, np.uint8, size, at))[:code])
            x, at = x + code, at + size + size % 2
    return out


def dib(info: bytes, bits: bytes | None = None) -> Raster | None:
    """A bitmap from its header and palette, and its pixels where they stand apart; None if it is none or too large."""
    h = dib_header(info)
    if h is None or h.width * h.height > MAX_PIXELS:
        return None
    if bits is None:
        bits = info[h.bits_at :]
    if h.compression in (PLAIN, FIELDS) and h.bits > 8:
        return Raster(h.width, h.height, 24, [], _true_colour(info, bits, h))
    if h.compression == PLAIN:
        rows = _source_rows(bits, (h.width * h.bits + 31) // 32 * 4, (h.width * h.bits + 7) // 8, h)
        return Raster(h.width, h.height, h.bits, _palette(info, h), rows.tobytes())
    if (h.compression, h.bits) not in ((RLE8, 8), (RLE4, 4)):
        return None
    laid = _run_lengths(bits, h, h.bits == 4)
    if laid is None:
        return None
    laid = laid[::-1] if h.bottom_up else laid
    palette = (_palette(info, h) + [(0, 0, 0)] * 256)[:256]
    return Raster(h.width, h.height, 8, palette, laid.tobytes())


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(raster: Raster, stencil: bool = False) -> bytes:
    """With `stencil`, set bits of a one-bit picture show in the palette's second colour and others are clear."""
    head = lambda depth, colour: struct.pack(">IIBBBBB", raster.width, raster.height, depth, colour, 0, 0, 0)
    rows = np.frombuffer(raster.rows, np.uint8).reshape(raster.height, raster.stride)
    chunks = []
    if stencil and raster.bits == 1:
        on = np.unpackbits(rows, axis=1)[:, : raster.width]
        ink = np.array([*raster.palette[1], 255], np.uint8)
        rows = (on[:, :, None] * ink).reshape(raster.height, -1)
        chunks = [_chunk(b"IHDR", head(8, 6))]
    elif raster.bits == 24:
        chunks = [_chunk(b"IHDR", head(8, 2))]
    else:
        chunks = [_chunk(b"IHDR", head(raster.bits, 3)), _chunk(b"PLTE", bytes(c for rgb in raster.palette for c in rgb))]
    lines = np.concatenate([np.zeros((raster.height, 1), np.uint8), rows.astype(np.uint8)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + b"".join(chunks) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


@dataclass
class JpegInfo:
    width: int
    height: int
    components: int
    dpi_x: float
    dpi_y: float
    known_density: bool


def jpeg_info(raw: bytes) -> JpegInfo | None:
    """What the markers up to the start of frame say. Without a density in dots an inch or centimetre, 72 is taken."""
    if raw[:2] != b"\xff\xd8":
        return None
    at, dpi, known = 2, (72.0, 72.0), False
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            return None
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        n = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + n]
        if n < 2 or marker in (0xD9, 0xDA):
            return None
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if len(body) < 6:
                return None
            h, w = struct.unpack_from(">HH", body, 1)
            return JpegInfo(w, h, body[5], *dpi, known)
        if marker == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 12:
            unit, x, y = struct.unpack_from(">BHH", body, 7)
            if unit in (1, 2) and x and y:
                scale = 1.0 if unit == 1 else 2.54
                dpi, known = (x * scale, y * scale), True
        at += 2 + n
    return None
