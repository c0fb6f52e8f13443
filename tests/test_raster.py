import struct
import zlib

import numpy as np
import pytest

from docquarry.functions.fax import MODES, FaxError, fax_rows, run_codes
from docquarry.functions.raster import Raster, dib, fax, jpeg_info, png
from docquarry.plans.fixtures import jpeg


def encode(rows):
    """A plain Group 4 coder for round trips, written from the recommendation's flow chart."""
    back = {m: c for c, m in MODES.items()}
    runs = [{n: c for c, n in run_codes(b).items()} for b in (False, True)]

    def length(n, colour):
        out = ""
        while n >= 2560:
            out, n = out + runs[colour][2560], n - 2560
        if n >= 64:
            out, n = out + runs[colour][n // 64 * 64], n % 64
        return out + runs[colour][n]

    out, width = "", rows.shape[1]
    above = np.zeros(width, int)
    for row in rows:
        at, colour = -1, 0

        def change(line, start, now):
            for x in range(max(start, 0), width):
                if line[x] != now:
                    return x
            return width

        def b_one():
            for x in range(at + 1, width):
                if above[x] != colour and (above[x - 1] if x else 0) == colour:
                    return x
            return width

        while at < width:
            a1, b1 = change(row, at, colour), b_one()
            b2 = change(above, b1, 1 - colour) if b1 < width else width
            if b2 < a1:
                out, at = out + back["pass"], b2
            elif abs(a1 - b1) <= 3:
                out, at, colour = out + back[a1 - b1], a1, 1 - colour
            else:
                a2 = change(row, a1, 1 - colour)
                out += back["runs"] + length(a1 - max(at, 0), colour) + length(a2 - a1, 1 - colour)
                at = a2
        above = row
    out += "000000000001" * 2
    return int(out.ljust((len(out) + 7) // 8 * 8, "0"), 2).to_bytes((len(out) + 7) // 8, "big")


@pytest.mark.parametrize("black", [False, True])
def test_run_codes_are_free_of_prefixes(black):
    codes = sorted(run_codes(black))
    assert len(codes) == 104 and not any(b.startswith(a) for a, b in zip(codes, codes[1:]))


@pytest.mark.parametrize("seed,shape,share", [(0, (20, 37), 0.5), (1, (9, 3000), 0.01), (2, (30, 64), 0.1), (3, (6, 6000), 0.001), (4, (5, 1), 0.5)])
def test_fax_round_trip(seed, shape, share):
    rng = np.random.default_rng(seed)
    rows = (rng.random(shape) < share).astype(int)
    rows[shape[0] // 2 :] |= rows[: shape[0] - shape[0] // 2]
    data = encode(rows)
    assert fax_rows(data, shape[1], shape[0]) == np.packbits(rows.astype(np.uint8), axis=1).tobytes()
    with pytest.raises(FaxError):
        fax_rows(data[: len(data) // 3], shape[1], shape[0])


def test_literal_pixels():
    bits = "0000001111" + "01" + "1" + "000001" + "00000001" + "0" + "1"  # white black, black, 5 white, end with 1 white, then white to the edge
    data = int(bits.ljust(40, "0"), 2).to_bytes(5, "big")
    assert fax_rows(data, 12, 1) == np.packbits([0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0]).tobytes()


def test_fax_of_no_size_or_no_data():
    assert fax(b"", 0, 1) is None and fax(b"", 8, 1) is None and fax(b"\x80", 1 << 20, 1 << 20) is None


def head(w, h, bits, compression=0, used=0):
    return struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, compression, 0, 0, 0, used, 0)


def test_bitmaps():
    two = b"\0\0\0\0\xff\xff\xff\0"
    up = dib(head(9, 2, 1) + two + b"\x80\x80\0\0" + b"\1\0\0\0")
    assert (up.stride, up.bilevel, up.rows) == (2, True, b"\1\0\x80\x80")
    assert dib(head(1, -2, 24) + b"\1\2\3\0\4\5\6\0").rows == b"\3\2\1\6\5\4"
    assert dib(head(1, 1, 16, 3) + struct.pack("<3I", 0xF800, 0x7E0, 0x1F) + b"\xff\xff\0\0").rows == b"\xff\xff\xff"
    assert dib(head(1, 1, 32) + b"\1\2\3\4").rows == b"\3\2\1"
    assert dib(head(1, 1, 5)) is None and dib(b"") is None and dib(head(1 << 15, 1 << 15, 24)) is None


def test_run_length_bitmaps():
    eight = dib(head(4, 2, 8, 1, 2) + b"\0" * 8 + bytes([3, 1, 0, 0, 0, 3, 5, 6, 7, 0, 0, 1]))
    assert eight.rows == bytes([5, 6, 7, 0, 1, 1, 1, 0])
    four = dib(head(4, -1, 4, 2, 16) + b"\0" * 64 + bytes([3, 0x12, 0, 1]))
    assert four.rows == bytes([1, 2, 1, 0])
    assert dib(head(4, 2, 8, 1, 1) + b"\0" * 4 + bytes([0, 5, 1])) is None


def test_png_is_readable():
    raw = png(Raster(2, 1, 24, [], b"\1\2\3\4\5\6"))
    assert raw.startswith(b"\x89PNG") and zlib.decompress(raw[raw.index(b"IDAT") + 4 : -16]) == b"\0\1\2\3\4\5\6"
    ink = png(Raster(3, 1, 1, [(255, 255, 255), (9, 8, 7)], b"\xa0"), stencil=True)
    assert zlib.decompress(ink[ink.index(b"IDAT") + 4 : -16]) == b"\0" + bytes([9, 8, 7, 255, 0, 0, 0, 0, 9, 8, 7, 255])


def test_jpeg_density():
    assert jpeg_info(jpeg(10, 20)).known_density is False
    jfif = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\2" + struct.pack(">HH", 100, 50) + b"\0\0"
    got = jpeg_info(jpeg(10, 20)[:2] + jfif + jpeg(10, 20)[2:])
    assert (got.width, got.height, got.components, got.dpi_x, got.dpi_y) == (10, 20, 1, 254.0, 127.0)
    assert jpeg_info(b"\xff\xd8\xff\xd9\0\2") is None and jpeg_info(b"") is None
