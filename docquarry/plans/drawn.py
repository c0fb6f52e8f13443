"""Containers whose pages are drawn from table rows: metafiles in coded bodies, fax pictures, bitmaps, previews, overlays and display pages."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.fax import run_codes
from ..functions.lzh import stored
from .fixtures import container, num, of_orders, page, preview, raw_jpeg, tlv

A4 = (21000, 29700)
DEVICE = (4961, 7016)


# ---- enhanced metafiles


def record(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 4)
    return struct.pack("<II", kind, 8 + len(body)) + body


def ints(kind: int, *values: int) -> bytes:
    return record(kind, struct.pack(f"<{len(values)}i", *values))


def words(kind: int, *values: int) -> bytes:
    return record(kind, struct.pack(f"<{len(values)}I", *values))


def colour(r: int, g: int, b: int) -> int:
    return r | g << 8 | b << 16


def emf(records: list[bytes]) -> bytes:
    head = struct.pack("<4i4i4sIIIHHIIIiiii", 0, 0, *DEVICE, 0, 0, *A4, b" EMF", 0x10000, 0, len(records) + 2, 8, 0, 0, 0, 0, *DEVICE, 210, 297)
    return record(1, head) + b"".join(records) + words(14, 0, 0, 20)


def font(handle: int, height: int, escapement: int, weight: int, underline: bool, face: str = "Mincho", charset: int = 128) -> bytes:
    body = struct.pack("<IiiiiiBBBB4B", handle, height, 0, escapement, 0, weight, 0, underline, 0, charset, 0, 0, 0, 0)
    return record(82, body + face.encode("utf-16-le").ljust(64, b"\0"))


def text(x: int, y: int, raw: bytes, steps: list[int], wide: bool = False) -> bytes:
    n = len(raw) // (2 if wide else 1)
    at = 76 + len(raw) + -len(raw) % 4
    head = struct.pack("<4iIffiiIII4iI", 0, 0, 0, 0, 1, 1.0, 1.0, x, y, n, 76, 0, 0, 0, 0, 0, at)
    return record(84 if wide else 83, head + raw + bytes(-len(raw) % 4) + struct.pack(f"<{len(steps)}i", *steps))


def blit(x: int, y: int, w: int, h: int) -> bytes:
    return record(76, struct.pack("<4iiiiiI", 0, 0, 0, 0, x, y, w, h, 0xF00021) + bytes(56))


def bitmap(w: int, h: int, bits: int, palette: list[tuple[int, int, int]], rows: list[bytes], compression: int = 0) -> tuple[bytes, bytes]:
    """Header with palette, and pixels, rows from the bottom."""
    data = b"".join(r + bytes(-len(r) % 4) for r in reversed(rows)) if not compression else b"".join(rows)
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, compression, len(data), 0, 0, len(palette), 0)
    return head + b"".join(bytes((b, g, r, 0)) for r, g, b in palette), data


def stretched(x: int, y: int, w: int, h: int, source: tuple[int, int, int, int], dib: tuple[bytes, bytes], code: int) -> bytes:
    info, data = dib
    at = 80
    head = struct.pack("<4i6i4IIIii", 0, 0, 0, 0, x, y, *source, at, len(info), at + len(info), len(data), 0, code, w, h)
    return record(81, head + info + data)


# ---- private comments


def comment(name: bytes, body: bytes = b"") -> bytes:
    return record(70, struct.pack("<I", len(name + body)) + name + body)


def comment_16(name: bytes, body: bytes = b"") -> bytes:
    return short(0x0626, struct.pack("<HH", 15, len(name + body)) + name + body)


def placed(x: int, y: int, w: int, h: int, sw: int, sh: int, code: int) -> bytes:
    """The name is the first of fifteen numbers."""
    return comment(b"DWc\0", struct.pack("<14i", 0, 0, 0, 0, x, y, 0, 0, sw, sh, 0, _signed(code), w, h))


def _signed(code: int) -> int:
    return code - (1 << 32) if code >> 31 else code


def inline_picture(dib: tuple[bytes, bytes]) -> bytes:
    info, data = dib
    at = 12 + 4 + 16
    return comment(b"DWa\0", struct.pack("<4I", at, len(info), at + len(info), len(data)) + info + data)


def wide_points(op: int, points: list[tuple[int, int]]) -> bytes:
    return comment(b"DW" + bytes((op, 0)), struct.pack("<I", len(points)) + b"".join(struct.pack("<ii", *p) for p in points))


def short_points(op: int, points: list[tuple[int, int]]) -> bytes:
    return comment(b"DW" + bytes((op, 0x20)), struct.pack("<I", len(points)) + b"".join(struct.pack("<hh", *p) for p in points))


def step_points(op: int, points: list[tuple[int, int]], halves: bool = False) -> bytes:
    """The first point, then steps of octets, or of half octets where those are large enough (an octet behind -8 else)."""
    out = b""
    for (a, b), (x, y) in zip(points, points[1:]):
        if halves:
            extra = b""
            byte = 0
            for step in (x - a, y - b):
                small = -7 <= step <= 7
                byte = byte << 4 | (step if small else -8) & 15
                extra += b"" if small else struct.pack("b", step)
            out += bytes([byte]) + extra
        else:
            out += struct.pack("bb", x - a, y - b)
    return comment(b"DW" + bytes((op, 0x80 if halves else 0x40)), struct.pack("<Ihh", len(points), *points[0]) + out)


# ---- plain metafiles


def short(kind: int, body: bytes) -> bytes:
    body += bytes(len(body) % 2)
    return struct.pack("<IH", 3 + len(body) // 2, kind) + body


def shorts(kind: int, *values: int) -> bytes:
    return short(kind, struct.pack(f"<{len(values)}h", *values))


def wmf(records: list[bytes]) -> bytes:
    body = b"".join(records) + shorts(0)
    return struct.pack("<HHHIHIH", 1, 9, 0x300, 9 + len(body) // 2, 8, 64, 0) + body


# ---- fax


def fax_bar(left: int, ink: int, width: int, height: int) -> bytes:
    """A Group 4 picture of one black bar from top to bottom: its first row told by runs, the others as before."""
    white, black = ({n: c for c, n in run_codes(b).items()} for b in (False, True))
    run = lambda table, n: (table[n // 64 * 64] if n >= 64 else "") + table[n % 64]
    bits = "001" + run(white, left) + run(black, ink) + "1" + "111" * (height - 1) + "000000000001" * 2
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def fax_page(coded: bytes, w: int, h: int) -> bytes:
    return page(num(0x80, 9) + num(0x84, A4[0]) + num(0x85, A4[1]) + num(0x87, w) + num(0x88, h) + tlv(0x86, coded))


# ---- pages and properties


def coded_page(raw: bytes, paper: tuple[int, int] = A4) -> bytes:
    return page(num(0x80, 4) + num(0x81, len(raw)) + num(0x84, paper[0]) + num(0x85, paper[1]) + tlv(0x86, stored(raw)))


def bare_page(coded: bytes) -> bytes:
    return page(coded)


def bitmap_page(dib: tuple[bytes, bytes], packed: bool) -> bytes:
    """A bitmap body: header and palette, then how the pixels are kept, then these."""
    info, data = dib
    kept = stored(data) if packed else data
    rows = struct.unpack_from("<i", info, 8)[0]
    return page(num(0x80, 7) + num(0x81, len(info)) + tlv(0x86, info + struct.pack("<4I", int(packed), len(kept), len(data), rows) + kept))


def long_tag(tag: bytes, value: bytes) -> bytes:
    return tag + tlv(0, value)[1:]


def pair(a: int, b: int) -> bytes:
    return b"".join(bytes([len(n)]) + n for n in (v.to_bytes(max(1, (v.bit_length() + 7) // 8), "big") for v in (a, b)))


def shown_page(paper: tuple[int, int]) -> bytes:
    return tlv(0x62, tlv(0x80, b"\2") + tlv(0x85, pair(*paper)))


def box(x: int, y: int, w: int, h: int) -> bytes:
    return tlv(0x62, tlv(0x80, b"\3") + long_tag(b"\x9f\x34", pair(x, y)) + long_tag(b"\x9f\x8f\x51", pair(w, h)))


def content(rotation: int = 0, drawing: bytes = b"", frame: tuple[int, int] | None = None) -> bytes:
    out = tlv(0x80, b"\4") + (tlv(0x85, pair(*frame)) if frame else b"")
    if rotation:
        out += long_tag(b"\x9f\x3d", bytes([1, rotation % 256]) if rotation < 256 else bytes([2]) + rotation.to_bytes(2, "big"))
    return tlv(0x62, out + (tlv(0x87, drawing) if drawing else b""))


def overlay(raw: bytes) -> bytes:
    return num(0x80, 4) + num(0x81, len(raw)) + tlv(0x86, stored(raw))


def shown_container(pages: list[bytes], records: list[bytes]) -> bytes:
    block = b"".join(records)
    return container(pages, properties=(len(block), stored(block)))


# ---- what lines draw


def line_emf(o: int, q: int, flag: str, part: int) -> list[bytes]:
    """A text, a filled box and a rectangle for a line; lines of kind N have a record that draws nothing besides."""
    raw = f"L{o}{flag}".encode()
    return [
        font(1, -(80 + q), 900 if flag == "R" else 0, 700 if flag == "A" else 400, q % 2 == 1), words(37, 1), words(24, colour(q, 2 * q, o)), text(10 * q, 100 * o, raw, [50] * len(raw)), words(40, 1),
        words(39, 2, 0, colour(q, o, 7), 0), words(37, 2), blit(q, 10 * o, 100 + q, 5),
        words(37, 0x80000008), words(33), ints(30, 0, 0, 2000, 3000), ints(43, q, o, q + 20, o + 30), ints(34, -1), words(40, 2),
        *([record(1234, b"")] if flag == "N" else []),
    ]


def line_wmf(o: int, q: int, flag: str, part: int) -> list[bytes]:
    """A text, a filled box and a stroked line from a moved origin."""
    raw = f"W{o}{flag}".encode()
    return [
        short(0x02FC, struct.pack("<HIH", 0, colour(q, o, 9), 0)), shorts(0x012D, 0), short(0x061D, struct.pack("<I4h", 0xF00021, 5, 100 + q, 10 * o, q)), shorts(0x01F0, 0),
        short(0x0A32, struct.pack("<hhHH", 100 * o, 10 * q, len(raw), 0) + raw + bytes(len(raw) % 2) + struct.pack(f"<{len(raw)}h", *[40] * len(raw))),
        short(0x02FA, struct.pack("<HhhI", 0, 3, 0, colour(o, q, 1))), shorts(0x012D, 0), shorts(0x0214, o, q), shorts(0x0213, o + 30, q + 20), shorts(0x01F0, 0),
    ]


BLACK_WHITE = [(0, 0, 0), (255, 255, 255)]


def line_bitmaps(o: int, q: int, flag: str, part: int) -> list[bytes]:
    """Bitmaps of q by o pixels: R of one bit, black; A of eight bits, their index the line's number; N of 24 bits. Of those with a first row to spare, it is cut off."""
    if flag == "R":
        dib = bitmap(q, o, 1, BLACK_WHITE, [bytes((q + 7) // 8)] * o)
    elif flag == "A":
        dib = bitmap(q, o, 8, [(k, k, 255 - k) for k in range(16)], [bytes([o % 16]) * q] * o)
    else:
        dib = bitmap(q, o, 24, [], [bytes((3, 2, 1)) * q] * o)
    top = 1 if o > 1 else 0
    return [stretched(q, 10 * o, 2 * q, 3 * o, (0, top, q, o - top), dib, 0xCC0020)]


def line_comments(o: int, q: int, flag: str, part: int) -> list[bytes]:
    """A stored picture that is called and placed, a path that a fill is clipped to, and a figure in one of four codings."""
    ring = [(q, o), (q + 5, o), (q + 5, o + 60), (q - 3, o + 4)]
    figure = wide_points(0x03, ring) if flag == "R" else step_points(0x03, ring) if flag == "A" else step_points(0x03, ring, halves=True)
    return [
        comment(b"DWb\0"), placed(10 * q, 10 * o, 100, 200, 100 + q, 50, 0xCC0020),
        comment(b"DW02"), short_points(0x01, [(0, 0), (900, 0)]), short_points(0x00, [(900, 900)]), comment(b"DW03"), blit(q, o, 30, 40),
        comment(b"DW06", struct.pack("<4i", 0, 0, *DEVICE)), comment(b"DW02"), figure, comment(b"DW04"),
    ]


def comment_pages(lines: list[tuple]) -> list[bytes]:
    """One coded sheet whose pictures stand beside it, and its thumbnail."""
    return [coded_page(emf([r for line in lines for r in line_comments(*line)])), *[raw_jpeg(100 + q, 50) for _, q, _, _ in lines], preview()]


def metafile_pages(lines: list[tuple]) -> list[bytes]:
    return [coded_page(emf([r for line in lines for r in line_emf(*line)])), coded_page(wmf([shorts(0x020B, -109, -109), shorts(0x020C, DEVICE[1], DEVICE[0])] + [r for line in lines for r in line_wmf(*line)]))]


def fax_pages(lines: list[tuple]) -> list[bytes]:
    return [fax_page(fax_bar(q, 5 + o, 128, 10 * o), 128, 10 * o) for o, q, _, _ in lines]


def bitmap_pages(lines: list[tuple]) -> list[bytes]:
    own = [coded_page(emf([r for line in lines for r in line_bitmaps(*line)]))]
    for o, q, flag, _ in lines:
        if flag == "R" and o == 1:  # a full preview, which is a page of its own
            own.append(bitmap_page(bitmap(1000, 1000, 1, BLACK_WHITE, [bytes([0xFF]) * 125] * (1000 - q) + [bytes(125)] * q), q % 2 == 1))
    return own


def text_pages(lines: list[tuple]) -> list[bytes]:
    """Bare bodies that expand to text, of unknown length, each before the thumbnail of a coded page."""
    return [b for o, q, flag, _ in lines for b in (coded_page(emf([text(10, 10, f"T{o}".encode(), [9, 9])])), preview())]


def of_lines(lineitem: DataFrame, make: Callable[[list[tuple]], bytes], suffix: str = "") -> DataFrame:
    """A container for each order of what `make` makes of its lines (number, quantity, flag, part), numbered from 1: path, content."""

    def each(key: int, lines: list[tuple]) -> tuple[str, bytes]:
        return f"order{key}{suffix}.xdw", make([(k, int(q), flag, part) for k, (q, flag, part) in enumerate(lines, 1)])

    return of_orders(lineitem, each)


def shown_lines(lines: list[tuple]) -> bytes:
    """A sheet and its thumbnail for each line, shown in a box on a page of its own; lines of kind R are turned, those of kind A have a note over them."""
    pages, records = [], []
    for o, q, flag, _ in lines:
        pages += [raw_jpeg(100 + q, 200), preview()]
        records += [shown_page((21000 + q, 29700)), box(o, q, 1000 + q, 2000), content(90 if flag == "R" else 0)]
        if flag == "A":
            records.append(content(0, overlay(emf([text(10, 20, f"note {o}".encode(), [5] * (6 + (o > 9)))]))))
    return shown_container(pages, records)


def overlaid(lines: list[tuple]) -> bytes:
    """One page. R: a small preview under a text that spans it. A: a coarse bitmap, of even quantities under a drawing. N: a picture with a text at a point."""
    ((_, q, flag, _),) = lines
    page_record, begun = shown_page(A4), content(0)
    note = overlay(emf([text(10, 20, b"note", [5] * 4)]))
    if flag == "R":
        return shown_container([preview()], [page_record, begun, box(10, 20, 19000 + q, 27000), content(0, note)])
    if flag == "A":
        coarse = coded_page(emf([stretched(0, 0, *DEVICE, (0, 0, 8, 8), bitmap(8, 8, 1, BLACK_WHITE, [b"\x55"] * 8), 0xCC0020)]))
        return shown_container([coarse], [page_record, begun, *([content(0, overlay(emf([blit(1, 2, 3, 4)])))] if q % 2 == 0 else [])])
    return shown_container([raw_jpeg(100 + q, 200)], [page_record, begun, box(100, 200, 1000, 500), content(0, note)])


def labelled(lines: list[tuple]) -> bytes:
    """A picture, and a small sheet with a number, which of kind N is no plain label."""
    ((_, q, flag, part),) = lines
    raw = f"SN-{part}{'*' if flag == 'N' else ''}".encode()
    return container([raw_jpeg(100 + q, 200), coded_page(emf([text(10, 20, raw, [5] * len(raw))]), (2000 + q, 1200))])


def masked_upright(lines: list[tuple]) -> bytes:
    """A stored picture drawn through a mask, which lies elsewhere in kind N, over texts that stand upright in a column in kind R."""
    ((_, q, flag, _),) = lines
    mask = inline_picture(bitmap(8, 8, 1, BLACK_WHITE, [b"\x0F"] * 8))
    at = (q, q, 500, 400)
    through = [comment(b"DWb\0"), placed(*at, 100 + q, 50, 0x660046), mask, placed(q + (flag == "N"), q, 500, 400, 8, 8, 0x8800C6), comment(b"DWb\0"), placed(*at, 100 + q, 50, 0x660046)]
    column = [font(1, -90, 900, 400, False), words(37, 1), *(text(1000 + (k * 50 if flag == "A" else 0), 1000 + 100 * k, b"abc"[k : k + 1], [9]) for k in range(3))] if flag != "N" else []
    return container([coded_page(emf(through + column)), raw_jpeg(100 + q, 50), preview()])
