"""Enhanced (32-bit) and plain (16-bit) metafiles. Each kind of record has one small function that gives a canvas its values."""

from __future__ import annotations

import struct
from collections.abc import Callable

from .comments import enhanced_comment, plain_comment
from .drawing import MULTIPLY, WINDING, Canvas, Drawing, Font, rgb
from .raster import dib_header

POINTS = 1 << 20
PATCOPY = 0xF00021
NULL_BRUSH, NULL_PEN = 1, 5


def japanese(raw: bytes) -> str:
    return raw.decode("cp932", "replace")


def wide_char(c: str) -> bool:
    """Whether a character takes two octets in that encoding."""
    return not (c <= "\x80" or "｡" <= c <= "ﾟ" or c == "�")


def _values(fmt: str, at: int, record: bytes) -> tuple:
    return struct.unpack_from("<" + fmt, record, at)


def _pen(c: Canvas, style: int, width: int, colour: int) -> dict:
    return {"pen": None if style & 15 == NULL_PEN else (rgb(colour), c.length(max(width, 1)))}


def _brush(style: int, colour: int) -> dict:
    return {"brush": None if style == NULL_BRUSH else rgb(colour)}


def _by_character(text: str, steps: tuple | None) -> list[float]:
    """Advances of octets, summed for characters of two."""
    out, k = [], 0
    for c in text:
        n = 1 + wide_char(c)
        out.append(float(sum(steps[k : k + n])) if steps else 0.0)
        k += n
    return out


# ---- 32 bits


def _pair(name: str, nonzero: bool = False):
    def run(c: Canvas, r: bytes) -> None:
        pair = _values("ii", 8, r)
        if not nonzero or all(pair):
            c.set(**{name: pair})

    return run


def _font32(c: Canvas, r: bytes) -> None:
    handle, height, _, escapement, _, weight = _values("Iiiiii", 8, r)
    face = r[40:104].decode("utf-16-le", "replace").split("\0")[0]
    if r[35:36] == b"\0":
        kind = "latin"
    elif "ゴシック" in face or "Gothic" in face:
        kind = "proportional gothic"
    else:
        kind = "proportional" if "Ｐ" in face or " P" in face else "japanese"
    c.objects[handle] = {"font": Font(height, escapement, weight, r[33:34] not in (b"", b"\0"), kind)}


def _points(fmt: str):
    size = struct.calcsize("<" + fmt)

    def rings(r: bytes, at: int, counts: list[int]) -> list[list[tuple]]:
        flat = list(struct.iter_unpack("<" + fmt, r[at : at + size * sum(counts)]))
        if len(flat) != sum(counts):
            raise struct.error("points")
        out = []
        for n in counts:
            out.append(flat[:n])
            del flat[:n]
        return out

    def one(closed: bool):
        def run(c: Canvas, r: bytes) -> None:
            (n,) = _values("I", 24, r)
            if n <= POINTS:
                c.polygons(rings(r, 28, [n]), closed)

        return run

    def many(c: Canvas, r: bytes) -> None:
        parts, total = _values("II", 24, r)
        if 0 < parts <= POINTS and parts <= total <= POINTS:
            counts = list(_values(f"{parts}I", 32, r))
            if sum(counts) == total:
                c.polygons(rings(r, 32 + 4 * parts, counts), True)

    return one, many


def _blit32(c: Canvas, r: bytes) -> bool:
    x, y, w, h, code = _values("iiiiI", 24, r)
    try:
        sx, sy, *turn = _values("ii6f", 44, r)
        info, n_info, bits, n_bits = _values("4I", 84, r)
        if turn == [1, 0, 0, 1, 0, 0] and n_info and n_bits and max(info + n_info, bits + n_bits) <= len(r) and c.bitmap(r[info : info + n_info], r[bits : bits + n_bits], (x, y, w, h), (sx, sy, w, h), code):
            return True
    except struct.error:
        pass
    if code == PATCOPY:
        c.fill(x, y, w, h)
    return code == PATCOPY


def _stretch32(c: Canvas, r: bytes) -> bool:
    x, y, sx, sy, sw, sh, info, n_info, bits, n_bits, _, code, w, h = _values("6i4IIIii", 24, r)
    return max(info + n_info, bits + n_bits) <= len(r) and c.bitmap(r[info : info + n_info], r[bits : bits + n_bits], (x, y, w, h), (sx, sy, sw, sh), code)


def _text32(width: int):
    def run(c: Canvas, r: bytes) -> bool:
        x, y, n, string = _values("iiII", 36, r)
        (steps_at,) = _values("I", 72, r)
        if not n or n > 1 << 16 or string + n * width > len(r):
            return not n
        raw = r[string : string + n * width]
        steps = _values(f"{n}i", steps_at, r) if steps_at + 4 * n <= len(r) else None
        if width == 1:
            text = japanese(raw)
            c.text(x, y, text, _by_character(text, steps))
        else:
            text = raw.decode("utf-16-le", "replace")
            c.text(x, y, text, [float(s) for s in (steps or (0,) * len(text))[: len(text)]])
        return True

    return run


_one32, _many32 = _points("ii")
_one16, _many16 = _points("hh")

# Numbers of records.
ENHANCED: dict[int, Callable] = {
    1: lambda c, r: None,
    3: _one32(True),
    4: _one32(False),
    8: _many32,
    9: _pair("window_size", True),
    10: _pair("window"),
    11: _pair("view_size", True),
    12: _pair("view"),
    14: lambda c, r: None,
    19: lambda c, r: c.set(even_odd=_values("I", 8, r)[0] != WINDING),
    20: lambda c, r: c.set(multiply=_values("I", 8, r)[0] == MULTIPLY),
    22: lambda c, r: c.set(align=_values("I", 8, r)[0]),
    24: lambda c, r: c.set(ink=rgb(_values("I", 8, r)[0])),
    27: _pair("at"),
    30: lambda c, r: c.clip(*_values("4i", 8, r)),
    33: lambda c, r: c.save(),
    34: lambda c, r: c.restore(_values("i", 8, r)[0]),
    37: lambda c, r: c.select(_values("I", 8, r)[0]),
    38: lambda c, r: c.objects.update({_values("I", 8, r)[0]: _pen(c, *[_values("IiiI", 12, r)[k] for k in (0, 1, 3)])}),
    39: lambda c, r: c.objects.update({_values("I", 8, r)[0]: _brush(*_values("II", 12, r))}),
    40: lambda c, r: c.objects.pop(_values("I", 8, r)[0], None) and None,
    42: lambda c, r: c.rounded(*_values("4i", 8, r)),
    43: lambda c, r: c.rectangle(*_values("4i", 8, r)),
    54: lambda c, r: c.line_to(*_values("ii", 8, r)),
    70: enhanced_comment,
    76: _blit32,
    81: _stretch32,
    82: _font32,
    83: _text32(1),
    84: _text32(2),
    86: _one16(True),
    87: _one16(False),
    91: _many16,
    95: lambda c, r: c.objects.update({_values("I", 8, r)[0]: _pen(c, *[_values("IiII", 28, r)[k] for k in (0, 1, 3)])}),
}
COUNTED = {70, 76, 81, 83, 84}


def enhanced(data: bytes) -> Drawing | None:
    """Reads until a record does not fit. Records that draw nothing here are counted by number."""
    if data[40:44] != b" EMF" or len(data) < 80:
        return None
    left, top, right, bottom = _values("4i", 24, data)
    c = Canvas(_values("ii", 72, data), (right - left, bottom - top))
    (c.drawing.records,) = _values("I", 52, data)
    at = 0
    while at + 8 <= len(data):
        kind, size = _values("II", at, data)
        if size < 8 or at + size > len(data):
            break
        _play(c, ENHANCED, COUNTED, kind, data[at : at + size])
        at += size
    return c.drawing


def _play(c: Canvas, table: dict[int, Callable], counted: set[int], kind: int, record: bytes) -> None:
    try:
        drawn = table[kind](c, record) if kind in table else False
    except struct.error:
        drawn = None if kind not in counted else False
    if drawn is False:
        c.drawing.skipped[kind] += 1


# ---- 16 bits


def _words(record: bytes, n: int) -> tuple:
    return _values(f"{n}h", 6, record)


def _reversed_pair(name: str, nonzero: bool = False):
    def run(c: Canvas, r: bytes) -> None:
        y, x = _words(r, 2)
        if nonzero and not (x and y):
            return
        c.set(**{name: (x, y)})
        if name == "window_size" and c.drawing.device == (0, 0):
            c.drawing.device = (abs(x), abs(y))

    return run


def _new(c: Canvas, made: dict) -> None:
    """Objects take the lowest free handle."""
    c.objects[next(k for k in range(len(c.objects) + 1) if k not in c.objects)] = made


def _font16(c: Canvas, r: bytes) -> None:
    height, _, escapement, _, weight = _words(r, 5)
    face = japanese(r[24:56].split(b"\0")[0])
    kind = "latin" if r[19:20] == b"\0" else "proportional gothic" if "ゴシック" in face or "Gothic" in face else "proportional" if "Ｐ" in face or " P" in face else "japanese"
    _new(c, {"font": Font(height, escapement, weight, r[17:18] not in (b"", b"\0"), kind)})


def _brush16(c: Canvas, r: bytes) -> None:
    _new(c, _brush(*_values("HI", 6, r)))


def _pen16(c: Canvas, r: bytes) -> None:
    style, width, _, colour = _values("HhhI", 6, r)
    _new(c, _pen(c, style, width, colour))


def _poly16(closed: bool):
    def run(c: Canvas, r: bytes) -> None:
        (n,) = _words(r, 1)
        flat = _values(f"{2 * max(n, 0)}h", 8, r)
        c.polygons([list(zip(flat[::2], flat[1::2]))], closed)

    return run


def _polys16(c: Canvas, r: bytes) -> None:
    (n,) = _values("H", 6, r)
    counts, at, rings = _values(f"{n}H", 8, r), 8 + 2 * n, []
    for k in counts:
        flat = _values(f"{2 * k}h", at, r)
        rings.append(list(zip(flat[::2], flat[1::2])))
        at += 4 * k
    c.polygons(rings, True)


def _after_header(info: bytes) -> bytes | None:
    h = dib_header(info)
    return None if h is None or h.bits_at > len(info) else info[h.bits_at :]


def _blit16(c: Canvas, r: bytes) -> bool:
    code, sy, sx, h, w, y, x = _values("I6h", 6, r)
    bits = _after_header(r[22:])
    words, kind = _values("IH", 0, r)
    return w > 0 and h > 0 and words != (kind >> 8) + 3 and bits is not None and c.bitmap(r[22:], bits, (x, y, w, h), (sx, sy, w, h), code)


def _stretch16(c: Canvas, r: bytes) -> bool:
    code, _, sh, sw, sy, sx, h, w, y, x = _values("IH8h", 6, r)
    bits = _after_header(r[28:])
    return bits is not None and c.bitmap(r[28:], bits, (x, y, w, h), (sx, sy, sw, sh), code)


def _by_height(c: Canvas, text: str) -> list[float]:
    step = float(max(abs(c.state.font.height), 1))
    return [step if wide_char(k) else step / 2 for k in text]


def _text16(c: Canvas, r: bytes) -> bool:
    (n,) = _values("H", 6, r)
    y, x = _values("hh", 8 + n + n % 2, r)
    text = japanese(r[8 : 8 + n])
    c.text(x, y, text, _by_height(c, text))
    return True


def _spaced_text16(c: Canvas, r: bytes) -> bool:
    y, x, n, options = _values("hhHH", 6, r)
    at = 14 + (8 if options & 6 else 0)
    if at + n > len(r):
        return not n
    text, steps_at = japanese(r[at : at + n]), at + n + n % 2
    steps = _values(f"{n}h", steps_at, r) if steps_at + 2 * n <= len(r) else None
    c.text(x, y, text, _by_character(text, steps) if steps else _by_height(c, text))
    return True


def _pattern16(c: Canvas, r: bytes) -> bool:
    code, h, w, y, x = _values("I4h", 6, r)
    if code == PATCOPY:
        c.fill(x, y, w, h)
    return code == PATCOPY


def _box16(draw: str):
    def run(c: Canvas, r: bytes) -> None:
        bottom, right, top, left = _words(r, 4)
        getattr(c, draw)(left, top, right, bottom)

    return run


def _rounded16(c: Canvas, r: bytes) -> None:
    h, w, bottom, right, top, left = _words(r, 6)
    c.rounded(left, top, right, bottom, w, h)


def _line16(c: Canvas, r: bytes) -> None:
    y, x = _words(r, 2)
    c.line_to(x, y)


PLAIN: dict[int, Callable] = {
    0x001E: lambda c, r: c.save(),
    0x00F7: lambda c, r: _new(c, {}),
    0x0104: lambda c, r: c.set(multiply=_values("H", 6, r)[0] == MULTIPLY),
    0x0106: lambda c, r: c.set(even_odd=_values("H", 6, r)[0] != WINDING),
    0x0127: lambda c, r: c.restore(_words(r, 1)[0]),
    0x012D: lambda c, r: c.select(_values("H", 6, r)[0]),
    0x012E: lambda c, r: c.set(align=_values("H", 6, r)[0]),
    0x0142: lambda c, r: _new(c, {}),
    0x01F0: lambda c, r: c.objects.pop(_values("H", 6, r)[0], None) and None,
    0x01F9: lambda c, r: _new(c, {}),
    0x0209: lambda c, r: c.set(ink=rgb(_values("I", 6, r)[0])),
    0x020B: _reversed_pair("window"),
    0x020C: _reversed_pair("window_size", True),
    0x020D: _reversed_pair("view"),
    0x020E: _reversed_pair("view_size", True),
    0x0213: _line16,
    0x0214: _reversed_pair("at"),
    0x02FA: _pen16,
    0x02FB: _font16,
    0x02FC: _brush16,
    0x0324: _poly16(True),
    0x0325: _poly16(False),
    0x0416: _box16("clip"),
    0x0418: _box16("rounded"),
    0x041B: _box16("rectangle"),
    0x0521: _text16,
    0x0538: _polys16,
    0x0626: plain_comment,
    0x061C: _rounded16,
    0x061D: _pattern16,
    0x06FF: lambda c, r: _new(c, {}),
    0x0940: _blit16,
    0x0A32: _spaced_text16,
    0x0F43: _stretch16,
}
COUNTED16 = {0x0521, 0x0626, 0x061D, 0x0940, 0x0A32, 0x0F43}


def plain(data: bytes, paper: tuple[int, int]) -> Drawing | None:
    """A 16-bit metafile; the first window size is its device, the paper its frame."""
    if len(data) < 18 or _values("HH", 0, data) != (1, 9) or _values("H", 4, data)[0] not in (0x100, 0x300):
        return None
    c = Canvas((0, 0), paper)
    (c.drawing.records,) = _values("H", 14, data)
    at = 18
    while at + 6 <= len(data):
        words, kind = _values("IH", at, data)
        if words < 3 or at + 2 * words > len(data) or not kind:
            break
        _play(c, PLAIN, COUNTED16, kind, data[at : at + 2 * words])
        at += 2 * words
    return c.drawing


def metafile(data: bytes, paper: tuple[int, int]) -> Drawing | None:
    found = enhanced(data)
    return found if found is not None else plain(data, paper)
