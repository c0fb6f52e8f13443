"""Private comments in metafiles: pictures that are called and placed, paths of coded points, clips. What a comment does to the canvas stands in one table."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from itertools import accumulate

from .drawing import OPS, Canvas

POINTS = 1 << 20
# Names of comments, codings of points, and what the bytes before an inline picture's offsets count.
MARK = b"DW"
INLINE, CALL, PLACE, CALL_16, PLACE_16 = b"DWa\0", b"DWb\0", b"DWc\0", b"DW\x02\x01", b"DW\x02\x02"
CLIP_END, BEGIN, CLIP_PATH, FILL, STROKE, CLIP_BOX = b"DW01", b"DW02", b"DW03", b"DW04", b"DW05", b"DW06"
WIDE, SHORT, STEP, HALF = 0x00, 0x20, 0x40, 0x80
LINES, NEW_LINES, MORE_LINES, RING, CURVES_ON, CURVES, CURVES_MORE, CURVE_RING, PAINTED, SINGLE = 0x00, 0x01, 0x02, 0x03, 0x10, 0x11, 0x12, 0x13, 0x20, 0x40
BEFORE = 12
#: Comments whose points stand behind the length that they declare.
LONGER = (CURVE_RING, PAINTED)


def _signed(n: int, bits: int) -> int:
    return n - (1 << bits) if n >> (bits - 1) else n


def _halves(raw: bytes, n: int, wide: bool) -> list[tuple[int, int]] | None:
    """Pairs of signed half octets; -8 says that the value is in the next octet, and with `wide` -128 there that it is in the next two. None unless raw is used up."""
    feed = iter(raw)

    def value(half: int) -> int:
        step = _signed(half, 4)
        if step == -8:
            step = _signed(next(feed), 8)
            if wide and step == -128:
                step = _signed(next(feed) | next(feed) << 8, 16)
        return step

    try:
        out = [(value(byte >> 4), value(byte & 15)) for byte in (next(feed) for _ in range(n))]
    except (StopIteration, RuntimeError):
        return None
    return out if len(out) == n and next(feed, None) is None else None


def coded_points(body: bytes) -> list[tuple[int, int]] | None:
    """A count, a first point, and the others as points, steps of octets or steps of half octets."""
    try:
        code, (n,) = body[3], struct.unpack_from("<I", body, 4)
        if not 0 < n <= POINTS or code not in (WIDE, SHORT, STEP, HALF):
            return None
        if code in (WIDE, SHORT):
            flat = struct.unpack_from(f"<{2 * n}{'i' if code == WIDE else 'h'}", body, 8)
            return list(zip(flat[::2], flat[1::2]))
        first = struct.unpack_from("<hh", body, 8)
        if code == STEP:
            flat = struct.unpack_from(f"<{2 * n - 2}b", body, 12)
            steps = list(zip(flat[::2], flat[1::2]))
        else:
            steps = _halves(body[12:], n - 1, False) or _halves(body[12:], n - 1, True)
            if steps is None and n > 1:
                return None
    except (struct.error, IndexError):
        return None
    return list(accumulate([first, *(steps or [])], lambda p, s: (p[0] + s[0], p[1] + s[1])))


def _lines(points: Iterable) -> list[tuple]:
    return [(p,) for p in points]


def _curves(points: list) -> list[tuple]:
    return [tuple(points[k : k + 3]) for k in range(0, len(points) - 2, 3)]


def _figure(segments: Callable, closed: bool, onward: bool):
    """Points that begin a figure, or go on with the last one."""

    def run(figures: list, points: list) -> None:
        if onward and figures:
            start, before, was = figures[-1]
            figures[-1] = (start, before + segments(points), was)
        else:
            figures.append((points[0], segments(points[1:]), closed))

    return run


FIGURES = {
    LINES: _figure(_lines, False, True), MORE_LINES: _figure(_lines, False, True), NEW_LINES: _figure(_lines, False, False), RING: _figure(_lines, True, False),
    CURVES_ON: _figure(_curves, False, True), CURVES_MORE: _figure(_curves, False, True), CURVES: _figure(_curves, False, False), CURVE_RING: _figure(_curves, True, False),
}


def _geometry(c: Canvas, body: bytes) -> bool:
    points = coded_points(body)
    if points is None:
        return False
    if body[2] == SINGLE:
        c.polygons([points], False)
        return True
    if body[2] == PAINTED:
        placed = [c.point(*p) for p in points]
        c.paint([(placed[0], _lines(placed[1:]), True)] if len(placed) > 1 else [], True, True)
        return True
    add = FIGURES.get(body[2])
    if add is None or c.path is None:
        return False
    add(c.path[0], [c.point(*p) for p in points])
    return True


def _inline(c: Canvas, body: bytes) -> bool:
    info, n_info, bits, n_bits = struct.unpack_from("<4I", body, 4)
    cut = lambda at, n: body[at - BEFORE : at - BEFORE + n] if at >= BEFORE and at - BEFORE + n <= len(body) else None
    head, pixels = cut(info, n_info), cut(bits, n_bits)
    return head is not None and pixels is not None and c.keep_picture(head, pixels)


def _place(c: Canvas, body: bytes) -> bool:
    v = struct.unpack_from("<15i", body)
    return c.place_picture((v[5], v[6], v[13], v[14]), (v[9], v[10]), OPS.get(v[12] & 0xFFFFFFFF, "other"))


def _place_16(c: Canvas, body: bytes) -> bool:
    if len(body) > 4:
        x, y, w, h, _, _, sw, sh = struct.unpack_from("<8h", body, 4)
        return c.place_picture((x, y, w, h), (sw, sh), "copy")
    if c.state.clip_logical is None:
        return False
    left, top, right, bottom = c.state.clip_logical
    return c.place_picture((left, top, right - left, bottom - top), (0, 0), "copy")


def _clip_box(c: Canvas, body: bytes) -> bool:
    if len(body) >= 20:
        c.clip(*struct.unpack_from("<4i", body, 4))
    return True


def _begin(c: Canvas, body: bytes) -> bool:
    c.path = ([], c.state.even_odd)
    return True


def _path_done(fill: bool):
    def run(c: Canvas, body: bytes) -> bool:
        figures = c.path[0] if c.path else []
        c.path = None
        c.paint(figures, fill, not fill)
        return True

    return run


def _call(c: Canvas, body: bytes) -> bool:
    c.call_picture()
    return True


NAMED = {INLINE: _inline, CALL: _call, CALL_16: _call, PLACE: _place, PLACE_16: _place_16, CLIP_BOX: _clip_box, BEGIN: _begin, CLIP_PATH: lambda c, b: c.clip_to_path(), CLIP_END: lambda c, b: True, FILL: _path_done(True), STROKE: _path_done(False)}


def comment(c: Canvas, body: bytes) -> bool:
    """Whether a comment was understood."""
    if len(body) < 4 or not body.startswith(MARK):
        return False
    try:
        return NAMED.get(body[:4], _geometry)(c, body)
    except struct.error:
        return False


def enhanced_comment(c: Canvas, record: bytes) -> bool:
    (n,) = struct.unpack_from("<I", record, 8)
    rest = record[12:]
    whole = n == 4 and rest.startswith(MARK) and rest[2:3] in [bytes([x]) for x in LONGER]
    return comment(c, rest if whole else rest[:n])


def plain_comment(c: Canvas, record: bytes) -> bool:
    kind, n = struct.unpack_from("<HH", record, 6)
    return kind == 15 and comment(c, record[10 : 10 + n])
