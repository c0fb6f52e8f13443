"""What a metafile draws, as marks in the order of drawing: texts, images, fills, shapes. The device context is one value that
each record replaces, so saving and restoring it is keeping and taking back a value."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np

from .raster import Raster, dib

# Raster operations, stock objects, flags of text alignment, the share of a radius that a Bezier arc's handles take.
OPS = {0xCC0020: "copy", 0x8800C6: "and", 0x660046: "xor", 0xB8074A: "stencil"}
STOCK = 0x80000000
STOCK_BRUSHES = {0: (255, 255, 255), 1: (192, 192, 192), 2: (128, 128, 128), 3: (64, 64, 64), 4: (0, 0, 0), 5: None}
STOCK_PENS = {6: ((255, 255, 255), 1.0), 7: ((0, 0, 0), 1.0), 8: None}
ALIGN_X, ALIGN_RIGHT, ALIGN_CENTRE, ALIGN_BASELINE, ALIGN_BOTTOM = 6, 2, 6, 24, 8
MULTIPLY = 9
WINDING = 2
ARC = 0.5522848


@dataclass(frozen=True)
class Font:
    height: int = 0
    escapement: int = 0
    weight: int = 0
    underline: bool = False
    kind: str = "japanese"


@dataclass(frozen=True)
class State:
    window: tuple = (0, 0)
    view: tuple = (0, 0)
    window_size: tuple | None = None
    view_size: tuple | None = None
    font: Font = Font()
    brush: tuple | None = (255, 255, 255)
    pen: tuple | None = ((0, 0, 0), 1.0)
    align: int = 0
    ink: tuple = (0, 0, 0)
    even_odd: bool = True
    clip: tuple | None = None
    clip_logical: tuple | None = None
    clip_path: int | None = None
    at: tuple = (0, 0)
    multiply: bool = False


@dataclass
class Mark:
    kind: str
    order: int
    box: tuple[float, float, float, float]
    rgb: tuple | None = None
    text: str = ""
    xs: list[float] = field(default_factory=list)
    size: float = 0.0
    font: Font = Font()
    raster: int | None = None
    op: str | None = None
    figures: list = field(default_factory=list)
    even_odd: bool = True
    stroke: tuple | None = None
    multiply: bool = False
    clip: tuple | None = None
    #: of fills and images, the path of the drawing that they are clipped to
    clip_path: int | None = None
    #: of images, the number of a picture that is stored beside the page, and the size that it is drawn from
    stored: int | None = None
    source: tuple | None = None


@dataclass
class Drawing:
    device: tuple[int, int]
    frame: tuple[int, int]
    marks: list[Mark] = field(default_factory=list)
    rasters: list[Raster] = field(default_factory=list)
    skipped: Counter = field(default_factory=Counter)
    records: int = 0
    #: paths that marks are clipped to: figures, and whether they fill by even and odd
    paths: list = field(default_factory=list)

    @property
    def calls(self) -> list[tuple[int, tuple]]:
        """Stored pictures by number with the size of their first drawing."""
        first: dict[int, tuple] = {}
        for m in self.marks:
            if m.stored is not None:
                first.setdefault(m.stored, m.source)
        return sorted(first.items())

    @property
    def sizes(self) -> list[tuple]:
        """The sizes that stored pictures are drawn from, each once."""
        return list(dict.fromkeys(m.source for m in self.marks if m.stored is not None))

    @property
    def stored(self) -> int:
        """How many stored pictures are called for."""
        return max((m.stored + 1 for m in self.marks if m.stored is not None), default=0)

    @property
    def shape_masks(self) -> int:
        return sum(m.clip_path is not None for m in self.marks)


def rgb(number: int) -> tuple[int, int, int]:
    return number & 255, number >> 8 & 255, number >> 16 & 255


def _box(*points) -> tuple[float, float, float, float]:
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


class Canvas:
    """Takes drawing calls in logical units and keeps marks in device units. Every call that could draw takes a place in the order."""

    def __init__(self, device: tuple[int, int], frame: tuple[int, int]):
        self.drawing = Drawing(device, frame)
        self.state, self.saved, self.objects, self.order = State(), [], {}, 0
        #: the picture that the next placement draws: ("stored", number) or ("inline", raster); how many were called; the path being built
        self.picture, self.called, self.path = None, 0, None

    def set(self, **values) -> None:
        self.state = replace(self.state, **values)

    def save(self) -> None:
        self.saved.append(self.state)

    def restore(self, level: int) -> None:
        """Below zero counts back from the last saved, above zero counts from the first."""
        k = len(self.saved) + level if level < 0 else level - 1
        if 0 <= k < len(self.saved):
            self.state = self.saved[k]
            del self.saved[k:]

    def select(self, handle: int) -> None:
        if handle & STOCK:
            k = handle ^ STOCK
            if k in STOCK_BRUSHES:
                self.set(brush=STOCK_BRUSHES[k])
            elif k in STOCK_PENS:
                self.set(pen=STOCK_PENS[k])
        elif handle in self.objects:
            self.set(**self.objects[handle])

    @property
    def scale(self) -> tuple[float, float]:
        w, v = self.state.window_size, self.state.view_size
        return (v[0] / w[0], v[1] / w[1]) if w and v else (1.0, 1.0)

    def point(self, x: float, y: float) -> tuple[float, float]:
        s, (sx, sy) = self.state, self.scale
        return (x - s.window[0]) * sx + s.view[0], (y - s.window[1]) * sy + s.view[1]

    def length(self, n: float) -> float:
        return n * abs(self.scale[1])

    def clip(self, left: int, top: int, right: int, bottom: int) -> None:
        """Replaces the clip; one that covers the page is none."""
        box = _box(self.point(left, top), self.point(right, bottom))
        w, h = self.drawing.device
        whole = w <= 0 or (box[0] <= 0 and box[1] <= 0 and box[2] >= w and box[3] >= h)
        self.set(clip=None if whole else box, clip_logical=(left, top, right, bottom), clip_path=None)

    def clip_to_path(self) -> bool:
        """Clips to the path that was built. One that is the same as the last is kept once."""
        if self.path is not None:
            paths, own = self.drawing.paths, self.path
            if not paths or paths[-1] != own:
                paths.append(own)
            self.path = None
            self.set(clip_path=len(paths) - 1)
        return True

    def _turn(self) -> int:
        self.order += 1
        return self.order

    def _mark(self, kind: str, order: int, box, **more) -> None:
        path = self.state.clip_path if kind in ("fill", "image") else None
        self.drawing.marks.append(Mark(kind, order, box, multiply=self.state.multiply, clip=self.state.clip, clip_path=path, **more))

    def text(self, x: int, y: int, text: str, advances: list[float]) -> None:
        if not text:
            return
        s, (sx, sy), order = self.state, self.scale, self._turn()
        ends = np.cumsum([0.0, *[a * sx for a in advances]])
        left, line = self.point(x, y)
        left -= {ALIGN_RIGHT: 1.0, ALIGN_CENTRE: 0.5}.get(s.align & ALIGN_X, 0.0) * float(ends[-1])
        xs = [left + float(e) for e in ends[:-1]]
        size = abs(s.font.height) * abs(sy) if s.font.height else max(abs(xs[1] - xs[0]), 1.0) if len(xs) > 1 else 1.0
        base = line if s.align & ALIGN_BASELINE == ALIGN_BASELINE else line - 0.2 * size if s.align & ALIGN_BOTTOM else line + 0.8 * size
        self._mark("text", order, (xs[0], base - size, xs[-1] + size, base), rgb=s.ink, text=text, xs=xs, size=size, font=s.font)

    def fill(self, x: int, y: int, w: int, h: int) -> None:
        order = self._turn()
        box = self.point(x, y) + self.point(x + w, y + h)
        if self.state.brush is not None and box[2] > box[0] and box[3] > box[1]:
            self._mark("fill", order, box, rgb=self.state.brush)

    def bitmap(self, info: bytes, bits: bytes, to: tuple, source: tuple, code: int) -> bool:
        """False if it is no bitmap that can be drawn with that raster operation."""
        raster, op = dib(info, bits), OPS.get(code)
        if raster is None or op in (None, "xor") or (op == "stencil" and raster.bits != 1):
            return False
        colour = None
        if op == "stencil":
            colour = self.state.brush
            if colour is None:
                self._turn()
                return True
        elif op == "and" and raster.bits == 1:
            colour = (0, 0, 0)
            raster.as_mask()
        self._cut(raster, source)
        self.drawing.rasters.append(raster)
        order, (x, y, w, h) = self._turn(), to
        box = self.point(x, y) + self.point(x + w, y + h)
        if box[2] > box[0] and box[3] > box[1]:
            self._mark("image", order, box, rgb=colour, raster=len(self.drawing.rasters) - 1, op=op)
        return True

    @staticmethod
    def _cut(raster: Raster, source: tuple) -> None:
        """Keeps whole rows alone; any other part of a bitmap is drawn whole."""
        x, y, w, h = source
        first, last = max(y, 0), min(max(y, 0) + h, raster.height)
        if x == 0 and w == raster.width and h > 0 and first < last:
            raster.rows = raster.rows[first * raster.stride : last * raster.stride]
            raster.height = last - first

    def call_picture(self) -> None:
        self.picture = ("stored", self.called)
        self.called += 1

    def keep_picture(self, info: bytes, bits: bytes) -> bool:
        """A bitmap for placements to come."""
        raster = dib(info, bits)
        if raster is None:
            return False
        self.drawing.rasters.append(raster)
        self.picture = ("inline", len(self.drawing.rasters) - 1)
        return True

    def place_picture(self, to: tuple, source: tuple[int, int], op: str) -> bool:
        """Draws the picture called or kept last. A placement before any call counts as a call."""
        x, y, w, h = to
        if min(source) < 0 or w <= 0 or h <= 0:
            return False
        kind, n = self.picture or ("stored", None)
        colour = None
        if kind == "inline" and op == "and":
            raster = self.drawing.rasters[n]
            if raster.bits != 1:
                return False
            # masks are kept with set bits for what they let through, and used again as they are then
            if not raster.mask:
                raster.as_mask()
            colour = (0, 0, 0)
        if n is None:
            self.call_picture()
            n = self.picture[1]
        order = self._turn()
        box = self.point(x, y) + self.point(x + w, y + h)
        if box[2] > box[0] and box[3] > box[1]:
            if kind == "stored":
                self._mark("image", order, box, stored=n, source=source, op=op)
            else:
                raster = self.drawing.rasters[n]
                self._mark("image", order, box, rgb=colour, raster=n, source=(raster.width, raster.height), op=op)
        return True

    def paint(self, figures: list, fill: bool, stroke: bool) -> None:
        self._paint(self._turn(), figures, fill, stroke)

    def _paint(self, order: int, figures: list, fill: bool, stroke: bool) -> None:
        s = self.state
        brush, pen = s.brush if fill else None, s.pen if stroke else None
        if figures and (brush is not None or pen is not None):
            box = _box(*[p for start, segments, _ in figures for p in [start, *[q for seg in segments for q in seg]]])
            self._mark("shape", order, box, rgb=brush, figures=figures, even_odd=s.even_odd, stroke=pen)

    def _shape(self, order: int, figures: list, closed: bool) -> None:
        self._paint(order, figures, closed, True)

    def polygons(self, rings: list[list[tuple]], closed: bool) -> None:
        order = self._turn()
        placed = [[self.point(*p) for p in ring] for ring in rings if len(ring) >= 2]
        self._shape(order, [(ring[0], [(p,) for p in ring[1:]], closed) for ring in placed], closed)

    def line_to(self, x: int, y: int) -> None:
        self.polygons([[self.state.at, (x, y)]], False)
        self.set(at=(x, y))

    def rectangle(self, left: int, top: int, right: int, bottom: int) -> None:
        self.polygons([[(left, top), (right, top), (right, bottom), (left, bottom)]], True)

    def rounded(self, left: int, top: int, right: int, bottom: int, w: int | None = None, h: int | None = None) -> None:
        """A rectangle with elliptic corners w wide and h high; an ellipse without them."""
        order = self._turn()
        x0, y0, x1, y1 = _box(self.point(left, top), self.point(right, bottom))
        if x1 <= x0 or y1 <= y0:
            return
        (sx, sy), half = self.scale, ((x1 - x0) / 2, (y1 - y0) / 2)
        rx = half[0] if w is None else min(abs(w * sx) / 2, half[0])
        ry = half[1] if h is None else min(abs(h * sy) / 2, half[1])
        kx, ky = rx * (1 - ARC), ry * (1 - ARC)
        segments = [
            ((x1 - rx, y0),), ((x1 - kx, y0), (x1, y0 + ky), (x1, y0 + ry)), ((x1, y1 - ry),), ((x1, y1 - ky), (x1 - kx, y1), (x1 - rx, y1)),
            ((x0 + rx, y1),), ((x0 + kx, y1), (x0, y1 - ky), (x0, y1 - ry)), ((x0, y0 + ry),), ((x0, y0 + ky), (x0 + kx, y0), (x0 + rx, y0)),
        ]
        self._shape(order, [((x0 + rx, y0), segments, True)], True)


def picture(raster: Raster, paper: tuple[int, int]) -> Drawing:
    """One bitmap over a whole page."""
    mark = Mark("image", 1, (0.0, 0.0, float(raster.width), float(raster.height)), raster=0, op="copy")
    return Drawing((raster.width, raster.height), paper, [mark], [raster])
