"""What a page shows, in layers from the bottom: bodies, pictures beside them, overlays, labels. Rules on what replaces what stand here; the renderers draw what they are given."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

import numpy as np

from .drawing import Drawing, Mark
from .pages import A4, full_preview, overlay_drawing, page_drawing
from .paper import covers, paired_pictures
from .raster import Raster, jpeg_info
from .shown import Overlay
from .tlv import Entry

# Sides of label sheets in hundredths of a millimetre, characters of a label, pixels an inch below which a body is a thumbnail.
LABEL_SIDE, LABEL_LEAST, LABEL_CHARS, LABEL_LONGEST = 3000, 300, frozenset(string.ascii_letters + string.digits + "-_/.: "), 64
COARSE, SAME = 72.0, 0.01


def kinds(d: Drawing) -> set[str]:
    return {m.kind for m in d.marks}


def text_only(d: Drawing) -> bool:
    return kinds(d) == {"text"} and not d.rasters


def whole_page(o: Overlay, paper: tuple[int, int]) -> bool:
    return o.area is None or covers(o.area, paper)


def preview_replaced(e: Entry, overlays: list[Overlay], paper: tuple[int, int]) -> bool:
    """A small preview under an overlay of text alone that spans the sheet."""
    if e.kind != "preview" or full_preview(e):
        return False
    drawn = (overlay_drawing(o, paper) for o in overlays if o.area and covers(o.area, paper))
    return any(d is not None and text_only(d) and not d.paths for d in drawn)


def body_replaced(d: Drawing, overlays: list[Overlay], paper: tuple[int, int]) -> bool:
    """A body of one coarse bitmap over the whole sheet, under an overlay that draws the sheet without bitmaps."""
    if len(d.marks) != 1 or len(d.rasters) != 1 or d.paths:
        return False
    m, r = d.marks[0], d.rasters[0]
    if m.kind != "image" or m.op != "copy" or m.raster is None or m.clip or m.clip_path is not None or max(abs(m.box[0]), abs(m.box[1])) > 1:
        return False
    w, h = (abs(n) for n in d.device)
    if not (w and h) or m.box[2] < 0.95 * w or m.box[3] < 0.95 * h or max(r.width * 2540 / max(paper[0], 1), r.height * 2540 / max(paper[1], 1)) >= COARSE:
        return False
    drawn = (overlay_drawing(o, paper) for o in overlays if whole_page(o, paper))
    return any(v is not None and v.marks and "image" not in kinds(v) and not v.rasters for v in drawn)


def anchored_text(o: Overlay, d: Drawing) -> bool:
    """An overlay whose rectangle only says where its text begins."""
    return o.area is not None and not covers(o.area, d.frame) and text_only(d)


def label_sheet(e: Entry) -> bool:
    return e.paper is not None and min(e.paper) >= LABEL_LEAST and max(e.paper) <= LABEL_SIDE


def label_text(d: Drawing) -> str | None:
    """The text of a drawing that is one short plain text and nothing else."""
    only = text_only(d) and len(d.marks) == 1
    return d.marks[0].text if only and 0 < len(d.marks[0].text) <= LABEL_LONGEST and set(d.marks[0].text) <= LABEL_CHARS else None


def sound(box: tuple[float, ...]) -> bool:
    """Whether a box is finite and has an area."""
    return all(map(math.isfinite, box)) and box[2] > box[0] and box[3] > box[1]


def upright(d: Drawing) -> bool:
    """Texts that stand upright in columns: three single characters or more at one quarter turn, two of them in one column, and not all on one line."""
    runs = [m for m in d.marks if m.kind == "text" and m.text.strip()]
    turns = {m.font.escapement % 3600 for m in runs}
    if len(runs) < 3 or any(len(m.text) != 1 for m in runs) or turns not in ({900}, {2700}):
        return False
    columns: list[float] = []
    repeated = False
    for m in runs:
        if any(abs(m.xs[0] - x) <= 1 for x in columns):
            repeated = True
        else:
            columns.append(m.xs[0])
    return repeated and any(abs(m.box[3] - runs[0].box[3]) > 1 for m in runs)


def text_bounds(d: Drawing) -> tuple[float, float, float] | None:
    """Right, top and bottom of a drawing's texts."""
    runs = [m.box for m in d.marks if m.kind == "text" and m.text.strip()]
    return (max(b[2] for b in runs), min(b[1] for b in runs), max(b[3] for b in runs)) if runs else None


def covered_glyphs(d: Drawing) -> dict[int, list[bool]]:
    """By place in the marks, which characters of texts are drawn by shapes of a glyph's size as well: a hundredth of a character's box under such a shape is
    enough. Empty unless the page has three characters or more and three quarters of them are so."""
    shapes = np.array([m.box for m in d.marks if m.kind == "shape" and sound(m.box)], float).reshape(-1, 4)
    texts = [(k, m) for k, m in enumerate(d.marks) if m.kind == "text" and m.size > 0]
    if not len(shapes) or not texts:
        return {}
    out, total, hidden = {}, 0, 0
    wide, high = shapes[:, 2] - shapes[:, 0], shapes[:, 3] - shapes[:, 1]
    for k, m in texts:
        near = shapes[(wide <= 1.5 * m.size) & (high <= 1.5 * m.size)]
        left = np.array(m.xs[: len(m.text)], float)[:, None]
        step = np.array([m.size * (0.55 if c < "\u0100" else 1.0) for c in m.text[: len(m.xs)]])[:, None]
        across = np.minimum(near[:, 2], left + step) - np.maximum(near[:, 0], left)
        down = np.minimum(near[:, 3], m.box[3]) - np.maximum(near[:, 1], m.box[3] - m.size)
        under = (np.maximum(across, 0) * np.maximum(down, 0) >= 0.01 * step * m.size).any(axis=1).tolist()
        out[k] = under
        shown = [u for u, c in zip(under, m.text) if not c.isspace()]
        total, hidden = total + len(shown), hidden + sum(shown)
    return out if total >= 3 and hidden * 4 >= total * 3 else {}


@dataclass
class Masked:
    """A stored picture drawn through a mask: exclusive or, and, exclusive or."""

    picture: int
    mask: int


def masked_pictures(d: Drawing, held: dict[int, int]) -> dict[int, Masked | None]:
    """By place in the marks: the first of three calls is one picture through a mask, the other two draw nothing. held: which entry each stored picture is."""
    images = [(k, m) for k, m in enumerate(d.marks) if m.kind == "image"]
    out: dict[int, Masked | None] = {}
    same = lambda a, b: a.clip == b.clip and a.clip_path == b.clip_path and all(abs(x - y) <= SAME for x, y in zip(a.box, b.box))
    for (i, a), (j, b), (k, c) in zip(images, images[1:], images[2:]):
        if {i, j, k} & out.keys() or (a.op, b.op, c.op) != ("xor", "and", "xor") or a.stored is None or b.raster is None or c.stored is None:
            continue
        in_row = b.order == a.order + 1 and c.order == b.order + 1
        if in_row and a.source == c.source and same(a, b) and same(a, c) and held.get(a.stored) is not None and held.get(a.stored) == held.get(c.stored):
            out |= {i: Masked(held[a.stored], b.raster), j: None, k: None}
    return out


def mask_alpha(mask: Raster, width: int, height: int) -> bytes | None:
    """A mask's clear bits as full cover, at another size by the nearest centre."""
    if mask.bits != 1 or min(mask.width, mask.height, width, height) <= 0:
        return None
    bits = np.unpackbits(np.frombuffer(mask.rows, np.uint8).reshape(mask.height, mask.stride), axis=1)
    y = np.minimum((2 * np.arange(height) + 1) * mask.height // (2 * height), mask.height - 1)
    x = np.minimum((2 * np.arange(width) + 1) * mask.width // (2 * width), mask.width - 1)
    return np.where(bits[np.ix_(y, x)] == 0, 255, 0).astype(np.uint8).tobytes()


@dataclass
class Layer:
    """area is in hundredths of a millimetre on the page, None for all of it. role: body, picture, overlay, note (in the size of its own frame) or label (near the upper right corner)."""

    role: str
    entry: int | None
    area: tuple[int, int, int, int] | None = None
    drawing: Drawing | None = None
    jpeg: bytes | None = None
    #: of a drawing, the entries of the stored pictures that it places
    held: dict[int, int] = field(default_factory=dict)


@dataclass
class Composed:
    paper: tuple[int, int] | None
    rotation: int
    layers: list[Layer]
    lost: bool
    #: bodies that an overlay replaces
    replaced: int = 0


def _held(d: Drawing, e: Entry, entries: list[Entry]) -> dict[int, int]:
    beside = [p for p in entries if p.role == "picture" and p.belongs_to == e.idx]
    found = paired_pictures([size for _, size in d.calls], [p.pixels for p in beside])
    return {n: beside[k].idx for (n, _), k in zip(d.calls, found) if k is not None}


def _body(data: bytes, e: Entry, entries: list[Entry], area, overlays, paper) -> tuple[list[Layer], bool]:
    """The layers of one body, and whether an overlay replaces it."""
    if e.kind == "jpeg":
        raw = data[e.at : e.at + e.length]
        return ([Layer("body", e.idx, area, jpeg=raw)] if jpeg_info(raw) else []), False
    if preview_replaced(e, overlays, paper):
        return [], True
    d = page_drawing(data, e, entries)
    if d is not None:
        return ([], True) if body_replaced(d, overlays, paper) else ([Layer("body", e.idx, area, d, held=_held(d, e, entries))], False)
    beside = [p for p in entries if p.role == "picture" and p.belongs_to == e.idx and p.kind == "jpeg"]
    return [Layer("picture", p.idx, area, jpeg=data[p.at : p.at + p.length]) for p in beside], False


def _labels(data: bytes, sheets: list[Entry], entries: list[Entry]) -> dict[int, Layer]:
    """Sheets that are only a label for the picture before them."""
    out = {}
    for before, e in zip(sheets, sheets[1:]):
        if before.kind == "jpeg" and label_sheet(e):
            d = page_drawing(data, e, entries)
            if d is not None and label_text(d) is not None:
                out[e.idx] = Layer("label", e.idx, None, d)
    return out


def composed(data: bytes, doc: dict, previews: bool = False) -> list[Composed]:
    """The pages of a parsed container. previews: thumbnails are pages too, where the properties do not tell the pages."""
    entries = doc["entries"]
    by = {e.idx: e for e in entries}
    labels: dict[int, Layer] = {}
    if doc["displays"]:
        wanted = [(d["paper"], d["rotation"], [(by[m["idx"]], m["area"]) for m in d["members"] if m["idx"] in by], d["overlays"]) for d in doc["displays"]]
    else:
        sheets = [e for e in entries if e.role == "sheet" or previews and e.role == "thumbnail"]
        labels = _labels(data, sheets, entries)
        wanted = [(e.paper, e.rotation, [(e, None)], e.overlays) for e in sheets]
    out: list[Composed] = []
    for paper, turn, members, overlays in wanted:
        if len(members) == 1 and members[0][0].idx in labels:
            out[-1].layers.append(labels[members[0][0].idx])
            continue
        frame = paper or A4
        page = Composed(paper, turn % 360, [], False)
        for e, area in members:
            layers, replaced = _body(data, e, entries, area if len(members) > 1 else None, overlays, frame)
            page.layers += layers
            page.replaced += replaced
        for o in overlays:
            d = overlay_drawing(o, frame)
            if d is not None and d.marks:
                page.layers.append(Layer("note", None, (*o.area[:2], *d.frame), d) if anchored_text(o, d) else Layer("overlay", None, o.area, d))
        page.lost = not page.layers and bool(members or overlays) and not _blank(members, overlays, frame)
        out.append(page)
    return out


def _blank(members, overlays, frame) -> bool:
    """A page without bodies whose overlays all decode and draw nothing."""
    return not members and bool(overlays) and all((d := overlay_drawing(o, frame)) is not None and not d.marks for o in overlays)


def layer_marks(layer: Layer) -> list[tuple[int, Mark]]:
    """The marks of a layer's drawing that can be drawn, in order, with their places."""
    return sorted(((k, m) for k, m in enumerate(layer.drawing.marks) if m.kind != "image" or sound(m.box)), key=lambda x: x[1].order)
