"""Page entries as drawings: previews, fax pictures, bare texts, coded metafiles and overlays."""

from __future__ import annotations

import struct
import unicodedata

from .drawing import Canvas, Drawing, Font, Mark, picture
from .lzh import CodingError, expand, expand_all
from .metafile import japanese, metafile, wide_char
from .raster import Raster, dib, dib_header, fax
from .shown import FAX_KIND, Overlay
from .tlv import Entry

A4 = (21000, 29700)
FULL = 1000
TEXT_CEILING = 4 << 20
# Fixed values of the text layout, in hundredths of a millimetre: margin, largest and least size, line step.
MARGIN, LARGEST, LEAST, STEP = 900, 300, 120, 1.35


def full_preview(e: Entry) -> bool:
    return e.kind == "preview" and e.pixels is not None and min(e.pixels) >= FULL


def readable(e: Entry) -> bool:
    """What needs no decoding, or whose coding is public."""
    return e.kind == "jpeg" or (e.kind == "encoded" and e.code == FAX_KIND) or full_preview(e)


def _expanded(coded: bytes, size: int) -> bytes | None:
    try:
        return expand(coded, size)
    except CodingError:
        return None


def _bitmap(raw: bytes, below: int, band_rows: int | None, band_allowed: bool) -> Raster | None:
    """A bitmap's header and palette, then at `below` its method, sizes and coded pixels. Method 5 is a band of rows from the top."""
    if below + 16 > len(raw):
        return None
    method, stored, size = struct.unpack_from("<3I", raw, below)
    coded = raw[below + 16 : below + 16 + stored]
    if len(coded) < stored or method not in ((0, 1, 5) if band_allowed else (0, 1)):
        return None
    bits = (coded[:size] if size <= len(coded) else None) if method == 0 else _expanded(coded, size)
    if bits is None:
        return None
    info = raw[:below]
    if method == 5:
        h = dib_header(info)
        if h is None or (h.bits, h.compression) != (1, 0) or not band_rows or band_rows > h.height or len(bits) != (h.width + 31) // 32 * 4 * band_rows:
            return None
        info = info[:8] + struct.pack("<i", -band_rows) + info[12:]
    return dib(info, bits)


def _is_text(text: str) -> bool:
    odd = sum(unicodedata.category(c) == "Cc" and c not in "\r\n\t" for c in text)
    shown = sum(not c.isspace() and unicodedata.category(c) != "Cc" for c in text)
    return shown >= 2 and 20 * max(text.count("�"), odd) <= len(text)


def bare_text(coded: bytes) -> str | None:
    """The text that bare bytes expand to, up to the first zero octet; None if it is another file or mostly not text."""
    head = _expanded(coded, 8)
    if head is None or head.startswith((b"%PDF-", b"PK\x03\x04", b"\xd0\xcf\x11\xe0")):
        return None
    raw = expand_all(coded, TEXT_CEILING)
    text = japanese(raw.split(b"\0")[0]) if raw else ""
    return text if text and _is_text(text) else None


def _wrapped(text: str, size: float, width: float) -> list[str]:
    lines = []
    for line in text.replace("\r", "").replace("\t", " ").split("\n"):
        now, used = "", 0.0
        for c in line:
            w = size * (1.0 if wide_char(c) else 0.55)
            if now and used + w > width:
                lines.append(now)
                now, used = "", 0.0
            now, used = now + c, used + w
        lines.append(now)
    return lines


def text_page(text: str, paper: tuple[int, int]) -> Drawing:
    """Lines within the margins, smaller as needed; what then still runs over the foot is left out."""
    width, height = (max(n - 2 * MARGIN, 1) for n in paper)
    size = float(LARGEST)
    while size > LEAST and len(_wrapped(text, size, width)) * size * STEP > height:
        size = max(size * 0.9, LEAST)
    c = Canvas(paper, paper)
    c.set(font=Font(height=round(size)))
    for k, line in enumerate(_wrapped(text, size, width)):
        y = MARGIN + k * size * STEP
        if y + size > paper[1] - MARGIN:
            break
        c.text(MARGIN, round(y), line, [size * (1.0 if wide_char(k) else 0.55) for k in line])
    return c.drawing


def entry_drawing(data: bytes, e: Entry) -> Drawing | None:
    """What an entry draws by itself; None if it cannot be decoded or draws nothing."""
    coded, paper = data[e.at : e.at + e.length], e.paper or A4
    if e.kind == "preview":
        raster = _bitmap(coded, e.below, e.rows, True) if e.below is not None else None
        return picture(raster, paper) if raster else None
    if e.kind == "bare":
        text = bare_text(coded) if e.paper else None
        return _drawn(text_page(text, paper)) if text else None
    if e.kind != "encoded":
        return None
    if e.code == FAX_KIND:
        raster = fax(coded, *e.pixels) if e.pixels else None
        return picture(raster, paper) if raster else None
    raw = _expanded(coded, e.aux) if e.aux is not None else None
    return _drawn(metafile(raw, paper)) if raw else None


def _drawn(drawing: Drawing | None) -> Drawing | None:
    return drawing if drawing is not None and drawing.marks else None


def page_drawing(data: bytes, e: Entry, entries: list[Entry]) -> Drawing | None:
    """As before; a full preview lies as a band over its thumbnail, which is stretched to the page."""
    own = entry_drawing(data, e)
    if not full_preview(e):
        return own
    small = next((t for t in entries if t.role == "thumbnail" and t.belongs_to == e.idx and t.kind == "preview"), None)
    base = entry_drawing(data, small) if small else None
    if base is None:
        return own
    (w, h), box = e.pixels, base.marks[0]
    box.box = (0.0, 0.0, float(w), float(h))
    both = Drawing((w, h), e.paper or A4, [box], base.rasters)
    if own and own.rasters[0].width == w and own.rasters[0].height < h:
        both.rasters = both.rasters + own.rasters
        both.marks.append(Mark("image", 1, (0.0, 0.0, float(w), float(own.rasters[0].height)), raster=1, op="copy"))
    return both


def overlay_drawing(o: Overlay, paper: tuple[int, int]) -> Drawing | None:
    """An overlay's drawing, which may be empty; None if it cannot be decoded. Its own area is the frame where it has one."""
    frame = o.area[2:] if o.area else paper
    if o.kind == FAX_KIND:
        raster = fax(o.coded, *o.pixels) if o.pixels else None
        return picture(raster, frame) if raster else None
    if o.kind == 7:
        h = dib_header(o.coded)
        raster = _bitmap(o.coded, o.expanded, None, False) if h and o.expanded >= h.bits_at else None
        return picture(raster, frame) if raster else None
    raw = _expanded(o.coded, o.expanded)
    return metafile(raw, frame) if raw else None


def recovered(data: bytes, e: Entry, entries: list[Entry]) -> bool:
    """Readable as it is, decodable, or with an overlay that draws something."""
    paper = e.paper or A4
    return readable(e) or page_drawing(data, e, entries) is not None or any(_drawn(overlay_drawing(o, paper)) for o in e.overlays)


def explicit_blank(page: dict) -> bool:
    """A logical page without bodies whose overlays all decode and draw nothing."""
    drawings = [overlay_drawing(o, page["paper"] or A4) for o in page["overlays"]]
    return not page["members"] and bool(drawings) and all(d is not None and not d.marks for d in drawings)


def page_recovered(data: bytes, page: dict, entries: list[Entry]) -> bool:
    by = {e.idx: e for e in entries}
    if any(m["idx"] in by and recovered(data, by[m["idx"]], entries) for m in page["members"]):
        return True
    if any(_drawn(overlay_drawing(o, page["paper"] or A4)) for o in page["overlays"]):
        return True
    return explicit_blank(page) or not (page["members"] or page["overlays"])
