"""Documents as PDF: pictures go in as they are, drawings as operators, and what cannot be read as a placeholder page."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from .carving import Found
from .compose import Composed, Layer, composed, layer_marks, mask_alpha, masked_pictures
from .drawing import Drawing, Mark
from .pages import A4
from .paper import A4_POINTS, contained, em_width, page_points
from .raster import Raster, jpeg_info
from .tlv import Entry
from .ttf import FontFile, font_file, to_unicode, widths

#: Notes for pages that are lost, the longest first.
NOTES = {"en": ("Page {} could not be recovered: its coding is not public.", "Page {} not recovered", "?"), "ja": ("{} ページの符号化方式は読み取れません。", "{} 読取不可", "?")}
GAP = {"en": "Page {} not recovered", "ja": "{} ページは読み取れません"}
# Where a label's box lies, in shares of the page and in points at least.
LABEL_RIGHT, LABEL_TOP = (0.10, 8.0), (0.04, 4.0)


@dataclass
class Options:
    """paper: one size in points for all pages, to which nothing is enlarged. carry: the container itself goes along as a file."""

    lang: str = "en"
    skip_lost: bool = False
    name: str = "container"
    paper: tuple[float, float] | None = None
    bookmarks: bool = True
    attach: bool = True
    carry: bool = False
    previews: bool = False
    #: a TrueType font that is embedded for characters that are not ASCII; others are set in a Japanese font that readers have
    font: bytes | None = None


@dataclass
class Report:
    pages: int = 0
    recovered: int = 0
    placeholders: int = 0
    attachments: int = 0
    bookmarks: int = 0
    skipped: int = 0
    glyphs: int = 0


def number(n: float) -> str:
    return f"{n:.3f}".rstrip("0").rstrip(".") or "0"


def text_string(text: str) -> bytes:
    """A string object: escaped where it is ASCII, else UTF-16 with its mark, in hexadecimal."""
    if text.isascii():
        raw = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").replace("\r", "\\r").replace("\n", "\\n")
        return f"({raw})".encode()
    return b"<FEFF" + text.encode("utf-16-be", "replace").hex().upper().encode() + b">"


class Objects:
    """Numbered objects and the cross-reference table."""

    def __init__(self):
        self.bodies: list[bytes | None] = []

    def reserve(self) -> int:
        self.bodies.append(None)
        return len(self.bodies)

    def add(self, body: bytes | str, at: int | None = None) -> int:
        at = at or self.reserve()
        self.bodies[at - 1] = body.encode() if isinstance(body, str) else body
        return at

    def stream(self, entries: str, raw: bytes, packed: bool = True) -> int:
        if packed:
            raw, entries = zlib.compress(raw, 6), entries + " /Filter /FlateDecode"
        return self.add(f"<< {entries} /Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream")

    def finish(self, root: int, info: int) -> bytes:
        out, at = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), []
        for k, body in enumerate(self.bodies, 1):
            at.append(len(out))
            out += f"{k} 0 obj\n".encode() + (body or b"null") + b"\nendobj\n"
        start = len(out)
        out += f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % a for a in at)
        return bytes(out + f"trailer\n<< /Size {len(at) + 1} /Root {root} 0 R /Info {info} 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())


class _Page:
    def __init__(self, objects: Objects, size: tuple[float, float], font: FontFile | None = None):
        self.objects, self.size, self.ops, self.images, self.font = objects, size, [], {}, font
        #: glyphs of the embedded font with their characters, and how many glyphs are set
        self.own: dict[int, str] = {}
        self.glyphs = 0
        #: whether text is set in the Japanese font
        self.wide = False

    def op(self, *parts) -> None:
        self.ops.append(" ".join(p if isinstance(p, str) else number(p) for p in parts))

    def image(self, ref: int, left: float, bottom: float, w: float, h: float) -> None:
        name = self.images.setdefault(ref, f"I{len(self.images)}")
        self.op("q", w, 0.0, 0.0, h, left, bottom, f"cm /{name} Do Q")

    def jpeg_object(self, raw: bytes, mask: Raster | None = None) -> int | None:
        """A picture as it is, with a mask at its own size where there is one."""
        found = jpeg_info(raw)
        if not found:
            return None
        space = {1: "/DeviceGray", 4: "/DeviceCMYK /Decode [1 0 1 0 1 0 1 0]"}.get(found.components, "/DeviceRGB")
        alpha = mask_alpha(mask, found.width, found.height) if mask else None
        size = f"/Type /XObject /Subtype /Image /Width {found.width} /Height {found.height} /BitsPerComponent 8"
        soft = f" /SMask {self.objects.stream(f'{size} /ColorSpace /DeviceGray', alpha)} 0 R" if alpha else ""
        return self.objects.stream(f"{size} /ColorSpace {space}{soft} /Filter /DCTDecode", raw, packed=False)

    def jpeg(self, raw: bytes, box: tuple[float, float, float, float]) -> bool:
        ref = self.jpeg_object(raw)
        if ref is None:
            return False
        left, top, w, h = box
        self.image(ref, left, self.size[1] - top - h, w, h)
        return True

    def raster(self, r: Raster, mark: Mark) -> int:
        head = f"/Type /XObject /Subtype /Image /Width {r.width} /Height {r.height}"
        if mark.op in ("stencil", "and") and mark.rgb and r.bits == 1:
            return self.objects.stream(f"{head} /ImageMask true /BitsPerComponent 1 /Decode [1 0]", r.rows)
        if r.bits == 24:
            return self.objects.stream(f"{head} /BitsPerComponent 8 /ColorSpace /DeviceRGB", r.rows)
        table = bytes(c for colour in r.palette for c in colour).hex()
        return self.objects.stream(f"{head} /BitsPerComponent {r.bits} /ColorSpace [/Indexed /DeviceRGB {len(r.palette) - 1} <{table}>]", r.rows)

    def drawing(self, layer: Layer, area: tuple[float, float, float, float], stored: dict[int, bytes]) -> None:
        """Marks in order, scaled from device units to an area (left, top, width, height) of the page. stored: pictures by entry."""
        d = layer.drawing
        dw, dh = (n if n > 0 else 1 for n in d.device)
        self.op("q", area[2] / dw, 0.0, 0.0, -area[3] / dh, area[0], self.size[1] - area[1], "cm")
        refs: dict = {}
        masked = masked_pictures(d, layer.held)
        for k, m in layer_marks(layer):
            if k in masked and masked[k] is None:
                continue
            self.op("q")
            if m.clip:
                self.op(m.clip[0], m.clip[1], m.clip[2] - m.clip[0], m.clip[3] - m.clip[1], "re W n")
            if m.clip_path is not None:
                figures, even_odd = d.paths[m.clip_path]
                self.path(figures)
                self.op("W* n" if even_odd else "W n")
            if m.rgb:
                self.op(*[c / 255 for c in m.rgb], "rg")
            if m.kind == "image":
                self.picture(layer, m, refs, stored, masked.get(k))
            else:
                getattr(self, f"_{m.kind}")(m)
            self.op("Q")
        self.op("Q")

    def picture(self, layer: Layer, m: Mark, refs: dict, stored: dict[int, bytes], masked) -> None:
        """A bitmap of the drawing, or a picture that stands beside the sheet; what is nowhere is left out."""
        d = layer.drawing
        key = ("masked", masked.picture, masked.mask) if masked else ("own", m.raster) if m.raster is not None else ("stored", layer.held.get(m.stored))
        if key not in refs:
            if masked:
                refs[key] = self.jpeg_object(stored.get(masked.picture, b""), d.rasters[masked.mask])
            elif m.raster is not None:
                refs[key] = self.raster(d.rasters[m.raster], m)
            else:
                refs[key] = self.jpeg_object(stored.get(layer.held.get(m.stored), b""))
        if refs[key] is not None:
            self.image(refs[key], m.box[0], m.box[3], m.box[2] - m.box[0], m.box[1] - m.box[3])

    def _fill(self, m: Mark) -> None:
        self.op(m.box[0], m.box[1], m.box[2] - m.box[0], m.box[3] - m.box[1], "re f")

    def path(self, figures: list) -> None:
        for start, segments, closed in figures:
            self.op(*start, "m")
            for seg in segments:
                self.op(*[n for p in seg for n in p], "l" if len(seg) == 1 else "c")
            if closed:
                self.op("h")

    def _shape(self, m: Mark) -> None:
        if m.stroke:
            self.op(*[c / 255 for c in m.stroke[0]], "RG", m.stroke[1], "w")
        self.path(m.figures)
        star = "*" if m.even_odd else ""
        self.op("n" if not (m.rgb or m.stroke) else f"B{star}" if m.rgb and m.stroke else f"f{star}" if m.rgb else "S")

    def _text(self, m: Mark) -> None:
        turn = np.deg2rad(m.font.escapement / 10)
        cos, sin = float(np.cos(turn)), float(np.sin(turn))
        self.op("BT")
        if m.font.weight >= 600:
            self.op("2 Tr", *[c / 255 for c in m.rgb or (0, 0, 0)], "RG", m.size / 40, "w")
        for x, c in zip(m.xs, m.text):
            name, raw = self.glyph(c)
            dx = x - m.xs[0]
            # the page is turned over, so glyphs are turned back
            self.op(name, m.size, "Tf", cos, -sin, -sin, -cos, m.xs[0] + dx * cos, m.box[3] - dx * sin, "Tm", raw, "Tj")
        self.op("ET")
        if m.font.underline:
            self.op(m.xs[0], m.box[3] + m.size * 0.1, m.xs[-1] - m.xs[0] + m.size, m.size * 0.05, "re f")

    def glyph(self, c: str) -> tuple[str, str]:
        """The font and the string that set a character."""
        self.glyphs += 1
        if 32 <= ord(c) < 127:
            return "/FH", text_string(c).decode()
        g = self.font.glyph(c) if self.font else 0
        if g:
            self.own[g] = c
            return "/FE", f"<{g:04X}>"
        self.wide = True
        return "/FJ", f"<{c.encode('utf-16-be', 'replace').hex()}>"

    def placeholder(self, notes: tuple[str, ...]) -> None:
        """A border and the longest note that fits on one line at seven points, or else at three and a half."""
        w, h = self.size
        edge = min(w, h) * 0.05
        self.op("0.6 G", edge, edge, w - 2 * edge, h - 2 * edge, "re S")
        for size in (12.0, 7.0, 3.5):
            note = next((n for n in notes if em_width(n) * size <= w - 3 * edge), None)
            if note:
                self.wide |= not note.isascii()
                font, raw = ("/FH", text_string(note).decode()) if note.isascii() else ("/FJ", f"<{note.encode('utf-16-be').hex()}>")
                self.op("BT", font, size, "Tf", (w - em_width(note) * size) / 2, h / 2, "Td", raw, "Tj ET")
                return

    def finish(self, parent: int, fonts: str, turn: int) -> int:
        content = self.objects.stream("", "\n".join(self.ops).encode())
        images = " ".join(f"/{name} {ref} 0 R" for ref, name in self.images.items())
        size = " ".join(number(n) for n in self.size)
        rotate = f" /Rotate {turn}" if turn else ""
        return self.objects.add(f"<< /Type /Page /Parent {parent} 0 R /MediaBox [0 0 {size}]{rotate} /Contents {content} 0 R /Resources << /Font << {fonts} >> /XObject << {images} >> >> >>")


def _within(box, area):
    return box[0] + area[0], box[1] + area[1], box[2], box[3]


def _stack(page: _Page, raws: list[bytes], area) -> None:
    """Pictures below each other at one scale, as wide and high as the area allows."""
    good = [(r, (i.width, i.height)) for r in raws if (i := jpeg_info(r)) and i.width and i.height]
    if not good:
        return
    k = min(area[2] / max(s[0] for _, s in good), area[3] / sum(s[1] for _, s in good))
    top = area[1]
    for raw, (w, h) in good:
        page.jpeg(raw, (area[0], top, w * k, h * k))
        top += h * k


def _own_size(c: Composed) -> tuple[float, float]:
    """The page's paper in points; without one, that of its one picture at its density."""
    size = page_points(c.paper)
    found = jpeg_info(c.layers[0].jpeg) if len(c.layers) == 1 and c.layers[0].jpeg else None
    if size is None and found and found.width and found.height:
        size = found.width * 72 / found.dpi_x, found.height * 72 / found.dpi_y
    return size or A4_POINTS


def _label_box(d: Drawing, size: tuple[float, float]) -> tuple[float, float, float, float]:
    w, h = (max(n, 1) * 72 / 2540 for n in d.frame)
    left, top = size[0] - max(LABEL_RIGHT[0] * size[0], LABEL_RIGHT[1]) - w, max(LABEL_TOP[0] * size[1], LABEL_TOP[1])
    return max(left, 0.0), min(top, max(size[1] - h, 0.0)), w, h


def _drawn_page(objects: Objects, c: Composed, paper: tuple[float, float] | None, stored: dict[int, bytes], font: FontFile | None) -> _Page:
    own = _own_size(c)
    page = _Page(objects, paper or own, font)
    # on paper of another size, the page lies in the middle, and is made smaller but never larger
    k = min(1.0, page.size[0] / own[0], page.size[1] / own[1])
    room = ((page.size[0] - own[0] * k) / 2, (page.size[1] - own[1] * k) / 2, own[0] * k, own[1] * k)
    frame = c.paper or A4
    scale = room[2] / frame[0], room[3] / frame[1]
    placed = lambda a: (room[0] + a[0] * scale[0], room[1] + a[1] * scale[1], a[2] * scale[0], a[3] * scale[1]) if a else room
    stacked = [x.jpeg for x in c.layers if x.role == "picture"]
    for x in c.layers:
        if x.role == "picture":
            if stacked:
                _stack(page, stacked, placed(x.area))
                stacked = []
        elif x.jpeg is not None:
            found = jpeg_info(x.jpeg)
            page.jpeg(x.jpeg, _within(contained((found.width or 1, found.height or 1), placed(x.area)[2:]), placed(x.area)))
        else:
            page.drawing(x, _label_box(x.drawing, page.size) if x.role == "label" else placed(x.area), stored)
    return page


def _embedded(objects: Objects, font: FontFile, used: dict[int, str]) -> int:
    """A font that is embedded, with the widths of the glyphs used and the way back to their characters."""
    file = objects.stream(f"/Length1 {len(font.data)}", font.data)
    box = " ".join(str(font.scaled(n)) for n in font.box)
    told = objects.add(f"<< /Type /FontDescriptor /FontName /Embedded /Flags 4 /FontBBox [{box}] /ItalicAngle 0 /Ascent {font.scaled(font.ascent)} /Descent {font.scaled(font.descent)} /CapHeight {font.scaled(font.ascent)} /StemV 80 /FontFile2 {file} 0 R >>")
    descend = objects.add(f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Embedded /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /CIDToGIDMap /Identity /DW 1000 /W {widths(font, used)} /FontDescriptor {told} 0 R >>")
    back = objects.stream("", to_unicode(used))
    return objects.add(f"<< /Type /Font /Subtype /Type0 /BaseFont /Embedded /Encoding /Identity-H /DescendantFonts [{descend} 0 R] /ToUnicode {back} 0 R >>")


def document_pdf(data: bytes, doc: dict, attached: list[Found] = (), lang: str = "en", skip_lost: bool = False, name: str = "container", options: Options | None = None) -> tuple[bytes, Report]:
    """A PDF with a page for each logical page, or sheet, of a parsed container, and its original files attached. Pages that cannot
    be read become placeholders, or go with `skip_lost`; numbers of bookmarks count them either way."""
    o = options or Options(lang, skip_lost, name)
    objects, report = Objects(), Report()
    root, tree, info, plain, wide = (objects.reserve() for _ in range(5))
    objects.add("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", plain)
    stored = {e.idx: data[e.at : e.at + e.length] for e in doc["entries"] if e.kind == "jpeg"}
    pages, made, lost, font = composed(data, doc, o.previews), [], [], font_file(o.font) if o.font else None
    for k, c in enumerate(pages, 1):
        if c.lost:
            if o.skip_lost:
                report.skipped += 1
                continue
            lost.append((k, len(made)))
            page = _Page(objects, o.paper or page_points(c.paper) or A4_POINTS)
            page.placeholder(tuple(n.format(k) for n in NOTES[o.lang]))
            report.placeholders += 1
        else:
            page = _drawn_page(objects, c, o.paper, stored, font)
            report.recovered += 1
        made.append((page, c.rotation))
    if not made:
        page = _Page(objects, o.paper or A4_POINTS)
        page.placeholder(("No page of this document could be recovered.", "Nothing recovered", "?"))
        made.append((page, 0))
    uses = any(page.wide for page, _ in made)
    if uses:
        descend = objects.add("<< /Type /Font /Subtype /CIDFontType0 /BaseFont /HeiseiMin-W3 /CIDSystemInfo << /Registry (Adobe) /Ordering (Japan1) /Supplement 2 >> /DW 1000 >>")
        objects.add(f"<< /Type /Font /Subtype /Type0 /BaseFont /HeiseiMin-W3 /Encoding /UniJIS-UTF16-H /DescendantFonts [{descend} 0 R] >>", wide)
    fonts = f"/FH {plain} 0 R" + (f" /FJ {wide} 0 R" if uses else "")
    used = {g: c for page, _ in made for g, c in page.own.items()}
    if used:
        fonts += f" /FE {_embedded(objects, font, used)} 0 R"
    report.glyphs = sum(page.glyphs for page, _ in made)
    kids = [page.finish(tree, fonts, turn) for page, turn in made]
    files = [(f"original{k}.{f.extension}", data[f.offset : f.offset + f.length]) for k, f in enumerate(attached)] if o.attach else []
    if o.carry:
        files.append((o.name, data))
    report.pages, report.attachments = len(kids), len(files)
    objects.add(f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>", tree)
    catalog = f"<< /Type /Catalog /Pages {tree} 0 R"
    if files:
        names = []
        for title, raw in files:
            file = objects.stream(f"/Type /EmbeddedFile /Params << /Size {len(raw)} >>", raw, packed=False)
            label = text_string(title).decode()
            spec = objects.add(f"<< /Type /Filespec /F {label} /UF {label} /EF << /F {file} 0 R >> >>")
            names.append(f"{label} {spec} 0 R")
        catalog += f" /Names << /EmbeddedFiles << /Names [{' '.join(names)}] >> >> /PageMode /UseAttachments"
    if lost and o.bookmarks:
        outline, items = objects.reserve(), [objects.reserve() for _ in lost]
        for k, (item, (n, kid)) in enumerate(zip(items, lost)):
            before, after = (f" /Prev {items[k - 1]} 0 R" if k else ""), (f" /Next {items[k + 1]} 0 R" if k + 1 < len(items) else "")
            title = text_string(GAP[o.lang].format(n)).decode()
            objects.add(f"<< /Title {title} /Parent {outline} 0 R{before}{after} /Dest [{kids[kid]} 0 R /Fit] >>", item)
        objects.add(f"<< /Type /Outlines /First {items[0]} 0 R /Last {items[-1]} 0 R /Count {len(items)} >>", outline)
        catalog += f" /Outlines {outline} 0 R" + ("" if files else " /PageMode /UseOutlines")
        report.bookmarks = len(items)
    objects.add(catalog + " >>", root)
    objects.add(b"<< /Title " + text_string(o.name) + f" /Producer (docquarry) /Subject (recovered {report.recovered} of {len(pages)} page(s); {report.placeholders} placeholder(s), {report.attachments} attachment(s)) >>".encode(), info)
    return objects.finish(root, info), report
