"""Documents as one HTML file: pictures as data addresses, drawings as SVG, gaps where a page cannot be read."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, replace
from zlib import crc32

from .carving import Found
from .compose import Layer, composed, covered_glyphs, layer_marks, mask_alpha, masked_pictures
from .drawing import Drawing, Mark
from .pages import A4
from .raster import Raster, jpeg_info, png

GAP = {"en": "This page cannot be read.", "ja": "このページは読み取れません。"}
NOTHING = {"en": "No page of this document could be recovered.", "ja": "復元できたページはありません。"}
#: Characters with a meaning in markup, in the order in which they are replaced.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
STYLE = "body{margin:1em;background:#eee;font-family:sans-serif}figure{position:relative;background:#fff;margin:1em auto;max-width:60em}figure>*{width:100%;display:block}.over{position:absolute}.gap{padding:4em 1em;text-align:center;color:#666}"


@dataclass
class Options:
    """skip_lost: pages that cannot be read are left out. carry: the container itself can be taken out."""

    lang: str = "en"
    skip_lost: bool = False
    name: str = "container"
    attach: bool = True
    carry: bool = False
    previews: bool = False


@dataclass
class Report:
    pages: int = 0
    gaps: int = 0
    skipped: int = 0
    attachments: int = 0


def escape(text: str) -> str:
    for a, b in ESCAPES:
        text = text.replace(a, b)
    return text


def file_stem(path: str) -> str:
    """The last part up to its first dot, with anything but letters and digits as underscores."""
    return re.sub(r"[^\w]", "_", path.rsplit("/", 1)[-1].split(".")[0])


def address(kind: str, raw: bytes) -> str:
    return f"data:{kind};base64,{base64.b64encode(raw).decode()}"


def _n(x: float) -> str:
    return f"{x:.2f}".rstrip("0").rstrip(".")


def _colour(rgb) -> str:
    return "none" if rgb is None else "#%02x%02x%02x" % tuple(rgb)


def _path(figures: list) -> str:
    return "".join(f"M{_n(s[0])} {_n(s[1])}" + "".join(("L" if len(g) == 1 else "C") + " ".join(f"{_n(x)} {_n(y)}" for x, y in g) for g in segments) + ("Z" if closed else "") for s, segments, closed in figures)


def _picture(d: Drawing, m: Mark, held: dict[int, int], stored: dict[int, bytes]) -> str | None:
    """The address of an image's bytes; None for a stored picture that is nowhere."""
    if m.raster is None:
        raw = stored.get(held.get(m.stored))
        return address("image/jpeg", raw) if raw else None
    raster = d.rasters[m.raster]
    mask = m.op in ("stencil", "and") and m.rgb is not None and raster.bits == 1
    # other uses of the bitmap keep its colours
    return address("image/png", png(replace(raster, palette=[(255, 255, 255), m.rgb]) if mask else raster, mask))


def _masked(masked, d: Drawing, m: Mark, stored: dict[int, bytes], name: str) -> tuple[str, str]:
    """A definition and a reference: a stored picture through a mask."""
    raw = stored.get(masked.picture, b"")
    found = jpeg_info(raw)
    alpha = mask_alpha(d.rasters[masked.mask], found.width, found.height) if found else None
    if alpha is None:
        return "", ""
    grey = address("image/png", png(Raster(found.width, found.height, 8, [(k, k, k) for k in range(256)], alpha)))
    at = f'x="{_n(m.box[0])}" y="{_n(m.box[1])}" width="{_n(m.box[2] - m.box[0])}" height="{_n(m.box[3] - m.box[1])}" preserveAspectRatio="none"'
    return f'<mask id="{name}"><image {at} href="{grey}"/></mask>', f'<image {at} mask="url(#{name})" href="{address("image/jpeg", raw)}"/>'


def _mark(d: Drawing, m: Mark, held: dict[int, int], stored: dict[int, bytes], hidden: list[bool] | None = None) -> str:
    x0, y0, x1, y1 = m.box
    blend = ' style="mix-blend-mode:multiply"' if m.multiply else ""
    if m.kind == "fill":
        return f'<rect x="{_n(x0)}" y="{_n(y0)}" width="{_n(x1 - x0)}" height="{_n(y1 - y0)}" fill="{_colour(m.rgb)}"{blend}/>'
    if m.kind == "image":
        href = _picture(d, m, held, stored)
        return f'<image x="{_n(x0)}" y="{_n(y0)}" width="{_n(x1 - x0)}" height="{_n(y1 - y0)}" preserveAspectRatio="none" href="{href}"/>' if href else ""
    if m.kind == "shape":
        path = _path(m.figures)
        stroke = f' stroke="{_colour(m.stroke[0])}" stroke-width="{_n(m.stroke[1])}"' if m.stroke else ""
        rule = ' fill-rule="evenodd"' if m.even_odd else ""
        return f'<path d="{path}" fill="{_colour(m.rgb)}"{rule}{stroke}{blend}/>'
    turn = f' transform="rotate({_n(-m.font.escapement / 10)} {_n(m.xs[0])} {_n(y1)})"' if m.font.escapement else ""
    look = (' font-weight="bold"' if m.font.weight >= 600 else "") + (' text-decoration="underline"' if m.font.underline else "")
    # characters that shapes draw stay as text that is not painted
    runs = []
    for x, c, under in zip(m.xs, m.text, hidden or [False] * len(m.text)):
        if not runs or runs[-1][0] != under:
            runs.append((under, [], []))
        runs[-1][1].append(_n(x))
        runs[-1][2].append(c)
    return "".join(f'<text x="{" ".join(xs)}" y="{_n(y1)}" font-size="{_n(m.size)}" fill="{"none" if under else _colour(m.rgb)}"{look}{turn}>{escape("".join(chars))}</text>' for under, xs, chars in runs)


def svg(layer: Layer, css: str = "", stored: dict[int, bytes] | None = None) -> str:
    """Everything but texts in the order of drawing, then the texts. stored: pictures beside sheets by entry."""
    d, stored = layer.drawing, stored or {}
    w, h = (max(n, 1) for n in d.device)
    clips: dict[tuple, int] = {}
    key, body, defs = f"{crc32(repr(d.marks).encode()):08x}", [], []
    masked, covered = masked_pictures(d, layer.held), covered_glyphs(d)
    for k, m in sorted(layer_marks(layer), key=lambda x: x[1].kind == "text"):
        if k in masked:
            if masked[k] is None:
                continue
            defined, one = _masked(masked[k], d, m, stored, f"m{k}-{key}")
            defs.append(defined)
        else:
            one = _mark(d, m, layer.held, stored, covered.get(k))
        for clip in (m.clip, m.clip_path):
            if clip is not None and one:
                one = f'<g clip-path="url(#c{clips.setdefault(clip, len(clips))}-{key})">{one}</g>'
        body.append(one)
    for clip, k in clips.items():
        if isinstance(clip, int):
            figures, even_odd = d.paths[clip]
            inner = f'<path d="{_path(figures)}"{' clip-rule="evenodd"' if even_odd else ""}/>'
        else:
            inner = f'<rect x="{_n(clip[0])}" y="{_n(clip[1])}" width="{_n(clip[2] - clip[0])}" height="{_n(clip[3] - clip[1])}"/>'
        defs.append(f'<clipPath id="c{k}-{key}">{inner}</clipPath>')
    held = "".join(defs)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}" preserveAspectRatio="none"{css}>{f"<defs>{held}</defs>" if held else ""}{"".join(body)}</svg>'


def _placed(layer: Layer, frame: tuple[int, int], alone: bool) -> str:
    """Where a layer lies on its page, in hundredths of its sides; labels lie near the upper right corner."""
    area = layer.area
    if layer.role == "label":
        w, h = layer.drawing.frame
        area = (frame[0] * 0.9 - w, frame[1] * 0.04, w, h)
    elif area is None:
        if layer.role in ("body", "picture") or alone:
            return ""
        area = (0, 0, *frame)
    return ' class="over" style="' + ";".join(f"{side}:{_n(100 * v / whole)}%" for side, v, whole in zip(("left", "top", "width", "height"), area, (*frame, *frame))) + '"'


def document_html(data: bytes, doc: dict, attached: list[Found] = (), lang: str = "en", name: str = "container", options: Options | None = None) -> tuple[str, Report]:
    """The text, and how many pages it has, how many of them are gaps, and what can be taken out."""
    o, report = options or Options(lang, name=name), Report()
    stored = {e.idx: data[e.at : e.at + e.length] for e in doc["entries"] if e.kind == "jpeg"}
    figures = []
    for k, c in enumerate(composed(data, doc, o.previews), 1):
        if c.lost:
            if o.skip_lost:
                report.skipped += 1
                continue
            report.gaps += 1
            parts = [f'<div class="gap">{GAP[o.lang]}</div>']
        else:
            parts = []
            for x in c.layers:
                where = _placed(x, c.paper or A4, False)
                parts.append(f'<img{where} src="{address("image/jpeg", x.jpeg)}" alt="">' if x.jpeg is not None else svg(x, where, stored))
        turned = f' style="transform:rotate({c.rotation}deg)"' if c.rotation else ""
        figures.append(f'<figure id="p{k}"{turned}>{"".join(parts)}</figure>')
    report.pages = len(figures)
    files = [(f"original{k}.{f.extension}", data[f.offset : f.offset + f.length]) for k, f in enumerate(attached)] if o.attach else []
    if o.carry:
        files.append((o.name, data))
    report.attachments = len(files)
    links = "".join(f'<li><a download="{escape(title)}" href="{address("application/octet-stream", raw)}">{escape(title)}</a></li>' for title, raw in files)
    shown = "".join(figures) or f"<p>{NOTHING[o.lang]}</p>"
    page = f'<!DOCTYPE html>\n<html lang="{o.lang}"><head><meta charset="utf-8"><title>{escape(o.name)}</title><style>{STYLE}</style></head><body>{shown}{f"<ul>{links}</ul>" if links else ""}</body></html>\n'
    return page, report
