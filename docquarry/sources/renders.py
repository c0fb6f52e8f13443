"""Documents rendered where their bytes are: a PDF or an HTML text for each container, with what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.carving import carved
from ..functions import html, pdf
from ..functions.compose import composed, kinds, label_text, masked_pictures, text_bounds, upright
from .containers import _per_file, _readable

PDF = "path string, pdf binary, pages int, recovered int, placeholders int, attachments int, bookmarks int, skipped int, glyphs int"
HTML = "path string, html string, pages int, gaps int, attachments int, skipped int"
LAYERS = "path string, page int, layer int, role string, entry int, kinds string, area struct<x:bigint,y:bigint,w:bigint,h:bigint>, masked int, stored int, upright boolean, label string, text_right double"
COMPOSED = "path string, page int, layers int, replaced int, lost boolean"


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def pdfs(files: DataFrame, **options) -> DataFrame:
    """A PDF for each container that can be read. files: path, content. options: those of the PDF writer, but the name, which is the file's."""

    def rows(path: str, data: bytes, doc: dict) -> list[dict]:
        raw, r = pdf.document_pdf(data, doc, carved(data), options=pdf.Options(name=_name(path), **options))
        return [{"path": path, "pdf": raw} | vars(r)]

    return _per_file(files, _readable(rows), PDF)


def htmls(files: DataFrame, **options) -> DataFrame:
    """An HTML text for each container that can be read. files: path, content. options: those of the HTML writer, but the name."""

    def rows(path: str, data: bytes, doc: dict) -> list[dict]:
        text, r = html.document_html(data, doc, carved(data), options=html.Options(name=_name(path), **options))
        return [{"path": path, "html": text} | vars(r)]

    return _per_file(files, _readable(rows), HTML)


def layers(files: DataFrame) -> DataFrame:
    """What pages are made of, from the bottom, as the renderers draw it."""

    def rows(path: str, data: bytes, doc: dict) -> list[dict]:
        out = []
        for k, c in enumerate(composed(data, doc), 1):
            for n, x in enumerate(c.layers):
                d = x.drawing
                row = {"path": path, "page": k, "layer": n, "role": x.role, "entry": x.entry, "area": x.area and dict(zip("xywh", map(int, x.area))), "kinds": ",".join(sorted(kinds(d))) if d else "jpeg"}
                if d:
                    bounds = text_bounds(d)
                    row |= {"masked": sum(v is not None for v in masked_pictures(d, x.held).values()), "stored": len(x.held), "upright": upright(d), "label": label_text(d) if x.role == "label" else None, "text_right": bounds and bounds[0]}
                out.append(row)
        return out

    return _per_file(files, _readable(rows), LAYERS)


def pages(files: DataFrame) -> DataFrame:
    """Pages as they are rendered: how many layers they have, how many bodies an overlay replaces, and whether nothing of them can be shown."""
    row = lambda path, k, c: {"path": path, "page": k, "layers": len(c.layers), "replaced": c.replaced, "lost": c.lost}
    return _per_file(files, _readable(lambda path, data, doc: [row(path, k, c) for k, c in enumerate(composed(data, doc), 1)]), COMPOSED)
