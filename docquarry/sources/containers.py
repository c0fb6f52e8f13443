"""Containers as tables. A file is read and parsed in one pass by its own task; only rows without payload leave it."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import HELD_BYTES, HELD_ROWS, lean
from ..functions.carving import carved
from ..functions.container import MAGIC, OFFICE, parse
from ..functions.drawing import Drawing
from ..functions.pages import A4, bare_text, overlay_drawing, page_drawing, page_recovered, readable, recovered
from ..functions.paper import paired_pictures
from ..functions.tlv import ContainerError, field_names

PAIR = "struct<w:bigint,h:bigint>"
ENTRY = f"struct<idx:int,role:string,belongs_to:int,data_kind:string,offset:bigint,at:bigint,length:bigint,checksum:bigint,paper:{PAIR},pixels:{PAIR},code:bigint,aux:bigint,method:bigint,stored:bigint,expanded:bigint,rows:bigint,colour:bigint,below:bigint,rotation:int,overlays:int,unknown:array<int>>"
AREA = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
DISPLAY = f"struct<paper:{PAIR},rotation:int,overlays:int,members:array<struct<idx:int,area:{AREA}>>>"
PARSED = f"path string, length bigint, generation bigint, trailer_tag int, declared_entries bigint, checksum bigint, generations_present bigint, rebuilt string, image_derived array<bigint>, unknown_elements array<struct<tag:int,at:bigint,length:bigint>>, properties_at bigint, properties_stored bigint, properties_expanded bigint, displays array<{DISPLAY}>, error_code string, error_detail string, entries array<{ENTRY}>"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the two extensions in a folder and those below it, in either case: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{[xX][dD][wW],[xX][bB][dD]}").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


def _row(path: str, data: bytes) -> dict:
    row = {"path": path, "length": len(data)}
    try:
        doc = parse(data)
    except ContainerError as e:
        return row | {"error_code": e.code, "error_detail": e.detail, "entries": [], "displays": []}
    pair = lambda p: {"w": p[0], "h": p[1]} if p else None
    entries = [{"idx": e.idx, "role": e.role, "belongs_to": e.belongs_to, "data_kind": e.kind, "offset": e.offset, "at": e.at, "length": e.length, "checksum": e.checksum, "paper": pair(e.paper), "pixels": pair(e.pixels), "code": e.code, "aux": e.aux, "method": e.method, "stored": e.stored, "expanded": e.expanded, "rows": e.rows, "colour": e.colour, "below": e.below, "rotation": e.rotation, "overlays": len(e.overlays), "unknown": e.unknown} for e in doc["entries"]]
    area = lambda a: dict(zip("xywh", a)) if a else None
    displays = [{"paper": pair(d["paper"]), "rotation": d["rotation"], "overlays": len(d["overlays"]), "members": [{"idx": m["idx"], "area": area(m["area"])} for m in d["members"]]} for d in doc["displays"]]
    return row | doc | {"entries": entries, "displays": displays}


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _given(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for path, content in zip(batch.column("path"), batch.column("content")):
        yield path.as_py(), content.as_py() or b""


def _batch(rows: list[dict] | list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    if rows and isinstance(rows[0], tuple):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _per_file(files: DataFrame, rows: Callable[[str, bytes], list[dict] | list[tuple]], ddl: str) -> DataFrame:
    """A table of what `rows` gives for each file, by name or in the table's order, in batches of few rows and few bytes. Files that are made of rows are made
    one by one in the task that reads them, and no table holds them. files: path, content."""
    parts = getattr(files, "_docquarry_parts", None)
    if parts:
        return functools.reduce(DataFrame.unionByName, [_per_file(p, rows, ddl) for p in parts])
    schema = _schema(ddl)
    source, each = getattr(files, "_docquarry_made", None) or (files.select("path", "content"), _given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for path, content in each(batch):
                held += rows(path, content)
                size += len(content)
                if len(held) >= HELD_ROWS or size >= HELD_BYTES:
                    yield _batch(held, schema)
                    held, size = [], 0
        yield _batch(held, schema)

    return source.mapInArrow(lean(run), ddl)


def united(*files: DataFrame) -> DataFrame:
    """Files of several tables as one; each table's are still read where they are made. files: path, content."""
    out = functools.reduce(DataFrame.unionByName, files)
    out._docquarry_parts = files
    return out


def parsed(files: DataFrame) -> DataFrame:
    """One row per file with its entries nested; what cannot be read has an error_code. files: path, content."""
    return _per_file(files, lambda path, data: [_row(path, data)], PARSED)


def _readable(rows: Callable[[str, bytes, dict], list[dict]]) -> Callable[[str, bytes], list[dict]]:
    """For files that can be read; others give no rows."""

    def run(path: str, data: bytes) -> list[dict]:
        try:
            return rows(path, data, parse(data))
        except ContainerError:
            return []

    return run


PAGES = f"path string, page int, idx int, kind string, paper {PAIR}, rotation int, recovered boolean"


def _pages(path: str, data: bytes, doc: dict) -> list[dict]:
    pair = lambda p: {"w": p[0], "h": p[1]} if p else None
    if doc["displays"]:
        return [{"path": path, "page": k, "kind": "display", "paper": pair(d["paper"]), "rotation": d["rotation"], "recovered": page_recovered(data, d, doc["entries"])} for k, d in enumerate(doc["displays"], 1)]
    sheets = [e for e in doc["entries"] if e.role == "sheet"]
    return [{"path": path, "page": k, "idx": e.idx, "kind": e.kind, "paper": pair(e.paper), "rotation": e.rotation, "recovered": recovered(data, e, doc["entries"])} for k, e in enumerate(sheets, 1)]


def pages(files: DataFrame) -> DataFrame:
    """Pages that a faithful conversion has: logical pages where the properties tell them, else sheets. Bodies are decoded to tell whether a page is recovered."""
    return _per_file(files, _readable(_pages), PAGES)


def _decoded(path: str, data: bytes, doc: dict) -> list[dict]:
    return [{"path": path, "idx": e.idx, "decoded": readable(e) or recovered(data, e, doc["entries"])} for e in doc["entries"] if e.role == "sheet"]


def decoded(files: DataFrame) -> DataFrame:
    """Which sheets can be used, decoding included: path, idx, decoded."""
    return _per_file(files, _readable(_decoded), "path string, idx int, decoded boolean")


COLOUR = "struct<r:int,g:int,b:int>"
BOX = "struct<left:double,top:double,right:double,bottom:double>"
MARKS = f"path string, idx int, overlay int, kind string, ord int, box {BOX}, rgb {COLOUR}, text string, xs array<double>, size double, escapement int, bold boolean, underline boolean, font string, op string, raster int, pixels {PAIR}, stroke {COLOUR}, stroke_width double, multiply boolean, clip {BOX}, clip_path int, stored int, source {PAIR}, points int, device {PAIR}, frame {PAIR}"


def _each_drawing(data: bytes, doc: dict) -> Iterator[tuple[int, int | None, Drawing]]:
    """Sheets by idx, with their overlays numbered."""
    for e in doc["entries"]:
        own = page_drawing(data, e, doc["entries"]) if e.role == "sheet" else None
        if own:
            yield e.idx, None, own
        for k, o in enumerate(e.overlays):
            over = overlay_drawing(o, e.paper or A4)
            if over:
                yield e.idx, k, over


def _marks(path: str, data: bytes, doc: dict) -> list[dict]:
    pair = lambda p: {"w": p[0], "h": p[1]}
    box = lambda b: dict(zip(("left", "top", "right", "bottom"), b)) if b else None
    colour = lambda c: dict(zip("rgb", c)) if c else None
    out = []
    for idx, overlay, d in _each_drawing(data, doc):
        for m in d.marks:
            stroke, width = m.stroke or (None, None)
            raster = d.rasters[m.raster] if m.raster is not None else None
            out.append({
                "path": path, "idx": idx, "overlay": overlay, "kind": m.kind, "ord": m.order, "box": box(m.box), "rgb": colour(m.rgb), "text": m.text, "xs": m.xs, "size": m.size, "escapement": m.font.escapement,
                "bold": m.font.weight >= 600, "underline": m.font.underline, "font": m.font.kind, "op": m.op, "raster": m.raster, "pixels": raster and pair((raster.width, raster.height)),
                "stroke": colour(stroke), "stroke_width": width, "multiply": m.multiply, "clip": box(m.clip), "clip_path": m.clip_path, "stored": m.stored, "source": m.source and pair(m.source), "points": sum(1 + sum(map(len, segments)) for _, segments, _ in m.figures), "device": pair(d.device), "frame": pair(d.frame),
            })
    return out


def marks(files: DataFrame) -> DataFrame:
    """What sheets and their overlays draw, a row for each text, image, fill and shape."""
    return _per_file(files, _readable(_marks), MARKS)


RASTERS = "path string, idx int, overlay int, raster int, width bigint, height bigint, bits int, ink bigint, sha256 string"


def _rasters(path: str, data: bytes, doc: dict) -> list[dict]:
    return [{"path": path, "idx": idx, "overlay": k, "raster": n, "width": r.width, "height": r.height, "bits": r.bits, "ink": r.ink(), "sha256": hashlib.sha256(r.rows).hexdigest()} for idx, k, d in _each_drawing(data, doc) for n, r in enumerate(d.rasters)]


def rasters(files: DataFrame) -> DataFrame:
    """The bitmaps that sheets and their overlays draw: sizes, how many pixels are black, and a digest of the packed rows."""
    return _per_file(files, _readable(_rasters), RASTERS)


def _pictures(path: str, data: bytes, doc: dict) -> list[dict]:
    out = []
    for e in doc["entries"]:
        d = page_drawing(data, e, doc["entries"]) if e.role == "sheet" else None
        if d and d.calls:
            beside = [p for p in doc["entries"] if p.role == "picture" and p.belongs_to == e.idx]
            found = paired_pictures([size for _, size in d.calls], [p.pixels for p in beside])
            out += [{"path": path, "idx": e.idx, "stored": n, "source": {"w": size[0], "h": size[1]}, "picture": None if k is None else beside[k].idx, "paths": len(d.paths), "masks": d.shape_masks} for (n, size), k in zip(d.calls, found)]
    return out


def called_pictures(files: DataFrame) -> DataFrame:
    """Stored pictures that sheets call for, each once, with the entry that holds it: path, idx, stored, source, picture, and how many paths the sheet clips how many marks to."""
    return _per_file(files, _readable(_pictures), f"path string, idx int, stored int, source {PAIR}, picture int, paths int, masks int")


def _bare_texts(path: str, data: bytes, doc: dict) -> list[dict]:
    found = ((e.idx, bare_text(data[e.at : e.at + e.length])) for e in doc["entries"] if e.kind == "bare")
    return [{"path": path, "idx": idx, "text": text} for idx, text in found if text]


def bare_texts(files: DataFrame) -> DataFrame:
    """The texts that bare bodies expand to: path, idx, text."""
    return _per_file(files, _readable(_bare_texts), "path string, idx int, text string")


def _skipped(path: str, data: bytes, doc: dict) -> list[dict]:
    return [{"path": path, "idx": idx, "overlay": k, "record": kind, "n": n} for idx, k, d in _each_drawing(data, doc) for kind, n in d.skipped.items()]


def skipped_records(files: DataFrame) -> DataFrame:
    """Metafile records that were not drawn, by number."""
    return _per_file(files, _readable(_skipped), "path string, idx int, overlay int, record bigint, n bigint")


def _names(path: str, data: bytes, doc: dict) -> list[dict]:
    return [{"path": path, "idx": e.idx, "fields": e.rows, "names": field_names(data[e.at : e.at + e.length])} for e in doc["entries"] if e.kind == "fields"]


def data_tables(files: DataFrame) -> DataFrame:
    """Field tables and the names in them."""
    return _per_file(files, _readable(_names), "path string, idx int, fields bigint, names array<string>")


def entries(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.inline("entries"))


AUDITED = f"path string, idx int, role string, belongs_to int, data_kind string, code bigint, pixels {PAIR}"


def _audited(path: str, data: bytes, doc: dict) -> list[tuple]:
    return [(path, e.idx, e.role, e.belongs_to, e.kind, e.code, e.pixels and {"w": e.pixels[0], "h": e.pixels[1]}) for e in doc["entries"]]


def audited(files: DataFrame) -> DataFrame:
    """Entries of files that can be read, with what audits ask of them alone: the same rows as of `entries`, in a few columns and not nested first."""
    return _per_file(files, _readable(_audited), AUDITED)


RUNS = "path string, sheet int, run bigint, first int, n bigint, width bigint"


def _runs(path: str, data: bytes, doc: dict) -> list[tuple]:
    out: list[list] = []
    last: dict[int | None, list] = {}
    for e in sorted((e for e in doc["entries"] if e.role == "picture"), key=lambda e: e.idx):
        width, before = e.pixels and e.pixels[0], last.get(e.belongs_to)
        if before and width is not None and before[5] == width:
            before[4] += 1
        else:
            last[e.belongs_to] = [path, e.belongs_to, before[2] + 1 if before else 1, e.idx, 1, width]
            out.append(last[e.belongs_to])
    return [tuple(r) for r in out]


def picture_runs(files: DataFrame) -> DataFrame:
    """The runs of `audit.picture_runs`, told in the task that reads a file: path, sheet, run, first, n, width. No entry is shuffled or sorted."""
    return _per_file(files, _readable(_runs), RUNS)


def looks_like(content: Column) -> Column:
    """What bytes that are no container seem to be, by their first ones; null if nothing known."""
    head, zips = F.substring(content, 1, 512), F.lit("zip")
    for part, kind in reversed(OFFICE):
        zips = F.when(F.contains(head, F.lit(part)), kind).otherwise(zips)
    out = F.lit(None).cast("string")
    for magic, label in reversed(MAGIC):
        out = F.when(F.startswith(content, F.lit(magic)), zips if label == "zip" else label).otherwise(out)
    return out


ATTACHMENT = "path string, offset bigint, length bigint, extension string, estimate boolean"


def _carve(path: str, data: bytes) -> list[dict]:
    return [{"path": path, "offset": f.offset, "length": f.length, "extension": f.extension, "estimate": f.estimate} for f in carved(data)]


def attachments(files: DataFrame) -> DataFrame:
    """Original files inside files, without their bytes: path, offset, length, extension, estimate. files: path, content."""
    return _per_file(files, _carve, ATTACHMENT)


def attachment_bytes(content: Column, offset: Column, length: Column) -> Column:
    return F.substring(content, (offset + 1).cast("int"), length.cast("int"))


def attachment_label(extension: Column) -> Column:
    return F.when(extension == "docx", "Word document").when(extension == "xlsx", "Excel workbook").when(extension == "pptx", "PowerPoint deck").when(extension == "cfb", "compound file (legacy Office)").when(extension == "pdf", "PDF").otherwise("zip container")
