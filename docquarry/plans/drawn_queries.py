"""Queries on what pages draw, over containers drawn from the table of parts, four in a row to a container, and their SQL on that table."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import HELD_BYTES, HELD_ROWS, lean
from ..functions.lzh import expand_all, stored
from ..operators import audit, marks, reports
from ..operators.service import Service, output_totals, stream_totals, tally
from ..sources import containers as src
from ..sources import renders
from . import drawn
from .fixtures import coded, container, made, preview, raw_jpeg


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of kinds R, A and N: the columns that `of_lines` reads."""
    part, kind = F.col("p_partkey"), F.element_at(F.array(F.lit("R"), F.lit("A"), F.lit("N")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.floor(part / 4).alias("l_orderkey"), part.alias("l_linenumber"), kind.alias("l_returnflag"), F.col("p_size").alias("l_quantity"), part.alias("l_partkey"))


def _made(spark: SparkSession, sf_dir: str, pages) -> DataFrame:
    return drawn.of_lines(_lines(spark, sf_dir), lambda lines: container(pages(lines)))


def metafile_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, fills and shapes of enhanced and plain metafiles in coded pages."""
    found = src.marks(_made(spark, sf_dir, drawn.metafile_pages))
    whole = lambda c: F.round(c * 10).cast("bigint")
    stroke = F.concat_ws(",", F.col("stroke.r"), F.col("stroke.g"), F.col("stroke.b"), F.col("stroke_width").cast("int"))
    return found.select(
        "path", "idx", "ord", "kind", whole(F.col("box.left")).alias("left10"), whole(F.col("box.top")).alias("top10"), whole(F.col("box.right")).alias("right10"), whole(F.col("box.bottom")).alias("bottom10"), F.concat_ws(",", "rgb.r", "rgb.g", "rgb.b").alias("rgb"),
        F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("kind") == "text", F.col("size").cast("int")).otherwise(0).alias("size"), F.col("escapement").alias("turn"), "bold", "underline", stroke.alias("stroke"), F.coalesce(F.col("clip.right").cast("int"), F.lit(0)).alias("clip_right"),
    )


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of decoded pages in the order of drawing."""
    texts = src.marks(_made(spark, sf_dir, drawn.metafile_pages)).where("kind = 'text'").select("path", "idx", "ord", F.col("box.bottom").alias("y"), "text")
    return marks.page_text(texts).select("path", "idx", "text")


def skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.skipped_survey(src.skipped_records(_made(spark, sf_dir, drawn.metafile_pages))).select(F.col("record").cast("bigint").alias("record"), F.col("pages").cast("bigint").alias("pages"), F.col("records").cast("bigint").alias("records"))


def fax_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black pixels of Group 4 pages."""
    return src.rasters(_made(spark, sf_dir, drawn.fax_pages)).select("path", "idx", "width", "height", "ink")


def drawn_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of 1, 8 and 24 bits, cut to their source rows, with where they are drawn."""
    files = _made(spark, sf_dir, drawn.bitmap_pages)
    placed = src.marks(files).where("kind = 'image'").select("path", "idx", "raster", F.col("box.left").cast("bigint").alias("left"), F.col("box.bottom").cast("bigint").alias("bottom"), "op")
    return placed.join(src.rasters(files).select("path", "idx", "raster", "width", "height", "bits", "ink"), ["path", "idx", "raster"])


def decoded_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage with decoding: pages of filler cannot be decoded, metafile pages can."""
    files = drawn.of_lines(_lines(spark, sf_dir), lambda lines: container([p for o, q, flag, part in lines for p in ((drawn.coded_page(drawn.emf(drawn.line_emf(o, q, flag, part))) if flag == "R" else drawn.coded_page(drawn.emf([])) if flag == "A" else raw_jpeg(q, q)), preview())]))
    covered = audit.coverage(src.entries(src.parsed(files)), src.decoded(files))
    return covered.select("path", "sheets", "sheets_recovered", "sheets_blank", reports.complete().alias("complete"))


def display_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical pages that the properties tell: size, turn, overlays, and the sheet in their box."""
    docs = src.parsed(drawn.of_lines(_lines(spark, sf_dir), drawn.shown_lines))
    page = docs.select("path", F.posexplode("displays").alias("k", "d"))
    member = F.col("d.members")[0]
    return page.select("path", (F.col("k") + 1).alias("page"), F.col("d.paper.w").alias("w"), F.col("d.paper.h").alias("h"), F.col("d.rotation").alias("rotation"), F.col("d.overlays").alias("overlays"), F.size("d.members").alias("members"), member["idx"].alias("idx"), member["area"]["x"].alias("x"), member["area"]["w"].alias("box_w"))


def overlay_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that overlays draw over sheets."""
    found = src.marks(drawn.of_lines(_lines(spark, sf_dir), drawn.shown_lines)).where("overlay is not null")
    return found.select("path", "idx", "overlay", "text", F.col("box.left").cast("int").alias("left"))


def logical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents whose pages the properties tell."""
    found = src.pages(drawn.of_lines(_lines(spark, sf_dir), drawn.shown_lines))
    return reports.manifest(found).select("path", "page", "kind", "width_mm", "height_mm", "recoverable")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out, size = [], [], 0
        for doc_id, t in zip(batch.column("doc_id"), batch.column("text")):
            ids.append(doc_id.as_py())
            out.append(expand_all(stored(t.as_py().encode()), 1 << 28) if t.is_valid else None)
            size += len(out[-1] or b"")
            if len(out) >= HELD_ROWS or size >= HELD_BYTES:
                yield _raw(ids, out)
                ids, out, size = [], [], 0
        yield _raw(ids, out)


def _raw(ids: list, out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "raw"])


def expanded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as coded streams of unknown length, and expanded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(lean(_packed), "doc_id bigint, raw binary").select("doc_id", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.sha2("raw", 256).alias("sha256"))


def _zips(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    kinds = ("word/document.xml", "xl/workbook.xml", "ppt/presentation.xml", "readme.txt")
    for doc_id, t in zip(batch.column("doc_id"), batch.column("text")):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr(zipfile.ZipInfo(kinds[doc_id.as_py() % 4]), t.as_py() or "")
        yield str(doc_id.as_py()), b"...." + held.getvalue() + b"tail"


def carved_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in archives behind other bytes, found and named by their parts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = src.attachments(made(docs, _zips))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), F.col("offset").alias("first_byte"), F.col("length").alias("n_bytes"), src.attachment_label(F.col("extension")).alias("label"))


def triage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triage report as lines of CSV, without the sizes of files: containers of orders, and pages that are no container."""
    drawn_files = drawn.of_lines(_lines(spark, sf_dir), lambda lines: container([p for o, q, flag, _ in lines for p in (raw_jpeg(100 + q, 200) if flag == "R" else coded(21000, 29700), preview())]))
    other = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".xdw")).alias("path"), F.col("html").cast("binary").alias("content"))
    docs = src.parsed(src.united(drawn_files, other))
    attached = reports.attachment_counts(src.attachments(drawn_files))
    return reports.as_csv(reports.triage_rows(docs, audit.coverage(src.entries(docs)), attached).drop("bytes"))


def extractable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be taken out of containers as it is, by name."""
    from ..sources.sinks import extracted_parts

    files = drawn.of_lines(_lines(spark, sf_dir), lambda lines: container([p for o, q, flag, _ in lines for p in (raw_jpeg(100 + q, 200) if flag == "R" else coded(21000, 29700), preview())]))
    return extracted_parts(files, src.parsed(files)).select("path", "name", "length")


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF: pages, those with content, placeholders, and what stands in the file."""
    files = drawn.of_lines(_lines(spark, sf_dir), lambda lines: container([p for o, q, flag, part in lines for p in (raw_jpeg(100 + q, 200) if flag == "R" else drawn.coded_page(drawn.emf(drawn.line_emf(o, q, flag, part))) if flag == "A" else coded(21000, 29700), preview())]))
    made = renders.pdfs(files)
    count = lambda what: (F.size(F.split(F.hex("pdf"), what.encode().hex().upper())) - 1).cast("bigint")
    return made.select("path", F.col("pages").cast("bigint").alias("pages"), F.col("recovered").cast("bigint").alias("recovered"), F.col("placeholders").cast("bigint").alias("placeholders"), count("/DCTDecode").alias("jpegs"), F.startswith("pdf", F.lit(b"%PDF-")).alias("is_pdf"))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as HTML: pages and gaps, and the pictures in the text."""
    files = drawn.of_lines(_lines(spark, sf_dir), lambda lines: container([p for o, q, flag, part in lines for p in (raw_jpeg(100 + q, 200) if flag == "R" else coded(21000, 29700), preview())]))
    made = renders.htmls(files)
    return made.select("path", F.col("pages").cast("bigint").alias("pages"), F.col("gaps").cast("bigint").alias("gaps"), (F.size(F.split("html", "data:image/jpeg")) - 1).cast("bigint").alias("jpegs"))


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container for each part."""
    return _lines(spark, sf_dir).withColumn("l_orderkey", F.col("l_partkey"))


def replaced_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose bodies an overlay replaces."""
    return renders.pages(drawn.of_lines(_single(spark, sf_dir), drawn.overlaid))


def page_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same pages are made of."""
    found = renders.layers(drawn.of_lines(_single(spark, sf_dir), drawn.overlaid))
    return found.select("path", "page", "layer", "role", "kinds", F.coalesce("area.w", F.lit(0)).cast("bigint").alias("area_w"))


def sheet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small sheets that are drawn on the picture before them."""
    found = renders.layers(drawn.of_lines(_single(spark, sf_dir), drawn.labelled))
    return found.select("path", "page", "layer", "role", F.coalesce("label", F.lit("")).alias("label"))


def masked_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures through masks, and texts that stand upright."""
    return renders.layers(drawn.of_lines(_single(spark, sf_dir), drawn.masked_upright)).select("path", "masked", "stored", "upright")


def output_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF and HTML with other options: lost pages left out, no bookmarks, the container carried along."""
    files = drawn.of_lines(_lines(spark, sf_dir), lambda lines: container([p for o, q, flag, part in lines for p in (raw_jpeg(100 + q, 200) if flag == "R" else coded(21000, 29700), preview())]))
    lean = renders.pdfs(files, skip_lost=True, carry=True).select("path", "pages", "skipped", "bookmarks", "attachments")
    full = renders.pdfs(files, paper=(500.0, 500.0)).select("path", F.col("bookmarks").alias("all_bookmarks"), (F.size(F.split(F.hex("pdf"), b"[0 0 500 500]".hex().upper())) - 1).alias("same_size"), F.contains(F.col("pdf"), F.lit(b"/Type0")).alias("wide_font"))
    text = renders.htmls(files, skip_lost=True).select("path", F.col("pages").alias("html_pages"), F.col("skipped").alias("html_skipped"), F.contains("html", F.lit("No page of this document")).alias("empty"))
    return lean.join(full, "path").join(text, "path")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: a picture. A: a page that decodes. N: one that does not, with an original behind it."""

    def make(lines: list[tuple]) -> bytes:
        pages = [p for o, q, flag, part in lines for p in (raw_jpeg(100 + q, 200) if flag == "R" else drawn.coded_page(drawn.emf(drawn.line_emf(o, q, flag, part))) if flag == "A" else coded(21000, 29700), preview())]
        if all(flag == "N" for _, _, flag, _ in lines):
            pages[-1] = drawn.bare_page(b"%PDF-1.4 original %%EOF")
        return container(pages)

    return drawn.of_lines(_lines(spark, sf_dir), make)


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage with decoding, originals and verdicts, in one pass."""
    return Service().analyze(_mixed(spark, sf_dir)).select("path", "generation", "entries", "sheets", "sheets_recovered", "thumbnails", "sheets_blank", "attachments", "verdict")


def verdict_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tally of an archive in which some files are no containers."""
    other = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))
    return tally(Service().analyze(src.united(_mixed(spark, sf_dir), other)))


def checked_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded streams that expand as they declare."""
    return stream_totals(Service().check_streams(_mixed(spark, sf_dir)))


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions whose page counts are the quantities of parts by five."""
    expected = reports.expectation(audit.covered(src.parsed(_mixed(spark, sf_dir))))
    seen = _lines(spark, sf_dir).groupBy("l_orderkey").agg((F.max("l_quantity") % 9).cast("bigint").alias("pages")).select(F.concat(F.lit("order"), F.col("l_orderkey").cast("string"), F.lit(".xdw")).alias("path"), "pages")
    return reports.verified(expected, seen)


def pdf_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output_totals(renders.pdfs(_mixed(spark, sf_dir)))


def info_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents are, in words."""
    files = drawn.of_lines(_lines(spark, sf_dir), lambda lines: container([p for o, q, flag, _ in lines for p in (raw_jpeg(100 + q, 200) if flag == "R" else coded(21000, 29700), preview())]))
    return reports.info_lines(reports.info(audit.covered(src.parsed(files))))


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of coded streams of documents with properties, row by row."""
    found = reports.streams(src.parsed(drawn.of_lines(_lines(spark, sf_dir), drawn.shown_lines)))
    return found.groupBy("role").agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.count("expanded_declared").cast("bigint").alias("declared"), F.max("entry").alias("last_entry"))


def placed_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pictures that pages call for, and the entry that holds each: the first unused of its size, or else the last."""
    found = src.called_pictures(_made(spark, sf_dir, drawn.comment_pages))
    return found.select("path", "stored", F.col("source.w").alias("w"), F.col("source.h").alias("h"), "picture", "paths", "masks")


def comment_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What private comments draw: pictures, fills clipped to a path, and paths of points in four codings."""
    found = src.marks(_made(spark, sf_dir, drawn.comment_pages))
    whole = lambda c: F.col(f"box.{c}").cast("bigint").alias(c)
    return found.select("path", "ord", "kind", whole("left"), whole("top"), whole("right"), whole("bottom"), F.coalesce("op", F.lit("")).alias("op"), F.coalesce("clip_path", F.lit(-1)).alias("clip_path"), "points")


QUERIES = {f.__name__: f for f in (analysis, verdict_tally, checked_streams, verify_report, pdf_totals, stream_index, info_report, replaced_bodies, page_layers, sheet_labels, masked_layers, output_options, placed_pictures, comment_marks, metafile_marks, page_lines, skipped, fax_ink, drawn_bitmaps, decoded_coverage, display_pages, overlay_notes, logical_pages, expanded_texts, carved_zips, triage_table, extractable, pdf_pages, html_pages)}

_L = """WITH l AS (SELECT 'order' || p_partkey // 4 || '.xdw' AS path, row_number() OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) AS o, CAST(p_size AS BIGINT) AS q, CASE p_partkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS flag FROM part)"""

_P = "WITH p AS (SELECT 'order' || p_partkey || '.xdw' AS path, CAST(p_size AS BIGINT) AS q, CASE p_partkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS flag, p_partkey AS part FROM part)"

# a container of parts of kind N alone has an original; parts four in a row are of all kinds but at the ends of the table
_M = _L + """, c AS (SELECT path, count(*) AS n, count(*) FILTER (flag = 'R') AS r, count(*) FILTER (flag = 'A') AS a, max(q) AS most FROM l GROUP BY path),
  d AS (SELECT path, n, r + a AS ok, n - r - a AS blank, CASE WHEN r + a = 0 THEN 1 ELSE 0 END AS att, most FROM c),
  v AS (SELECT *, CASE WHEN att > 0 THEN 'ORIGINAL' WHEN ok = n THEN 'ALL' WHEN ok > 0 THEN 'SOME' ELSE 'NONE' END AS verdict FROM d)"""

ORACLE_SQL = {
    "info_report": _L + """, c AS (SELECT path, count(*) AS n, count(*) FILTER (flag = 'R') AS r FROM l GROUP BY path), b AS (SELECT *, CASE WHEN n > r THEN 3 ELSE 2 END AS base FROM c)
  SELECT path, CAST(0 AS INTEGER) AS line, path || ': generation 7, ' || 2 * n || ' entries' AS text FROM c
  UNION ALL SELECT path, 1, '  ' || n || ' sheet(s), ' || r || ' recovered; 0 picture(s), 0 recovered; ' || n || ' thumbnail(s); 0 data table(s)' FROM c
  UNION ALL SELECT path, 2, '  ' || n - r || ' sheet(s) would come out blank' FROM c WHERE n > r
  UNION ALL SELECT path, base + 2 * (o - 1), CASE WHEN flag = 'R' THEN '    sheet jpeg ' || 100 + q || 'x200' ELSE '    sheet encoded (62.5x)' END FROM l JOIN b USING (path)
  UNION ALL SELECT path, base + 2 * (o - 1) + 1, '    thumbnail preview 104x146 (474.5x)' FROM l JOIN b USING (path)""",
    "analysis": _M + " SELECT path, CAST(7 AS BIGINT) AS generation, CAST(2 * n AS INTEGER) AS entries, n AS sheets, ok AS sheets_recovered, n - att AS thumbnails, blank AS sheets_blank, CAST(att AS INTEGER) AS attachments, verdict FROM v",
    "verdict_tally": _M + """, t AS (SELECT verdict, count(*) AS files, CAST(sum(n) AS BIGINT) AS sheets, CAST(sum(blank) AS BIGINT) AS blank FROM v GROUP BY verdict UNION ALL SELECT 'OTHER', count(*), 0, 0 FROM pages)
  SELECT verdict, files, sheets, blank, CAST(NULL AS VARCHAR) AS blank_percent FROM t UNION ALL SELECT 'TOTAL', CAST(sum(files) AS BIGINT), CAST(sum(sheets) AS BIGINT), CAST(sum(blank) AS BIGINT), printf('%.0f', 100.0 * sum(blank) / sum(sheets)) FROM t""",
    "checked_streams": _M + ", f AS (SELECT count(*) AS n, count(*) FILTER (flag = 'A') AS a, count(*) FILTER (flag = 'N') AS b FROM l) SELECT n + a + b - (SELECT CAST(sum(att) AS BIGINT) FROM v) AS streams, a AS expanded, a AS enhanced FROM f",
    "verify_report": _M + """, w AS (SELECT path, n, n - att AS previews, most % 9 AS seen FROM v)
  SELECT path, CAST(0 AS INTEGER) AS line, path || ': container ' || n || ' page(s), converted file ' || seen || ' page(s)' AS text FROM w
  UNION ALL SELECT path, 1, CASE WHEN seen > n THEN '  ! page count: ' || seen - n || ' extra' ELSE '  ! page count: ' || n - seen || ' missing' END FROM w WHERE seen <> n
  UNION ALL SELECT path, 2, '  ! the ' || previews || ' preview(s) were converted as pages' FROM w WHERE seen - n = previews AND previews > 0
  UNION ALL SELECT path, 9, CASE WHEN seen = n THEN '  OK: page counts agree' ELSE '  no page is missing; see the notes above' END FROM w WHERE seen >= n""",
    "pdf_totals": _M + " SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS pages, CAST(sum(ok) AS BIGINT) AS recovered, CAST(sum(blank) AS BIGINT) AS placeholders, CAST(sum(att) AS BIGINT) AS attachments, (SELECT CAST(sum(length('L' || o || flag)) AS BIGINT) FROM l WHERE flag = 'A') AS glyphs FROM v",
    "stream_index": _L + """, n AS (SELECT path, count(*) AS k FROM l GROUP BY path) SELECT 'preview' AS role, count(*) AS n, 'preview' AS kind, count(*) AS declared, CAST(max(2 * o - 1) AS INTEGER) AS last_entry FROM l
  UNION ALL SELECT 'properties', count(*), 'properties', count(*), CAST(max(2 * k) AS INTEGER) FROM n""",
    "replaced_bodies": _P + " SELECT path, CAST(1 AS INTEGER) AS page, CAST(CASE WHEN flag = 'N' THEN 2 ELSE 1 END AS INTEGER) AS layers, CAST(CASE WHEN flag = 'R' OR flag = 'A' AND q % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS replaced, false AS lost FROM p",
    "page_layers": _P + """ SELECT path, CAST(1 AS INTEGER) AS page, CAST(0 AS INTEGER) AS layer, CASE WHEN flag = 'N' OR flag = 'A' AND q % 2 = 1 THEN 'body' ELSE 'overlay' END AS role, CASE WHEN flag = 'N' THEN 'jpeg' WHEN flag = 'R' THEN 'text' WHEN q % 2 = 1 THEN 'image' ELSE 'fill' END AS kinds,
  CASE WHEN flag = 'R' THEN 19000 + q ELSE 0 END AS area_w FROM p UNION ALL SELECT path, 1, 1, 'note', 'text', 21000 FROM p WHERE flag = 'N'""",
    "sheet_labels": _P + """ SELECT path, CAST(1 AS INTEGER) AS page, CAST(0 AS INTEGER) AS layer, 'body' AS role, '' AS label FROM p
  UNION ALL SELECT path, CASE WHEN flag = 'N' THEN 2 ELSE 1 END, CASE WHEN flag = 'N' THEN 0 ELSE 1 END, CASE WHEN flag = 'N' THEN 'body' ELSE 'label' END, CASE WHEN flag = 'N' THEN '' ELSE 'SN-' || part END FROM p""",
    "masked_layers": _P + " SELECT path, CAST(CASE WHEN flag = 'N' THEN 0 ELSE 1 END AS INTEGER) AS masked, CAST(2 AS INTEGER) AS stored, flag = 'R' AS upright FROM p",
    "output_options": _L + """ SELECT path, CAST(greatest(count(*) FILTER (flag = 'R'), 1) AS INTEGER) AS pages, CAST(count(*) FILTER (flag <> 'R') AS INTEGER) AS skipped, CAST(0 AS INTEGER) AS bookmarks, CAST(1 AS INTEGER) AS attachments, CAST(count(*) FILTER (flag <> 'R') AS INTEGER) AS all_bookmarks,
  CAST(count(*) AS INTEGER) AS same_size, false AS wide_font, CAST(count(*) FILTER (flag = 'R') AS INTEGER) AS html_pages, CAST(count(*) FILTER (flag <> 'R') AS INTEGER) AS html_skipped, count(*) FILTER (flag = 'R') = 0 AS empty FROM l GROUP BY path""",
    "placed_pictures": _L + """, p AS (SELECT *, row_number() OVER (PARTITION BY path, q ORDER BY o) AS nth, count(*) OVER (PARTITION BY path) AS n FROM l)
  SELECT path, CAST(o - 1 AS INTEGER) AS stored, 100 + q AS w, CAST(50 AS BIGINT) AS h, CAST(o AS INTEGER) AS picture, CAST(1 AS INTEGER) AS paths, CAST(n AS INTEGER) AS masks FROM p""",
    "comment_marks": _L + """ SELECT path, CAST(3 * o - 2 AS INTEGER) AS ord, 'image' AS kind, 10 * q AS "left", CAST(10 * o AS BIGINT) AS top, 10 * q + 100 AS "right", CAST(10 * o + 200 AS BIGINT) AS bottom, 'copy' AS op, CAST(-1 AS INTEGER) AS clip_path, CAST(0 AS INTEGER) AS points FROM l
  UNION ALL SELECT path, 3 * o - 1, 'fill', q, o, q + 30, o + 40, '', 0, 0 FROM l
  UNION ALL SELECT path, 3 * o, 'shape', q - 3, o, q + 5, o + 60, '', -1, 4 FROM l""",
    "metafile_marks": _L + """, m AS (
  SELECT path, 0 AS idx, 3 * o - 2 AS ord, 'text' AS kind, 100 * q AS left10, 10 * 100 * o + 8 * (80 + q) - 10 * (80 + q) AS top10, 10 * (10 * q + 50 * (length('L' || o || flag) - 1) + 80 + q) AS right10, 1000 * o + 8 * (80 + q) AS bottom10, q || ',' || 2 * q || ',' || o AS rgb,
    'L' || o || flag AS text, 80 + q AS size, CASE WHEN flag = 'R' THEN 900 ELSE 0 END AS turn, flag = 'A' AS bold, q % 2 = 1 AS underline, '' AS stroke, 0 AS clip_right FROM l
  UNION ALL SELECT path, 0, 3 * o - 1, 'fill', 10 * q, 100 * o, 10 * (100 + 2 * q), 10 * (10 * o + 5), q || ',' || o || ',7', '', 0, 0, false, false, '', 0 FROM l
  UNION ALL SELECT path, 0, 3 * o, 'shape', 10 * q, 10 * o, 10 * (q + 20), 10 * (o + 30), q || ',' || o || ',7', '', 0, 0, false, false, '', 2000 FROM l
  UNION ALL SELECT path, 1, 3 * o - 2, 'fill', 10 * (q + 109), 10 * (10 * o + 109), 10 * (100 + 2 * q + 109), 10 * (10 * o + 114), q || ',' || o || ',9', '', 0, 0, false, false, '', 0 FROM l
  UNION ALL SELECT path, 1, 3 * o - 1, 'text', 10 * (10 * q + 109), 10 * (100 * o + 109) - 80, 10 * (10 * q + 109 + 40 * length('W' || o || flag)), 10 * (100 * o + 109) + 320, '0,0,0', 'W' || o || flag, 40, 0, false, false, '', 0 FROM l
  UNION ALL SELECT path, 1, 3 * o, 'shape', 10 * (q + 109), 10 * (o + 109), 10 * (q + 129), 10 * (o + 139), '', '', 0, 0, false, false, o || ',' || q || ',1,3', 0 FROM l)
  SELECT path, CAST(idx AS INTEGER) AS idx, CAST(ord AS INTEGER) AS ord, kind, CAST(left10 AS BIGINT) AS left10, CAST(top10 AS BIGINT) AS top10, CAST(right10 AS BIGINT) AS right10, CAST(bottom10 AS BIGINT) AS bottom10, rgb, text, CAST(size AS INTEGER) AS size,
    CAST(turn AS INTEGER) AS turn, bold, underline, stroke, CAST(clip_right AS INTEGER) AS clip_right FROM m""",
    "page_lines": _L + """ SELECT path, CAST(0 AS INTEGER) AS idx, string_agg('L' || o || flag, chr(10) ORDER BY o) AS text FROM l GROUP BY path UNION ALL SELECT path, 1, string_agg('W' || o || flag, chr(10) ORDER BY o) FROM l GROUP BY path""",
    "skipped": _L + " SELECT CAST(1234 AS BIGINT) AS record, CAST(count(DISTINCT path) AS BIGINT) AS pages, count(*) AS records FROM l WHERE flag = 'N' HAVING count(*) > 0",
    "fax_ink": _L + " SELECT path, CAST(o - 1 AS INTEGER) AS idx, CAST(128 AS BIGINT) AS width, CAST(10 * o AS BIGINT) AS height, CAST((5 + o) * 10 * o AS BIGINT) AS ink FROM l",
    "drawn_bitmaps": _L + """ SELECT path, CAST(0 AS INTEGER) AS idx, CAST(o - 1 AS INTEGER) AS raster, q AS "left", CAST(13 * o AS BIGINT) AS bottom, 'copy' AS op, q AS width, CAST(CASE WHEN o > 1 THEN o - 1 ELSE 1 END AS BIGINT) AS height,
  CAST(CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN 8 ELSE 24 END AS INTEGER) AS bits, CAST(CASE flag WHEN 'R' THEN q * CASE WHEN o > 1 THEN o - 1 ELSE 1 END ELSE 0 END AS BIGINT) AS ink FROM l
  UNION ALL SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY o) AS INTEGER), 0, 0, 1000, 'copy', 1000, 1000, 1, 1000 * q FROM l WHERE flag = 'R' AND o = 1""",
    "decoded_coverage": _L + """ SELECT path, count(*) AS sheets, count(*) FILTER (flag <> 'A') AS sheets_recovered, count(*) FILTER (flag = 'A') AS sheets_blank, count(*) FILTER (flag = 'A') = 0 AS complete FROM l GROUP BY path""",
    "display_pages": _L + """ SELECT path, CAST(o AS INTEGER) AS page, 21000 + q AS w, CAST(29700 AS BIGINT) AS h, CAST(CASE WHEN flag = 'R' THEN 90 ELSE 0 END AS INTEGER) AS rotation, CAST(CASE WHEN flag = 'A' THEN 1 ELSE 0 END AS INTEGER) AS overlays, CAST(1 AS INTEGER) AS members,
  CAST(2 * (o - 1) AS INTEGER) AS idx, CAST(o AS BIGINT) AS x, 1000 + q AS box_w FROM l""",
    "overlay_notes": _L + " SELECT path, CAST(2 * (o - 1) AS INTEGER) AS idx, CAST(0 AS INTEGER) AS overlay, 'note ' || o AS text, CAST(10 AS INTEGER) AS \"left\" FROM l WHERE flag = 'A'",
    "logical_pages": _L + " SELECT path, CAST(o AS INTEGER) AS page, 'display' AS kind, printf('%.1f', (21000 + q) / 100.0) AS width_mm, '297.0' AS height_mm, true AS recoverable FROM l",
    "expanded_texts": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM documents",
    "carved_zips": """SELECT doc_id, CAST(4 AS BIGINT) AS first_byte, CAST(98 + strlen(coalesce(text, '')) + 2 * length(CASE doc_id % 4 WHEN 0 THEN 'word/document.xml' WHEN 1 THEN 'xl/workbook.xml' WHEN 2 THEN 'ppt/presentation.xml' ELSE 'readme.txt' END) AS BIGINT) AS n_bytes,
  CASE doc_id % 4 WHEN 0 THEN 'Word document' WHEN 1 THEN 'Excel workbook' WHEN 2 THEN 'PowerPoint deck' ELSE 'zip container' END AS label FROM documents""",
    "triage_table": _L + """, c AS (SELECT path, count(*) AS n, count(*) FILTER (flag = 'R') AS r FROM l GROUP BY path)
  SELECT path || ',7,' || 2 * n || ',' || n || ',' || n || ',0,' || n - r || ',' || n - r || ',' || r || ',0,' || CASE WHEN n = r THEN 'ALL,every content page recovers losslessly' WHEN r > 0 THEN 'SOME,part of the sheets recover; the rest need the vendor codec' ELSE 'NONE,sheets are in the vendor codec' END AS value FROM c
  UNION ALL SELECT 'page' || page_id || '.xdw,,,,,,,,,,OTHER,NotAContainer markup' FROM pages""",
    "extractable": _L + " SELECT path, replace(path, '.xdw', '') || printf('_p%03d.jpg', 2 * o - 1) AS name, CAST(17 AS BIGINT) AS length FROM l WHERE flag = 'R'",
    "pdf_pages": _L + " SELECT path, count(*) AS pages, count(*) FILTER (flag <> 'N') AS recovered, count(*) FILTER (flag = 'N') AS placeholders, count(*) FILTER (flag = 'R') AS jpegs, true AS is_pdf FROM l GROUP BY path",
    "html_pages": _L + " SELECT path, count(*) AS pages, count(*) FILTER (flag <> 'R') AS gaps, count(*) FILTER (flag = 'R') AS jpegs FROM l GROUP BY path",
}
