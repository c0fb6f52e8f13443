"""Private comments by their bytes, options of the writers, exchangeable parts."""

import struct

from docquarry.functions import html, pdf
from docquarry.functions.comments import coded_points
from docquarry.functions.container import parse, sniffed
from docquarry.functions.metafile import metafile
from docquarry.functions.ttf import font_file, widths
from docquarry.operators.service import Service, tally
from docquarry.plans import drawn
from docquarry.plans.fixtures import coded, container, preview, raw_jpeg


def test_points():
    head = lambda code, n, x, y: b"DW\x03" + bytes([code]) + struct.pack("<Ihh", n, x, y)
    assert coded_points(head(0x40, 3, 10, 20) + struct.pack("4b", 2, -1, -128, 1)) == [(10, 20), (12, 19), (-116, 20)]
    assert coded_points(head(0x80, 2, 100, 100) + bytes([0xD1])) == [(100, 100), (97, 101)]
    assert coded_points(head(0x80, 2, 100, 100) + bytes([0x83, 0xD3])) == [(100, 100), (55, 103)]
    assert coded_points(head(0x80, 2, 100, 100) + bytes([0xD8, 0x80]) + struct.pack("<h", 1000)) == [(100, 100), (97, 1100)]
    assert coded_points(head(0x80, 2, 1, 1) + b"\x11\x11") is None and coded_points(head(0x30, 1, 0, 0)) is None and coded_points(b"DW\x03\x00\0\0\0\0") is None
    assert coded_points(b"DW\x13\x00" + struct.pack("<I4i", 2, 1, 2, 70000, -4)) == [(1, 2), (70000, -4)]


def test_clip_path_is_kept_once():
    square = [(0, 0), (10, 0), (10, 10)]
    clip = [drawn.comment(b"DW02"), drawn.short_points(0x03, square), drawn.comment(b"DW03")]
    d = metafile(drawn.emf([*clip, drawn.blit(0, 0, 5, 5), *clip, drawn.blit(1, 1, 5, 5), drawn.comment(b"DWzz")]), drawn.A4)
    assert len(d.paths) == 1 and d.shape_masks == 2 and d.skipped == {70: 1}
    pen = drawn.record(95, struct.pack("<I4IIII", 1, 0, 0, 0, 0, 0x10000, 6, 0) + struct.pack("<I", 255) + bytes(12))
    d = metafile(drawn.emf([pen, drawn.words(37, 1), drawn.words(37, 0x80000005), drawn.comment(b"DW02"), drawn.wide_points(0x11, [(0, 0), (1, 1), (2, 2), (3, 3)]), drawn.comment(b"DW05")]), drawn.A4)
    assert [(m.rgb, m.stroke, m.figures) for m in d.marks] == [(None, ((255, 0, 0), 6.0), [((0.0, 0.0), [((1.0, 1.0), (2.0, 2.0), (3.0, 3.0))], False)])]


def test_pictures_placed():
    dib = drawn.bitmap(8, 2, 1, [(255, 255, 255), (0, 0, 0)], [b"\xF0", b"\x0F"])
    d = metafile(drawn.emf([drawn.placed(400, 500, 1000, 1500, 128, 64, 0x660046), drawn.inline_picture(dib), drawn.placed(0, 0, 8, 2, 8, 2, 0x8800C6), drawn.placed(0, 0, 8, 2, 8, 2, 0x8800C6), drawn.comment(b"DWb\0"), drawn.placed(0, 0, -8, 2, 8, 2, 0xCC0020)]), drawn.A4)
    first, mask, again = d.marks
    assert (first.stored, first.source, first.op, first.box) == (0, (128, 64), "xor", (400.0, 500.0, 1400.0, 2000.0))
    assert mask.raster == again.raster == 0 and mask.rgb == (0, 0, 0) and d.rasters[0].rows == b"\x0F\xF0" and d.rasters[0].mask
    assert d.stored == 1 and d.sizes == [(128, 64)] and d.calls == [(0, (128, 64))] and d.skipped == {70: 1}
    w = metafile(drawn.wmf([drawn.shorts(0x020C, 100, 200), drawn.shorts(0x0416, 40, 30, 20, 10), drawn.comment_16(b"DW\x02\x01"), drawn.comment_16(b"DW\x02\x02"), drawn.comment_16(b"DW\x02\x02", struct.pack("<8h", 1, 2, 3, 4, 0, 0, 5, 6))]), drawn.A4)
    assert [(m.stored, m.source, m.box) for m in w.marks] == [(0, (0, 0), (10.0, 20.0, 30.0, 40.0)), (0, (5, 6), (1.0, 2.0, 4.0, 6.0))]


def test_pdf_options():
    data = container([raw_jpeg(100, 100), coded(21000, 29700), coded(7800, 3100)])
    build = lambda **o: pdf.document_pdf(data, parse(data), options=pdf.Options(**o))
    raw, r = build(paper=(595.32, 841.92))
    assert raw.count(b"/MediaBox [0 0 595.32 841.92]") == r.pages == 3 and b"/Type0" not in raw and (r.placeholders, r.bookmarks) == (2, 2)
    assert b"Page 2 not recovered" in raw and b"Page 3 not recovered" in raw and b"/Prev" in raw and b"/Next" in raw
    raw, r = build(bookmarks=False, carry=True, name="source.xdw")
    assert b"/Outlines" not in raw and r.attachments == 1 and data in raw and b".xdw)" in raw
    raw, r = build(skip_lost=True, lang="ja", name="日本")
    assert (r.pages, r.skipped) == (1, 2) and b"/Title <FEFF65E5672C>" in raw


def test_pictures_are_not_enlarged():
    import re
    import zlib

    data = container([raw_jpeg(100, 100)])
    raw, _ = pdf.document_pdf(data, parse(data), options=pdf.Options(paper=(595.32, 841.92)))
    drawn_ops = b"".join(zlib.decompress(x) for x in re.findall(rb"FlateDecode /Length \d+ >>\nstream\n(.*?)\nendstream", raw, re.S))
    assert b"q 100 0 0 100 " in drawn_ops


def test_html_options():
    data = container([coded(21000, 29700), preview(), raw_jpeg(300, 200)])
    text, r = html.document_html(data, parse(data), options=html.Options(skip_lost=True, name="<script>", carry=True))
    assert (r.gaps, r.skipped, r.attachments) == (0, 1, 1) and 'class="gap"' not in text and "<title>&lt;script&gt;</title>" in text
    none = container([coded(21000, 29700)])
    text, _ = html.document_html(none, parse(none), options=html.Options(skip_lost=True))
    assert html.NOTHING["en"] in text and text.endswith("</html>\n")


def test_shared_bitmap_keeps_its_colours():
    dib = drawn.bitmap(8, 1, 1, [(255, 255, 255), (0, 0, 0)], [b"\xF0"])
    body = drawn.emf([drawn.inline_picture(dib), drawn.placed(0, 0, 8, 2, 8, 1, 0x8800C6), drawn.placed(0, 5, 8, 2, 8, 1, 0xCC0020)])
    data = container([drawn.coded_page(body)])
    before = metafile(body, drawn.A4).rasters[0].palette
    text, _ = html.document_html(data, parse(data))
    assert text.count("<image") == 2 and metafile(body, drawn.A4).rasters[0].palette == before


def test_parts_of_the_service_can_be_exchanged(spark):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"%PDF-1.4")), ("c", bytearray(container([coded(1, 1), preview()])))], "path string, content binary")
    plain = {r["path"]: r for r in Service().analyze(files).collect()}
    assert plain["a"]["verdict"] is None and (plain["b"]["verdict"], plain["b"]["error_detail"]) == ("OTHER", "PDF") and plain["c"]["verdict"] == "NONE"
    assert {r["verdict"]: r["files"] for r in tally(Service().analyze(files)).collect()} == {"FAILED": 1, "OTHER": 1, "NONE": 1, "TOTAL": 2}
    own = Service(read=lambda spark, folder: files, parse=lambda data: parse(container([coded(1, 1)])), scan=lambda data: [1, 2], recovered=lambda *a: True)
    got = own.analyze(own.open(spark, "nowhere")).collect()
    assert {(r["sheets"], r["sheets_recovered"], r["attachments"], r["verdict"]) for r in got} == {(1, 1, 2, "ORIGINAL")}


def test_glyphs_under_shapes():
    letters = drawn.text(100, 100, b"abcd", [60] * 4)
    boxes = [drawn.ints(43, 105 + 60 * k, 60, 125 + 60 * k, 150) for k in range(3)]
    page = lambda n: html.document_html(data := container([drawn.coded_page(drawn.emf([drawn.font(1, -100, 0, 400, False), drawn.words(37, 1), letters, *boxes[:n]]))]), parse(data))[0]
    assert 'fill="none">abc</text>' in page(3) and 'fill="#000000">d</text>' in page(3)
    assert "abcd</text>" in page(2) and 'fill="none">' not in page(2)


def tiny_font(pairs):
    """A TrueType file with a character map of segments, each of one character."""
    pairs = sorted(pairs)
    n = len(pairs) + 1
    ends = [c for c, _ in pairs] + [0xFFFF]
    steps = [(g - c) & 0xFFFF for c, g in pairs] + [1]
    seg = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + struct.pack(f">{n}H", *ends) + bytes(2) + struct.pack(f">{n}H", *ends) + struct.pack(f">{n}H", *steps) + bytes(2 * n)
    tables = {
        b"cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + seg, b"head": bytes(18) + struct.pack(">H", 2000) + bytes(16) + struct.pack(">4h", 0, -400, 2000, 1600) + bytes(10),
        b"hhea": struct.pack(">Ihh", 0x10000, 1600, -400) + bytes(26) + struct.pack(">H", 3), b"hmtx": struct.pack(">HhHhHh", 1000, 0, 1200, 0, 2000, 0), b"maxp": struct.pack(">IH", 0x10000, 9),
    }
    out, body = b"\0\1\0\0" + struct.pack(">4H", len(tables), 0, 0, 0), b""
    for tag, raw in tables.items():
        out += struct.pack(">4sIII", tag, 0, 12 + 16 * len(tables) + len(body), len(raw))
        body += raw + bytes(-len(raw) % 4)
    return out + body


def test_fonts():
    import re
    import zlib

    raw = tiny_font([(0x3042, 1), (0x3044, 2), (0x4E00, 7), (0x4E8C, 50)])
    f = font_file(raw)
    assert (f.units, f.glyph("あ"), f.glyph("い"), f.glyph("一"), f.glyph("二"), f.glyph("x")) == (2000, 1, 2, 7, 0, 0)
    assert [f.width(g) for g in (0, 1, 2, 8)] == [500, 600, 1000, 1000] and font_file(b"OTTO" + raw[4:]) is None and font_file(raw[:90]) is None
    assert widths(f, [7, 2, 1, 2]) == "[1 [600 1000] 7 [1000]]"
    page = drawn.emf([drawn.text(10, 20, "aあ一".encode("cp932"), [9, 9, 9, 9, 9])])
    data = container([drawn.coded_page(page)])
    made, r = pdf.document_pdf(data, parse(data), options=pdf.Options(font=raw))
    assert r.glyphs == 3 and b"/CIDFontType2" in made and b"/W [1 [600] 7 [1000]]" in made and b"Japan1" not in made
    streams = [zlib.decompress(x) for x in re.findall(rb"FlateDecode /Length \d+ >>\nstream\n(.*?)\nendstream", made, re.S)]
    assert raw in streams and any(b"<0001> <3042>" in x for x in streams) and any(b"/FE" in x and b"<0007>" in x for x in streams)


def test_sniffed():
    assert [sniffed(b) for b in (b"<html>", b"<!DOCTYPE x", b"<?xml", b"<p>", b"\x89PNG", b"\x89PNG\r\n\x1a\n", b"PK\3\4..xl/", b"PK\3\4")] == ["markup", "markup", "markup", None, None, "PNG", "xlsx", "zip"]
