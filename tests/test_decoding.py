import struct

import pytest

from docquarry.functions.container import parse
from docquarry.functions.drawing import Canvas
from docquarry.functions.lzh import stored
from docquarry.functions.metafile import metafile
from docquarry.functions.pages import bare_text, entry_drawing, page_drawing, recovered, text_page
from docquarry.functions.shown import Shown, displayed, merge_orphans, misfit, shown_pages
from docquarry.functions.tlv import Entry
from docquarry.plans.fixtures import coded, container, num, page, preview, raw_jpeg, tlv


def emf(*records):
    body = b"".join(struct.pack("<II", kind, 8 + len(raw)) + raw for kind, raw in records)
    head = struct.pack("<II", 1, 88) + b"\0" * 16 + struct.pack("<4i", 0, 0, 21000, 29700) + b" EMF" + b"\0" * 8 + struct.pack("<I", len(records) + 1) + b"\0" * 16 + struct.pack("<ii", 1000, 2000) + b"\0" * 8
    return head + body


def ints(*n):
    return struct.pack(f"<{len(n)}i", *n)


def text_record(x, y, text, steps):
    raw = text.encode("utf-16-le")
    at = 76
    return 84, b"\0" * 28 + ints(x, y, len(text), at) + b"\0" * 20 + ints(at + len(raw) + len(raw) % 4) + raw + b"\0" * (len(raw) % 4) + ints(*steps)


def test_enhanced_metafile():
    data = emf((10, ints(10, 20)), (39, ints(1, 0, 0x0000FF, 0)), (37, ints(1)), (43, ints(10, 20, 110, 220)), text_record(10, 20, "ab", [7, 9]), (33, b""), (24, ints(0xFF0000)), (34, ints(-1)), text_record(10, 20, "c", [0]), (999, b"\0" * 4))
    d = metafile(data, (1, 1))
    assert (d.device, d.frame, d.records, dict(d.skipped)) == ((1000, 2000), (21000, 29700), 11, {999: 1})
    box, first, second = d.marks
    assert (box.kind, box.rgb, box.box, box.order) == ("shape", (255, 0, 0), (0, 0, 100, 200), 1)
    assert (first.text, first.xs, first.order) == ("ab", [0, 7], 2) and second.rgb == (0, 0, 0)


def test_cut_off_metafiles_keep_what_was_read():
    data = emf((43, ints(0, 0, 5, 5)), (43, ints(0, 0, 9, 9)))
    assert len(metafile(data[:-3], (1, 1)).marks) == 1 and metafile(data[:60], (1, 1)) is None and metafile(b"", (1, 1)) is None


def test_plain_metafile():
    rec = lambda kind, raw: struct.pack("<IH", 3 + len(raw) // 2, kind) + raw
    shorts = lambda *n: struct.pack(f"<{len(n)}h", *n)
    font = shorts(-20, 0, 0, 0, 700) + b"\0\1\0\x80" + b"\0" * 36
    data = struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 3, 0, 0) + rec(0x20C, shorts(500, 400)) + rec(0x2FB, font) + rec(0x12D, shorts(0)) + rec(0x521, shorts(3) + b"\x82\xa0b\0" + shorts(30, 40)) + rec(0x41B, shorts(9, 8, 1, 2)) + rec(0, b"")
    d = metafile(data, (21000, 29700))
    text, box = d.marks
    assert (d.device, text.text, text.xs, text.font.weight, text.font.underline) == ((400, 500), "あb", [40.0, 60.0], 700, True)
    assert box.box == (2, 1, 8, 9)


def test_states_clips_and_order():
    c = Canvas((100, 100), (1, 1))
    c.save()
    c.clip(0, 0, 100, 100)
    assert c.state.clip is None
    c.clip(10, 10, 20, 5)
    c.save()
    c.set(brush=None, pen=None)
    c.rectangle(0, 0, 5, 5)
    c.restore(1)
    assert c.state.clip is None and not c.saved and c.order == 1
    c.set(window_size=(10, 10), view_size=(100, 50))
    c.rounded(0, 0, 10, 10)
    c.fill(0, 0, -1, 5)
    (m,) = c.drawing.marks
    assert m.box == pytest.approx((0, 0, 100, 50)) and c.order == 3


def drawing_page(raw):
    body = stored(raw)
    return page(num(0x80, 4) + num(0x81, len(raw)) + num(0x84, 21000) + num(0x85, 29700) + tlv(0x86, body))


def test_coded_pages_decode():
    data = container([drawing_page(emf((43, ints(0, 0, 5, 5)))), coded(21000, 29700), drawing_page(emf())])
    doc = parse(data)
    assert [recovered(data, e, doc["entries"]) for e in doc["entries"]] == [True, False, False]


def test_previews_decode():
    data = container([raw_jpeg(9, 9), preview()])
    thumb = parse(data)["entries"][1]
    assert thumb.kind == "preview" and entry_drawing(data, thumb) is None  # its pixels are no stream
    head = struct.pack("<IiiHHIIiiII", 40, 8, 1, 1, 1, 0, 0, 0, 0, 2, 0) + b"\0\0\0\0\xff\xff\xff\0"
    good = page(num(0x80, 7) + num(0x81, len(head)) + tlv(0x86, head + struct.pack("<4I", 0, 4, 4, 1) + b"\xaa\0\0\0"))
    data = container([raw_jpeg(9, 9), good])
    (mark,) = page_drawing(data, parse(data)["entries"][1], []).marks
    assert mark.box == (0, 0, 8, 1)


def test_bare_text():
    assert bare_text(stored(b"hello\0rest")) == "hello"
    for none in (b"%PDF-1.4 more text", b"\1\2\3\4\5\6\7\x08\x0e", b"        ", b"ab"):
        assert bare_text(stored(none)) is None
    d = text_page("a" * 200 + "\n\tb", (21000, 29700))
    assert len(d.marks) > 2 and max(m.xs[-1] for m in d.marks) < 21000 - 900


def bits(tag, n):
    return tlv(tag, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def long_tag(tag, value):
    return tag + bytes([len(value)]) + value


def two(a, b):
    out = b""
    for n in (a, b):
        raw = n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")
        out += bytes([len(raw)]) + raw
    return out


def record(level, *fields):
    return tlv(0x62, bits(0x80, level) + b"".join(fields))


def box(x, y, w, h):
    return record(3, long_tag(b"\x9f\x34", two(x, y)), long_tag(b"\x9f\x8f\x51", two(w, h)))


def test_properties_and_layout():
    overlay = tlv(0x87, bits(0x80, 4) + bits(0x81, 9) + tlv(0x86, b"zz"))
    block = record(2, tlv(0x85, two(21000, 29700))) + record(4, long_tag(b"\x9f\x3d", b"\1\x5a")) + box(0, 5, 100, 200) + record(4, tlv(0x85, two(2970, 2100))) + record(2) + record(4, tlv(0x62, overlay))
    first, second = shown_pages(block)
    assert (first.paper, first.rotation, first.boxes) == ((21000, 29700), 90, [((0, 5, 100, 200), (2970, 2100))])
    assert [(o.kind, o.expanded, o.coded) for o in second.overlays] == [(4, 9, b"zz")]
    pages = [Entry(0, 0, "jpeg", 0, 1, paper=(500, 500)), Entry(1, 0, "jpeg", 0, 1, paper=(2100, 2970))]
    shown = displayed(pages, [first, second])
    assert [[m["idx"] for m in d["members"]] for d in shown] == [[1], [0]]
    assert pages[1].rotation == 90 and pages[0].overlays == second.overlays and shown[1]["paper"] == (500, 500)
    assert misfit((1, 2), (2, 1)) == 0 and misfit(None, (1, 1)) == 100 and misfit((0, 1), (1, 1)) == 100


def test_untrusted_properties_go_by_position():
    pages = [Entry(0, 0, "jpeg", 0, 1), Entry(1, 0, "jpeg", 0, 1)]
    assert displayed(pages, [Shown((1, 2), 180)] + [Shown(None)] * 2) == []
    assert (pages[0].paper, pages[0].rotation, pages[1].paper) == ((1, 2), 180, None)


def test_orphans_give_their_overlays():
    pages = [Entry(0, 0, "bare", 0, 0, paper=(10000, 20000), overlays=["o"]), Entry(1, 0, "jpeg", 0, 1, paper=(20050, 10000))]
    merge_orphans(pages)
    assert (pages[0].role, pages[1].overlays) == ("data", ["o"])


def test_tables_and_reports(spark, tmp_path):
    from docquarry.operators import audit, reports
    from docquarry.sources import containers as src
    from docquarry.sources import sinks

    made = container([drawing_page(emf((43, ints(0, 0, 5, 5)), (77, b""), text_record(1, 2, "hi", [3, 4]))), raw_jpeg(400, 120), coded(21000, 29700), preview()])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xdw").write_bytes(made)
    (tmp_path / "in" / "b.xbd").write_bytes(b"%PDF-1 %%EOF")
    files = src.read_files(spark, str(tmp_path / "in"))
    docs = src.parsed(files)
    plain = audit.coverage(src.entries(docs))
    full = audit.coverage(src.entries(docs), src.decoded(files))
    assert [r["sheets_recovered"] for r in plain.collect() + full.collect()] == [0, 1]
    rows = {r["path"][-5:]: r for r in reports.triage_rows(docs, full, reports.attachment_counts(src.attachments(files))).collect()}
    assert (rows["a.xdw"]["verdict"], rows["a.xdw"]["sheets_in_vendor_coding"], rows["a.xdw"]["attachments"]) == ("SOME", 1, 0)
    assert (rows["b.xbd"]["verdict"], rows["b.xbd"]["sheets"]) == ("OTHER", None)
    pages = src.pages(files)
    assert [tuple(r)[1:] for r in reports.manifest(pages).orderBy("page").collect()] == [(1, "encoded", "210.0", "297.0", True), (2, "encoded", "210.0", "297.0", False)]
    assert {r["kind"] for r in src.marks(files).collect()} == {"shape", "text"}
    assert [r["record"] for r in src.skipped_records(files).collect()] == [77]
    streams = reports.streams(docs)
    assert sorted((r["entry"], r["role"]) for r in streams.collect()) == [(0, "page"), (2, "page"), (3, "preview")]
    assert reports.leanest(streams).count() == 1
    found = reports.findings(reports.expectation(docs, full), spark.createDataFrame([(r["path"], 3) for r in docs.collect()], "path string, pages long"))
    assert sorted(r["finding"] for r in found.collect()) == ["PageCount", "PicturesConverted", "PreviewsConverted"]
    out = sinks.write_parts(files, sinks.extracted_parts(files, docs).unionByName(sinks.stream_parts(streams)), str(tmp_path / "out")).collect()
    assert all(r["ok"] for r in out) and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.0000.page.bin", "a.0002.page.bin", "a.0003.preview.bin", "a_p002.jpg"]
    sinks.write_csv(reports.manifest(pages), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).count() == 2
    assert reports.info(docs, full).select("first_entries").first()[0][0].startswith("sheet encoded")


def test_arriving_files(spark, tmp_path):
    from docquarry.streaming import arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xdw").write_bytes(container([raw_jpeg(400, 120), preview()]))
    for _ in range(2):
        arrivals.arrived_tables(arrivals.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (row,) = arrivals.document_states(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert (row["sheets"], row["readable"]) == (1, 1)
