import re
import zlib
from xml.dom import minidom

import pytest

from docquarry.functions.html import document_html, file_stem
from docquarry.functions.paper import contained, covers, page_points, paired_pictures, paper_option, snapped
from docquarry.functions.pdf import document_pdf, text_string
from docquarry.functions.container import parse
from docquarry.plans.fixtures import coded, container, preview, raw_jpeg
from tests.test_decoding import drawing_page, emf, ints, text_record


def checked(pdf):
    """The cross-reference table points at the objects; gives the streams that unpack."""
    start = int(re.search(rb"startxref\n(\d+)", pdf)[1])
    rows = re.findall(rb"(\d{10}) 00000 n", pdf[start:])
    for k, at in enumerate(rows, 1):
        assert pdf[int(at) :].startswith(b"%d 0 obj" % k)
    return [zlib.decompress(s) for s in re.findall(rb"FlateDecode /Length \d+ >>\nstream\n(.*?)\nendstream", pdf, re.S)]


DRAWN = emf((39, ints(1, 0, 0x0000FF, 0)), (37, ints(1)), (43, ints(10, 20, 110, 220)), (42, ints(0, 0, 9, 9)), (30, ints(1, 1, 50, 50)), text_record(10, 20, "a<あ", [7, 9, 9]))


def test_pdf():
    data = container([drawing_page(DRAWN), raw_jpeg(400, 120), coded(21000, 29700), preview()])
    pdf, report = document_pdf(data, parse(data))
    streams = b"\n".join(checked(pdf))
    assert (report.pages, report.recovered, report.placeholders) == (2, 1, 1)
    assert b"10 20 m" in streams and b" c" in streams and b"<3042>" in streams
    assert document_pdf(data, parse(data), skip_lost=True)[1].pages == 1
    assert document_pdf(data, parse(data) | {"entries": []})[1].pages == 1
    scan = container([raw_jpeg(600, 800), preview()])
    pdf, report = document_pdf(scan, parse(scan), lang="ja")
    assert report.recovered == 1 and b"/DCTDecode" in pdf and checked(pdf)


def test_strings():
    assert text_string("a(b)\\") == b"(a\\(b\\)\\\\)" and text_string("あ") == b"<FEFF3042>"


def test_html_is_well_formed():
    data = container([drawing_page(DRAWN), coded(21000, 29700), raw_jpeg(9, 9)])
    text, r = document_html(data, parse(data), name="<x>")
    assert r.pages == 2 and r.gaps == 0 and 'id="p2"' in text
    (drawing,) = re.findall(r"<svg.*?</svg>", text)
    assert minidom.parseString(drawing).getElementsByTagName("text")[0].firstChild.data == "a<あ"
    lost = container([coded(21000, 29700)])
    assert (document_html(lost, parse(lost))[1].pages, document_html(lost, parse(lost))[1].gaps) == (1, 1)
    assert file_stem("/a/b c.x.y") == "b_c"


def test_paper():
    assert snapped((20950, 29790)) == (21000, 29700) and snapped((29700, 21050)) == (29700, 21000) and snapped((5, 5)) == (5, 5)
    assert page_points((21000, 29700)) == pytest.approx((595.32, 841.92)) and page_points(None) is None
    assert paper_option("A4") == (595.32, 841.92) and paper_option("25.4x50.8") == pytest.approx((72, 144)) and paper_option("0x1") is None and paper_option("b") is None
    assert contained((1, 2), (10, 10)) == (2.5, 0, 5, 10)
    assert covers((5, 5, 90, 90), (100, 100)) and not covers((6, 0, 94, 100), (100, 100))


def test_paired_pictures():
    a, b = (1, 1), (2, 2)
    assert paired_pictures([a, a, b, b], [a, b]) == [0, 0, 1, 1]
    assert paired_pictures([b, a, b, (0, 0)], [a, b, None]) == [1, 0, 1, 2]
    assert paired_pictures([a, b], []) == [None, None]


def test_render_tables(spark):
    from docquarry.sources import renders

    data = container([drawing_page(DRAWN), coded(21000, 29700)])
    files = spark.createDataFrame([("x/a.xdw", bytearray(data)), ("b.xdw", bytearray(b"no"))], "path string, content binary")
    (p,) = renders.pdfs(files).collect()
    (h,) = renders.htmls(files).collect()
    assert (p["pages"], p["placeholders"], h["pages"], h["gaps"]) == (2, 1, 2, 1) and checked(bytes(p["pdf"]))
