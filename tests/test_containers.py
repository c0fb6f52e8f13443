import io
import random
import struct
import zipfile

import pytest

from docquarry.functions.carving import CFB, carved
from docquarry.functions.container import parse
from docquarry.functions.lzh import CodingError, expand, stored
from docquarry.functions.tlv import ContainerError, elements, length_at
from docquarry.plans.fixtures import coded, container, jpeg, preview, raw_jpeg, tlv


def roles(data):
    return [(e.kind, e.role, e.belongs_to) for e in parse(data)["entries"]]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 255, 256, 70000])
def test_lengths_round_trip(n):
    data = tlv(0x64, b"x" * n)
    (e,) = elements(data, 0, len(data))
    assert (e.tag, e.length) == (0x64, n)


@pytest.mark.parametrize("data", [b"", b"\x80", b"\x85\1\1\1\1\1", b"\x82\1"])
def test_bad_lengths(data):
    with pytest.raises(ContainerError):
        length_at(data, 0)


def test_pictures_and_thumbnail():
    got = roles(container([coded(21000, 29700), raw_jpeg(4733, 281), raw_jpeg(4733, 281), raw_jpeg(4733, 281), preview()]))
    assert got == [("encoded", "sheet", None), *[("jpeg", "picture", 0)] * 3, ("preview", "thumbnail", 0)]


def test_largest_picture_is_the_sheet():
    assert roles(container([raw_jpeg(947, 859), raw_jpeg(203, 243), preview()])) == [("jpeg", "sheet", None), ("jpeg", "picture", 0), ("preview", "thumbnail", 0)]


def test_picture_before_coded_page_is_a_sheet():
    assert [r[1] for r in roles(container([raw_jpeg(600, 800), coded(21000, 29700)]))] == ["sheet", "sheet"]


def test_previews_alone_are_sheets():
    assert [r[1] for r in roles(container([preview(), preview()]))] == ["sheet", "sheet"]


def test_other_files_and_generations():
    for data, code in ((b"%PDF-1.4", "NotAContainer"), (b"", "Truncated"), (container([], 9), "UnsupportedGeneration")):
        with pytest.raises(ContainerError) as e:
            parse(data)
        assert e.value.code == code


def test_damaged_offsets_are_scanned_for():
    good = container([raw_jpeg(600, 800), coded(21000, 29700)])
    first = parse(good)["entries"][0].offset
    bad = good.replace(first.to_bytes(4, "little"), (1 << 30).to_bytes(4, "little"))
    doc = parse(bad)
    assert doc["rebuilt"] == "OffsetOutsideFile" and [e.kind for e in doc["entries"]] == ["jpeg", "encoded"]


@pytest.mark.parametrize("n", [31, 32, 34, 64, 128, 200, 16400])
def test_long_page_tables(n):
    """From 32 entries on, the last octet of the trailer's length may by itself be no length."""
    doc = parse(container([preview()] * n))
    assert (len(doc["entries"]), doc["declared_entries"], doc["rebuilt"]) == (n, n, None)


def test_expand():
    text = b"The quick brown fox" * 400
    assert expand(stored(text), len(text)) == text
    assert expand(stored(text), 10) == text[:10]
    with pytest.raises(CodingError):
        expand(stored(text), len(text) + 1)
    with pytest.raises(CodingError):
        expand(b"\0\0rest", 1)


def archive(name):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, "body")
    return out.getvalue()


def test_carving():
    deck, plain, pdf = archive("ppt/a.xml"), archive("notes.txt"), b"%PDF-1.4 a %%EOF b %%EOF"
    compound = CFB + b"\0" * 22 + struct.pack("<H", 9) + b"\0" * 12 + struct.pack("<I", 1) + b"\0" * 464
    data = b"xx" + deck + b"yy" + plain + pdf + compound
    at = [2, 4 + len(deck), 4 + len(deck) + len(plain), len(data) - len(compound)]
    assert [(f.offset, f.length, f.extension, f.estimate) for f in carved(data)] == [(at[0], len(deck), "pptx", False), (at[1], len(plain), "zip", False), (at[2], len(pdf), "pdf", False), (at[3], 512, "cfb", True)]
    for none in (b"", b"%PDF-1.4", b"%%EOF %PDF-1", CFB, deck[:-1], compound[:-1]):
        assert carved(none) == []


def test_damage_never_escapes():
    rng = random.Random(7)
    good = container([coded(21000, 29700), raw_jpeg(600, 800), preview()])
    for _ in range(3000):
        data = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        try:
            parse(bytes(data))
        except ContainerError:
            pass
    for n in range(len(good)):
        try:
            parse(good[:n])
        except ContainerError:
            pass
    assert jpeg(3, 4)[:2] == b"\xff\xd8"


def test_files_become_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from docquarry.operators import audit
    from docquarry.sources import containers as src

    (tmp_path / "a.XDW").write_bytes(container([coded(21000, 29700), raw_jpeg(400, 120), coded(21000, 29700)]))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.xbd").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "c.txt").write_bytes(b"no")
    docs = src.parsed(src.read_files(spark, str(tmp_path)))
    assert sorted((r["path"][-5:], r["error_code"]) for r in docs.collect()) == [("a.XDW", None), ("b.xbd", "NotAContainer")]
    (tmp_path / "d.xbd").write_bytes(b"%PDF-1 %%EOF!")
    files = src.read_files(spark, str(tmp_path)).where("path like '%d.xbd'")
    got = src.attachments(files).join(files.select("path", "content"), "path").select("offset", "extension", src.attachment_bytes(F.col("content"), F.col("offset"), F.col("length")).alias("raw")).collect()
    assert [(r[0], r[1], bytes(r[2])) for r in got] == [(0, "pdf", b"%PDF-1 %%EOF")]
    (row,) = audit.coverage(src.entries(docs)).collect()
    assert (row["sheets"], row["sheets_recovered"], row["sheets_with_pictures"], row["sheets_blank"]) == (2, 0, 1, 1)
