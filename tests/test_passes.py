import os

import pytest

from docquarry.functions.container import parse
from docquarry.functions.lzh import expand, expand_all, stored
from docquarry.operators import audit
from docquarry.plans import fixtures, queries
from docquarry.sources import containers as src

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["coverage", "entry_kinds", "findings", "info_report", "picture_runs", "triage", "verify_report"])
def test_files_are_read_once(spark, name):
    """Making and reading files is what these queries cost."""
    assert plan(queries.QUERIES[name](spark, SF)).count("MapInArrow") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_picture_runs_shuffle_no_entries(spark):
    told = plan(queries.QUERIES["picture_runs"](spark, SF))
    assert "Window" not in told and told.count("Repartition") == 1


def files(spark):
    """Sheets with pictures of several widths, and of none that is known; blank sheets; a file that is no container."""
    jpeg, coded, preview = fixtures.raw_jpeg, fixtures.coded, fixtures.preview
    bare = fixtures.page(b"\xff" * 9)
    held = {
        "a": [coded(210, 297), jpeg(5, 50), jpeg(5, 50), bare, bare, jpeg(6, 50), jpeg(5, 50), preview(), coded(210, 297), jpeg(5, 50), preview()],
        "b": [coded(210, 297), preview(), coded(210, 297), preview()], "c": [jpeg(600, 800), preview()], "d": [],
    }
    rows = [(name, bytearray(fixtures.container(pages))) for name, pages in held.items()] + [("e", bytearray(b"%PDF-1.4"))]
    return spark.createDataFrame(rows, "path string, content binary")


def test_audits_of_single_files_agree_with_those_of_tables(spark):
    made = files(spark)
    docs = src.parsed(made)
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    runs = ("path", "sheet", "run", "first", "n", "width")
    assert rows(src.picture_runs(made).select(*runs)) == rows(audit.picture_runs(src.entries(docs)).select(*runs)) != []
    names = src.audited(made).columns
    assert rows(src.audited(made)) == rows(src.entries(docs).select(*names)) != []
    counts = audit.coverage(src.entries(docs))
    got = audit.covered(docs).where("size(entries) > 0").select(*counts.columns)
    assert rows(got) == rows(counts) != []


def test_equal_entries_are_entries_of_their_own():
    page = fixtures.coded(210, 297)
    a, b = parse(fixtures.container([page, page]))["entries"]
    assert (a.idx, b.idx, b.offset - a.offset, b.at - a.at) == (0, 1, len(page), len(page))
    a.overlays.append(1)
    a.unknown.append(2)
    (c,) = parse(fixtures.container([page]))["entries"]
    assert (b.overlays, b.unknown, c.overlays, c.unknown) == ([], [], [], [])


@pytest.mark.parametrize("cut", range(0, 40, 3))
def test_letters_of_eight_bits_end_where_the_stream_does(cut):
    """Blocks of letters that all have eight bits are taken at once; what is cut off is missing, and all before it is there."""
    text = bytes(range(256)) * 300  # two blocks, the second not on an octet's edge
    coded = stored(text)
    held = expand_all(coded[: len(coded) - cut], 1 << 28)
    assert text.startswith(held) and len(text) - cut - 1 <= len(held) <= len(text) - max(cut - 1, 0)
    assert expand(coded, len(text) - cut) == text[: len(text) - cut]


def test_streams_of_one_code_expand_alike():
    for text in (b"abc", b"xyz" * 50000, b"abc"):
        assert expand(stored(text), len(text)) == text
