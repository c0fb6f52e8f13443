import os
import random

import duckdb
import pytest

from docquarry.operators import marks
from docquarry.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


BOX = "left double, top double, right double, bottom double"


def test_covered_texts(spark):
    rng = random.Random(5)
    glyphs, shapes = [], []
    for page in range(6):
        for o in range(8):
            glyphs += [("p", page, o, k, 10.0 * k, 30.0 * o, 10.0 * k + 9, 30.0 * o + 12) for k in range(rng.randint(1, 6))]
        shapes += [("p", page, x - 0.5, y - 0.5, x + 8.0, y + 9.0) for x, y in ((10 * rng.randint(0, 6), 30 * rng.randint(0, 7)) for _ in range(110))]

    def hit(g, s):
        w, h = min(g[6], s[4]) - max(g[4], s[2]), min(g[7], s[5]) - max(g[5], s[3])
        return g[1] == s[1] and w > 0 and h > 0 and w * h * 100 >= 9 * 12

    want = []
    for page, o in sorted({(g[1], g[2]) for g in glyphs}):
        own = [g for g in glyphs if (g[1], g[2]) == (page, o)]
        n = sum(any(hit(g, s) for s in shapes) for g in own)
        if len(own) >= 3 and 4 * n >= 3 * len(own):
            want.append((page, o, len(own), n))
    got = marks.covered_texts(spark.createDataFrame(glyphs, f"path string, idx int, ord int, k int, {BOX}"), spark.createDataFrame(shapes, f"path string, idx int, {BOX}"), 10.0)
    assert want and sorted(tuple(r)[1:] for r in got.collect()) == want


def test_upright_columns(spark):
    rows = [("a", 0, k, 5.0, 10.0 * k, "x", 900) for k in range(3)] + [("b", 0, k, 5.0 * k, 10.0, "x", 900) for k in range(3)] + [("c", 0, k, 5.0, 10.0 * k, "xy", 900) for k in range(3)]
    got = marks.upright_columns(spark.createDataFrame(rows, "path string, idx int, ord int, x double, y double, text string, escapement int"))
    assert [r["path"] for r in got.collect()] == ["a"]


def test_survey_counts_pages_and_records(spark):
    rows = [("a", 0, 7, 2), ("a", 0, 7, 1), ("b", 1, 7, 1), ("a", 0, 9, 5)]
    got = marks.skipped_survey(spark.createDataFrame(rows, "path string, idx int, record long, n long"))
    assert sorted(tuple(r) for r in got.collect()) == [(7, 2, 4), (9, 1, 5)]
