import pyarrow as pa

from docquarry.functions.batches import HELD_BYTES, files_out
from docquarry.plans import drawn
from docquarry.plans.fixtures import made
from docquarry.sources import containers as src

LINES = "l_orderkey bigint, l_linenumber bigint, l_returnflag string, l_quantity bigint, l_partkey bigint"


def test_files_are_made_one_by_one_where_they_are_read(spark):
    """As many files as rows must never be held at once: a container may be large, and its row is small."""
    waiting = [0]

    def make(lines):
        waiting[0] += 1
        return bytes(100)

    def rows(path, data):
        waiting[0] -= 1
        return [{"path": path, "others": waiting[0], "size": len(data)}]

    lines = spark.createDataFrame([(k, k, "R", 5, k) for k in range(900)], LINES)
    files = drawn.of_lines(lines, make)
    got = src._per_file(files, rows, "path string, others int, size int").collect()
    assert sorted(r["path"] for r in got) == sorted(f"order{k}.xdw" for k in range(900)) and {(r["others"], r["size"]) for r in got} == {(0, 100)}
    # as a table they are the same files
    assert files.selectExpr("count(*) as n", "sum(length(content)) as size").first() == (900, 90000)


def test_files_as_a_table_go_out_in_small_batches():
    rows = pa.RecordBatch.from_pydict({"k": list(range(500))})
    each = lambda batch: ((str(k), bytes(1 << 16)) for k in batch.column("k").to_pylist())
    out = list(files_out(each)(iter([rows])))
    assert [p for b in out for p in b.column("path").to_pylist()] == [str(k) for k in range(500)]
    assert max(b.nbytes for b in out) < HELD_BYTES + (1 << 17)


def test_united_files_are_all_read(spark):
    rows = spark.range(10, numPartitions=2)
    a = made(rows, lambda batch: ((f"a{k}", b"1") for k in batch.column("id").to_pylist()))
    b = spark.createDataFrame([("b", bytearray(b"22"))], "path string, content binary")
    got = src._per_file(src.united(a, b), lambda path, data: [{"path": path, "size": len(data)}], "path string, size int").collect()
    assert sorted((r["path"], r["size"]) for r in got) == [*((f"a{k}", 1) for k in range(10)), ("b", 2)]
