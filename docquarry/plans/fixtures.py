"""Containers made from table rows, for round trips: what goes in is known, so SQL on the rows tells what must come out."""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import files_out, slices


def tlv(tag: int, value: bytes) -> bytes:
    n = len(value)
    if n < 0x80:
        return bytes([tag, n]) + value
    size = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag, 0x80 | len(size)]) + size + value


def num(tag: int, n: int) -> bytes:
    return tlv(tag, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def jpeg(w: int, h: int) -> bytes:
    return b"\xff\xd8\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00\xff\xd9"


def page(body: bytes) -> bytes:
    return tlv(0x64, tlv(0x81, b"\0\0\0\1") + tlv(0x82, body))


@functools.lru_cache(4096)
def raw_jpeg(w: int, h: int) -> bytes:
    image = jpeg(w, h)
    return page(struct.pack("<IIII", 16 + len(image), 0, w, h) + image)


@functools.lru_cache(64)
def coded(w: int, h: int) -> bytes:
    return page(num(0x80, 4) + num(0x81, 2000) + num(0x84, w) + num(0x85, h) + tlv(0x86, b"\0\0" + b"\x5a" * 30))


@functools.lru_cache(1)
def preview() -> bytes:
    head = struct.pack("<IiiHHIIiiII", 40, 104, 146, 1, 8, 0, 0, 0, 0, 216, 0)
    return page(num(0x80, 7) + num(0x81, 40) + tlv(0x86, head + struct.pack("<4I", 1, 32, 15184, 146) + b"\0" * 32))


def container(pages: list[bytes], generation: int = 7, properties: tuple[int, bytes] | None = None) -> bytes:
    """properties: their expanded size, and how they are stored."""
    out = tlv(0x60, num(0x82, generation) + tlv(0x83, b"\1\2\3\4"))
    block = tlv(0x63, properties[1]) if properties else b""
    size = sum(map(len, pages)) + 4 * len(pages) + 64 + len(block)
    octets = (size.bit_length() + 7) // 8 if size >= 0x80 else 0
    offsets, at = [], len(out) + 2 + octets
    for p in pages:
        offsets.append(at)
        at += len(p)
    fields = num(0x80, len(pages)) + tlv(0x81, struct.pack(f"<{len(pages)}I", *offsets))
    if properties:
        fields += num(0x83, properties[0]) + num(0x84, len(properties[1]))
    tail = tlv(0x65, fields + tlv(0x86, struct.pack("<I", len(fields) + 6)))
    body = b"".join(pages) + block + tail
    return out + (bytes([0x61, 0x80 | octets]) + len(body).to_bytes(octets, "big") if octets else bytes([0x61, len(body)])) + body


def _orders(runs: bool):
    def each(key: int, lines: list[tuple]) -> tuple[str, bytes]:
        pages = [coded(21000, 29700)] if runs else []
        for q, flag, _ in lines:
            if runs:
                pages.append(raw_jpeg(100 + int(q) // 10, 50))
            else:
                pages += [raw_jpeg(100 + int(q), 200) if flag == "R" else coded(21000, 29700), preview()]
        return f"order{key}.xdw", container([*pages, preview()] if runs else pages)

    return each


def made(rows: DataFrame, each: Callable[[pa.RecordBatch], Iterator[tuple[str, bytes]]]) -> DataFrame:
    """Files made of rows, as path and content. What reads them (`_per_file`) takes the rows and makes each file in the task that reads it."""
    out = rows.mapInArrow(files_out(each), "path string, content binary")
    out._docquarry_made = (rows, each)
    return out


def of_orders(lineitem: DataFrame, each: Callable[[int, list[tuple]], tuple[str, bytes]]) -> DataFrame:
    """A file for each order of what `each` makes of its key and its lines (quantity, flag, part), which are sorted. Orders are spread over all partitions:
    their rows are small but dear to work on, and by their size alone they would be put into one."""
    n = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.struct(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"))
    grouped = lineitem.repartition(n, "l_orderkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("lines"))

    def files(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        for part in slices(batch):
            lists = part.column("lines")
            held = lists.flatten()
            lines = list(zip(*(held.field(c).to_pylist() for c in ("q", "f", "p"))))
            at = 0
            for key, n in zip(part.column("k").to_pylist(), lists.value_lengths().to_pylist()):
                yield each(key, lines[at : at + n])
                at += n

    return made(grouped, files)


def order_containers(lineitem: DataFrame, runs: bool = False) -> DataFrame:
    """A container for each order: a page and its thumbnail for each line, or with `runs` one sheet with a picture for each line."""
    return of_orders(lineitem, _orders(runs))
