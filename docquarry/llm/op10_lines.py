"""Line dedup with two Bloom filters.

A first pass feeds every document's distinct line keys to a filter of keys seen once and a filter of keys
seen twice. The filters have a fixed number of bits, cut into slices by the key's hash: tasks send the bits
they set, slice by slice, and slices are merged apart from each other (twice = twice or both once).
Only lines whose key the second filter holds are shuffled; grouping them confirms exactly in how many documents
a key stands and which document keeps it. A full filter only lets more lines through, so results never
depend on its size.

Cases: null or empty text is one empty line; null ids count as one document below all others;
rows that repeat an id belong to one document, and the largest id keeps its lines in all its rows;
an empty table gives an empty result; other columns are ignored or, in `kept_lines`, carried through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, id_key, pack, read_table, staged, unpack

#: 64 slices of 2^20 bits: 8 MB is all that is ever broadcast.
SLICES, SLICE_BITS, PROBES = 64, 1 << 20, 4
LEAST_CHARS, LEAST_DOCS = 40, 5


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\r\x0b\x0c").lower()


def _keys(text: bytes, least: int) -> list[bytes]:
    """Digests of the lines' keys, b"" for keys that are too short."""
    out = []
    for line in text.split(b"\n"):
        key = line_key(line)
        if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
            out.append(b"")
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    ids, texts = batch.column("did").to_pylist(), batch.column("text").cast(pa.binary())
    for i, t in zip(ids, texts):
        yield i, t.as_py() or b""


def _slots(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For digests as pairs of 64-bit numbers: the slice of each and its bits there."""
    a, b = digests[:, 0], digests[:, 1] | np.uint64(1)
    bits = np.stack([(a + np.uint64(k) * b) >> np.uint64(20) for k in range(PROBES)], axis=1) % np.uint64(SLICE_BITS)
    return (a % np.uint64(SLICES)).astype(np.int64), bits.astype(np.uint32)


def _feed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found: list[bytes]) -> Iterator[pa.RecordBatch]:
            if not found:
                return
            d = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
            u, n = np.unique(d, axis=0, return_counts=True) if len(d) < 2 else _unique(d)
            part, bits = _slots(u)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(SLICES + 1))
            rows = [(s, pack(np.unique(bits[order[lo:hi]]), np.unique(bits[order[lo:hi]][n[order[lo:hi]] > 1]))) for s, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "bits"])

        found: list[bytes] = []
        for batch in batches:
            for _, text in _rows(batch):
                found += {k for k in _keys(text, least) if k}
                if len(found) > 500_000:
                    yield from flush(found)
                    found = []
        yield from flush(found)

    return run


def _unique(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((d[:, 1], d[:, 0]))
    d = d[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)])
    at = np.flatnonzero(new)
    return d[at], np.diff(np.append(at, len(d)))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("bits")):
            once, twice = held.setdefault(part, (np.zeros(SLICE_BITS, bool), np.zeros(SLICE_BITS, bool)))
            seen, again = unpack(block.as_py())
            twice[seen[once[seen]]] = True
            twice[again] = True
            once[seen] = True
    parts = list(held)
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([np.packbits(held[p][1]).tobytes() for p in parts], pa.binary())], ["part", "bits"])


def repeat_filter(docs: DataFrame, least_chars: int) -> np.ndarray:
    """The second filter, a bool for each bit of each slice. docs: did, text."""
    fed = docs.select("did", "text").mapInArrow(_feed(least_chars), "part int, bits binary")
    merged = fed.repartition(SLICES, "part").mapInArrow(_merge, "part int, bits binary")
    out = np.zeros((SLICES, SLICE_BITS // 8), np.uint8)
    for row in merged.toLocalIterator():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def _suspects(shared, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            ids: list[int] = []
            keys: list[bytes] = []
            for i, text in _rows(batch):
                own = {k for k in _keys(text, least) if k}
                keys += own
                ids += [i] * len(own)
            if not keys:
                continue
            part, bits = _slots(np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2))
            hit = ((held[part[:, None], bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).all(axis=1)
            at = np.flatnonzero(hit)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in at], pa.int64()), pa.array([keys[j] for j in at], pa.binary())], ["did", "key"])

    return run


def drops(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Rows (did, keys): the keys that a document loses. docs: did, text."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(repeat_filter(docs, least_chars))
    suspects = staged(docs.select("did", "text").mapInArrow(_suspects(held, least_chars), "did bigint, key binary"))
    common = suspects.groupBy("key").agg(F.count_distinct("did").alias("n"), F.max("did").alias("keeper")).where(F.col("n") >= least_docs)
    common = staged(common)  # so that the join deals both sides anew and can split a frequent key
    lost = suspects.join(common.select(F.col("key").alias("ck"), "keeper"), F.col("key") == F.col("ck")).where("did <> keeper")
    return lost.groupBy("did").agg(F.collect_set("key").alias("keys"))


def _apply(least: int, carry: list[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column("text").cast(pa.binary()), batch.column(len(batch.schema) - 1).to_pylist()
            lines_n, gone_n, out = [], [], []
            for t, keys in zip(texts, lost):
                text = t.as_py() or b""
                if keys:
                    keys, lines = set(keys), text.split(b"\n")
                    kept = [x for x, k in zip(lines, _keys(text, least)) if not k or k not in keys]
                    lines_n.append(len(lines))
                    gone_n.append(len(lines) - len(kept))
                    text = b"\n".join(kept)
                else:
                    lines_n.append(text.count(b"\n") + 1)
                    gone_n.append(0)
                out.append(text)
            if carry is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                new = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in carry], carry)

    return run


def _joined(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    lost = drops(docs.select(id_key().alias("did"), "text"), least_chars, least_docs)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    keyed = plain.withColumn("did", F.coalesce(F.col(names["doc_id"]).cast("long"), F.lit(NULL_ID)))
    lost = lost.withColumnRenamed("did", "ld")
    wide = keyed.join(lost, F.col("did") == F.col("ld"), "left").drop("did", "ld")
    return wide.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("keys").alias(lost_name(docs.columns)))


def lost_name(columns: list[str]) -> str:
    """A name for the last column, the keys a row loses, that no other column has."""
    name = "keys"
    while name in columns:
        name += "_"
    return name


def kept_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The documents with the lines dropped from their text; other columns stay as they are."""
    return _joined(docs, least_chars, least_docs).mapInArrow(_apply(least_chars, docs.columns), docs.schema)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return _joined(docs, LEAST_CHARS, LEAST_DOCS).mapInArrow(_apply(LEAST_CHARS, None), schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS MATERIALIZED (SELECT rid, doc_id, i, x[i] AS line, translate(trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT rid, doc_id, string_split(t, chr(10)) AS x FROM d))),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM l LEFT JOIN c USING (k))
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (
  SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY rid)
"""
