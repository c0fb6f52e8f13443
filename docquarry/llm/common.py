"""What the corpus operators share: staged tables, byte views of Arrow text, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where rows are ordered or joined by id; null ids come first.
NULL_ID = -(1 << 63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where none is named and all run in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("docquarry.shared.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("docquarry.shared.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there and
    no executor that is lost later takes rows with it."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docquarry_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    path = getattr(df, "_docquarry_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def _give_back() -> None:
    """Hands memory that is free but kept by the allocators back to the system: a worker outlives its tasks, beside the workers of the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, whose worker keeps no free memory when the task is done."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    lean_run.__name__ = run.__name__
    return lean_run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once for a body that uses it many times."""
    return F.transform(F.array(value), body)[0]


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw, at = raw[at[0] : at[-1]], at - at[0]
    if column.null_count:
        # Arrow does not promise empty slots for nulls
        gone = np.asarray(column.is_null())
        length = np.where(gone, 0, np.diff(at))
        if length.sum() != at[-1]:
            keep = np.repeat(~gone, np.diff(at))
            raw = raw[keep]
            at = np.concatenate([[0], np.cumsum(length)])
    return raw, at


def row_slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a longer row stands alone."""
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any kinds as one compressed block."""
    parts = []
    for a in arrays:
        head = f"{a.dtype.str}:{len(a)};".encode()
        parts.append(bytes([len(head)]) + head + a.tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    size = int.from_bytes(block[:8], "little")
    raw = pa.decompress(block[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out, i = [], 0
    while i < len(raw):
        j = i + 1 + raw[i]
        kind, n = raw[i + 1 : j - 1].decode().split(":")
        a = np.frombuffer(raw, np.dtype(kind), int(n), j)
        out.append(a)
        i = j + a.nbytes
    return out


_SALT = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(1 << max(10, int(n - 1).bit_length()), 0x9E3779B97F4A7C15, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without space and \\x09-\\x0D) of concatenated texts, and
    the number of words of each row. Words never cross rows."""
    n = len(raw)
    counts = np.zeros(len(at) - 1, np.int64)
    if not n:
        return np.zeros(0, np.uint64), counts
    inside = ~_BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[1:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    which = np.cumsum(first) - 1
    pos = np.flatnonzero(inside)
    which = which[pos]
    within = pos - starts[which]
    letters = _LOWER[raw[pos]] if lower else raw[pos]
    terms = _SALT[letters] * _powers(int(within.max()) + 1)[within]
    begins = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    hashes = mix(np.add.reduceat(terms, begins))
    counts = np.diff(np.searchsorted(starts, at))
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words and the number of each row's; fewer words than n make one."""
    m = len(words)
    row = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(m)
    starts = np.cumsum(counts) - counts
    short = (counts > 0) & (counts < n)
    good = (at + n <= ends) | (short[row] & (at == starts[row])) if m else np.zeros(0, bool)
    total = np.zeros(m, np.uint64)
    length = np.minimum(counts, n)[row] if m else np.zeros(0, np.int64)
    zero = np.zeros(1, np.uint64)
    for j in range(n):
        part = np.zeros(m, np.uint64)
        if m > j:
            part[: m - j] = words[j:] * mix(np.uint64(j + 1) + zero)[0]
        total += np.where(j < length, part, np.uint64(0))
    out = mix(total + length.astype(np.uint64))[good]
    per = np.where(short, 1, np.maximum(counts - n + 1, 0))
    return out, per


def _least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids on edges between different ids, and the smallest id that each can reach."""
    far = u != v
    ids, flat = np.unique(np.concatenate([u[far], v[far]]), return_inverse=True)
    a, b = flat[: far.sum()], flat[far.sum() :]
    root = np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return ids, ids[root]


def components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """Connected components of edges (u, v), bigint: rows (id, component) for every id on an edge
    between different ids; component is the smallest id that can be reached. Alternates
    large-star and small-star steps, each a grouped minimum and a join that can be split, and
    stages the edges after each round; nothing is gathered on the driver but two sums. Of edges that are
    staged and not more than at_once, the driver finds the components without rounds."""
    spark = edges.sparkSession
    if at_once and edges.count() <= at_once:
        few = edges.select("u", "v").toArrow()
        ids, least = _least_reachable(np.asarray(few["u"]), np.asarray(few["v"]))
        return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(least, pa.int64())}), "id bigint, component bigint")

    def measure(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = measure(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        after = staged(small)
        found = measure(after)
        dropped(now)
        now = after
        if found == seen:
            break
        seen = found
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    heads = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.unionByName(heads)
