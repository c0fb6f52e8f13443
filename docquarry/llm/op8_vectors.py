"""Embedding near-dedup by spherical-cap filters.

Filters are directions from structured random product codes: a code word for each half of the randomly turned vector,
so that M^2 directions need only 2 M random ones; four codes with turns of their own even out what one code has of chance. A vector goes to every filter whose direction it
exceeds by the cap height; these are list-decoded from the sorted scores of the halves. A vector with fewer than FEWEST filters takes a lower cap. Vectors that
share a filter meet in its bucket and are verified in double precision; a pair counts in the least filter that
both exceed, so that links are neither lost between buckets nor counted twice. M and the cap height follow the number
of vectors, such that buckets keep their size: near pairs share about half of some 40 filters.
Equal vectors are one vector with a number of copies; buckets of many vectors are cut into
chunks that meet pair by pair.

The filters are random: a pair at the threshold is missed with a probability of about one in a thousand, closer ones more rarely.

Cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing; vectors
of different lengths do not link; rows that repeat an id count as vectors of their own; null ids
stay null and are kept apart; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, components, id_key, partitions, read_table, staged

CODES, BLOCKS, PER_VECTOR, FEWEST, BUCKET, CHUNK = 4, 2, 10, 2, 64, 1024


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        keys, raws = [], []
        for v in vectors:
            x = v.as_py()
            a = np.array([np.nan if y is None else y for y in x], np.float64) if x else np.zeros(0)
            ok = len(a) and np.isfinite(a).all() and (a != 0).any()
            raw = a.astype(np.float32).astype(np.float64)
            short = ok and (raw == a).all()  # single precision holds the vector: half the bytes
            raws.append((a.astype("<f4") if short else a.astype("<f8")).tobytes() if ok else None)
            keys.append(xxhash.xxh3_128_digest(a.tobytes()) if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("vid"), pa.array([len(v) if v.is_valid else 0 for v in vectors], pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vid", "dim", "key", "raw"])


def _unit(raws: list[bytes], dim: int) -> np.ndarray:
    """Vectors of length one in double precision."""
    x = np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8").astype(np.float64) for r in raws])
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def code(dim: int, m: int, which: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random turn, and the m code words of each block, of the length that makes a whole direction a unit vector."""
    rng = np.random.default_rng([dim, m, which])
    turn, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    blocks = min(BLOCKS, dim)
    edges = np.linspace(0, dim, blocks + 1).astype(int)
    out = []
    for lo, hi in zip(edges, edges[1:]):
        c = rng.normal(size=(m, hi - lo))
        out.append(c / np.sqrt((c * c).sum(axis=1))[:, None] / math.sqrt(blocks))
    return turn, out


def exceeded(x: np.ndarray, words: list[np.ndarray], height: float) -> list[np.ndarray]:
    """List decoding: for each unit vector, the sorted numbers of all filters whose direction it exceeds by the cap height."""
    edges = np.cumsum([0, *(w.shape[1] for w in words)])
    scores = [x[:, lo:hi] @ w.T for lo, hi, w in zip(edges, edges[1:], words)]
    half = (len(scores) + 1) // 2

    def sums(parts):
        total = parts[0]
        for p in parts[1:]:
            total = (total[:, :, None] + p[:, None, :]).reshape(len(x), -1)
        return total

    a = sums(scores[:half])
    b = sums(scores[half:]) if scores[half:] else np.zeros((len(x), 1))
    order = np.argsort(b, axis=1)
    out = []
    for i in range(len(x)):
        ranked, cap = b[i][order[i]], height
        while True:
            some = np.flatnonzero(a[i] + ranked[-1] >= cap)
            start = np.searchsorted(ranked, cap - a[i][some])
            n = len(ranked) - start
            if n.sum() >= min(FEWEST, a.shape[1] * b.shape[1]):
                break
            cap -= 0.1 * abs(height) + 1e-3
        left = np.repeat(some, n)
        right = order[i][np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]
        out.append(np.sort(left.astype(np.int64) * b.shape[1] + right))
    return out


def _filters(n: int):
    rate = min(0.25, BUCKET / max(n, 1))
    z = NormalDist().inv_cdf(1 - rate)
    m = max(2, math.ceil((PER_VECTOR / rate) ** (1 / BLOCKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raws = np.asarray(batch.column("dim")), batch.column("raw").to_pylist()
            out: list = [None] * len(raws)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                codes = [code(dim, m, c) for c in range(CODES)]
                for lo in range(0, len(at), 512):
                    some = at[lo : lo + 512]
                    x = _unit([raws[k] for k in some], dim)
                    lists = [exceeded(x @ turn, words, z / math.sqrt(dim)) for turn, words in codes]
                    for k, i in enumerate(some):
                        out[i] = np.concatenate([own[k] + c * m**BLOCKS for c, own in enumerate(lists)])
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("dim"), batch.column("raw"), pa.array(out, pa.list_(pa.int64()))], ["rep", "copies", "dim", "raw", "filters"])

    return run


def _least_shared(fa: list[np.ndarray], fb: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(fa), np.int64)
    for i, (a, b) in enumerate(zip(fa, fb)):
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        out[i] = a[np.argmax(b[at] == a)]
    return out


def _bucket(cut: float):
    """Rows come sorted by (dim, filter, cell): a cell is a whole bucket, a chunk, or two chunks that meet."""

    def cell(rows, now):
        dim, f, lo, hi = now
        if len(rows) < 2:
            return None
        reps = np.array([r[0] for r in rows], np.int64)
        copies = np.array([r[1] for r in rows], np.int64)
        side = np.array([r[4] for r in rows])
        lists = [np.array(r[3], np.int64) for r in rows]
        x = _unit([r[2] for r in rows], dim)
        links = np.zeros(len(rows), np.int64)
        label = np.arange(len(rows))
        pairs_a, pairs_b = [], []
        for s in range(0, len(rows), 512):
            near = x[s : s + 512] @ x[s:].T >= cut
            i, j = np.nonzero(near)
            i, j = i + s, j + s
            keep = (i < j) & (reps[i] != reps[j])
            if lo != hi:
                keep &= side[i] != side[j]
            pairs_a.append(i[keep])
            pairs_b.append(j[keep])
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        if not len(a):
            return None
        first = _least_shared([lists[k] for k in a], [lists[k] for k in b]) == f
        np.add.at(links, a[first], copies[b[first]])
        np.add.at(links, b[first], copies[a[first]])
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero((links > 0) | (label != np.arange(len(rows))))
        return reps[some], links[some], reps[label[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        out = []

        def emitted():
            made = [o for o in out if o is not None]
            out.clear()
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in made])) for k in range(3)], ["rep", "links", "root"])

        for batch in batches:
            for rep, copies, raw, filters, side, *at in zip(*(batch.column(c).to_pylist() for c in ("rep", "copies", "raw", "filters", "side", "dim", "filter", "lo", "hi"))):
                if tuple(at) != now:
                    out.append(cell(rows, now) if rows else None)
                    now, rows = tuple(at), []
                rows.append((rep, copies, raw, filters, side))
            yield from emitted()
        out.append(cell(rows, now) if rows else None)
        yield from emitted()

    return run


def near_vectors(vectors: DataFrame, cut: float = 0.95, chunk: int = CHUNK) -> DataFrame:
    """Rows (vid, n_links, component). vectors: vid, vector (array of float or double)."""
    spark = vectors.sparkSession
    sound = staged(vectors.mapInArrow(_sound, "vid bigint, dim int, key binary, raw binary"))
    # rep numbers the classes of equal vectors: ids may repeat and do not tell vectors apart
    reps = staged(sound.where("key is not null").groupBy("dim", "key").agg(F.min("vid").alias("least"), F.count("*").alias("copies"), F.first("raw").alias("raw")).withColumn("rep", F.monotonically_increasing_id()))
    listed = staged(reps.select("rep", "copies", "dim", "raw").repartition(partitions(spark)).mapInArrow(_filters(reps.count()), "rep bigint, copies bigint, dim int, raw binary, filters array<bigint>"))
    rows = listed.select("rep", "copies", "dim", "raw", "filters", F.explode("filters").alias("filter"))
    large = staged(listed.select("dim", F.explode("filters").alias("f")).groupBy(F.col("dim").alias("ld"), "f").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).where("chunks > 1"))
    placed = rows.join(large, (F.col("ld") == F.col("dim")) & (F.col("f") == F.col("filter")), "left")
    n = F.coalesce("chunks", F.lit(1))
    side = F.pmod(F.xxhash64("rep"), n).cast("int")
    cells = placed.withColumn("side", side).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    cells = cells.select("rep", "copies", "dim", "raw", "filters", "filter", "side", F.least("side", "k").alias("lo"), F.greatest("side", "k").alias("hi"))
    dealt = cells.repartition(partitions(spark), "dim", "filter", "lo", "hi").sortWithinPartitions("dim", "filter", "lo", "hi")
    found = staged(dealt.mapInArrow(_bucket(cut), "rep bigint, links bigint, root bigint"))
    comps = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "lr")
    comps = staged(reps.join(comps, F.col("id") == F.col("rep")).select("rep", "least", "component"))
    heads = comps.groupBy(F.col("component").alias("head")).agg(F.min("least").alias("first"))
    named = comps.join(heads, F.col("head") == F.col("component")).select(F.col("rep").alias("nr"), "first")
    per = reps.join(links, F.col("lr") == F.col("rep"), "left").join(named, F.col("nr") == F.col("rep"), "left")
    per = staged(per.select(F.col("key").alias("rk"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("component")))
    return sound.select("vid", "key").join(per, F.col("rk") == F.col("key"), "left").select("vid", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vid").alias("component"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings").select(id_key("vec_id").alias("vid"), F.col("embedding").alias("vector"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return near_vectors(table).select(back("vid").alias("vec_id"), "n_links", back("component").alias("component_id"), (F.col("vid") == F.col("component")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) for x in e]) AND list_bool_or([x <> 0 for x in e])),
p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM s x JOIN s y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, m AS component_id, vec_id = m AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
