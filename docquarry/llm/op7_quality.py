"""Quality rules with an n-gram perplexity model.

An interpolated modified Kneser-Ney model of order 5 over units is counted on all documents. A unit is a code point as it stands, or a
run of one ASCII mark or white space together with its length, so that no text is lost. Tasks give out their distinct n-grams with
counts, dealt by a hash of two context units to parts of the model. What is counted and kept grows with the
corpus: each part has its own sorted hash arrays of all its n-grams. Orders
above LOCAL are made within a part, as their contexts lie there; LOCAL and below are grouped sums and joins. A model of
at most WHOLE n-grams goes to every worker; a larger one stays in its parts, documents are dealt in slices of some megabytes by a hash, a slice asks each part for its distinct n-grams,
and the answers come back to it. Both ways give the same scores. What stands in no
other text is not held to be seen, as a document would vouch for itself: such n-grams back off, at every order. Equal texts are
one text there; n-grams that texts share keep their whole count. A document's score is the mean log probability of its units. For each language, the median and the median absolute
deviation of the scores give the upper and lower band; documents outside are rejected.

Cases: null or empty text has no words, all counts 0, and fails; a null language is a language of its
own; rows that repeat are judged alike; an empty table gives an empty result; other columns are ignored or,
in `kept_documents`, carried through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, dropped, lean, mix, pack, partitions, read_table, row_slices, shingle_hashes, staged, unpack, word_hashes

#: Of the model over units, and the order up to which its tables are not kept in parts.
UNITS, LOCAL = 5, 2
#: Of the packed keys of `KneserNey`.
ORDER, CLASS_BITS = 4, 6
#: Bands are this many deviations wide, at least `FLOOR` in mean log probability.
LOWER, UPPER, FLOOR = 6.0, 5.0, 0.05
SLICE_BYTES, SHARE_BYTES = 1 << 18, 1 << 24
#: Places of a table by which n-grams are numbered; beyond it they are sorted.
TABLE = 1 << 23
#: Units after which a task gives out its counts, and n-grams.
TASK_UNITS, MOST = 1 << 28, 1 << 21
#: N-grams of a model that every worker may hold whole: 96 MB.
WHOLE = 8_000_000
#: Stands for the text of an n-gram that several texts hold.
MANY = 0
SYMBOLS = b"#*$%&|<>"


_BEGIN, _LONGEST, _ODD = np.uint32(0xFFFFFFFF), 2047, np.uint64(0x9E3779B97F4A7C15)
_MARK = np.zeros(128, bool)
_MARK[[c for c in range(128) if not chr(c).isalnum()]] = True
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def units(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of concatenated UTF-8 texts, and the offsets of rows in units. Runs of over 2047 marks make several units."""
    first = np.flatnonzero(~_CONT[raw])
    b = raw[first].astype(np.uint32)
    code = b.copy()
    multi = np.flatnonzero(b >= 0xC0)
    if len(multi):
        p = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.uint32)
        f, lead_byte = first[multi], b[multi]
        c1, c2, c3 = p[f + 1] & 63, p[f + 2] & 63, p[f + 3] & 63
        two = ((lead_byte & 31) << 6) | c1
        three = ((lead_byte & 15) << 12) | (c1 << 6) | c2
        four = ((lead_byte & 7) << 18) | (c1 << 12) | (c2 << 6) | c3
        code[multi] = np.where(lead_byte < 0xE0, two, np.where(lead_byte < 0xF0, three, four))
    n = len(code)
    rows = np.searchsorted(first, at)
    # runs of one mark or of white space stand as one unit: else long runs, easy to foretell, hide how odd they are
    keep = np.ones(n, bool)
    keep[1:] = (code[1:] != code[:-1]) | ~_MARK[np.minimum(code[1:], 65)]
    keep[rows[:-1][rows[:-1] < n]] = True
    kept = np.flatnonzero(keep)
    length = np.diff(np.append(kept, n))
    if len(length) and length.max() > _LONGEST:
        keep[(np.arange(n) - np.repeat(kept, length)) % _LONGEST == 0] = True
        kept = np.flatnonzero(keep)
        length = np.diff(np.append(kept, n))
    return code[kept] | ((length - 1).astype(np.uint32) << np.uint32(21)), np.searchsorted(kept, rows)


def _hash(cols: list[np.ndarray]) -> np.ndarray:
    h = cols[-1].astype(np.uint64)
    for c in reversed(cols[:-1]):
        h = h * _ODD + c
    return mix(h)


def _column(u: np.ndarray, dist: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """The unit that stands k before each unit, or before those at `at`; a text is led by starts."""
    if at is None:
        before = np.full(len(u), _BEGIN, np.uint32)
        before[k:] = u[: len(u) - k]
        before[dist < k] = _BEGIN
        return before
    return np.where(dist[at] >= k, u[np.maximum(at - k, 0)], _BEGIN)


def numbered(u: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit the number of the n-gram that ends there, for each of these n-grams a place where it stands, and how far each unit is
    from its text's begin. Numbers are dense: each order's come from those of the context and the unit by a table of what occurs."""
    n = len(u)
    dist = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    starts = dist == 0
    small = u < 1 << 16
    seen = np.zeros(1 << 16, bool)
    seen[u[small]] = True
    single = (np.cumsum(seen) - 1).astype(np.int32)
    kinds = int(seen.sum())
    if small.all():
        unit = single[u]
    else:
        unit = np.empty(n, np.int32)
        unit[small] = single[u[small]]
        rest, back = np.unique(u[~small], return_inverse=True)
        unit[~small] = back + kinds
        kinds += len(rest)
    rank, size = unit, kinds
    for _ in range(1, order):
        code = np.empty(n, np.int64)
        code[0] = size
        code[1:] = rank[:-1]
        code[starts] = size  # the context of starts alone
        code *= kinds
        code += unit
        if (size + 1) * kinds <= TABLE:
            seen = np.zeros((size + 1) * kinds, bool)
            seen[code] = True
            size = int(np.count_nonzero(seen))
            rank = (np.cumsum(seen, dtype=np.int32) - np.int32(1))[code]
        else:
            found, rank = np.unique(code, return_inverse=True)
            rank, size = rank.astype(np.int32), len(found)
    place = np.empty(size, np.int64)
    place[rank] = np.arange(n)
    return rank, place, dist


#: Hashes, counts, the text that holds the n-gram or MANY, columns of units.
Counted = tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the order that sorts them, and where each begins in it."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(h) else np.zeros(0, np.int64)
    return ranked[starts], order, starts


def _sole(text: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    least, most = np.minimum.reduceat(text[order], at), np.maximum.reduceat(text[order], at)
    return np.where(least == most, most, MANY)


def _merged(parts: list[Counted]) -> Counted:
    """N-grams by rising hash."""
    h, n, text = (np.concatenate([p[k] for p in parts]) for k in range(3))
    u, order, at = _groups(h)
    cols = [np.concatenate([p[3][j] for p in parts])[order[at]] for j in range(len(parts[0][3]))]
    return u, np.add.reduceat(n[order], at), _sole(text, order, at), cols


def _counted(texts: pa.Array, order: int, others: bool) -> Iterator[Counted]:
    raw, at = byte_view(texts)
    for lo, hi in row_slices(at, SLICE_BYTES):
        u, ends = units(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        if not len(u):
            continue
        rank, place, dist = numbered(u, ends, order)
        text = np.full(len(place), MANY, np.uint32)
        if others:
            ids = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) % 0x7FFFFFFF + 1 for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1])], np.uint32)
            ids = np.repeat(ids, np.diff(ends))
            text[rank] = ids
            text[rank[text[rank] != ids]] = MANY
        cols = [_column(u, dist, k, place) for k in range(order - 1, -1, -1)]
        yield _hash(cols), np.bincount(rank, minlength=len(place)), text, cols


def _part_of(cols: list[np.ndarray], parts: int) -> np.ndarray:
    return (_hash(cols[-1 - LOCAL : -1]) % np.uint64(parts)).astype(np.int64)


def _count(order: int, parts: int, others: bool = True):
    """The distinct n-grams of what a task reads, with counts, by part of the model."""

    def out(held):
        _, n, text, cols = _merged(held)
        part = _part_of(cols, parts)
        by = np.lexsort((*reversed(cols), part))
        n, text, part, cols = n[by], text[by], part[by], [c[by] for c in cols]
        edge = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(edge[1:] > edge[:-1])
        blocks = [pack(n[a:b].astype(np.uint32), text[a:b], *(c[a:b] for c in cols)) for a, b in zip(edge[some], edge[some + 1])]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blocks, pa.binary())], ["part", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fed = [], 0
        for batch in batches:
            for c in _counted(batch.column("text"), order, others):
                held.append(c)
                fed += int(c[1].sum())
                if len(held) > 6:
                    held = [_merged(held)]
                if fed > TASK_UNITS or len(held[0][0]) > MOST:
                    yield out(held)
                    held, fed = [], 0
        if held:
            yield out(held)

    return run


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    s = np.asarray(batch.column("slice"))
    edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else []
    for lo, hi in zip(edges, edges[1:]):
        yield int(s[lo]), batch.slice(lo, hi - lo)


def _tables(n: np.ndarray, text: np.ndarray, cols: list[np.ndarray]) -> list[tuple]:
    """Counts, sole texts and columns from the full order down to LOCAL; lower orders count the different units that come before."""
    out = [(n.astype(np.int64), text, cols)]
    for k in range(len(cols) - 1, LOCAL - 1, -1):
        _, text, cols = out[-1]
        u, order, at = _groups(_hash(cols[1:]))
        out.append((np.diff(np.append(at, len(order))), _sole(text, order, at), [c[order[at]] for c in cols[1:]]))
    return out


def _times(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


_PART = "part int, grams binary, times array<bigint>, low binary"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part. For each part its n-grams, how often counts of 1 to 4 occur at each order above LOCAL, and its share of the counts of order LOCAL."""

    def done(part, held):
        _, n, text, cols = _merged(held)
        *upper, (low, sole, pair) = _tables(n, text, cols)
        times = [t for level, *_ in upper for t in _times(level)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(n, text, *cols)], pa.binary()), pa.array([times], pa.list_(pa.int64())), pa.array([pack(*pair, low, sole)], pa.binary())], ["part", "grams", "times", "low"])

    now, held = None, []
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("grams")):
            if part != now:
                if held:
                    yield done(now, held)
                now, held = part, []
            n, text, *cols = unpack(block.as_py())
            held.append((_hash(cols), n.astype(np.int64), text, cols))
            if len(held) > 64:
                held = [_merged(held)]
    if held:
        yield done(now, held)


def _low_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("low")):
            cols = unpack(block.as_py())
            for lo in range(0, len(cols[0]), 1 << 16):
                some = [pa.array(c[lo : lo + (1 << 16)].astype(np.int64)) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), part, np.int32)), *some], ["part", "a", "b", "n", "text"])


def part_of_model(n: np.ndarray, text: np.ndarray, cols: list[np.ndarray], low: tuple[np.ndarray, np.ndarray, np.ndarray], discounts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One part of the model: the sorted hashes of its n-grams, and their log probabilities."""
    a, b, p = low
    keys = _hash([a.astype(np.uint32), b.astype(np.uint32)])
    order = np.argsort(keys)
    keys, p = keys[order], p[order]
    for (n, text, own), d in zip(reversed(_tables(n, text, cols)[:-1]), reversed(discounts)):
        ctx = _hash(own[:-1])
        _, order, at = _groups(ctx)
        back = np.empty(len(ctx), np.int64)
        back[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ctx))))
        total, off = np.add.reduceat(n[order], at), d[np.minimum(n, 3)]
        weight = np.add.reduceat(off[order], at) / total
        base = p[np.searchsorted(keys, _hash(own[1:]))]
        seen = _sole(text, order, at) == MANY
        p = np.where(text == MANY, np.maximum(n - off, 0) / total[back], 0) + np.where(seen, weight, 1.0)[back] * base
        keys = _hash(own)
        order = np.argsort(keys)
        keys, p = keys[order], p[order]
    return keys, np.log(p).astype(np.float32)


def _model(discounts: list[np.ndarray]):
    """Rows come sorted by part, the part's n-grams first, then its probabilities of order LOCAL."""

    def done(part, counts, low):
        keys, logs = part_of_model(counts[0], counts[1], counts[2:], tuple(np.array(x) for x in zip(*low)), discounts)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([pack(keys, logs)], pa.binary())], ["part", "n", "model"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, low = None, None, []
        for batch in batches:
            for part, grams, a, b, p in zip(*(batch.column(c).to_pylist() for c in ("part", "grams", "a", "b", "p"))):
                if part != now:
                    if counts is not None:
                        yield done(now, counts, low)
                    now, counts, low = part, None, []
                if grams is not None:
                    counts = unpack(grams)
                else:
                    low.append((a, b, p))
        if counts is not None:
            yield done(now, counts, low)

    return run


def _off(n, d: np.ndarray):
    return F.when(n == 1, float(d[1])).when(n == 2, float(d[2])).otherwise(float(d[3]))


def kneser_ney(docs: DataFrame, order: int = UNITS, base: float | None = None, others: bool = True) -> DataFrame:
    """The model of all documents, staged: rows (part, n, model), a part's n-grams as sorted hashes with log probabilities. docs: text.
    base: probability of a unit before any count, one over their number where none is given."""
    n = partitions(docs.sparkSession)
    fed = docs.select("text").mapInArrow(lean(_count(order, n, others)), "part int, grams binary")
    summed = staged(fed.repartition(n, "part").sortWithinPartitions("part").mapInArrow(lean(_sum), _PART))
    upper = order - LOCAL
    times = summed.agg(*[F.sum(F.col("times")[k]) for k in range(4 * upper)]).first()
    discounts = [KneserNey.discounts([float(t or 0) for t in times[4 * k : 4 * k + 4]]) for k in range(upper)]
    some = lambda t: t.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()
    sole = F.when(F.min("text") == F.max("text"), F.min("text")).otherwise(MANY).alias("text")
    own_pairs = staged(summed.select("part", "low").mapInArrow(lean(_low_rows), "part int, a bigint, b bigint, n bigint, text bigint"))
    pairs = staged(own_pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), sole))
    d2 = KneserNey.discounts([float(t or 0) for t in some(pairs)])
    ones = staged(pairs.groupBy("b").agg(F.count("*").alias("n"), sole))
    d1 = KneserNey.discounts([float(t or 0) for t in some(ones)])
    whole = ones.agg(F.sum("n").alias("n"), F.sum(_off(F.col("n"), d1)).alias("off"), F.count("*").alias("k")).first()
    total, flat = float(whole["n"] or 1), (whole["off"] or 0) / float(whole["n"] or 1) * (base or 1 / max(whole["k"], 1))
    own = lambda d: F.when(F.col("text") == MANY, F.greatest(F.col("n") - _off(F.col("n"), d), F.lit(0.0))).otherwise(0.0)
    of_one = ones.select(F.col("b").alias("ob"), (own(d1) / total + flat).alias("p1"))
    contexts = pairs.groupBy(F.col("a").alias("ca")).agg(F.sum("n").alias("cn"), F.sum(_off(F.col("n"), d2)).alias("coff"), ((F.min("text") != F.max("text")) | (F.max("text") == MANY)).alias("seen"))
    p2 = own(d2) / F.col("cn") + F.when(F.col("seen"), F.col("coff") / F.col("cn")).otherwise(1.0) * F.col("p1")
    of_two = pairs.join(of_one, F.col("ob") == F.col("b")).join(contexts, F.col("ca") == F.col("a")).select(F.col("a").alias("pa"), F.col("b").alias("pb"), p2.alias("p"))
    low = own_pairs.select("part", "a", "b").join(of_two, (F.col("pa") == F.col("a")) & (F.col("pb") == F.col("b")))
    null = lambda kind: F.lit(None).cast(kind)
    rows = summed.select("part", "grams", null("long").alias("a"), null("long").alias("b"), null("double").alias("p"))
    rows = rows.unionByName(low.select("part", null("binary").alias("grams"), "a", "b", "p"))
    model = staged(rows.repartition(n, "part").sortWithinPartitions("part", F.col("grams").isNull()).mapInArrow(lean(_model(discounts)), "part int, n bigint, model binary"))
    for t in (summed, own_pairs, pairs, ones):
        dropped(t)
    return model


class KneserNey:
    """Interpolated modified Kneser-Ney of one process, over packed keys of 64 kinds of units: what the parts are held against. levels[k] has sorted keys of (k + 1)-grams, log probabilities, and the
    log weight that a missing longer n-gram pays to fall back from this context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        tables = [(keys, counts)]
        for k in range(ORDER - 1, 0, -1):
            # lower orders count the different characters that come before
            low = tables[0][0] & np.uint32((1 << (CLASS_BITS * k)) - 1)
            u, n = np.unique(low, return_counts=True)
            tables.insert(0, (u, n))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []
        lower = None
        for k, (u, n) in enumerate(tables):
            context = u >> np.uint32(CLASS_BITS)  # without the last character
            context = u >> np.uint32(CLASS_BITS)
            order = np.argsort(context, kind="stable")
            ctx, at = np.unique(context[order], return_index=True)
            total = np.add.reduceat(n[order], at) if len(at) else n
            d = self.discounts([float(t) for t in _times(n)])
            off = d[np.minimum(n, 3)]
            weight = np.add.reduceat(off[order], at) / total if len(at) else n
            where = np.searchsorted(ctx, context)
            base = np.full(len(u), 1.0 / 64) if k == 0 else np.exp(self._of(lower, u & np.uint32((1 << (CLASS_BITS * k)) - 1)))
            p = np.maximum(n - off, 0) / total[where] + weight[where] * base
            lower = (u, np.log(p))
            self.levels.append((u, lower[1].astype(np.float32)))
            self.backoff.append((ctx, np.log(np.maximum(weight, 1e-9)).astype(np.float32)))

    @staticmethod
    def discounts(c: list[float]) -> np.ndarray:
        """By how much counts of 0, 1, 2 and more are lowered, where counts of 1 to 4 occur c times."""
        y = c[0] / (c[0] + 2 * c[1]) if c[0] and c[1] else 0.5
        d = [0.0] + [min(max((k + 1) - (k + 2) * y * c[k + 1] / c[k], 0.1), k + 1 - 1e-3) if c[k] else 0.5 for k in (0, 1, 2)]
        return np.array(d)

    @staticmethod
    def _of(level: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        return level[1][np.searchsorted(level[0], keys)]

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        """Of n-grams of the full order; those that were never counted back off."""
        out = np.zeros(len(keys), np.float64)
        left = np.arange(len(keys))
        for k in range(ORDER - 1, -1, -1):
            u, lp = self.levels[k]
            if not len(u):
                out[left] += np.log(1.0 / 64)
                return out
            own = keys[left] & np.uint32((1 << (CLASS_BITS * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(u, own), len(u) - 1)
            hit = u[at] == own
            out[left[hit]] += lp[at[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            ctx, weight = self.backoff[k]
            c = own >> np.uint32(CLASS_BITS)
            at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            out[left] += np.where(ctx[at] == c, weight[at], 0.0)
        out[left] += np.log(1.0 / 64)
        return out


def _line_repeats(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _repeat_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row, the words that stand in a 3-word window found twice or more in the row."""
    grams, per = shingle_hashes(words, counts, 3)
    per = np.where(counts < 3, 0, per)
    grams = grams[np.repeat(counts >= 3, np.where((counts > 0) & (counts < 3), 1, np.maximum(counts - 2, 0)))]
    row = np.repeat(np.arange(len(counts)), per)
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint16) if len(counts) < 65536 else row[order], kind="stable")]
    g, r = grams[order], row[order]
    same = (g[1:] == g[:-1]) & (r[1:] == r[:-1]) if len(g) else np.zeros(0, bool)
    twice = np.zeros(len(g), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(g), bool)
    hit[order] = twice
    starts = np.cumsum(counts) - counts
    first = np.repeat(starts, per) + np.arange(len(g)) - np.repeat(np.cumsum(per) - per, per)
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[first[hit] + j] = True
    sums = np.concatenate([[0], np.cumsum(covered)])
    return sums[starts + counts] - sums[starts]


#: Of sorted hashes of n-grams, their log probabilities.
Answer = Callable[[np.ndarray], np.ndarray]


def measures(texts: pa.Array, order: int, answer: Answer) -> dict[str, np.ndarray]:
    """The base counts and the mean log probability of each text."""
    raw, at = byte_view(texts)
    n = len(at) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"score": np.zeros(n)}
    for lo, hi in row_slices(at, SLICE_BYTES):
        part, ends = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        words, counts = word_hashes(part, ends, lower=False)
        out["n_words"][lo:hi] = counts
        for name, flag in (("word_chars", ~_CONT[part] & ~_SPACE[part]), ("n_symbols", _SYMBOL[part])):
            sums = np.concatenate([[0], np.cumsum(flag)])
            out[name][lo:hi] = sums[ends[1:]] - sums[ends[:-1]]
        out["n_repeat_words"][lo:hi] = _repeat_words(words, counts)
        whole = part.tobytes()
        for i in range(lo, hi):
            out["n_dup_lines"][i] = _line_repeats(whole[ends[i - lo] : ends[i - lo + 1]])
        u, rows = units(part, ends)
        if not len(u):
            continue
        rank, place, dist = numbered(u, rows, order)
        keys = _hash([_column(u, dist, k, place) for k in range(order - 1, -1, -1)])
        by = np.argsort(keys)
        logs = np.empty(len(keys))
        logs[by] = answer(keys[by])
        sums = np.concatenate([[0.0], np.cumsum(logs[rank])])
        out["score"][lo:hi] = (sums[rows[1:]] - sums[rows[:-1]]) / np.maximum(np.diff(rows), 1)
    return out


_MADE = (("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("score", T.DoubleType()))


def _lookup(keys: np.ndarray, logs: np.ndarray) -> Answer:
    def answer(asked: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        if not (keys[at] == asked).all():
            raise ValueError("a text changed between counting and scoring")
        return logs[at]

    return answer


def _measured(batch: pa.RecordBatch, carry: list[str], order: int, answer: Answer) -> pa.RecordBatch:
    m = measures(batch.column("text"), order, answer)
    return pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(m[k]) for k, _ in _MADE], carry + [f"q_{k}" for k, _ in _MADE])


@lru_cache(maxsize=1)
def _whole(data: bytes) -> Answer:
    return _lookup(*unpack(data))


def _measure_by_whole(carry: list[str], order: int, model):
    """With the whole model in each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = _whole(model.value)
        for batch in batches:
            yield _measured(batch, carry, order, answer)

    return run


def _asked(order: int, parts: int):
    """Rows come sorted by slice: the n-grams that each slice asks of each part of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(now, held):
            keys, _, _, cols = _merged(held)
            part = _part_of(cols, parts)
            some = np.unique(part)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([pack(keys[part == p]) for p in some], pa.binary())], ["slice", "part", "asked"])

        now, held = None, []
        for batch in batches:
            for s, rows in _runs(batch):
                if s != now:
                    if held:
                        yield out(now, held)
                    now, held = s, []
                for c in _counted(rows.column("text"), order, False):
                    held = [_merged([*held, c])]
        if held:
            yield out(now, held)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, its model first: the answers to each slice."""
    answer = None
    for batch in batches:
        out = []
        for s, part, model, asked in zip(*(batch.column(c).to_pylist() for c in ("slice", "part", "model", "asked"))):
            if model is not None:
                answer = _lookup(*unpack(model))
            else:
                keys = unpack(asked)[0]
                out.append((s, pack(keys, answer(keys))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["slice", "answers"])


def _measure_by_slice(carry: list[str], order: int):
    """Rows come sorted by slice, a slice's answers before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, answer = None, [], None
        for batch in batches:
            for s, some in _runs(batch):
                if s != now:
                    now, held, answer = s, [], None
                block = some.column("answers")
                held += [unpack(b.as_py()) for b in block if b.is_valid]
                if block.null_count:
                    if answer is None:
                        keys, logs = (np.concatenate([h[k] for h in held]) for k in (0, 1)) if held else (np.zeros(1, np.uint64), np.zeros(1, np.float32))
                        by = np.argsort(keys)
                        held, answer = [], _lookup(keys[by], logs[by])
                    yield _measured(some.filter(block.is_null()), carry, order, answer)

    return run


def scored(docs: DataFrame, carry: list[str], order: int = UNITS, base: float | None = None, others: bool = True, whole: int = WHOLE) -> DataFrame:
    """docs' columns in `carry` with the measures as q_ columns. docs has a column text. others: what stands in no other text counts as not seen.
    whole: n-grams up to which every worker gets the whole model; a larger one stays in its parts, which answer slices of the documents. Results are the same."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    need = list(dict.fromkeys([*carry, "text"]))
    model = kneser_ney(docs, order, base, others)
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(f"q_{k}", t) for k, t in _MADE])
    if (model.agg(F.sum("n")).first()[0] or 0) <= whole:
        parts = [unpack(r["model"]) for r in model.select("model").toLocalIterator()] or [[np.zeros(1, np.uint64), np.zeros(1, np.float32)]]
        keys, logs = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        by = np.argsort(keys)
        data = spark.sparkContext.broadcast(pack(keys[by], logs[by]))
        return docs.select(*need).mapInArrow(lean(_measure_by_whole(carry, order, data)), schema)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    plain = [c for c in need if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    dealt = docs.select(*need, F.pmod(F.xxhash64(*plain), F.lit(1 + size // SHARE_BYTES)).alias("slice"))
    asked = dealt.select("slice", "text").repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(lean(_asked(order, n)), "slice bigint, part int, asked binary")
    both = model.select("part", "model").unionByName(asked, allowMissingColumns=True)
    answered = staged(both.repartition(n, "part").sortWithinPartitions("part", F.col("model").isNull()).select("slice", "part", "model", "asked").mapInArrow(lean(_answered), "slice bigint, answers binary"))
    rows = dealt.unionByName(answered, allowMissingColumns=True)
    return rows.repartition(n, "slice").sortWithinPartitions("slice", F.col("answers").isNull()).mapInArrow(lean(_measure_by_slice(carry, order)), schema)


def base_failed():
    return (F.col("q_n_words") < 50) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * 50)


def bands(measured: DataFrame, lang: str) -> DataFrame:
    """Rows (lang, low, high): mean log probabilities that documents of a language may have. Medians are taken on a histogram of steps of 0.001, over documents that pass the base rules."""
    step = F.round(F.col("q_score") * 1000).cast("int")
    hist = measured.where(~base_failed()).groupBy(F.col(lang).alias("b_lang"), step.alias("s")).agg(F.count("*").alias("n"))
    mid = hist.groupBy("b_lang").agg(F.expr("percentile(s, 0.5, n)").alias("mid")).withColumnRenamed("b_lang", "m_lang")
    off = hist.join(mid, F.col("m_lang").eqNullSafe(F.col("b_lang"))).groupBy("b_lang", "mid").agg(F.expr("percentile(abs(s - mid), 0.5, n)").alias("mad"))
    wide = lambda k: F.greatest(F.col("mad") * 1.4826 * k / 1000, F.lit(FLOOR))
    return staged(off.select("b_lang", (F.col("mid") / 1000 - wide(LOWER)).alias("low"), (F.col("mid") / 1000 + wide(UPPER)).alias("high")))


def judged(measured: DataFrame, lang: str) -> DataFrame:
    """Adds q_failed and q_kept. A language none of whose documents passes the base rules has no band and keeps none."""
    joined = measured.join(bands(measured, lang), F.col("b_lang").eqNullSafe(F.col(lang)), "left")
    kept = ~base_failed() & F.coalesce(F.col("q_score").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.withColumn("q_failed", base_failed()).withColumn("q_kept", kept).drop("b_lang", "low", "high")


def kept_documents(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns."""
    names = {c: ("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    measured = staged(scored(plain, list(names.values())))  # scored once, for the bands and for the verdicts
    limits = bands(measured, names[lang])
    passed = measured.join(limits, F.col("b_lang").eqNullSafe(F.col(names[lang]))).where(~base_failed() & F.col("q_score").between(F.col("low"), F.col("high")))
    return passed.select(*[F.col(n).alias(c) for c, n in names.items()])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = judged(staged(scored(docs, ["doc_id", "lang"])), "lang")
    counts = [F.col(f"q_{k}").alias(k) for k, _ in _MADE if k != "score"]
    return out.select("doc_id", *counts, F.col("q_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.exp(-F.col("q_score")).alias("perplexity"))
