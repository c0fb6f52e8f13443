"""Suffix-array dedup: removes every byte covered by a string of 100 bytes that also starts earlier.

Strings of WINDOW bytes that are equal have the same least 32-byte gram at the same place, so each string is
dealt out by that gram (its anchor): neighbouring strings with one anchor form a run, and a run's bytes
are a context. Tasks send runs as (gram, context hash, place); contexts that are equal but for their place
need no sorting - all but the first go. Where different contexts share an anchor, their bytes are concatenated and a suffix
array decides: suffixes smaller than their successors are sorted directly, the others are induced by one scan over
the buckets, and adjacent common prefixes of 100 bytes or more show which strings are equal. Anchors with
more than HOT contexts are not put in one array: their strings are dealt out one by one by 128-bit hashes.

Earlier means a smaller doc_id, or the same document and an earlier start. Cases: null text is empty; a null id comes
before all others; rows that repeat doc_id and text are one document and get one result each; rows
that repeat only the id are ordered by a hash of the text; texts shorter than 100 bytes lose nothing; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, byte_view, id_key, mix, pack, partitions, read_table, row_slices, staged, unpack

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
SLICE_BYTES = 1 << 20
HOT = 1000
ARRAY_BYTES = 1 << 20
_ONE = np.uint64(1)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each position, by doubling; shorter than b by GRAM - 1."""
    h = b.astype(np.uint64) + _ONE
    power, k = np.uint64(0x9E3779B97F4A7C15), 1
    while k < GRAM:
        h = h[:-k] * power + h[k:]
        power = np.uint64((int(power) * int(power)) & 0xFFFFFFFFFFFFFFFF)
        k *= 2
    return mix(h)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, k = v, 1
    while 2 * k <= width:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(v) - width + 1], out[width - k : len(v) - k + 1])


def runs(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For concatenated texts: row, first and last start (in b) and anchor hash of each run."""
    none = np.zeros(0, np.int64)
    if len(b) < WINDOW:
        return none, none, none, np.zeros(0, np.uint64)
    h = _gram_hashes(b)
    low = np.uint64((1 << 22) - 1)
    place = np.arange(len(h), dtype=np.uint64)
    least = _sliding_min((h & ~low) | place, SPAN) & low
    length = np.diff(at)
    n_starts = np.maximum(length - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(length)), n_starts)
    if not len(row):
        return none, none, none, np.zeros(0, np.uint64)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts) + np.repeat(at[:-1], n_starts)
    anchor = least[start]
    first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    a = np.flatnonzero(first)
    e = np.append(a[1:], len(row)) - 1
    return row[a], start[a], start[e], h[anchor[a].astype(np.int64)]


def _pieces(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts of bounded size: bytes, row offsets, row numbers, and each row's place in its text. Long texts come in pieces that
    overlap by WINDOW - 1 bytes, so that each string is whole in exactly one piece."""
    for lo, hi in row_slices(at, SLICE_BYTES):
        if hi - lo == 1 and at[hi] - at[lo] > 2 * SLICE_BYTES:
            for s in range(int(at[lo]), int(at[hi]) - WINDOW + 1, SLICE_BYTES):
                e = min(s + SLICE_BYTES + WINDOW - 1, int(at[hi]))
                yield raw[s:e], np.array([0, e - s]), np.array([lo]), np.array([s - at[lo]])
        else:
            yield raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64)


class _Marks:
    """Gathers intervals by document and gives them out packed: start and end, or with the anchor of what is still open."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, id1, id2, kind, a, e, h=None):
        if len(id1):
            self.parts.append((id1, id2, np.full(len(id1), kind, np.int8), a.astype(np.int64), e.astype(np.int64), np.zeros(len(id1), np.uint64) if h is None else h))

    def batch(self) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        id1, id2, kind, a, e, h = (np.concatenate([p[k] for p in self.parts]) for k in range(6))
        self.parts = []
        order = np.lexsort((a, kind, id2, id1))
        id1, id2, kind, a, e, h = id1[order], id2[order], kind[order], a[order], e[order], h[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], (id1[1:] != id1[:-1]) | (id2[1:] != id2[:-1])])), len(id1))
        blocks = []
        for s, t in zip(edge, edge[1:]):
            open_ = kind[s:t] > 0
            blocks.append(kind[s:t].tobytes() + a[s:t].tobytes() + e[s:t].tobytes() + h[s:t][open_].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(id1[edge[:-1]]), pa.array(id2[edge[:-1]]), pa.array(np.diff(edge)), pa.array(blocks, pa.binary())], ["id1", "id2", "n", "marks"])


def _unmark(n: int, block: bytes) -> tuple[np.ndarray, ...]:
    kind = np.frombuffer(block, np.int8, n)
    a = np.frombuffer(block, np.int64, n, n)
    e = np.frombuffer(block, np.int64, n, 9 * n)
    h = np.zeros(n, np.uint64)
    h[kind > 0] = np.frombuffer(block, np.uint64, int((kind > 0).sum()), 17 * n)
    return kind, a, e, h


MARKS = "id1 bigint, id2 bigint, n bigint, marks binary"
DEALT = "part int, id1 bigint, id2 bigint, n bigint, marks binary"


def _firsts(key1, key2, id1, id2, a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts by key and place; the order, which of it are first of their key, and which are later ones in another place."""
    order = np.lexsort((a, id2, id1, key2, key1))
    k1, k2, d1, d2, s = key1[order], key2[order], id1[order], id2[order], a[order]
    new = np.ones(len(order), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    later = (d1 != d1[head]) | (d2 != d2[head]) | (s != s[head])
    return order, new, later


def _to_marks(marks: _Marks) -> pa.RecordBatch | None:
    out = marks.batch()
    if out is None:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), -1, np.int32)), *out.columns], ["part", "id1", "id2", "n", "marks"])


def _deal(held: list[tuple[np.ndarray, ...]], parts: int) -> Iterator[pa.RecordBatch]:
    """Runs by part, equal contexts within the task reduced to their first. Rows with part -1 are intervals that go."""
    if not held:
        return
    key1, key2, id1, id2, a, e = (np.concatenate([h[k] for h in held]) for k in range(6))
    order, new, later = _firsts(key1, key2, id1, id2, a)
    marks = _Marks()
    gone = order[later]
    marks.add(id1[gone], id2[gone], 0, a[gone], e[gone] + WINDOW)
    out = _to_marks(marks)
    if out is not None:
        yield out
    keep = np.sort(order[new])  # in the order of documents, which packs well
    part = (key1[keep] % np.uint64(parts)).astype(np.int32)
    by = np.argsort(part, kind="stable")
    keep, part = keep[by], part[by]
    edge = np.searchsorted(part, np.arange(parts + 1))
    rows = []
    for p, (lo, hi) in enumerate(zip(edge, edge[1:])):
        if hi > lo:
            k = keep[lo:hi]
            change = np.concatenate([[True], (id1[k][1:] != id1[k][:-1]) | (id2[k][1:] != id2[k][:-1])])
            rows.append((p, pack(key1[k], key2[k], id1[k][change], id2[k][change], (np.cumsum(change) - 1).astype(np.uint32), a[k].astype(np.uint32 if a[k].max() < 1 << 32 else np.int64), (e[k] - a[k]).astype(np.uint8))))
    none = pa.array([None] * len(rows), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), none, none, none, pa.array([r[1] for r in rows], pa.binary())], ["part", "id1", "id2", "n", "marks"])


def _anchor_runs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            raw, at = byte_view(batch.column("text"))
            ids1, ids2 = np.asarray(batch.column("id1")), np.asarray(batch.column("id2"))
            for b, ends, rows, places in _pieces(raw, at):
                row, first, last, gram = runs(b, ends)
                if not len(row):
                    continue
                view = memoryview(np.ascontiguousarray(b))
                digest = xxhash.xxh3_64_intdigest
                ctx = np.fromiter((digest(view[s : e + WINDOW]) for s, e in zip(first.tolist(), last.tolist())), np.uint64, len(first))
                shift = places[row] - ends[row]
                held.append((gram, ctx, ids1[rows[row]], ids2[rows[row]], first + shift, last + shift))
                n += len(row)
                if n > 800_000:
                    yield from _deal(held, parts)
                    held, n = [], 0
        yield from _deal(held, parts)

    return run


def _gathered(blocks: list[bytes]) -> tuple[np.ndarray, ...]:
    cols = []
    for block in blocks:
        key1, key2, d1, d2, which, a, width = unpack(block)
        cols.append((key1, key2, d1[which], d2[which], a.astype(np.int64), a.astype(np.int64) + width))
    return tuple(np.concatenate([c[k] for c in cols]) for k in range(6))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blocks of each part; rows come sorted by part."""
    now, blocks = None, []
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("marks").to_pylist()):
            if part != now and blocks:
                yield blocks
                blocks = []
            now = part
            blocks.append(block)
    if blocks:
        yield blocks


def _shared_runs(hot: int):
    """What the runs of each anchor come to: kind 0 goes, kind 1 meets other contexts in a suffix array, kind 2 is dealt out string by string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _by_part(batches):
            key1, key2, id1, id2, a, e = _gathered(blocks)
            by = np.argsort(key1)
            k = key1[by]
            same = k[1:] == k[:-1]
            twin = np.zeros(len(k), bool)
            twin[1:] |= same
            twin[:-1] |= same
            some = by[twin]
            key1, key2, id1, id2, a, e = (x[some] for x in (key1, key2, id1, id2, a, e))
            order, new, later = _firsts(key1, key2, id1, id2, a)
            marks = _Marks()
            gone = order[later]
            marks.add(id1[gone], id2[gone], 0, a[gone], e[gone] + WINDOW)
            first = order[new]
            if len(first):
                g = key1[first]
                edge = np.append(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), len(g))
                count = np.repeat(np.diff(edge), np.diff(edge))
                for kind, pick in ((1, (count > 1) & (count <= hot)), (2, count > hot)):
                    f = first[pick]
                    marks.add(id1[f], id2[f], kind, a[f], e[f], key1[f])
            out = marks.batch()
            if out is not None:
                yield out

    return run


def _contexts(parts: int):
    """From texts with their open runs: bytes for the suffix arrays (lane 0) and strings by their hashes (lane 1), by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            if not held:
                return
            gram = np.concatenate([h[0] for h in held])
            id1, id2, a, e = (np.concatenate([np.full(len(h[0]), h[k]) if k < 3 else h[k] for h in held]) for k in (1, 2, 3, 4))
            text = [x for h in held for x in h[5]]
            part = (gram % np.uint64(parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[by], np.arange(parts + 1))
            rows = []
            for p, (lo, hi) in enumerate(zip(edge, edge[1:])):
                if hi > lo:
                    k = by[lo:hi]
                    joined = np.frombuffer(b"".join(text[i] for i in k), np.uint8)
                    rows.append((p, pack(gram[k], id1[k], id2[k], a[k], (e[k] - a[k]).astype(np.uint8), joined)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "lane", "marks"])

        strings: list[tuple[np.ndarray, ...]] = []
        n_strings = 0

        def flush_strings():
            for out in _deal(strings, parts):
                if out.column("part")[0].as_py() < 0:
                    rows = zip(*(out.column(c).to_pylist() for c in ("id1", "id2", "n", "marks")))
                    cols = [(np.full(k, i), np.full(k, j), _unmark(k, m)[1]) for i, j, k, m in rows]
                    again = _Marks()
                    _joined(*(np.concatenate([c[k] for c in cols]) for k in range(3)), again)
                    own = [p[k] for p in again.parts for k in (0, 1, 3, 4)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(own[2].sum()) % parts], pa.int32()), pa.array([2], pa.int32()), pa.array([pack(*own)], pa.binary())], ["part", "lane", "marks"])
                else:
                    yield pa.RecordBatch.from_arrays([out.column("part"), pa.array([1] * len(out), pa.int32()), out.column("marks")], ["part", "lane", "marks"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, (id1, id2, marks) in enumerate(zip(batch.column("id1").to_pylist(), batch.column("id2").to_pylist(), batch.column("all").to_pylist())):
                text = None
                for m in marks:
                    kind, a, e, h = _unmark(m["n"], m["marks"])
                    if not (kind > 0).any():
                        continue
                    text = texts[i].as_py() if text is None else text
                    one = kind == 1
                    if one.any():
                        s, t = a[one], e[one]
                        held.append((h[one], id1, id2, s, t, [text[x : y + WINDOW] for x, y in zip(s.tolist(), t.tolist())]))
                        size += int((t - s + WINDOW).sum())
                    for x, y in zip(a[kind == 2].tolist(), e[kind == 2].tolist()):
                        at = np.arange(x, y + 1)
                        d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[s : s + WINDOW]) for s in range(x, y + 1)), "<u8").reshape(-1, 2)
                        strings.append((d[:, 0], d[:, 1], np.full(len(at), id1), np.full(len(at), id2), at, at))
                        n_strings += len(at)
                if size > 24 << 20:
                    yield from flush()
                    held, size = [], 0
                if n_strings > 800_000:
                    yield from flush_strings()
                    strings, n_strings = [], 0
        yield from flush()
        yield from flush_strings()

    return run


def suffix_array(t: np.ndarray, n_text: int, needed: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The needed suffixes of t in the order of their first `depth` bytes, and the big-endian words from each position. Two
    stages: suffixes smaller than their successors (type S) are sorted directly, eight bytes a round for those still tied;
    one scan over the buckets of first bytes then puts each other suffix (type L) after the scan has
    met its successor. The text is the first n_text bytes of t, zeros follow, and its end is smaller than any byte; needed holds, with every L suffix, its successor or the end."""
    n = len(t)
    symbol = t.astype(np.int16) + 1
    symbol[n_text:] = 0
    w = t.astype(np.uint64)
    for k, bits in ((1, 8), (2, 16), (4, 32)):
        tail = np.zeros(n, np.uint64)
        tail[: n - k] = w[k:]
        w = (w << np.uint64(bits)) | tail
    # type S: the next symbol that differs is larger
    step = np.sign(symbol[1:] - symbol[:-1])
    differs = np.flatnonzero(step)
    small = np.zeros(n, bool)
    small[:n_text] = step[differs[np.searchsorted(differs, np.arange(n_text))]] > 0
    needed = needed.copy()
    needed[n_text:] = False
    direct = np.flatnonzero(needed & small)
    group = np.zeros(len(direct), np.int64)
    order = direct
    active = np.arange(len(direct))
    for d in range(0, depth, 8):
        if len(active) < 2:
            break
        pos = order[active]
        key = w[np.minimum(pos + d, n - 1)]
        by = np.argsort(key)
        g = group[active]
        by = by[np.argsort(g[by], kind="stable")]
        pos, key, g = pos[by], key[by], g  # groups keep their places
        order[active] = pos
        same = (key[1:] == key[:-1]) & (g[1:] == g[:-1])
        start = np.concatenate([[True], ~same])
        group[active] = active[np.flatnonzero(start)[np.cumsum(start) - 1]]
        tied = np.zeros(len(active), bool)
        tied[1:] |= same
        tied[:-1] |= same
        active = active[tied]
    bucket_s = np.searchsorted(symbol[order], np.arange(258))
    large = needed & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, c: int) -> np.ndarray | None:
        """Sends the L predecessors to their buckets; those of bucket c itself are the scan's next wave."""
        prev = found[found > 0] - 1
        prev = prev[large[prev]]
        if not len(prev):
            return None
        first = symbol[prev]
        by = np.argsort(first, kind="stable")
        prev, first = prev[by], first[by]
        at = np.append(np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])), len(first))
        own = None
        for lo, hi in zip(at, at[1:]):
            if first[lo] == c:
                own = prev[lo:hi]
            else:
                waiting[first[lo]].append(prev[lo:hi])
        return own

    induce(np.array([n_text]), 0)
    for c in range(1, 257):
        wave = np.concatenate(waiting[c]) if waiting[c] else None
        waiting[c] = []
        while wave is not None and len(wave):
            out.append(wave)
            wave = induce(wave, c)
        s = order[bucket_s[c] : bucket_s[c + 1]]
        if len(s):
            out.append(s)
            induce(s, c)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), w


def equal_strings(text: np.ndarray, begins: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in `text`, each with widths[i] + 1 strings of WINDOW bytes from begins[i]: positions of strings in suffix order and, for
    each, whether it equals the one before it."""
    n = len(text)
    t = np.concatenate([text, np.zeros(WINDOW + 16, np.uint8)])
    mark = np.zeros(len(t) + 1, np.int32)
    np.add.at(mark, begins, 1)
    np.add.at(mark, begins + widths + 1, -1)
    wanted = np.cumsum(mark)[:-1] > 0
    # an L suffix needs its successors up to the first S or the end: to the first rise at or after a context's last string
    rises = np.flatnonzero(text[1:] > text[:-1])
    foot = np.searchsorted(rises, begins + widths)
    stop = np.append(rises, n)[foot]
    mark = np.zeros(len(t) + 1, np.int32)
    np.add.at(mark, begins, 1)
    np.add.at(mark, stop + 1, -1)
    needed = np.cumsum(mark)[:-1] > 0
    array, w = suffix_array(t, n, needed)
    array = array[wanted[array]]
    common = np.zeros(len(array), np.int64)
    live = np.arange(1, len(array))
    for d in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
        live = live[w[array[live] + d] == w[array[live - 1] + d]]
        common[live] = d + 8
    return array, common >= WINDOW


def _sorted_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and lane."""
    now, blocks = None, []

    def done():
        if not blocks:
            return None
        marks = _Marks()
        if now[1] == 0:
            cols = [unpack(b) for b in blocks]
            gram, id1, id2, a, width = (np.concatenate([c[k] for c in cols]) for k in range(5))
            text = np.concatenate([c[5] for c in cols])
            length = width.astype(np.int64) + WINDOW
            begin = np.cumsum(length) - length
            by = np.argsort(gram, kind="stable")
            size = np.cumsum(length[by])
            g = gram[by]
            edge = np.append(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), len(g))
            lo = 0
            while lo < len(edge) - 1:
                base = size[edge[lo] - 1] if edge[lo] else 0
                hi = max(lo + 1, int(np.searchsorted(size[edge[1:] - 1], base + ARRAY_BYTES, side="right")))
                hi = min(hi, len(edge) - 1)
                _decide(by[edge[lo] : edge[hi]], text, begin, length, width, id1, id2, a, marks)
                lo = hi
        elif now[1] == 1:
            key1, key2, id1, id2, a, _ = _gathered(blocks)
            order, _, later = _firsts(key1, key2, id1, id2, a)
            _joined(id1[order[later]], id2[order[later]], a[order[later]], marks)
        else:
            for b in blocks:
                id1, id2, a, e = unpack(b)
                marks.add(id1, id2, 0, a, e)
        return marks.batch()

    for batch in batches:
        for part, lane, block in zip(*(batch.column(c).to_pylist() for c in ("part", "lane", "marks"))):
            if (part, lane) != now:
                out = done()
                if out is not None:
                    yield out
                now, blocks = (part, lane), []
            blocks.append(block)
    out = done()
    if out is not None:
        yield out


def _decide(some, text, begin, length, width, id1, id2, a, marks) -> None:
    own = length[some]
    starts = np.cumsum(own) - own
    at = np.arange(int(own.sum())) - np.repeat(starts, own) + np.repeat(begin[some], own)
    array, same = equal_strings(text[at], starts, width[some].astype(np.int64))
    if not same.any():
        return
    ctx = np.searchsorted(starts, array, side="right") - 1
    place = a[some][ctx] + array - starts[ctx]
    d1, d2 = id1[some][ctx], id2[some][ctx]
    cls = np.cumsum(~same)
    order = np.lexsort((place, d2, d1, cls))
    c = cls[order]
    head = order[np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))[np.searchsorted(np.unique(c), c)]]
    # rows that repeat a document bring its strings twice: those stand in one place
    later = (d1[order] != d1[head]) | (d2[order] != d2[head]) | (place[order] != place[head])
    gone = order[later]
    _joined(d1[gone], d2[gone], place[gone], marks)


def _joined(id1, id2, start, marks) -> None:
    """Adds strings as intervals, neighbours joined."""
    if not len(id1):
        return
    order = np.lexsort((start, id2, id1))
    id1, id2, start = id1[order], id2[order], start[order]
    new = np.concatenate([[True], (id1[1:] != id1[:-1]) | (id2[1:] != id2[:-1]) | (start[1:] > start[:-1] + 1)])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(new)) - 1
    marks.add(id1[head], id2[head], 0, start[head], start[tail] + WINDOW)


def removed_spans(n_bytes: int, marks: list) -> list[tuple[int, int]]:
    """The union of a document's intervals as maximal runs."""
    if not marks:
        return []
    parts = [_unmark(m["n"], m["marks"]) for m in marks]
    kind, a, e = (np.concatenate([p[k] for p in parts]) for k in range(3))
    a, e = a[kind == 0], e[kind == 0]
    order = np.argsort(a)
    a, e = a[order], np.maximum.accumulate(e[order]) if len(e) else e
    if not len(a):
        return []
    new = np.concatenate([[True], a[1:] > e[:-1]])
    head = np.flatnonzero(new)
    return list(zip(a[head].tolist(), e[np.append(head[1:], len(a)) - 1].tolist()))


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column("text").cast(pa.binary()), batch.column("all").to_pylist()
            rows = []
            for t, m in zip(texts, marks):
                text = t.as_py() or b""
                spans = removed_spans(len(text), m)
                at, kept = 0, []
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((len(text), len(text) - len(left), len(spans), left if with_text else hashlib.sha256(left).hexdigest()))
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([r[3] for r in rows], pa.binary() if with_text else pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id1"), *cols], ["id1", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def removed(docs: DataFrame, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): kept is the bytes that stay, or their sha256. docs: doc_id, text."""
    spark = docs.sparkSession
    n = partitions(spark)
    parts = 8 * n
    texts = docs.select(id_key().alias("id1"), F.coalesce("text", F.lit("")).alias("text")).withColumn("id2", F.xxhash64("text")).select("id1", "id2", "text")
    dealt = staged(texts.mapInArrow(_anchor_runs(parts), DEALT))
    local = dealt.where("part < 0").select("id1", "id2", "n", "marks")
    shared = staged(dealt.where("part >= 0").select("part", "marks").repartition(n, "part").sortWithinPartitions("part").mapInArrow(_shared_runs(hot), MARKS))
    gather = lambda m: m.groupBy(F.col("id1").alias("m1"), F.col("id2").alias("m2")).agg(F.collect_list(F.struct("n", "marks")).alias("all"))
    on = (F.col("id1") == F.col("m1")) & (F.col("id2") == F.col("m2"))
    opened = texts.join(gather(shared), on)
    contexts = opened.select("id1", "id2", "text", "all").mapInArrow(_contexts(parts), "part int, lane int, marks binary")
    decided = contexts.repartition(n, "part").sortWithinPartitions("part", "lane").mapInArrow(_sorted_contexts, MARKS)
    everything = gather(local.unionByName(shared).unionByName(decided))
    out = texts.join(everything, on, "left").select("id1", "text", "all").mapInArrow(_apply(with_text), f"id1 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'binary' if with_text else 'string'}")
    return out.select(F.when(F.col("id1") != NULL_ID, F.col("id1")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).withColumnRenamed("kept", "kept_sha256")
