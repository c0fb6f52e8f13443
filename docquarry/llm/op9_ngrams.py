"""N-gram Jaccard join by prefix trees.

Every document becomes a set of word n-grams; documents with equal sets are one node, named by 64 bits of a digest of the set (a
digest that two different sets share is noticed, and another one is taken). Nodes meet by their prefixes in a global order, rare before frequent by
a sketch of counts over all documents, then by hash: two similar sets share an n-gram there. An entry of a prefix carries
the set's size, the n-gram's place and counts of the set's n-grams in 32 bins; sizes, places and bins bound the overlap from above, and
no pair is given out whose bound is too low. First each entry meets the hub of its n-gram alone. The nodes that hang together so go to one
block, each set once, as tries: the sets in one global order, common beginnings stored once. Each set of a block is walked through the
trie, all nodes of a level at once; partial overlaps are shared along common paths, and a subtree is pruned where the n-grams that are left cannot reach the
overlap needed. Sets that links already connect are not compared again, so that what comes out is a spanning set of links and not all pairs. Large
groups are dealt over several blocks, and what is then outside a group's largest component meets the whole group block by block. At last, pairs with a common prefix n-gram that are
of different groups and components make new groups, which are compared in the same way: no link between components is lost. Of these pairs only
so many are given out as tie each group together, fewer than a part's nodes. Before sets move, pairs are screened by counts in as many bins as a quarter of their n-grams.

Cases: null text and text without words give an empty set that links with nothing; fewer words than n make one n-gram; texts may be of any length; equal
sets are always linked; rows that repeat an id are one document for links and keep a row each; null ids count as an id below all
others and come out null; an empty table gives an empty result; other columns are ignored or carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, byte_view, components, dropped, id_key, lean, mix, pack, partitions, read_table, row_slices, shingle_hashes, staged, unpack, word_hashes

SLICE_BYTES = 1 << 19
#: The sketch has about one slot for SLOT_BYTES of text, between these powers of two.
SLOT_BYTES, LEAST_BITS, MOST_BITS, SKETCH_PARTS = 8, 12, 24, 256
#: Bins of a set's n-grams that bound overlaps.
BINS = 32
#: The least number of the bins that screen pairs more finely.
FINE = 128
#: Sets and n-grams of a block.
BLOCK, BLOCK_GRAMS = 512, 1 << 21
#: Entries of an n-gram up to which all its pairs are looked at before anything is given out.
SMALL = 64
#: Ids that may be broadcast to find their documents: 16 MB; more are joined by a shuffle.
FEW = 1 << 21
#: Links up to which components are found at once on the driver: 2 MB.
AT_ONCE = 1 << 17


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, last row, their distinct n-gram hashes in order, and where each row's begin and end."""
    raw, at = byte_view(column)
    for lo, hi in row_slices(at, SLICE_BYTES):
        words, counts = word_hashes(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lower=True)
        grams, per = shingle_hashes(words, counts, n)
        row = np.repeat(np.arange(hi - lo, dtype=np.int32), per)
        order = _sorted_sets(grams, row, hi - lo)
        g, r = grams[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        g, r = g[new], r[new]
        yield lo, hi, g, np.searchsorted(r, np.arange(hi - lo + 1))


def _sorted_sets(key: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """An order by row, then by key."""
    order = np.argsort(key)
    rows = row[order]
    return order[np.argsort(rows.astype(np.uint16) if n_rows < 65536 else rows, kind="stable")]


def _digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _node(digest: bytes, part: int) -> int:
    """A signed 64-bit name, from the first or the second half of a digest."""
    return int.from_bytes(digest[8 * part : 8 * part + 8], "big", signed=True)


def fine_bins(grams: np.ndarray) -> np.ndarray:
    """Counts of a set's n-grams by their lowest bits, in a bin for about four of them or FINE at least: a power of two, so that bins of a larger set fold to those of a smaller one."""
    size = max(FINE, 1 << (max(len(grams) - 1, 1) // 4).bit_length())
    return np.minimum(np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def fold(bins: np.ndarray, size: int) -> np.ndarray:
    return bins.reshape(-1, size).sum(axis=0, dtype=np.int64)


def room(m: int, n: int, x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether sets of m and n n-grams with these fine bins can overlap enough."""
    size = min(len(x), len(y))
    return bool(np.abs(fold(x, size) - fold(y, size)).sum() <= m + n - 2 * -(-num * (m + n) // (num + den)))


def _screen(num: int, den: int):
    """Pairs whose fine bins leave room for the overlap needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(c).to_pylist() for c in ("an", "bn", "abins", "bbins")))
            keep = [room(m, k, np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), num, den) for m, k, x, y in sides]
            some = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(some), batch.column("b").filter(some)], ["a", "b"])

    return run


def _screened(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    side = lambda c: reps.select(F.col("node").alias(f"{c}_"), F.col("n").alias(f"{c}n"), F.col("bins").alias(f"{c}bins"))
    both = _small(staged(pairs)).join(side("a"), F.col("a_") == F.col("a")).join(side("b"), F.col("b_") == F.col("b"))
    return staged(both.select("a", "b", "an", "bn", "abins", "bbins").mapInArrow(lean(_screen(num, den)), "a bigint, b bigint"))


class Counts:
    """Counts of slots: a byte each, and what goes beyond apart."""

    def __init__(self, n: int):
        self.low = np.zeros(n, np.uint8)
        self.high: dict[int, int] = {}

    def add(self, slots: np.ndarray) -> None:
        slot, times = np.unique(slots, return_counts=True)
        slot = slot.astype(np.int64)
        times += self.low[slot]
        self.low[slot] = times & 255
        for k in np.flatnonzero(times > 255).tolist():
            self.high[int(slot[k])] = self.high.get(int(slot[k]), 0) + (int(times[k]) >> 8 << 8)

    def some(self, lo: int, hi: int) -> np.ndarray:
        """Of the slots from lo to hi, in as few bytes as they need."""
        out = self.low[lo:hi].astype(np.int64)
        if self.high:
            if not hasattr(self, "slots"):
                self.slots = np.array(sorted(self.high), np.int64)
            for slot in self.slots[slice(*np.searchsorted(self.slots, [lo, hi]))].tolist():
                out[slot - lo] += self.high[slot]
        return out.astype(np.min_scalar_type(out.max()))


def _survey(n: int, bits: int):
    """Per document its size and digest, and per task its share of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(1 << bits)
        for batch in batches:
            size, key, fine = [], [], []
            for lo, hi, g, edge in _sets(batch.column("text"), n):
                counts.add(g >> np.uint64(64 - bits))
                size += np.diff(edge).tolist()
                key += [_digest(g[a:b]) if b > a else None for a, b in zip(edge[:-1], edge[1:])]
                fine += [fine_bins(g[a:b]).tobytes() if b > a else None for a, b in zip(edge[:-1], edge[1:])]
            none = [None] * len(size)
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(fine, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], ["did", "n", "key", "bins", "part", "counts"])
        if counts.low.any() or counts.high:
            parts = min(SKETCH_PARTS, 1 << bits)
            none = [None] * parts
            blocks = [pack(counts.some(k * ((1 << bits) // parts), (k + 1) * ((1 << bits) // parts))) for k in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.binary()), pa.array(range(parts), pa.int32()), pa.array(blocks, pa.binary())], ["did", "n", "key", "bins", "part", "counts"])

    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: as they are up to 64, above by their logarithm."""
    return np.where(counts <= 64, counts, np.minimum(64 + 4 * np.log2(np.maximum(counts, 1) / 64), 255)).astype(np.uint8)


def _sum_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("counts")):
            own = unpack(block.as_py())[0].astype(np.int64)
            sums[part] = sums[part] + own if part in sums else own
    parts = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([pack(_levels(sums[p])) for p in parts], pa.binary())], ["part", "counts"])


def frequency_sketch(made: DataFrame, bits: int) -> np.ndarray:
    """How often n-grams fall on each slot, over all documents, as levels: 16 MB at most."""
    fed = made.where("counts is not null").select("part", "counts")
    summed = fed.repartition(min(SKETCH_PARTS, partitions(made.sparkSession)), "part").mapInArrow(lean(_sum_sketch), "part int, counts binary")
    out = np.zeros((min(SKETCH_PARTS, 1 << bits), (1 << bits) // min(SKETCH_PARTS, 1 << bits)), np.uint8)
    for row in summed.collect():
        out[row["part"]] = unpack(row["counts"])[0]
    return out.reshape(-1)


def packed_entries(gram: np.ndarray, node: np.ndarray, size: np.ndarray, pos: np.ndarray, bins: np.ndarray) -> bytes:
    """Entries by node as one block in which a node's name, size and bins stand once. Of an n-gram the level and 32 bits of hash are kept: two that look alike in one part only make a pair more to compare."""
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    count = np.diff(np.append(first, len(node)))
    return pack((gram >> np.uint64(56)).astype(np.uint8), (gram >> np.uint64(24)).astype(np.uint32), pos.astype(np.int32), count.astype(np.uint16 if count.max() < 65536 else np.int32), node[first], size[first].astype(np.int32), bins[first].T.reshape(-1))


def unpacked_entries(block: bytes) -> tuple[np.ndarray, ...]:
    """Grams, places, the number of each entry's node; and of nodes names, sizes and bins."""
    level, low, pos, count, node, size, bins = unpack(block)
    return (level.astype(np.uint64) << np.uint64(32)) | low, pos, np.repeat(np.arange(len(node)), count), node, size, bins.reshape(-1, len(node)).T


def _deal(shared, n: int, bits: int, num: int, den: int, half: int, parts: int):
    """The entries of prefixes, by part of the n-grams: n-gram in the global order, node, size, place and bins. A task deals equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        known: set[int] = set()

        def flush(held):
            cols = [np.concatenate([h[k] for h in held]) for k in range(5)]
            part = (mix(cols[0]) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((cols[1], part))
            part, cols = part[order], [c[order] for c in cols]
            edge = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(edge[1:] > edge[:-1])
            blocks = []
            for a, b in zip(edge[some], edge[some + 1]):
                blocks.append(packed_entries(*(c[a:b] for c in cols)))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

        held, count = [], 0
        for batch in batches:
            for lo, hi, g, edge in _sets(batch.column("text"), n):
                size = np.diff(edge)
                row = np.repeat(np.arange(hi - lo), size)
                place = (levels[(g >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (g >> np.uint64(8))
                ranked = _sorted_sets(place, row.astype(np.int32), hi - lo)
                at = np.arange(len(g)) - np.repeat(edge[:-1], size)
                nodes = np.array([_node(_digest(g[a:b]), half) if b > a else 0 for a, b in zip(edge[:-1], edge[1:])], np.int64)
                if len(known) > 200_000:
                    known.clear()
                fresh = np.zeros(hi - lo, bool)
                for k, (node, m) in enumerate(zip(nodes.tolist(), size.tolist())):
                    if m and node not in known:
                        known.add(node)
                        fresh[k] = True
                bins = np.bincount(row * BINS + (g & np.uint64(BINS - 1)).astype(np.int64), minlength=(hi - lo) * BINS).reshape(-1, BINS)
                bins = np.minimum(bins, 255).astype(np.uint8)
                take = (at < (size - (num * size + den - 1) // den + 1)[row]) & fresh[row]
                r = row[take]
                held.append((place[ranked][take], nodes[r], size[r].astype(np.int32), at[take].astype(np.int32), bins[r]))
                count += len(r)
                if count > 500_000:
                    yield flush(held)
                    held, count = [], 0
        if count:
            yield flush(held)

    return run


def _near(a, b, size, pos, bins, num: int, den: int) -> np.ndarray:
    """Which pairs of entries of one n-gram can overlap enough, by their sizes, places and bins."""
    x, y, i, j = size[a].astype(np.int64), size[b].astype(np.int64), pos[a], pos[b]
    need = -(-num * (x + y) // (num + den))
    ok = np.flatnonzero((np.minimum(i, j) + 1 + np.minimum(x - i - 1, y - j - 1) >= need) & (np.minimum(x, y) * den >= np.maximum(x, y) * num))
    out = np.zeros(len(a), bool)
    for lo in range(0, len(ok), 1 << 18):
        k = ok[lo : lo + (1 << 18)]
        apart = np.abs(bins[a[k]].astype(np.int16) - bins[b[k]]).sum(axis=1)
        out[k] = apart <= x[k] + y[k] - 2 * need[k]
    return out


def _hubs(gram: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """For entries by n-gram and size, the first of each n-gram, and again the first that its hub's size is too small for."""
    n = len(gram)
    hub = np.zeros(n, np.int64)
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    hub[start] = start
    hub = np.maximum.accumulate(hub)
    while True:
        far = size[hub].astype(np.int64) * den < size.astype(np.int64) * num
        if not far.any():
            return hub
        at = np.flatnonzero(far)
        first = at[np.concatenate([[True], gram[at[1:]] != gram[at[:-1]]])]
        new = np.zeros(n, np.int64)
        new[first] = first
        hub = np.where(far, np.maximum.accumulate(new), hub)


def _unique_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _entries(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram, node, size, place, and where in the bins; bins apart."""
    parts, base = [], 0
    for block in blocks:
        gram, pos, row, node, size, bins = unpacked_entries(block)
        parts.append((gram, node[row], size[row], pos, row + base, bins))
        base += len(node)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _some_near(gram: np.ndarray, size: np.ndarray, pos: np.ndarray, bins: np.ndarray, num: int, den: int, apart: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """Which entries can be similar to another one of their n-gram that differs from them in each of `apart`. In groups of over SMALL entries, all are held to,
    if they differ at all."""
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    count = np.diff(np.append(start, len(gram)))
    of = np.repeat(count, count)
    out = of > SMALL
    live = np.flatnonzero(~out)
    for kind in apart:
        out &= np.repeat(np.minimum.reduceat(kind, start) != np.maximum.reduceat(kind, start), count)
    stop = np.repeat(start + count, count)
    for lag in range(1, SMALL):
        live = live[live + lag < stop[live]]
        if not len(live):
            break
        a = live[~(out[live] & out[live + lag])]
        for kind in apart:
            a = a[kind[a] != kind[a + lag]]
        a = a[_near(a, a + lag, size, pos, bins, num, den)]
        out[a] = out[a + lag] = True
    return out


def _groups(num: int, den: int):
    """Rows come sorted by part. Of each part the n-grams that several nodes have in their prefixes, packed, and the pairs with their hubs that can be similar."""

    def done(part: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        gram, node, size, pos, row, bins = _entries(blocks)
        order = np.lexsort((node, size, gram))
        same = (gram[order][1:] == gram[order][:-1]) & (node[order][1:] == node[order][:-1])
        order = order[np.concatenate([[True], ~same])]
        g = gram[order]
        twin = np.zeros(len(g), bool)
        twin[1:] |= g[1:] == g[:-1]
        twin[:-1] |= g[1:] == g[:-1]
        order = order[twin]
        if not len(order):
            return
        gram, node, size, pos, bins = gram[order], node[order], size[order], pos[order], bins[row[order]]
        kept = _some_near(gram, size, pos, bins, num, den)
        gram, node, size, pos, bins = gram[kept], node[kept], size[kept], pos[kept], bins[kept]
        if not len(gram):
            return
        hub, own = _hubs(gram, size, num, den), np.arange(len(gram))
        far = own != hub
        own, hub = own[far], hub[far]
        ok = _near(hub, own, size, pos, bins, num, den)
        a, b = _unique_pairs(node[hub[ok]], node[own[ok]])
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(a), pa.int32()), pa.array(a), pa.array(b), pa.array([None] * len(a), pa.binary())], ["part", "a", "b", "block"])
        order = np.argsort(node, kind="stable")
        block = packed_entries(gram[order] << np.uint64(24), node[order], size[order], pos[order], bins[order])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([block], pa.binary())], ["part", "a", "b", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                if part != now:
                    if held:
                        yield from done(now, held)
                    now, held = part, []
                held.append(block)
        if held:
            yield from done(now, held)

    return run


class Trie:
    """Ordered sets as a trie with compressed paths. Nodes hold a run of n-grams each."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(x) for x in sets])
        grams, flat = np.unique(np.concatenate(sets), return_inverse=True)
        edge = np.concatenate([[0], np.cumsum(size)])
        self.kinds = len(grams)
        self.sets = [flat[a:b] for a, b in zip(edge, edge[1:])]
        self.size = size
        order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        begin, end, parent, owner = [0], [0], [-1], [order[0]]  # the root is empty
        leaf = {}
        path = [0]
        before = None
        for i in order:
            own = self.sets[i]
            common = 0
            if before is not None:
                m = min(len(before), len(own))
                differ = np.flatnonzero(before[:m] != own[:m])
                common = int(differ[0]) if len(differ) else m
            while len(path) > 1 and begin[path[-1]] >= common:
                last = path.pop()
            if end[path[-1]] > common:  # the run parts here
                k = path[-1]
                begin.append(begin[k])
                end.append(common)
                parent.append(parent[k])
                owner.append(owner[k])
                begin[k], parent[k] = common, len(begin) - 1
                path[-1] = len(begin) - 1
            begin.append(common)
            end.append(len(own))
            parent.append(path[-1])
            owner.append(i)
            leaf[len(begin) - 1] = i
            path.append(len(begin) - 1)
            before = own
        n = len(begin)
        level = [-1] * n
        level[0] = 0
        for k in range(n):
            up = []
            while level[k] < 0:
                up.append(k)
                k = parent[k]
            for j in reversed(up):
                level[j] = level[parent[j]] + 1
        self.parent, level = np.array(parent), np.array(level)
        self.leaf = np.full(n, -1)
        self.leaf[list(leaf)] = list(leaf.values())
        least, most = np.full(n, 1 << 60), np.zeros(n, np.int64)
        for k, i in leaf.items():
            least[k] = most[k] = size[i]
        by_level = [np.flatnonzero(level == d) for d in range(int(level.max()) + 1)]
        for nodes in reversed(by_level[1:]):
            np.minimum.at(least, self.parent[nodes], least[nodes])
            np.maximum.at(most, self.parent[nodes], most[nodes])
        self.least, self.most, self.levels = least, most, by_level[1:]
        begin, end = np.array(begin), np.array(end)
        self.end = end
        run = end - begin
        self.stop = np.cumsum(run)
        start = edge[np.array(owner)] + begin
        self.runs = flat[np.arange(int(run.sum())) - np.repeat(self.stop - run - start, run)]
        # the last n-gram on the way to a node
        self.last = np.full(n, -1)
        self.last[run > 0] = self.runs[self.stop[run > 0] - 1]
        for nodes in self.levels:
            self.last[nodes] = np.where(run[nodes] > 0, self.last[nodes], self.last[self.parent[nodes]])

    def similar(self, i: int, num: int, den: int) -> np.ndarray:
        """The sets that overlap the i-th enough, itself among them."""
        x, m = self.sets[i], int(self.size[i])
        hit = np.zeros(self.kinds + 1, bool)
        hit[x] = True
        upto = np.concatenate([np.cumsum(hit[:-1]), [0]])  # the last one stands for no n-gram
        hits = np.concatenate([[0], np.cumsum(hit[self.runs])])
        gain = hits[self.stop] - hits[np.concatenate([[0], self.stop[:-1]])]
        overlap, alive = np.zeros(len(gain), np.int64), np.zeros(len(gain), bool)
        alive[0] = True
        out = []
        for nodes in self.levels:
            nodes = nodes[alive[self.parent[nodes]]]
            if not len(nodes):
                break
            overlap[nodes] = overlap[self.parent[nodes]] + gain[nodes]
            left = np.minimum(self.most[nodes] - self.end[nodes], m - upto[self.last[nodes]])
            need = -(-num * (m + self.least[nodes]) // (num + den))
            nodes = nodes[overlap[nodes] + left >= need]
            alive[nodes] = True
            found = nodes[self.leaf[nodes] >= 0]
            out.append(self.leaf[found[overlap[found] * (num + den) >= num * (m + self.size[self.leaf[found]])]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def block_links(sets: list[np.ndarray], num: int, den: int, ask: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets of a block as all links between them do, or as all links of the sets `ask` do."""
    trie, group, links = Trie(sets), np.arange(len(sets)), []
    for i in range(len(sets)) if ask is None else ask:
        if (group == group[i]).all():
            if ask is None:
                break
            continue
        for j in trie.similar(i, num, den).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                links.append((i, j))
    return links


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], ["u", "v"])


def _blocks(num: int, den: int, asking: bool):
    """Rows come sorted by (head, block). With `asking`, only links of the rows that ask count; else all of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asks = None, {}, set()

        def done() -> list[tuple[int, int]]:
            ids = list(held)
            if len(ids) < 2 or asking and not asks:
                return []
            return [(ids[i], ids[j]) for i, j in block_links(list(held.values()), num, den, [k for k, x in enumerate(ids) if x in asks] if asking else None)]

        for batch in batches:
            links = []
            for head, block, node, ask, grams in zip(*(batch.column(c).to_pylist() for c in ("head", "block", "node", "ask", "grams"))):
                if (head, block) != now:
                    links += done()
                    now, held, asks = (head, block), {}, set()
                held[node] = np.frombuffer(grams, np.uint64)
                if ask:
                    asks.add(node)
            if links:
                yield _link_batch(links)
        links = done()
        if links:
            yield _link_batch(links)

    return run


def _small(table: DataFrame) -> DataFrame:
    """A staged table, to be broadcast where it has few rows: files of few rows each look larger to Spark than they are."""
    return F.broadcast(table) if table.count() <= AT_ONCE else table


def _linked(asked: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int, half: int, asking: bool) -> DataFrame:
    """Links inside blocks. asked: head, block, node, ask. The sets go to their blocks from where they are made, if the rows that tell the blocks are few enough to broadcast."""
    spark = docs.sparkSession
    asked = staged(asked)
    told = F.broadcast(asked) if asked.count() <= FEW else asked
    sets = _sets_of(told.select(F.col("node").alias("w")), reps, docs, n, half)
    rows = sets.join(told, F.col("id") == F.col("node")).select("head", "block", "node", "ask", "grams")
    return staged(rows.repartition(partitions(spark), "head", "block").sortWithinPartitions("head", "block", "node").mapInArrow(lean(_blocks(num, den, asking)), "u bigint, v bigint"))


def _full_sets(n: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, g, edge in _sets(batch.column("text"), n):
                some = np.flatnonzero(edge[1:] > edge[:-1])
                out = [g[edge[k] : edge[k + 1]] for k in some]
                yield pa.RecordBatch.from_arrays([pa.array([_node(_digest(x), half) for x in out], pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())], ["id", "grams"])

    return run


def _sets_of(wanted: DataFrame, reps: DataFrame, docs: DataFrame, n: int, half: int) -> DataFrame:
    """Rows (id, grams) of the nodes `wanted` (w). A document that shares its id with others may bring sets that nothing asks for."""
    ids = staged(reps.join(wanted, F.col("w") == F.col("node"), "left_semi").select(F.col("rep").alias("r")))
    few = F.broadcast(ids) if ids.count() <= FEW else ids
    return docs.select("did", "text").join(few, F.col("did") == F.col("r"), "left_semi").mapInArrow(lean(_full_sets(n, half)), "id bigint, grams binary")


def _asks(parts: int):
    """Of packed groups: the nodes whose names each part asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                own = unpacked_entries(block)[3]
                to = (mix(own.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                some = np.unique(to)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([pack(own[to == q]) for q in some], pa.binary())], ["q", "part", "ids"])

    return run


def _listed(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b.as_py(), np.uint8) for b in column]


def _with_bins(cols: list[np.ndarray], bins: list[np.ndarray], some: np.ndarray) -> bytes:
    """Columns and the bins of some rows, one behind another, as one block."""
    own = [bins[k] for k in some]
    return pack(*cols, np.array([len(b) for b in own], np.int32), np.concatenate(own) if own else np.zeros(0, np.uint8))


def _split_bins(block: list[np.ndarray]) -> list[np.ndarray]:
    *_, size, flat = block
    ends = np.cumsum(size)
    return [flat[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]


def _named(parts: int):
    """Of rows (id, component, block, bins): packed, by share of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in ("id", "component", "block")]
            bins = _listed(batch.column("bins"))
            to = (mix(cols[0].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            some = np.unique(to)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([None] * len(some), pa.int32()), pa.array([_with_bins([c[to == q] for c in cols], bins, np.flatnonzero(to == q)) for q in some], pa.binary())], ["q", "part", "ids"])

    return run


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by share, names before asks: answers to parts."""
    now, held, table = None, [], None
    for batch in batches:
        out = []
        for q, part, block in zip(*(batch.column(c).to_pylist() for c in ("q", "part", "ids"))):
            if q != now:
                now, held, table = q, [], None
            if part is None:
                held.append(unpack(block))
                continue
            if table is None:
                table = [np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(3)]
                bins = [x for h in held for x in _split_bins(h)]
                by = np.argsort(table[0])
                table, held = [c[by] for c in table], []
            own = unpack(block)[0]
            at = by[np.searchsorted(table[0], own)]
            back = np.searchsorted(table[0], own)
            out.append((part, _with_bins([own, table[1][back], table[2][back]], bins, at)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["part", "names"])


class Forest:
    """Which of n things hang together. Links of things that do already are turned away."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def settle(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def join(self, x: int, y: int) -> bool:
        root = self.root
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
        return x != y


def cross_pairs(gram, own, size, pos, bins, comp, block, num: int, den: int, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (as numbers of their nodes, `own`) of one n-gram that can be similar, of different components and blocks, and that do not hang together in the
    forest. Entries come by n-gram and size. Only what is outside an n-gram's largest component meets all others."""
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    stop = np.append(start[1:], len(gram))
    which = np.repeat(np.arange(len(start)), stop - start)
    order = np.lexsort((comp, which))
    new = np.concatenate([[True], (which[order][1:] != which[order][:-1]) | (comp[order][1:] != comp[order][:-1])])
    heads = np.flatnonzero(new)
    times, of = np.diff(np.append(heads, len(order))), which[order][heads]
    by = np.lexsort((times, of))
    largest = np.zeros(len(start), np.int64)
    largest[of[by]] = comp[order][heads[by]]
    rest = np.flatnonzero(comp != largest[which])
    span = (stop - start)[which[rest]]
    cut = np.concatenate([[0], np.cumsum(span)])
    lo = 0
    while lo < len(rest):
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + (1 << 17), side="right")) - 1)
        a = np.repeat(rest[lo:hi], span[lo:hi])
        b = np.arange(len(a)) - np.repeat(cut[lo:hi] - cut[lo] - start[which[rest[lo:hi]]], span[lo:hi])
        # a pair of two outside the largest is met twice: once is enough
        ok = np.flatnonzero((comp[a] != comp[b]) & (block[a] != block[b]) & ((comp[b] == largest[which[a]]) | (a < b)) & (forest.root[own[a]] != forest.root[own[b]]))
        a, b = a[ok], b[ok]
        ok = _near(a, b, size, pos, bins, num, den)
        if ok.any():
            yield _unique_pairs(own[a[ok]], own[b[ok]])
            forest.settle()
        lo = hi


def spanning_pairs(entry, sizes, fine, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that connect nodes as all pairs do that `cross_pairs` finds without a forest and that have room by their fine bins: fewer than there are nodes."""
    forest, out = Forest(len(sizes)), []
    for a, b in cross_pairs(*entry, num, den, forest):
        for x, y in zip(a.tolist(), b.tolist()):
            if forest.root[x] != forest.root[y] and room(int(sizes[x]), int(sizes[y]), fine[x], fine[y], num, den) and forest.join(x, y):
                out.append((x, y))
    return out


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows come sorted by part, names before its groups. Of each part its number, entries by n-gram and size as `cross_pairs` takes them, and of its nodes names, sizes and fine bins."""
    now, held = None, []
    for batch in batches:
        for part, names, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "names", "block"))):
            if part != now:
                now, held = part, []
            if names is not None:
                held.append(unpack(names))
                continue
            gram, pos, back, own, size, bins = unpacked_entries(packed)
            comp, block, fine = own.copy(), own.copy(), [None] * len(own)
            for h in held:
                at = np.searchsorted(own, h[0])
                comp[at], block[at] = h[1], h[2]
                for k, x in zip(at.tolist(), _split_bins(h)):
                    fine[k] = x
            entry = [gram, back, size[back], pos, bins[back], comp[back], block[back]]
            by = np.lexsort((own[back], entry[2], gram))
            held = []
            yield part, [c[by] for c in entry], own, size, fine


def open_entries(entry, num: int, den: int) -> np.ndarray:
    """Which entries `cross_pairs` may find a pair for."""
    gram, _, size, pos, bins, comp, block = entry
    return _some_near(gram, size, pos, bins, num, den, (comp, block))


def _opened(num: int, den: int):
    """Of each part what is still open, packed: only the nodes of that need their fine bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, entry, own, _, _ in _answered(batches):
            some = np.flatnonzero(open_entries(entry, num, den))
            if len(some):
                gram, back, size, pos, bins = (c[some] for c in entry[:5])
                by = np.argsort(own[back], kind="stable")
                block = packed_entries(gram[by] << np.uint64(24), own[back][by], size[by], pos[by], bins[by])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.binary())], ["part", "block"])

    return run


def _across(num: int, den: int):
    """Of each part the pairs that tie what can be similar, no more than it has nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, entry, own, size, fine in _answered(batches):
            pairs = np.array(spanning_pairs(entry, size, fine, num, den), np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(own[pairs[:, 0]]), pa.array(own[pairs[:, 1]])], ["a", "b"])

    return run


def _with_answers(packed: DataFrame, names: DataFrame, parts: int) -> DataFrame:
    """Packed groups by part, behind what `names` (id, component, block, bins) tells of their nodes."""
    asks = packed.mapInArrow(lean(_asks(parts)), "q int, part int, ids binary").unionByName(names.mapInArrow(lean(_named(parts)), "q int, part int, ids binary"))
    answers = asks.repartition(parts, "q").sortWithinPartitions("q", F.col("part").isNotNull()).mapInArrow(lean(_name), "part int, names binary")
    both = answers.unionByName(packed, allowMissingColumns=True).repartition(parts, "part").sortWithinPartitions("part", F.col("names").isNull())
    return both.select("part", "names", "block")


def _count(nodes, size):
    """How many blocks so many nodes make whose sets have so many n-grams."""
    return F.greatest(F.ceil(nodes / BLOCK), F.ceil(size / BLOCK_GRAMS)).cast("int")


def _group_links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, num: int, den: int, half: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links inside the groups that the pairs make, with those known before; and rows (id, head) of their nodes. Groups of several blocks are dealt twice by
    different hashes, so what one dealing parts the other may tie; what is then outside the largest component of its group meets the whole group, block by block."""
    groups = staged(components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), AT_ONCE).join(reps.select("node", "n"), F.col("node") == F.col("id")).select("id", F.col("component").alias("head"), "n"))
    blocks = staged(groups.groupBy(F.col("head").alias("bh")).agg(_count(F.count("*"), F.sum("n")).alias("blocks")))
    dealt = groups.join(_small(blocks), F.col("bh") == F.col("head")).select("id", "head", "n", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    again = dealt.where("blocks > 1").select("id", "head", "n", "blocks", (F.col("blocks") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))).cast("int").alias("block"))
    asked = dealt.unionByName(again).select("head", "block", F.col("id").alias("node"), F.lit(False).alias("ask"))
    links = _linked(asked, reps, docs, n, num, den, half, False)
    if known is not None:
        links = links.unionByName(known)
    of_node = groups.select("id", "head")
    large = dealt.where("blocks > 1")
    if not blocks.where("blocks > 1").take(1):
        return links, of_node
    comps = staged(components(links, AT_ONCE))
    named = staged(large.join(_small(comps).withColumnRenamed("id", "cid"), F.col("cid") == F.col("id"), "left").select("id", "head", "n", "blocks", "block", F.coalesce("component", "id").alias("c")))
    most = named.groupBy(F.col("head").alias("mh"), "c").agg(F.count("*").alias("k")).groupBy("mh").agg(F.max_by("c", F.struct("k", "c")).alias("largest"))
    rest = staged(named.join(most, F.col("mh") == F.col("head")).where("c <> largest").select("id", "head", "n", "blocks"))
    shares = staged(rest.groupBy(F.col("head").alias("sh")).agg(_count(F.count("*"), F.sum("n")).alias("shares")))
    cell = lambda row, column: (F.col(row) * F.col("shares") + F.col(column)).cast("int").alias("block")
    share = F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share")
    asks = rest.join(_small(shares), F.col("sh") == F.col("head")).select("id", "head", "shares", share, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    others = named.join(_small(shares), F.col("sh") == F.col("head")).select("id", "head", "shares", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    both = asks.select("head", cell("own", "share"), F.col("id").alias("node"), F.lit(True).alias("ask")).unionByName(others.select("head", cell("own", "share"), F.col("id").alias("node"), F.lit(False).alias("ask")))
    more = _linked(both, reps, docs, n, num, den, half, True)
    return staged(links.unionByName(more)), of_node


def similar_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (did, n, component): documents with the size of their set and the least id of their class, where sets x and y link when den * |x & y| >= num * |x | y|. docs: did, text."""
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max(int(size // SLOT_BYTES).bit_length(), LEAST_BITS), MOST_BITS)
    made = staged(docs.select("did", "text").mapInArrow(lean(_survey(n, bits)), "did bigint, n bigint, key binary, bins binary, part int, counts binary"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(made, bits))
    sets = made.where("key is not null").groupBy("key").agg(F.min("did").alias("rep"), F.first("n").alias("n"), F.first("bins").alias("bins"))
    sets = staged(sets)
    half = 0 if sets.count() == sets.select(_node_of("key", 0).alias("node")).distinct().count() else 1
    if half and sets.count() != sets.select(_node_of("key", 1).alias("node")).distinct().count():
        raise ValueError("both halves of the digest name two sets alike")
    reps = sets.select("key", "rep", "n", "bins", _node_of("key", half).alias("node"))
    dealt = docs.select("text").mapInArrow(lean(_deal(sketch, n, bits, num, den, half, parts)), "part int, block binary")
    groups = staged(dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(_groups(num, den)), "part int, a bigint, b bigint, block binary"))
    pairs = _screened(groups.where("a is not null").select("a", "b").distinct(), reps, num, den)
    links, blocks = _group_links(pairs, reps, docs, n, num, den, half)
    comps = staged(components(links, AT_ONCE))
    linked = blocks.join(_small(comps).withColumnRenamed("id", "cid"), F.col("cid") == F.col("id"), "left").select("id", F.coalesce("component", "id").alias("component"), F.col("head").alias("block"))
    linked = F.broadcast(linked) if blocks.count() <= AT_ONCE else linked
    names = staged(reps.select("node", "bins").join(linked, F.col("id") == F.col("node"), "left").select(F.col("node").alias("id"), F.coalesce("component", "node").alias("component"), F.coalesce("block", "node").alias("block"), "bins"))
    packed = groups.where("block is not null").select("part", "block")
    plain = names.withColumn("bins", F.lit(b""))
    still = staged(_with_answers(packed, plain, parts).mapInArrow(lean(_opened(num, den)), "part int, block binary"))
    late = staged(_with_answers(still, names, parts).mapInArrow(lean(_across(num, den)), "a bigint, b bigint"))
    if late.take(1):
        more, _ = _group_links(late, reps, docs, n, num, den, half, links)
        comps = staged(components(more, AT_ONCE))
    # a class is named by the least document id of its sets
    named = reps.join(_small(comps), F.col("id") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "node").alias("c"))
    named = staged(named)
    least = named.groupBy(F.col("c").alias("lc")).agg(F.min("rep").alias("component"))
    of_key = staged(named.join(least, F.col("lc") == F.col("c")).select(F.col("key").alias("rk"), "component"))
    keyed = made.where("counts is null").select("did", "n", "key")
    # rows that share an id are one document: they tie the classes of their sets
    twice = keyed.where("key is not null").groupBy("did").agg(F.countDistinct("key").alias("k")).where("k > 1").select(F.col("did").alias("td"))
    ties = staged(keyed.join(twice, F.col("td") == F.col("did"), "left_semi").join(of_key, F.col("rk") == F.col("key")).select(F.col("did").alias("u"), F.col("component").alias("v")))
    if ties.take(1):
        tied = staged(components(ties, AT_ONCE))
        of_key = of_key.join(tied, F.col("id") == of_key["component"], "left").select("rk", F.coalesce(tied["component"], of_key["component"]).alias("component"))
    out = keyed.join(of_key, F.col("rk") == F.col("key"), "left").select("did", "n", F.coalesce("component", "did").alias("component"))
    for t in (groups, pairs, blocks, names, still, late):
        dropped(t)
    return out


def _node_of(key: str, half: int):
    """The signed number that `_node` makes of half a digest."""
    digits = F.hex(F.substring(key, 1 + 8 * half, 8))
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def first_documents(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each class of similar ones, that with the least id; columns stay as they are."""
    keyed = docs.select(id_key().alias("did"), "text")
    classes = similar_classes(keyed, n, num, den)
    # those that go are fewer than those that stay: told to where the texts are, they spare a shuffle of the texts
    lost = staged(classes.groupBy("did").agg(F.max(F.col("did") == F.col("component")).alias("first")).where("not first").select(F.col("did").alias("lost_did")))
    told = F.broadcast(lost) if lost.count() <= FEW else lost
    return docs.join(told, F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col("lost_did"), "left_anti")


def op9_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(id_key().alias("did"), "text")
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return similar_classes(docs, 3, 90, 100).select(back("did").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
p AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS i FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2) WHERE 100 * i >= 90 * (na + nb - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT doc_id, len(s) AS n_shingles, m AS component_id FROM g JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) q ON q.a = g.doc_id
"""
