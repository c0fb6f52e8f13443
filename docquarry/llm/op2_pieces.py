"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut at the beginnings of words, which no piece of the model crosses (a model with pieces
that do keeps texts whole). The batch's text, each word once and without those whose ids the worker still holds, is concatenated and
indexed by a suffix array; every piece of the model is looked up by binary search, and its range in the array
holds all places where it occurs: the edges of the words' lattices. Edges sorted by position are then relaxed
from left to right. What a worker holds is bounded in bytes; a word longer than an index is indexed in overlapping parts. A unigram model takes the path of the best score. A byte-pair model takes, at each end, the one edge
whose piece stays apart from the piece before it when the two are merged in the model's order; that
path is what merging the whole word would leave. Characters that no piece covers become byte pieces, or the unknown piece.

Cases: null text has null ids and is decoded to null; empty text has no ids; texts may be of any length;
an empty table gives an empty result; other columns are carried through. Models with a normaliser that changes characters are refused.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of words and ids that a worker keeps, twice: those met lately, and those met before them.
REMEMBERED = 32 << 20
#: Words that are taken together, characters that are indexed at once, and the length from which a word is relaxed by itself.
WORDS, INDEXED, LONG = 400_000, 300_000, 48
#: The answers kept for pairs of pieces.
PAIR_BITS = 21
NEVER = 1 << 60


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """Fields of a protocol buffer message: number, wire type, value."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            byte = data[i]
            i += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, kind, data[i : i + size]
            i += size


class Model:
    """A SentencePiece model: pieces with scores and kinds (1 normal, 2 unknown, 3 control, 4 user, 5 unused, 6 byte)."""

    def __init__(self, data: bytes, merges: bool = True):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.prefix, self.squeeze = 1, True, True
        for number, _, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, _, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                for n, _, v in _fields(value):
                    if n == 3:
                        self.kind = v
            elif number == 3:
                for n, _, v in _fields(value):
                    if n == 2 and v:
                        raise ValueError("models whose normaliser changes characters are not supported")
                    if n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
        if self.kind not in (1, 2):
            raise ValueError("only unigram and byte-pair models are supported")
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0
        self.index = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (1, 4) and p}
        self.words = not any(SPACE in p.lstrip(SPACE) for p in self.index)
        self.value_of = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k in (2, 3) else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.value_of[self.unknown] = b" \xe2\x81\x87 "
        self.time: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        if self.kind == 2 and merges:
            self._merges()
        self.sought = [p for p in self.index if self.kind == 1 or self.index[p] in self.time]
        self.apart: dict[tuple[int, int], bool] = {}

    def _part(self, text: str) -> int | None:
        """The piece's number, or a negative one for a character that is no piece."""
        return self.index.get(text, ~ord(text) if len(text) == 1 else None)

    def _merges(self) -> None:
        """For byte-pair models: when each piece is made and of which two, and which pieces can be made at all."""
        ranked = sorted((i for p, i in self.index.items() if len(p) > 1), key=lambda i: -self.scores[i])
        rank = {i: r for r, i in enumerate(ranked)}
        for p, i in self.index.items():
            if len(p) == 1:
                self.time[i] = -1
        for i in ranked:
            parts = list(self.pieces[i])
            last = None
            while len(parts) > 1:
                best, at = NEVER, -1
                for k in range(len(parts) - 1):
                    r = rank.get(self.index.get(parts[k] + parts[k + 1], -1), NEVER)
                    if r < best:
                        best, at = r, k
                if at < 0:
                    break
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 1:
                self.time[i] = rank[i]
                # a part may be a character that is no piece of its own
                self.split[i] = (self._part(last[0]), self._part(last[1]))
                # every split of the piece's string into two pieces merges to it
        for p, i in self.index.items():
            for k in range(1, len(p)):
                a, b = self._part(p[:k]), self._part(p[k:])
                if a is not None and b is not None:
                    self.merge[a, b] = rank[i]

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' characters in the model's order leaves the two pieces."""
        time, merge, split = self.time, self.merge, self.split
        limit = NEVER
        while True:
            # a and b stand side by side until one of them is taken apart; a merge of the two before that joins them
            made = merge.get((a, b), NEVER)
            if made < limit:
                return False
            ta, tb = time.get(a, -1), time.get(b, -1)
            if ta < 0 and tb < 0:
                return True
            if ta > tb:
                limit = ta
                a = split[a][1]
            else:
                # at equal times the left one is made first
                limit = tb + 1
                b = split[b][0]

    def stays_apart(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 300_000:
                self.apart.clear()
            known = self.apart[key] = self._apart(a, b)
        return known


def suffix_order(w: np.ndarray, depth: int, per: int) -> np.ndarray:
    """Positions in the order of the `depth` characters from each. w: at every position `per` characters as one number, and as many more positions as depth."""
    n = len(w) - depth
    order = np.argsort(w[:n])
    group = np.zeros(n, np.int64)
    active = np.arange(n)
    for d in range(0, depth, per):
        if len(active) < 2:
            break
        pos = order[active]
        key, g = w[pos + d], group[active]
        if d:
            by = np.lexsort((key, g))
            pos, key, g = pos[by], key[by], g[by]
            order[active] = pos
        same = (key[1:] == key[:-1]) & (g[1:] == g[:-1])
        start = np.concatenate([[True], ~same])
        group[active] = active[np.flatnonzero(start)[np.cumsum(start) - 1]]
        tied = np.zeros(len(active), bool)
        tied[1:] |= same
        tied[:-1] |= same
        active = active[tied]
    return order


class Sought:
    """The pieces that are looked up in every index: their characters as numbers, one after another."""

    def __init__(self, pieces: list[str]):
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.longest = int(self.length.max()) if len(pieces) else 1
        flat = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        self.known, self.flat = np.unique(flat, return_inverse=True)
        self.offset = np.cumsum(self.length) - self.length


def occurrences(code: np.ndarray, sought: Sought) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the text where a sought piece occurs, and the piece's number. Zeros in the text are in no piece."""
    here, text = np.unique(code, return_inverse=True)
    # characters of the text that stand in pieces are numbered from 2; 1 stands for all others, 0 for zeros and for the end
    at = np.minimum(np.searchsorted(sought.known, here), len(sought.known) - 1)
    own = (sought.known[at] == here) & (here > 0)
    number = np.where(own, np.cumsum(own) + 1, (here > 0).astype(np.int64)).astype(np.uint64)
    bits = max(2, int(number.max(initial=1)).bit_length())
    per, wide = 64 // bits, np.uint64(bits)
    depth = -(-sought.longest // per) * per
    spaced = np.zeros(len(code) + depth + per, np.uint64)
    spaced[: len(code)] = number[text]
    w = np.zeros(len(code) + depth, np.uint64)
    for k in range(per):
        w = (w << wide) | spaced[k : k + len(w)]
    order = suffix_order(w, depth, per)
    local = np.zeros(len(sought.known), np.uint64)
    local[at[own]] = number[own]
    flat = local[sought.flat]
    which = np.flatnonzero(np.minimum.reduceat(flat, sought.offset) > 0) if len(flat) else np.zeros(0, np.int64)
    length, offset = sought.length[which], sought.offset[which]

    def words(k: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some pieces the k-th number of `per` characters, and the bits of it that lie beyond the piece."""
        key, beyond = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
        for j in range(k * per, k * per + per):
            inside = j < length[some]
            key = (key << wide) | np.where(inside, flat[np.minimum(offset[some] + j, len(flat) - 1)], 0)
            beyond = (beyond << wide) | np.where(inside, 0, (1 << bits) - 1).astype(np.uint64)
        return key, beyond

    key, beyond = words(0, np.arange(len(which)))
    ranked = w[order]
    by = np.argsort(key)
    low, high = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
    low[by] = np.searchsorted(ranked, key[by])
    high[by] = np.searchsorted(ranked, (key | beyond)[by], side="right")
    for k in range(1, depth // per):
        some = np.flatnonzero((length > k * per) & (low < high))
        key, beyond = words(k, some)
        for upper in (False, True):
            lo, hi = low[some], high[some]
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                own = w[order[np.minimum(mid, len(order) - 1)] + k * per]
                right = own <= (key | beyond) if upper else own < key
                lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
            if upper:
                high[some] = lo
            else:
                first = lo
        low[some] = first
    n = high - low
    start = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)]
    return start, np.repeat(which, n)


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        self.ids = np.array([model.index[p] for p in model.sought], np.int64)
        self.sought = Sought(model.sought)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def words_of(self, text: str) -> Iterator[list[str]]:
        """The text's words in lists of a bounded number."""
        m = self.model
        if m.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return
        text = text.replace(" ", SPACE)
        if m.prefix:
            text = SPACE + text
        if not m.words:
            yield [text]
        elif len(text) < WORDS:
            yield self.cut.findall(text)
        else:
            found = (x[0] for x in self.cut.finditer(text))
            while some := list(islice(found, WORDS)):
                yield some

    def learn(self, words: list[str]) -> None:
        """Encodes new words and keeps them."""
        parted: dict[str, list[str]] = {}
        plain = []
        for w in words:
            if "\0" in w:  # the mark between words: such a word is cut there and the mark is a character of no piece
                parted[w] = w.split("\0")
                plain += [x for x in parted[w] if x and x not in self.known]
            else:
                plain.append(w)
        plain = list(dict.fromkeys(plain)) if parted else plain
        held, size = [], 0
        for w in plain:
            if len(w) > INDEXED:
                self._keep(w, self._alone(w, self._windows(w)))
                continue
            held.append(w)
            size += len(w) + 1
            if size > INDEXED:
                self._learn(held)
                held, size = [], 0
        if held:
            self._learn(held)
        nul = np.array(self._spelled("\0"), np.int32).tobytes()
        for w, parts in parted.items():
            self._keep(w, nul.join(self.known[part] for part in parts))

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.held += 200 + len(word) + len(ids)

    def _spelled(self, char: str) -> list[int]:
        m = self.model
        if len(m.bytes_at) == 256:
            return [m.bytes_at[b] for b in char.encode("utf-8", "surrogatepass")]
        return [m.unknown]

    def _learn(self, words: list[str]) -> None:
        code = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), "<u4")
        size = np.array([len(w) for w in words])
        base = np.cumsum(size + 1) - size - 1
        start, which = occurrences(code, self.sought)
        owner = np.repeat(np.arange(len(words)), size + 1)[start]
        length = self.sought.length[which]
        ids = self.ids[which]
        place = start + length - base[owner]
        short = size < (LONG if self.model.kind == 2 else 0)
        pick = short[owner]
        if pick.any() or short.any():
            self._together(words, code, size, base, short, place[pick], owner[pick], length[pick], ids[pick])
        alone = np.flatnonzero(~short)
        if not len(alone):
            return
        place, owner, length, ids = (x[~pick] for x in (place, owner, length, ids))
        by = np.lexsort((-length, place, owner))
        place, owner, length, ids = place[by], owner[by], length[by], ids[by]
        edge = np.searchsorted(owner, alone), np.searchsorted(owner, alone, side="right")
        for k, lo, hi in zip(alone.tolist(), *edge):
            self._keep(words[k], self._alone(words[k], [(place[lo:hi] - length[lo:hi], place[lo:hi], ids[lo:hi])]))

    def _windows(self, word: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The edges of a word that is too long for one index, by end, from overlapping parts of it."""
        code = np.frombuffer(word.encode("utf-32-le"), "<u4")
        for lo in range(0, len(code), INDEXED):
            begin = max(0, lo - self.sought.longest)
            start, which = occurrences(code[begin : lo + INDEXED], self.sought)
            end = start + self.sought.length[which] + begin
            pick = end > lo
            start, end, ids = start[pick] + begin, end[pick], self.ids[which[pick]]
            by = np.lexsort((start, end))
            yield start[by], end[by], ids[by]

    def _together(self, words, code, size, base, short, place, owner, length, ids) -> None:
        """Relaxes the edges of many words of a byte-pair model, one end after another in all of them."""
        # by end within the word, then word, then the longest first; all of it in one number
        key = np.sort((place << 48) | (owner << 28) | ((63 - length) << 22) | ids)
        last = np.full(len(code) + 1, -1, np.int64)
        last[1:] = ~code.astype(np.int64)  # a character of no piece stands for itself
        back = np.arange(-1, len(code))
        steps = np.searchsorted(key, np.arange(1, LONG + 1) << 48)
        for i, (lo, hi) in enumerate(zip(steps, steps[1:]), 1):
            if lo == hi:
                continue
            own = key[lo:hi]
            word, own_length, piece = (own >> 28) & 0xFFFFF, 63 - ((own >> 22) & 63), own & 0x3FFFFF
            begin = base[word] + (i - own_length)
            ok = own_length == i
            ask = np.flatnonzero(~ok)
            ok[ask] = self._all_apart(last[begin[ask]], piece[ask])
            good = np.flatnonzero(ok)
            if len(good):
                good = good[np.concatenate([[True], word[good[1:]] != word[good[:-1]]])]
                end = base[word[good]] + i
                last[end] = piece[good]
                back[end] = begin[good]
        some = np.flatnonzero(short)
        now = base[some] + size[some]
        taken, of = [], []
        live = np.arange(len(some))
        while len(live):
            taken.append(last[now[live]])
            of.append(live)
            now[live] = back[now[live]]
            live = live[now[live] > base[some[live]]]
        flat = np.concatenate(taken[::-1])
        word = np.concatenate(of[::-1])
        order = np.argsort(word, kind="stable")
        flat, word = flat[order], word[order]
        edge = np.searchsorted(word, np.arange(len(some) + 1))
        odd = np.zeros(len(some), bool)
        odd[word[flat < 0]] = True
        raw = flat.astype(np.int32).tobytes()
        known = self.known
        for k, is_odd, lo, hi in zip(some.tolist(), odd.tolist(), (4 * edge[:-1]).tolist(), (4 * edge[1:]).tolist()):
            known[words[k]] = self._spelled_out(flat[lo // 4 : hi // 4].tolist()) if is_odd else raw[lo:hi]
        self.held += 200 * len(some) + int(size[some].sum()) + len(raw)

    def _spelled_out(self, found: list[int]) -> bytes:
        out: list[int] = []
        for t in found:
            out += self._spelled(chr(~t)) if t < 0 else (t,)
        return np.array(out, np.int32).tobytes()

    def _all_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """stays_apart for many pairs, by a table of fixed size with one place for each pair."""
        pair = ((left + (1 << 21)) << 22) | right
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        kept = self.pairs[slot]
        out = (kept & 1) == 1
        ask = np.flatnonzero(kept >> 1 != pair)
        if len(ask):
            new, back = np.unique(pair[ask], return_inverse=True)
            apart = self.model._apart
            found = np.array([apart((k >> 22) - (1 << 21), k & 0x3FFFFF) for k in new.tolist()], bool)
            out[ask] = found[back]
            self.pairs[slot[ask]] = (pair[ask] << 1) | out[ask]
        return out

    def _alone(self, word: str, edges: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> bytes:
        """Relaxes the edges of one word, which come by end, the longest first."""
        pairwise, scores, check = self.model.kind == 2, self.model.scores, self.model.stays_apart
        size, i = len(word), 0
        floor = min(scores, default=0.0) - 10.0
        last, back, best = array("i", bytes(4 * size + 4)), array("i", bytes(4 * size + 4)), array("d", bytes(8 * size + 8) if not pairwise else b"")
        for start, end, ids in chain(edges, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]):
            start, end, ids = start.tolist(), end.tolist(), ids.tolist()
            e, n = 0, len(end)
            until = end[-1] if n else i
            for i in range(i + 1, (size if not n else until) + 1):
                chosen, top = None, -1e300
                while e < n and end[e] == i:
                    s, t = start[e], ids[e]
                    e += 1
                    if pairwise:
                        if chosen is None and (s == 0 or check(last[s], t)):
                            chosen = (s, t)
                    else:
                        v = best[s] + scores[t]
                        if v > top:
                            top, chosen = v, (s, t)
                if pairwise:
                    if chosen is None:
                        chosen = (i - 1, ~ord(word[i - 1]))
                else:
                    if chosen is None or best[i - 1] + floor > top:
                        chosen, top = (i - 1, ~ord(word[i - 1])), best[i - 1] + floor
                    best[i] = top
                back[i], last[i] = chosen
        found = array("i")
        i = size
        while i:
            found.append(last[i])
            i = back[i]
        found.reverse()
        return found.tobytes() if min(found, default=0) >= 0 else self._spelled_out(found)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out: list[list[bytes] | None] = [None if t is None else [] for t in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, t in enumerate(texts):
            for words in self.words_of(t) if t else ():
                held.append((k, words))
                size += len(words)
                if size >= WORDS:
                    self._fill(held, out)
                    held, size = [], 0
        self._fill(held, out)
        return [None if o is None else np.frombuffer(b"".join(o), np.int32) for o in out]

    def _fill(self, held: list[tuple[int, list[str]]], out: list[list[bytes] | None]) -> None:
        if self.held > REMEMBERED:
            self.older, self.known, self.held = self.known, {"": b""}, 0
        known, older = self.known, self.older
        new = set().union(*(words for _, words in held)) - known.keys()
        for w in new & older.keys():
            self._keep(w, older[w])
        self.learn([w for w in new if w not in known])
        for k, words in held:
            out[k].append(b"".join(map(known.__getitem__, words)))


def decode(model: Model, ids: list[int] | None) -> str | None:
    if ids is None:
        return None
    text = b"".join(map(model.value_of.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)
def encoder(data: bytes) -> Encoder:
    return Encoder(Model(data))


@lru_cache(maxsize=1)
def decoder(data: bytes) -> Model:
    return Model(data, merges=False)


def _texts(batch: pa.Array, most: int = 1 << 20) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in batch:
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encode(model, carry: list[str], text: str, out: str, back: str | None = None):
    """Adds the ids, and with `back` what they decode to, in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for batch in batches:
            at = 0
            for texts in _texts(batch.column(text)):
                ids = e.encode(texts)
                part = batch.slice(at, len(texts))
                at += len(texts)
                flat = np.concatenate([i for i in ids if i is not None] or [np.zeros(0, np.int32)])
                ends = np.cumsum([0, *(0 if i is None else len(i) for i in ids)])
                made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*(i is None for i in ids), False])), pa.array(flat))]
                if back:
                    made.append(pa.array([None if i is None else decode(e.model, i.tolist()) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *made], [*carry, out, *([back] if back else [])])

    return run


def _decode(model, carry: list[str], ids: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = decoder(model.value)
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                texts = [decode(m, i) for i in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(texts, pa.string())], [*carry, out])

    return run


def model_bytes(spark: SparkSession, path: str = MODEL):
    """The model's file, read on the driver and broadcast: half a megabyte for 32,000 pieces, refused beyond 16 MB."""
    with open(path, "rb") as f:
        data = f.read((16 << 20) + 1)
    if len(data) > 16 << 20:
        raise ValueError("the model is larger than 16 MB")
    return spark.sparkContext.broadcast(data)


def encoded(docs: DataFrame, carry: list[str], text: str = "text", out: str = "ids", path: str = MODEL) -> DataFrame:
    """The columns in `carry` and the ids of each text, array<int>."""
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(_encode(model_bytes(docs.sparkSession, path), carry, text, out), schema)


def encoded_and_decoded(docs: DataFrame, carry: list[str], text: str = "text", out: str = "ids", back: str = "decoded", path: str = MODEL) -> DataFrame:
    """`encoded` and `decoded` in one pass of Python."""
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(back, T.StringType())])
    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(_encode(model_bytes(docs.sparkSession, path), carry, text, out, back), schema)


def decoded(rows: DataFrame, carry: list[str], ids: str = "ids", out: str = "decoded", path: str = MODEL) -> DataFrame:
    """The columns in `carry` and the text that each row's ids stand for."""
    schema = T.StructType([rows.schema[c] for c in carry] + [T.StructField(out, T.StringType())])
    return rows.select(*dict.fromkeys([*carry, ids])).mapInArrow(_decode(model_bytes(rows.sparkSession, path), carry, ids, out), schema)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of ids, the sha256 of the ids joined by commas, and whether decoding gives the text back."""
    rows = encoded_and_decoded(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id", "text"])
    digest = F.sha2(F.array_join(F.col("ids"), ","), 256).alias("ids_sha256")
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), digest, F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
