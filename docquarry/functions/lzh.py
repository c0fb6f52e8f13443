"""Expansion of LZ-Huffman streams: blocks of 16-bit counts with three prefix codes and an 8 KiB window (the public -lh5- layout)."""

from __future__ import annotations

import functools

CEILING = 256 << 20
#: A prefix code: its longest length, symbol and length by what that many bits are, and, where each of 256 octets stands for a letter, the letters.
Code = tuple[int, list, bytes | None]


class CodingError(Exception):
    pass


class _Bits:
    """Bits, high end first, in one integer; past the end an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n, self.end = data, 0, 0, 0, 8 * len(data)

    def fill(self) -> None:
        step = self.data[self.at : self.at + 8]
        self.at += 8
        self.held = ((self.held & ((1 << self.n) - 1)) << 64) | int.from_bytes(step if len(step) == 8 else step.ljust(8, b"\0"), "big")
        self.n += 64

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.n < n:
            self.fill()
        self.n -= n
        if self.at * 8 - self.n > self.end:
            raise CodingError("the stream ends too early")
        return self.held >> self.n & ((1 << n) - 1)

    def octets(self, most: int) -> bytes:
        """The next groups of eight bits: as many as there are, at most `most`."""
        start = self.at * 8 - self.n
        n = min(most, (self.end - start) // 8)
        first, off = divmod(start, 8)
        raw = self.data[first : first + n]
        if off and n:
            raw = (int.from_bytes(self.data[first : first + n + 1], "big") >> (8 - off) & ((1 << 8 * n) - 1)).to_bytes(n, "big")
        self.at, self.held, self.n = first + n, 0, 0
        if off:
            self.fill()
            self.n -= off
        return raw

    def symbol(self, code: Code | int) -> int:
        if isinstance(code, int):
            return code
        longest, table, _ = code
        if self.n < longest:
            self.fill()
        found = table[self.held >> (self.n - longest) & ((1 << longest) - 1)]
        if found is None:
            raise CodingError("no such code")
        self.n -= found[1]
        if self.at * 8 - self.n > self.end:
            raise CodingError("the stream ends too early")
        return found[0]


@functools.lru_cache(16)
def _code(lengths: tuple[int, ...]) -> Code:
    """The canonical prefix code of symbol lengths: the longest length, and symbol and length by what the next bits are. Streams of one writer share codes."""
    longest, code = max(max(lengths, default=0), 1), 0
    if longest > 16:
        raise CodingError("a code is too long")
    table: list = [None] * (1 << longest)
    by_length = sorted((n, s) for s, n in enumerate(lengths) if n)
    at = 0
    for n in range(1, longest + 1):
        while at < len(by_length) and by_length[at][0] == n:
            if code >> n:
                raise CodingError("a code table is too full")
            free = longest - n
            table[code << free : (code + 1) << free] = [(by_length[at][1], n)] * (1 << free)
            code += 1
            at += 1
        code <<= 1
    whole = longest == 8 and all(found is not None and found[1] == 8 and found[0] < 256 for found in table)
    return longest, table, bytes(found[0] for found in table) if whole else None


def _short_table(bits: _Bits, size: int, width: int, gap: int) -> Code | int:
    n = bits.take(width)
    if not n:
        return bits.take(width)
    if n > size:
        raise CodingError("a code table is too long")
    lengths: list[int] = []
    while len(lengths) < n:
        length = bits.take(3)
        if length == 7:
            while bits.take(1):
                length += 1
                if length > 16:
                    raise CodingError("a code is too long")
        lengths.append(length)
        if len(lengths) == gap:
            lengths += [0] * bits.take(2)
    return _code(tuple(lengths[:size]))


def _long_table(bits: _Bits, inner: Code | int) -> Code | int:
    n = bits.take(9)
    if not n:
        return bits.take(9)
    if n > 510:
        raise CodingError("a code table is too long")
    if isinstance(inner, int) and inner > 2:  # one symbol, which takes no bits
        return _code((inner - 2,) * n)
    lengths: list[int] = []
    while len(lengths) < n:
        s = bits.symbol(inner)
        if s > 2:
            lengths.append(s - 2)
        else:
            lengths += [0] * (1 if s == 0 else bits.take(4) + 3 if s == 1 else bits.take(9) + 20)
    return _code(tuple(lengths[:510]))


def expand(data: bytes, size: int) -> bytes:
    """The first `size` bytes that data expands to."""
    if size > CEILING:
        raise CodingError("the declared size is over the ceiling")
    out = bytearray()
    _expand(data, size, out)
    return bytes(out[:size])


def expand_all(data: bytes, ceiling: int) -> bytes | None:
    """All that data expands to, for streams of unknown size; None from the ceiling on."""
    out = bytearray()
    try:
        _expand(data, ceiling, out)
    except CodingError:
        return bytes(out)
    return None


def _expand(data: bytes, size: int, out: bytearray) -> None:
    bits, left = _Bits(data), 0
    letters = places = None
    while len(out) < size:
        if not left:
            left = bits.take(16)
            if not left:
                raise CodingError("an empty block")
            inner = _short_table(bits, 19, 5, 3)
            letters = _long_table(bits, inner)
            places = _short_table(bits, 14, 4, -1)
        if isinstance(letters, int):
            s = letters
            left -= 1
        else:
            # letters in a row, without calls; n below `over` is past the end
            longest, table, plain = letters
            if plain:
                raw = bits.octets(min(left, size - len(out)))
                if raw:
                    out += raw.translate(plain)
                    left -= len(raw)
                    continue
            mask, s, n, over, held, append = (1 << longest) - 1, 0, bits.n, bits.at * 8 - bits.end, bits.held, out.append
            while left and len(out) < size:
                if n < longest:
                    bits.n = n
                    bits.fill()
                    n, over, held = bits.n, bits.at * 8 - bits.end, bits.held
                found = table[held >> (n - longest) & mask]
                if found is None:
                    raise CodingError("no such code")
                s, used = found
                n -= used
                if n < over:
                    raise CodingError("the stream ends too early")
                left -= 1
                if s > 255:
                    break
                append(s)
            bits.n = n
            if s < 256:
                continue
        if s < 256:
            out.append(s)
            continue
        n = s - 256 + 3
        p = bits.symbol(places)
        start = len(out) - ((1 << (p - 1)) + bits.take(p - 1) if p else 0) - 1
        if start >= 0 and len(out) - start >= n:
            out += out[start : start + n]
        else:
            for k in range(n):
                # before the start the window holds spaces
                out.append(out[start + k] if start + k >= 0 else 32)


def stored(raw: bytes) -> bytes:
    """raw as a stream of blocks whose letters all have codes of eight bits: for fixtures."""
    word, n = 0, 0
    for lo in range(0, len(raw), 65535):
        part = raw[lo : lo + 65535]
        for value, width in ((len(part), 16), (0, 5), (10, 5), (256, 9), (0, 4), (0, 4), (int.from_bytes(part, "big"), 8 * len(part))):
            word, n = word << width | value, n + width
    pad = -n % 8
    return (word << pad).to_bytes((n + pad) // 8, "big")
