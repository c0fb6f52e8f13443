"""Group 4 fax pictures (ITU-T T.6) as packed rows, black bits set."""

from __future__ import annotations

from functools import cache

import numpy as np

MAX_PIXELS = 64 << 20

# The run codes of ITU-T T.4, tables 2 and 3, by run length.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"""
WHITE_64 = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"""
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"""
BLACK_64 = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010
0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"""
BOTH_1792 = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
MODES = {"0001": "pass", "001": "runs", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "0000001111": "plain"}

PEEK = 13


class FaxError(Exception):
    pass


def run_codes(black: bool) -> dict[str, int]:
    short, long = (BLACK, BLACK_64) if black else (WHITE, WHITE_64)
    out = {code: n for n, code in enumerate(short.split())}
    out |= {code: 64 * n for n, code in enumerate(long.split(), 1)}
    return out | {code: 1792 + 64 * n for n, code in enumerate(BOTH_1792.split())}


def _lookup(codes: dict) -> list:
    table = [None] * (1 << PEEK)
    for code, meaning in codes.items():
        free = PEEK - len(code)
        lo = int(code, 2) << free
        table[lo : lo + (1 << free)] = [(meaning, len(code))] * (1 << free)
    return table


@cache
def _tables() -> tuple[list, list, list]:
    return _lookup(MODES), _lookup(run_codes(False)), _lookup(run_codes(True))


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte, bit = divmod(self.at, 8)
        window = int.from_bytes(self.data[byte : byte + 4].ljust(4, b"\0"), "big")
        return window >> (32 - bit - n) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise FaxError("data ends")

    def symbol(self, table: list):
        found = table[self.peek(PEEK)]
        if found is None:
            raise FaxError("no such code")
        self.skip(found[1])
        return found[0]

    def run(self, table: list) -> int:
        total = 0
        while True:
            n = self.symbol(table)
            total += n
            if n < 64:
                return total


class _Row:
    """Columns at which the colour changes, white first. A change on top of another cancels it."""

    def __init__(self, width: int, clamp: int):
        self.width, self.clamp, self.changes = width, clamp, []

    def turn(self, at: int) -> int:
        if at > self.width:
            if at - self.width > self.clamp:
                raise FaxError("a run passes the edge")
            at = self.width
        if self.changes and self.changes[-1] == at:
            self.changes.pop()
        else:
            self.changes.append(at)
        return at


def _plain(reader: _Reader, row: _Row, at: int, black: bool) -> tuple[int, bool]:
    """Literal pixels: each code is zeros and a one; five zeros stand alone, more end the mode."""
    colour = black

    def put(bit: bool) -> None:
        nonlocal at, colour
        if at >= row.width:
            raise FaxError("pixels pass the edge")
        if bit != colour:
            row.turn(at)
            colour = bit
        at += 1

    while True:
        zeros = 0
        while not reader.peek(1):
            reader.skip(1)
            zeros += 1
            if zeros > 10:
                raise FaxError("no end of literal pixels")
        reader.skip(1)
        white = zeros if zeros < 5 else 5 if zeros == 5 else zeros - 6
        for _ in range(white):
            put(False)
        if zeros < 5:
            put(True)
        elif zeros > 5:
            after = bool(reader.peek(1))
            reader.skip(1)
            if after != colour:
                row.turn(at)
            return at, after


def _row(reader: _Reader, above: list[int], width: int, clamp: int) -> list[int]:
    modes, white, black = _tables()
    row, at, dark, k = _Row(width, clamp), -1, False, 0
    while at < width:
        # the next change above, right of here, to the other colour
        while k and (k > len(above) or above[k - 1] > at):
            k -= 1
        while k < len(above) and (above[k] <= at or bool(k & 1) != dark):
            k += 1
        b1 = above[k] if k < len(above) else width
        mode = reader.symbol(modes)
        if mode == "pass":
            at = above[k + 1] if k + 1 < len(above) else width
        elif mode == "runs":
            first, second = (black, white) if dark else (white, black)
            at = row.turn(max(at, 0) + reader.run(first))
            at = row.turn(at + reader.run(second))
        elif mode == "plain":
            at, dark = _plain(reader, row, max(at, 0), dark)
        else:
            if b1 + mode < max(at, 0):
                raise FaxError("a change steps back")
            at = row.turn(b1 + mode)
            dark = not dark
    return row.changes


def fax_rows(data: bytes, width: int, height: int, relaxed: bool = False) -> bytes:
    """Rows of width bits, each padded to octets, black set. Raises FaxError where data ends early, a code is unknown or a
    run leaves the row; with `relaxed`, runs may pass the edge by up to 64 pixels."""
    if width <= 0 or height <= 0 or width * height > MAX_PIXELS:
        raise FaxError("size")
    reader, changes, rows = _Reader(data), [], []
    for _ in range(height):
        changes = _row(reader, changes, width, 64 if relaxed else 0)
        turns = np.zeros(width + 1, np.uint8)
        turns[changes] = 1
        rows.append(np.packbits(np.bitwise_xor.accumulate(turns)[:width]).tobytes())
    return b"".join(rows)
