"""TrueType fonts as far as a PDF needs them: which glyph a character has, and how wide glyphs are."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

# What TrueType files begin with, and units of an em in PDF.
VERSIONS = (b"\0\1\0\0", b"true")
EM = 1000


@dataclass
class FontFile:
    data: bytes
    units: int
    box: tuple[int, int, int, int]
    ascent: int
    descent: int
    advances: list[int]
    glyphs: dict[int, int]

    def glyph(self, c: str) -> int:
        """0 where the font has no glyph for a character."""
        return self.glyphs.get(ord(c), 0)

    def scaled(self, n: int) -> int:
        return round(n * EM / self.units)

    def width(self, glyph: int) -> int:
        """In thousandths of an em; glyphs behind the last one with a width of its own share that."""
        return self.scaled(self.advances[min(glyph, len(self.advances) - 1)])


def _tables(data: bytes) -> dict[bytes, bytes]:
    (n,) = struct.unpack_from(">H", data, 4)
    rows = (struct.unpack_from(">4sIII", data, 12 + 16 * k) for k in range(n))
    return {tag: data[at : at + size] for tag, _, at, size in rows}


def _by_segments(raw: bytes) -> dict[int, int]:
    (double,) = struct.unpack_from(">H", raw, 6)
    n = double // 2
    read = lambda at, kind="H": struct.unpack_from(f">{n}{kind}", raw, at)
    ends, starts, steps, offsets = read(14), read(16 + double), read(16 + 2 * double, "h"), read(16 + 3 * double)
    out = {}
    for k, (end, start, step, offset) in enumerate(zip(ends, starts, steps, offsets)):
        for c in range(start, min(end, 0xFFFE) + 1):
            if offset:
                at = 16 + 3 * double + 2 * k + offset + 2 * (c - start)
                g = struct.unpack_from(">H", raw, at)[0] if at + 2 <= len(raw) else 0
                g = (g + step) & 0xFFFF if g else 0
            else:
                g = (c + step) & 0xFFFF
            if g:
                out[c] = g
    return out


def _by_groups(raw: bytes) -> dict[int, int]:
    (n,) = struct.unpack_from(">I", raw, 12)
    groups = struct.iter_unpack(">III", raw[16 : 16 + 12 * n])
    return {c: first + c - start for start, end, first in groups for c in range(start, min(end, 0x10FFFF) + 1)}


FORMATS = {4: _by_segments, 12: _by_groups}


def _characters(cmap: bytes) -> dict[int, int]:
    """The subtable of Unicode that says most: of several, the last in the order of the public table of encodings."""
    (n,) = struct.unpack_from(">H", cmap, 2)
    found = {}
    for platform, encoding, at in sorted(struct.unpack_from(">HHI", cmap, 4 + 8 * k) for k in range(n)):
        kind = struct.unpack_from(">H", cmap, at)[0]
        if (platform == 0 or (platform == 3 and encoding in (1, 10))) and kind in FORMATS:
            found |= FORMATS[kind](cmap[at:])
    return found


def font_file(data: bytes) -> FontFile | None:
    """None if it is no TrueType font, or one whose tables do not hold."""
    if not data.startswith(VERSIONS):
        return None
    try:
        t = _tables(data)
        head, hhea, maxp = t[b"head"], t[b"hhea"], t[b"maxp"]
        (units,), box = struct.unpack_from(">H", head, 18), struct.unpack_from(">4h", head, 36)
        ascent, descent = struct.unpack_from(">hh", hhea, 4)
        (n,), (count,) = struct.unpack_from(">H", hhea, 34), struct.unpack_from(">H", maxp, 4)
        advances = [struct.unpack_from(">H", t[b"hmtx"], 4 * k)[0] for k in range(n)]
        glyphs = {c: g for c, g in _characters(t[b"cmap"]).items() if g < count}
    except (KeyError, struct.error):
        return None
    return FontFile(data, units, box, ascent, descent, advances, glyphs) if units and advances else None


def number_runs(numbers: Iterable[int]) -> Iterator[list[int]]:
    """Sorted numbers in runs without gaps."""
    run: list[int] = []
    for n in sorted(set(numbers)):
        if run and n != run[-1] + 1:
            yield run
            run = []
        run.append(n)
    if run:
        yield run


def widths(font: FontFile, glyphs: Iterable[int]) -> str:
    """A PDF array of widths: the first glyph of each run, and the widths of the run."""
    return "[" + " ".join(f"{run[0]} [{' '.join(str(font.width(g)) for g in run)}]" for run in number_runs(glyphs)) + "]"


def to_unicode(glyphs: dict[int, str]) -> bytes:
    """A character map from glyphs back to text, at most 100 to a block."""
    rows = [f"<{g:04X}> <{c.encode('utf-16-be', 'replace').hex().upper()}>" for g, c in sorted(glyphs.items())]
    blocks = [rows[k : k + 100] for k in range(0, len(rows), 100)]
    body = "\n".join(f"{len(b)} beginbfchar\n" + "\n".join(b) + "\nendbfchar" for b in blocks)
    return f"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Own def /CMapType 2 def\n1 begincodespacerange <0000> <FFFF> endcodespacerange\n{body}\nendcmap CMapName currentdict /CMap defineresource pop end end".encode()
