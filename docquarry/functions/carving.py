"""Original files that lie inside other bytes: ZIP archives, compound files, PDFs. Nothing here knows Spark."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

#: Fixed values of the formats.
ZIP_LOCAL, ZIP_CENTRAL, ZIP_END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
CFB, PDF, PDF_END = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"%PDF-", b"%%EOF"
OFFICE = ((b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx"))


@dataclass(frozen=True)
class Found:
    """estimate: the length is an upper bound from a header."""

    offset: int
    length: int
    extension: str
    estimate: bool = False


def _office(data: bytes, at: int, end: int) -> str:
    """The office format that the names of a central directory tell, else zip."""
    while at + 46 <= end and data.startswith(ZIP_CENTRAL, at):
        name, extra, comment = struct.unpack_from("<3H", data, at + 28)
        if at + 46 + name > len(data):
            break
        for folder, extension in OFFICE:
            if name >= len(folder) and data.startswith(folder, at + 46):
                return extension
        at += 46 + name + extra + comment
    return "zip"


def _archives(data: bytes) -> dict[int, tuple[int, int, int]]:
    """By its start, each archive's end and the window of its directory. One walk over the end records tells where
    each one's archive begins; the last record counts, and one that the data cut short leaves none."""
    out = {}
    for m in re.finditer(re.escape(ZIP_END), data):
        at = m.start()
        if at + 22 > len(data):
            return {}
        size, offset, comment = struct.unpack_from("<IIH", data, at + 12)
        if at + 22 + comment <= len(data) and at >= size + offset:
            out[at - size - offset] = (at + 22 + comment, at - size, at)
    return out


def _walk(data: bytes, magic: bytes, carve: Callable[[int], Found | None]) -> Iterator[Found]:
    """What carve makes of each place where the magic stands outside what was found before."""
    at = data.find(magic)
    while at >= 0:
        found = carve(at)
        if found:
            yield found
        at = data.find(magic, at + (found.length if found else 1))


def carved(data: bytes) -> list[Found]:
    """All files found, by offset. Those of one kind do not overlap; those of different kinds may."""
    ends = _archives(data)
    last = data.rfind(PDF_END) + len(PDF_END)

    def archive(at: int) -> Found | None:
        if at not in ends:
            return None
        end, lo, hi = ends[at]
        return Found(at, end - at, _office(data, lo, hi))

    def compound(at: int) -> Found | None:
        if at + 512 > len(data):
            return None
        (shift,), (tables,) = struct.unpack_from("<H", data, at + 30), struct.unpack_from("<I", data, at + 44)
        if not 7 <= shift <= 12 or not 1 <= tables <= 4096:
            return None
        return Found(at, min(512 + tables * (1 << shift - 2) * (1 << shift), len(data) - at), "cfb", True)

    def portable(at: int) -> Found | None:
        return Found(at, last - at, "pdf") if last - len(PDF_END) >= at else None

    return sorted((f for magic, carve in ((ZIP_LOCAL, archive), (CFB, compound), (PDF, portable)) for f in _walk(data, magic, carve)), key=lambda f: f.offset)
