"""Tag-length-value elements and page entries of the container format. Nothing here knows Spark."""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass, field
from typing import NamedTuple


class ContainerError(Exception):
    """code is what the docs table shows; a bad file is a row, never a failure."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(code, detail)
        self.code, self.detail = code, detail


class Element(NamedTuple):
    tag: int
    start: int
    value: int
    length: int

    @property
    def end(self) -> int:
        return self.value + self.length


def length_at(data: bytes, at: int) -> tuple[int, int]:
    """A length and where its value begins: one octet below 0x80, else 1 to 4 octets, big end first."""
    if at >= len(data):
        raise ContainerError("Truncated")
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4:
        raise ContainerError("BadLength")
    if at + 1 + n > len(data):
        raise ContainerError("Truncated")
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def element_at(data: bytes, at: int) -> Element:
    if at >= len(data):
        raise ContainerError("Truncated")
    size = len(data)
    if at + 1 < size and data[at + 1] < 0x80:
        n, value = data[at + 1], at + 2
    else:
        n, value = length_at(data, at + 1)
    if value + n > size:
        raise ContainerError("Truncated")
    return Element(data[at], at, value, n)


def elements(data: bytes, start: int, length: int) -> list[Element]:
    """All elements of a window; one that runs past the window's end is truncated."""
    out, at, end, size = [], start, start + length, len(data)
    while at < end:
        if at >= size:
            raise ContainerError("Truncated")
        if at + 1 < size and data[at + 1] < 0x80:
            n, value = data[at + 1], at + 2
        else:
            n, value = length_at(data, at + 1)
        after = value + n
        if after > size or after > end:
            raise ContainerError("Truncated")
        out.append(Element(data[at], at, value, n))
        at = after
    return out


def others(data: bytes, start: int, length: int, known: frozenset[int]) -> list[Element]:
    """The elements of a window whose tags are not known; as `elements`, but those that are known are stepped over."""
    out, at, end, size = [], start, start + length, len(data)
    while at < end:
        if at + 1 < size and data[at + 1] < 0x80:
            n, value = data[at + 1], at + 2
        else:
            n, value = length_at(data, at + 1)
        after = value + n
        if after > size or after > end:
            raise ContainerError("Truncated")
        if data[at] not in known:
            out.append(Element(data[at], at, value, n))
        at = after
    return out


def find(items: list[Element], tag: int) -> Element | None:
    for e in items:
        if e.tag == tag:
            return e
    return None


def uint(items: list[Element], data: bytes, tag: int) -> int | None:
    """The first element's value as a number of 1 to 8 octets, big end first."""
    e = find(items, tag)
    return int.from_bytes(data[e.value : e.end], "big") if e and 1 <= e.length <= 8 else None


def le_words(raw: bytes) -> list[int]:
    n = len(raw) // 4
    return list(struct.unpack_from(f"<{n}I", raw))


@dataclass
class Entry:
    """A page-table entry. kind is jpeg, preview, encoded, fields or bare."""

    idx: int
    offset: int
    kind: str
    at: int
    length: int
    role: str = "sheet"
    belongs_to: int | None = None
    checksum: int | None = None
    paper: tuple[int, int] | None = None
    pixels: tuple[int, int] | None = None
    code: int | None = None
    aux: int | None = None
    method: int | None = None
    stored: int | None = None
    expanded: int | None = None
    rows: int | None = None
    colour: int | None = None
    below: int | None = None
    rotation: int = 0
    overlays: list = field(default_factory=list)
    unknown: list[int] = field(default_factory=list)


#: Fixed values of the format: tags of page fields and of a nested body, and the kinds of body.
CHECKSUM, BODY = 0x81, 0x82
KIND, AUX, PAPER_W, PAPER_H, DATA, STORED, METHOD, COLOUR, PIXEL_W, PIXEL_H = 0x80, 0x81, 0x84, 0x85, 0x86, 0x89, 0x8A, 0x8D, 0x90, 0x91
IMAGE_W, IMAGE_H, DPI_X, DPI_Y = 0x87, 0x88, 0x8B, 0x8C
JPEG_BODY, BITMAP_BODY, FAX_BODY = 5, 7, 9
#: Entries of at most so many octets are remembered by them.
SMALL = 256
#: Tags that are known in a page element, in a nested body, and in one with a picture.
KNOWN = frozenset({CHECKSUM, BODY})
NESTED = frozenset({KIND, AUX, PAPER_W, PAPER_H, DATA, STORED, METHOD, COLOUR, PIXEL_W, PIXEL_H})
NESTED_PICTURE = NESTED | {IMAGE_W, IMAGE_H, DPI_X, DPI_Y}


def _strange(found: list[Element], known: frozenset[int]) -> list[int]:
    return sorted({e.tag for e in found} - known)


def jpeg_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height from the start-of-frame marker."""
    at = 2
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            return None
        marker = raw[at + 1]
        if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        n = int.from_bytes(raw[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(raw):
                return None
            h, w = struct.unpack_from(">HH", raw, at + 5)
            return w, h
        if n < 2 or marker in (0xD9, 0xDA):
            return None
        at += 2 + n
    return None


def _values(raw: bytes) -> list[bytes] | None:
    """The values of a run of one-octet lengths and values that fills raw, or None."""
    out, at = [], 0
    while at < len(raw):
        n = raw[at]
        if not n or at + 1 + n > len(raw):
            return None
        out.append(raw[at + 1 : at + 1 + n])
        at += 1 + n
    return out


def _is_name(value: bytes) -> bool:
    return len(value) >= 3 and value[-1] == 0 and all(32 <= c < 127 for c in value[:-1])


def field_names(raw: bytes) -> list[str]:
    """Names in a field table in the order in which they first stand."""
    return list(dict.fromkeys(v[:-1].decode("ascii") for v in _values(raw) or [] if _is_name(v)))


def entry_at(data: bytes, idx: int, offset: int) -> Entry:
    """Reads one entry and tells its shape: nested body, raw JPEG, field table, or bare bytes. An entry of few octets that was read before is not read again."""
    whole = element_at(data, offset)
    if whole.end - offset > SMALL:
        return _entry(data, idx, whole)
    known, entry = _small_entry(data[offset : whole.end]), Entry.__new__(Entry)
    entry.__dict__.update(known.__dict__)
    entry.idx, entry.offset, entry.at, entry.overlays, entry.unknown = idx, offset, known.at + offset, [], list(known.unknown)
    return entry


@functools.lru_cache(4096)
def _small_entry(data: bytes) -> Entry:
    return _entry(data, 0, element_at(data, 0))


def _entry(data: bytes, idx: int, whole: Element) -> Entry:
    offset = whole.start
    items = elements(data, whole.value, whole.length)
    entry = Entry(idx, offset, "bare", whole.value, whole.length, checksum=uint(items, data, CHECKSUM), unknown=_strange(items, KNOWN))
    body = find(items, BODY)
    if body is None:
        return entry
    entry.at, entry.length = body.value, body.length
    raw = data[body.value : body.end]
    if raw[:1] == bytes([KIND]):
        try:
            nested = elements(data, body.value, body.length)
        except ContainerError:
            nested = []
        if nested:
            return _nested(data, entry, nested)
    if len(raw) > 18 and int.from_bytes(raw[:4], "little") == body.length and raw[16:18] == b"\xff\xd8":
        w, h = struct.unpack_from("<II", raw, 8)
        entry.kind, entry.at, entry.length, entry.pixels = "jpeg", body.value + 16, body.length - 16, (w, h)
        return entry
    values = _values(raw) if len(raw) >= 8 else None
    if values is not None and 40 * sum(map(_is_name, values)) >= len(values):
        entry.kind, entry.role, entry.rows = "fields", "data", len(values)
    return entry


def _nested(data: bytes, entry: Entry, nested: list[Element]) -> Entry:
    # the first element of a tag counts
    first = {e.tag: e for e in reversed(nested)}

    def number(tag: int) -> int | None:
        e = first.get(tag)
        return int.from_bytes(data[e.value : e.end], "big") if e and 1 <= e.length <= 8 else None

    pair = lambda a, b: (number(a), number(b)) if number(a) is not None and number(b) is not None else None
    entry.code, entry.aux = number(KIND) or 0, number(AUX)
    entry.colour = number(COLOUR)
    entry.paper, entry.pixels = pair(PAPER_W, PAPER_H), pair(PIXEL_W, PIXEL_H)
    known = NESTED
    if entry.code in (JPEG_BODY, FAX_BODY):
        known = NESTED_PICTURE
        size = pair(IMAGE_W, IMAGE_H)
        if size and max(size) < 1 << 32:
            entry.pixels = size
    if not first.keys() <= known:
        entry.unknown = [*entry.unknown, *_strange(nested, known)]
    image = first.get(DATA)
    if image is None:
        return entry
    entry.at, entry.length = image.value, image.length
    raw = data[image.value : image.end]
    if entry.code == BITMAP_BODY:
        entry.kind = "preview"
        if len(raw) >= 40 and int.from_bytes(raw[:4], "little") == 40:
            w, h = struct.unpack_from("<Ii", raw, 4)
            if w:
                entry.pixels = (w, abs(h))
        below = entry.aux or 0
        if below + 16 <= len(raw):
            entry.below = below
            entry.method, entry.stored, entry.expanded, entry.rows = struct.unpack_from("<4I", raw, below)
    elif entry.code == JPEG_BODY and raw[:2] == b"\xff\xd8":
        entry.kind = "jpeg"
        entry.pixels = jpeg_size(raw) or entry.pixels
    else:
        entry.kind, entry.method, entry.expanded = "encoded", number(METHOD), entry.aux
    return entry
