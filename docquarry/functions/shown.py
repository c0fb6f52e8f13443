"""The properties block: how pages are shown. Its records become logical pages, and these take page bodies from the page table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from .tlv import ContainerError, Entry, length_at

# Fixed values of the format: record and field tags, levels of records.
RECORD = b"\x62"
LEVEL, PAPER, DRAWING, ROTATION, CHILD_SIZE, CHILD_PLACE = b"\x80", b"\x85", b"\x87", b"\x9f\x3d", b"\x9f\x8f\x51", b"\x9f\x34"
KIND, EXPANDED, DATA, PIXEL_W, PIXEL_H = b"\x80", b"\x81", b"\x86", b"\x87", b"\x88"
PAGE_LEVEL, CHILD_LEVEL, CONTENT_LEVEL = 2, 3, 4
FAX_KIND = 9
DEPTH = 8
SAME = 100


@dataclass
class Overlay:
    """A drawing laid over a page. expanded 0 stands for a fax picture without a declared size."""

    kind: int
    expanded: int
    coded: bytes
    pixels: tuple[int, int] | None
    area: tuple[int, int, int, int] | None


@dataclass
class Shown:
    paper: tuple[int, int] | None
    rotation: int = 0
    overlays: list[Overlay] = field(default_factory=list)
    #: boxes for page bodies: area, and the body's own frame if it is told
    boxes: list[tuple[tuple, tuple | None]] = field(default_factory=list)
    begun: bool = False


def tagged(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Elements with tags of several octets: low five bits set carry on while the high bit is, up to five octets. Ends at the first that does not fit."""
    at = 0
    while at < len(data):
        end = at + 1
        if data[at] & 0x1F == 0x1F:
            while True:
                if end >= len(data):
                    return
                end += 1
                if not data[end - 1] & 0x80 or end - at > 4:
                    break
        try:
            n, value = length_at(data, end)
        except ContainerError:
            return
        if value + n > len(data):
            return
        yield data[at:end], data[value : value + n]
        at = value + n


def lookup(data: bytes, tag: bytes, depth: int = 0) -> bytes | None:
    """The first field of that tag, in the order in which they stand, wrapped records included."""
    for found, value in tagged(data):
        if found == tag:
            return value
        inner = lookup(value, tag, depth + 1) if found == RECORD and depth < DEPTH else None
        if inner is not None:
            return inner
    return None


def numbers(raw: bytes | None) -> list[int]:
    out, at = [], 0
    while raw and at < len(raw) and 1 <= raw[at] <= 8 and at + 1 + raw[at] <= len(raw):
        out.append(int.from_bytes(raw[at + 1 : at + 1 + raw[at]], "big"))
        at += 1 + raw[at]
    return out


def _number(raw: bytes | None) -> int | None:
    return int.from_bytes(raw, "big") if raw and len(raw) <= 8 else None


def _two(raw: bytes | None, least: int) -> tuple[int, int] | None:
    got = numbers(raw)[:2]
    return tuple(got) if len(got) == 2 and all(least <= n < 1 << 32 for n in got) else None


def _overlay(raw: bytes | None, area) -> Overlay | None:
    if raw is None:
        return None
    kind, coded, size = _number(lookup(raw, KIND)), lookup(raw, DATA), _number(lookup(raw, EXPANDED))
    if kind is None or coded is None:
        return None
    pixels = None
    if kind == FAX_KIND:
        pixels = (_number(lookup(raw, PIXEL_W)), _number(lookup(raw, PIXEL_H)))
        if any(p is None or p >= 1 << 32 for p in pixels):
            return None
    if size is None:
        return Overlay(kind, 0, coded, pixels, area) if pixels else None
    return Overlay(kind, size, coded, pixels, area) if 0 < size <= 1 << 28 else None


def shown_pages(block: bytes) -> list[Shown]:
    """Logical pages in order. A box record stands for the content record after it; a page's first content record turns the page."""
    pages: list[Shown] = []
    box = None
    for tag, record in tagged(block):
        if tag != RECORD:
            continue
        level = _number(next((v for t, v in tagged(record) if t == LEVEL), None))
        if level == PAGE_LEVEL:
            pages.append(Shown(_two(lookup(record, PAPER), 1)))
            box = None
        elif level == CHILD_LEVEL:
            place, size = _two(lookup(record, CHILD_PLACE), 0), _two(lookup(record, CHILD_SIZE), 1)
            box = place + size if place and size else None
        elif level == CONTENT_LEVEL and pages:
            page, area, box = pages[-1], box, None
            if not page.begun:
                page.begun = True
                page.rotation = next(iter(numbers(lookup(record, ROTATION))), 0) % 360
            overlay = _overlay(lookup(record, DRAWING), area)
            if overlay:
                page.overlays.append(overlay)
            elif area:
                page.boxes.append((area, _two(lookup(record, PAPER), 1)))
    return pages


def misfit(size: tuple[int, int] | None, frame: tuple[int, int] | None) -> float:
    """How far a body's shape is from a frame, either way round; 0 where the frame is unknown, 100 where the body's size is."""
    if frame is None:
        return 0.0
    if size is None or not all(frame) or not all(size):
        return 100.0
    off = lambda a, b: abs(math.log(a / b))
    return min(off(size[0], frame[0]) + off(size[1], frame[1]), off(size[0], frame[1]) + off(size[1], frame[0]))


def _trusted(sheets: list[Entry], shown: list[Shown]) -> bool:
    """Whether boxes and bodies match well enough to say what each logical page holds."""
    boxes = [len(s.boxes) for s in shown]
    total = sum(boxes)
    if len(shown) == len(sheets) or (total == len(sheets) and boxes.count(1) == total):
        return True
    known = sum(e.kind != "bare" or e.paper is not None or e.pixels is not None for e in sheets)
    return len(shown) == 1 and (total == len(sheets) or 0 < total >= known)


def near(a: tuple[int, int], b: tuple[int, int]) -> bool:
    return abs(a[0] - b[0]) <= SAME and abs(a[1] - b[1]) <= SAME


def _paper(page: Shown, bodies: list[Entry]) -> tuple[int, int] | None:
    """A lone body's own size, turned, counts where it is about the declared one or none is declared."""
    if len(bodies) != 1 or bodies[0].paper is None:
        return page.paper
    own = bodies[0].paper[::-1] if page.rotation % 180 == 90 else bodies[0].paper
    return own if page.paper is None or near(page.paper, own) else page.paper


def displayed(entries: list[Entry], shown: list[Shown]) -> list[dict]:
    """Logical pages with the bodies they show, or an empty list where the properties are no guide; then they only tell
    paper, rotation and overlays of sheets by position. Each body is used once: boxes take the nearest shape in turn."""
    sheets = [e for e in entries if e.role == "sheet"]
    if not shown:
        return []
    if not _trusted(sheets, shown):
        for e, s in zip(sheets, shown):
            e.rotation, e.overlays, e.paper = s.rotation, s.overlays, s.paper or e.paper
        return []
    free = dict(enumerate(sheets))
    after, out = 0, []
    for s in shown:
        members = []
        for area, frame in s.boxes:
            if free:
                k = min(free, key=lambda i: (misfit(free[i].paper or free[i].pixels, frame), i))
                members.append((free.pop(k), area))
                after = k + 1
        if not members and free and len(shown) == len(sheets):
            members.append((free.pop(next((k for k in free if k >= after), next(iter(free)))), None))
        if members:
            members[0][0].rotation, members[0][0].overlays = s.rotation, s.overlays
        elif s.paper is None and not s.overlays:
            continue
        out.append({"paper": _paper(s, [e for e, _ in members]), "rotation": s.rotation, "overlays": s.overlays, "members": [{"idx": e.idx, "area": a} for e, a in members]})
    return out


def merge_orphans(entries: list[Entry]) -> None:
    """A bodiless sheet that only carries overlays gives them to the next sheet, if that has its size and turn and can be recovered."""
    if not any(e.overlays for e in entries):
        return
    sheets = [e for e in entries if e.role == "sheet"]
    owners = {e.belongs_to for e in entries if e.role == "picture"}
    for e, to in zip(sheets, sheets[1:]):
        if e.kind != "bare" or not e.overlays or e.idx in owners or not e.paper or not to.paper or e.rotation % 360 != to.rotation % 360:
            continue
        whole = to.kind == "jpeg" or (to.kind == "encoded" and to.code == FAX_KIND) or (to.kind == "preview" and to.pixels is not None and min(to.pixels) >= 1000)
        if whole and (near(e.paper, to.paper) or near(e.paper, to.paper[::-1])):
            to.overlays = to.overlays + e.overlays
            e.overlays, e.role, e.belongs_to = [], "data", None
