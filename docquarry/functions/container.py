"""Whole containers: header, trailer, page table, roles."""

from __future__ import annotations

from .lzh import CodingError, expand
from .shown import displayed, merge_orphans, shown_pages
from .tlv import ContainerError, Entry, element_at, elements, entry_at, find, le_words, length_at, others, uint

#: Fixed values of the format.
HEADER, BODY, PROPERTIES, PAGE = 0x60, 0x61, 0x63, 0x64
INNER = frozenset({PROPERTIES, PAGE, 0x65, 0x68})
GENERATIONS = (7, 10, 11)
#: What other files begin with.
MAGIC = (
    (b"%PDF-", "PDF"), (b"PK\x03\x04", "zip"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "CFB"), (b"\xff\xd8\xff", "JPEG"), (b"\x89PNG\r\n\x1a\n", "PNG"), (b"II*\0", "TIFF"), (b"MM\0*", "TIFF"), (b"{\\rtf", "RTF"),
    (b"<!DOCTYPE", "markup"), (b"<html", "markup"), (b"<?xml", "markup"),
)
OFFICE = ((b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx"))


def sniffed(data: bytes) -> str | None:
    """What bytes that are no container seem to be; None if nothing known."""
    label = next((label for magic, label in MAGIC if data.startswith(magic)), None)
    return next((kind for part, kind in OFFICE if part in data[:512]), label) if label == "zip" else label


def trailer(data: bytes):
    """Found from the end: the last field is the trailer's own length, and the header may have 2 to 5 octets."""
    n = len(data)
    if n < 8 or data[n - 6 : n - 4] != b"\x86\x04":
        raise ContainerError("NoTrailer")
    size = int.from_bytes(data[n - 4 :], "little")
    for head in range(2, 6):
        start = n - size - head
        if start < 0:
            continue
        try:
            fits = length_at(data, start + 1) == (size, start + head)
        except ContainerError:
            continue  # this is no header's length; a longer header may fit
        if fits:
            return data[start], start, elements(data, start + head, size)
    raise ContainerError("NoTrailer")


def scanned_offsets(data: bytes) -> list[int]:
    """Where page elements seem to stand, for files whose page table is of no use."""
    out, at = [], data.find(PAGE)
    while 0 <= at < len(data) - 8:
        step = at + 1
        try:
            n, value = length_at(data, at + 1)
            if n > 10 and value + n <= len(data) and data[value : value + 2] == b"\x81\x04" and data[value + 6] == 0x82:
                out.append(at)
                step = value + n
        except ContainerError:
            pass
        at = data.find(PAGE, step)
    return out


def _is_payload(data: bytes, e: Entry) -> bool:
    """Whether a bare entry holds a packed file: it expands, and to text, a PDF, or a good many bytes."""
    try:
        head = expand(data[e.at : e.at + e.length], 8)
    except CodingError:
        return False
    fine = [c >= 32 or c in (9, 10, 13) for c in head]
    return head.startswith(b"%PDF-") or (all(fine) and len(fine) >= 6) or e.length >= 512


def assign_roles(entries: list[Entry]) -> None:
    """Thumbnails part the table into groups; in each group, sheets own the pictures that follow them."""
    group: list[Entry] = []
    after = False

    def settle(tail: bool) -> None:
        own = [e for e in group if e.role != "data"]
        if not own:
            return
        if tail and all(e.kind == "bare" and not e.paper and not e.pixels for e in own):
            for e in own:
                e.role, e.belongs_to = "data", None
            return
        picture = [e.kind in ("jpeg", "bare") for e in own]
        framed = [e.kind == "jpeg" and e.paper is not None for e in own]
        if any(framed):
            sheet = [f or not p for f, p in zip(framed, picture)]
            fallback = own[framed.index(True)]
        elif all(picture):
            area = [e.pixels[0] * e.pixels[1] if e.pixels else 0 for e in own]
            top = max(range(len(own)), key=lambda k: (area[k], k))
            sheet = [k == top for k in range(len(own))]
            fallback = own[top]
        else:
            coded = picture.index(False)
            sheet = [not p or k < coded for k, p in enumerate(picture)]
            fallback = own[sheet.index(True)]
        last = None
        for e, s in zip(own, sheet):
            e.role = "sheet" if s else "picture"
            last = e if s else last
            e.belongs_to = None if s else (last or fallback).idx

    for e in entries:
        full = e.kind == "preview" and e.pixels is not None and min(e.pixels) >= 1000
        if e.kind == "fields":
            e.role, e.belongs_to, after = "data", None, False
        elif e.kind == "preview":
            settle(False)
            owner = next((x.idx for x in reversed(group) if x.role == "sheet"), None)
            small = not full and owner is not None
            e.role, e.belongs_to, after = ("thumbnail", owner, True) if small else ("sheet", None, False)
            group = [e] if full else []
        else:
            group.append(e)
    settle(after)


def _properties(data: bytes, start: int, tail) -> tuple[int, int, int] | None:
    """Where the properties lie, just before the trailer: offset, stored and expanded size."""
    stored, size = uint(tail, data, 0x84), uint(tail, data, 0x83)
    for head in range(2, 6):
        at = start - (stored or 0) - head
        if stored is None or at < 0 or data[at] != PROPERTIES:
            continue
        try:
            if length_at(data, at + 1) == (stored, at + head):
                return at + head, stored, size or 0
        except ContainerError:
            pass
    return None


def _shown(data: bytes, place) -> list:
    if place is None or not place[2]:
        return []
    try:
        return shown_pages(expand(data[place[0] : place[0] + place[1]], place[2]))
    except CodingError:
        return []


def parse(data: bytes) -> dict:
    """A container as one nested row; raises ContainerError."""
    try:
        head = element_at(data, 0)
        if head.tag != HEADER:
            raise ContainerError("NoFileHeader")
    except ContainerError:
        label = sniffed(data)
        if label:
            raise ContainerError("NotAContainer", label) from None
        raise
    fields = elements(data, head.value, head.length)
    generation = uint(fields, data, 0x82)
    if generation is None:
        raise ContainerError("MissingField", "82 in 60")
    if generation not in GENERATIONS:
        raise ContainerError("UnsupportedGeneration", str(generation))
    tag, tail_at, tail = trailer(data)
    lock = find(tail, 0x88)
    if generation == 11 and lock and data[lock.value : lock.value + 4] == b"SECU":
        raise ContainerError("ProtectedDocument")
    table = find(tail, 0x81)
    place = _properties(data, tail_at, tail)
    shown = _shown(data, place)
    rebuilt, entries = None, []
    for idx, offset in enumerate(le_words(data[table.value : table.end]) if table else []):
        if offset >= len(data):
            rebuilt = "OffsetOutsideFile"
            break
        try:
            entries.append(entry_at(data, idx, offset))
        except ContainerError:
            rebuilt = "OffsetNotAPage"
            break
    if rebuilt:
        entries = []
        for idx, offset in enumerate(scanned_offsets(data)):
            try:
                entries.append(entry_at(data, idx, offset))
            except ContainerError:
                pass
    for e in entries:
        if e.kind == "bare" and _is_payload(data, e):
            e.role = "data"
    assign_roles(entries)
    if not entries and shown:
        entries = [Entry(k, tail_at, "bare", tail_at, 0, paper=s.paper, rotation=s.rotation, overlays=s.overlays) for k, s in enumerate(shown)]
    if not entries and table is None:
        raise ContainerError("MissingField", "81 in trailer")
    displays = displayed(entries, shown)
    if not displays:
        merge_orphans(entries)
    strange: list[dict] = []
    states, at = 0, 0
    while at < len(data):
        try:
            e = element_at(data, at)
        except ContainerError:
            break
        if e.tag == BODY:
            states += 1
            try:
                strange += [{"tag": x.tag, "at": x.start, "length": x.length} for x in others(data, e.value, e.length, INNER)]
            except ContainerError:
                pass
        at = e.end
    images = find(tail, 0x8D)
    stored, size = uint(tail, data, 0x84), uint(tail, data, 0x83)
    return {"image_derived": le_words(data[images.value : images.end])[::2] if images else [], "unknown_elements": strange, "displays": displays, "properties_at": place and place[0], "properties_stored": stored, "properties_expanded": size, "generation": generation, "trailer_tag": tag, "declared_entries": uint(tail, data, 0x80) or 0, "checksum": uint(tail, data, 0x85), "generations_present": max(states, 1), "rebuilt": rebuilt, "entries": entries}
