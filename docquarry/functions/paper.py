"""Paper sizes and where things lie on paper, shared by the renderers. Sizes are hundredths of a millimetre."""

from __future__ import annotations

import re

A4_POINTS = (595.32, 841.92)
# Standard sheets, upright; A6, A5, B5, A4, Letter, B4, A3.
STANDARD = [(10500, 14800), (14800, 21000), (18200, 25700), (21000, 29700), (21590, 27940), (25700, 36400), (29700, 42000)]
NEAR = 100
GRID = 600


def snapped(paper: tuple[int, int]) -> tuple[int, int]:
    """The standard sheet within a millimetre, either way round, else the size itself."""
    sheets = [s for pair in STANDARD for s in (pair, pair[::-1])]
    return next((s for s in sheets if abs(s[0] - paper[0]) <= NEAR and abs(s[1] - paper[1]) <= NEAR), paper)


def page_points(paper: tuple[int, int] | None) -> tuple[float, float] | None:
    """Points on the grid of a 600-dpi printer."""
    if paper is None:
        return None
    w, h = (int(n * GRID / 2540 + 0.5) * 72 / GRID for n in snapped(paper))
    return w, h


def paper_option(text: str) -> tuple[float, float] | None:
    """a4, letter, or WxH in millimetres, as points; None for anything else or sizes that are not above zero."""
    named = {"a4": A4_POINTS, "letter": (612.0, 792.0)}
    m = re.fullmatch(r"(\d+(?:\.\d+)?)x(\d+(?:\.\d+)?)", text.strip().lower())
    if m and float(m[1]) > 0 and float(m[2]) > 0:
        return float(m[1]) * 72 / 25.4, float(m[2]) * 72 / 25.4
    return named.get(text.strip().lower())


def contained(size: tuple[float, float], room: tuple[float, float]) -> tuple[float, float, float, float]:
    """The largest box of that shape in the middle of the room: left, top, width, height."""
    k = min(room[0] / size[0], room[1] / size[1])
    w, h = size[0] * k, size[1] * k
    return (room[0] - w) / 2, (room[1] - h) / 2, w, h


def covers(box: tuple[float, float, float, float], whole: tuple[float, float]) -> bool:
    """Whether a box (left, top, width, height) begins within a twentieth of the edges and spans nine tenths of both sides."""
    return box[0] <= whole[0] // 20 and box[1] <= whole[1] // 20 and box[2] >= whole[0] * 9 // 10 and box[3] >= whole[1] * 9 // 10


def em_width(text: str) -> float:
    return sum(0.55 if c < "\u0100" else 1.0 for c in text)


def paired_pictures(calls: list[tuple[int, int]], stored: list[tuple[int, int] | None]) -> list[int | None]:
    """Which stored picture each call places. Twice as many calls as pictures, in pairs of one size, go two to a picture; else each
    takes the first unused of its size, the last of its size, or the first unused. A size of 0 suits any."""
    if stored and len(calls) == 2 * len(stored) and all(a == b for a, b in zip(calls[::2], calls[1::2])):
        return [i // 2 for i in range(len(calls))]
    free, out = dict.fromkeys(range(len(stored))), []
    for size in calls:
        told = min(size) > 0
        alike = [k for k, s in enumerate(stored) if not told or s == size]
        unused = [k for k in alike if k in free]
        pick = unused[0] if unused else alike[-1] if told and alike else next(iter(free), None)
        free.pop(pick, None)
        out.append(pick)
    return out
