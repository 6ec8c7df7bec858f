"""Page geometry: words to lines, lines to segments, what stands below what, module headings."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from statistics import median_high

from ..dims import tables as D
from ..functions.domain import _MODULE_MAP, SCENARIO

#: Fixed values of the layout, in points or as shares of a line's height.
SAME_LINE, WORD_JOIN, LEAST_GAP, GAP_OF_HEIGHT, COLUMN_SHIFT = 0.55, 4.0, 12.0, 1.6, 20.0


@dataclass(slots=True)
class Box:
    text: str
    x0: float
    x1: float
    y0: float
    y1: float

    @property
    def xc(self) -> float:
        return (self.x0 + self.x1) / 2

    @property
    def yc(self) -> float:
        return (self.y0 + self.y1) / 2

    @property
    def height(self) -> float:
        return self.y1 - self.y0


def join(boxes: list[Box], glue: str = " ") -> Box:
    return Box(glue.join(b.text for b in boxes), min(b.x0 for b in boxes), max(b.x1 for b in boxes), min(b.y0 for b in boxes), max(b.y1 for b in boxes))


_PLAIN = str.maketrans({**dict.fromkeys(D.DASHES, "-"), **D.SUBSCRIPTS, **dict.fromkeys(D.HARD_SPACES, " "), **D.QUOTES, D.SOFT_HYPHEN: ""})


def plain(text: str | None) -> str:
    """What functions.text.normalize_text does to a column."""
    return " ".join((text or "").translate(_PLAIN).lower().split())


def lines(words: list[Box]) -> list[list[Box]]:
    """Top to bottom; a word opens a line if it is off the running mean of the line's middles."""
    tall = sorted(w.height for w in words if w.height > 0)
    reach = SAME_LINE * (median_high(tall) if tall else 8.0)
    out: list[tuple[float, list[Box]]] = []
    for w in sorted(words, key=lambda w: (w.yc, w.x0)):
        if out and abs(w.yc - out[-1][0]) <= reach:
            mean, own = out[-1]
            own.append(w)
            out[-1] = ((mean * (len(own) - 1) + w.yc) / len(own), own)
        else:
            out.append((w.yc, [w]))
    return [sorted(own, key=lambda w: w.x0) for _, own in out]


def segments(words: list[Box]) -> list[Box]:
    """Runs of a line between wide gaps, so columns stay apart."""
    out: list[Box] = []
    for line in lines(words):
        widest = max(LEAST_GAP, GAP_OF_HEIGHT * max((w.height for w in line if w.height > 0), default=8.0))
        run = line[:1]
        for w in line[1:]:
            if w.x0 - run[-1].x1 > widest:
                out.append(join(run))
                run = []
            run.append(w)
        out.append(join(run))
    return out


def below(all_: list[Box], at: Box, most_lines: float = 3.0) -> Box | None:
    """The nearest segment under one, in its column."""
    tall = max(at.height, 6.0)

    def fits(o: Box) -> bool:
        under = o is not at and o.y0 > at.y0 + tall / 2 and o.y0 - at.y1 <= tall * most_lines
        return under and (min(o.x1, at.x1) > max(o.x0, at.x0) or abs(o.x0 - at.x0) <= COLUMN_SHIFT)

    return min((o for o in all_ if fits(o)), key=lambda o: o.y0, default=None)


def column_below(all_: list[Box], at: Box, stop, most: int = 1500) -> str:
    out: list[str] = []
    while (n := below(all_, at, 2.5)) and not stop(n.text) and sum(map(len, out)) <= most:
        out.append(n.text)
        at = n
    return " ".join(out).strip()


def reading_order(all_: list[Box], width: float, wide: float = 0.6) -> list[tuple[str, float | None, bool]]:
    """text, gap above in heights and whether a column begins, for segments in the order they are read.

    A segment over most of the page's width stands by itself; between two of those, columns are read
    one after the other, each from the top.
    """
    if not all_:
        return []
    bands: list[list[Box]] = [[]]
    for b in sorted(all_, key=lambda b: (b.yc, b.x0)):
        if b.x1 - b.x0 > wide * width:
            bands += [[b], []]
        else:
            bands[-1].append(b)
    columns: list[list[Box]] = []
    for band in bands:
        reach = None
        for b in sorted(band, key=lambda b: b.x0):
            if reach is None or b.x0 > reach:
                columns.append([])
                reach = b.x1
            columns[-1].append(b)
            reach = max(reach, b.x1)
    out: list[tuple[str, float | None, bool]] = []
    last = None
    for column in columns:
        for b in sorted(column, key=lambda b: (b.y0, b.x0)):
            under = last is not None and b.y0 >= last.y0 and (min(b.x1, last.x1) > max(b.x0, last.x0) or abs(b.x0 - last.x0) <= COLUMN_SHIFT)
            out.append((b.text, (b.y0 - last.y1) / max(last.height, 6.0) if under else None, not under))
            last = b
    return out


#: ASCII signs that a spelling of a module can begin with, white space and characters that are made plain included; others need no look.
_BEGIN = {*"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ", ""} | {c for name in _MODULE_MAP for c in (name[0].lower(), name[0].upper())} | {chr(k) for k in _PLAIN if k < 128}


#: Headings repeat on page after page.
@lru_cache(maxsize=4096)
def module_header(text: str | None) -> tuple[str | None, str | None]:
    """What functions.domain.module_header does to a column."""
    t = plain(text)
    if known := _MODULE_MAP.get(t.replace(" ", "")):
        return known, None
    m = re.match(SCENARIO, re.sub(r"\s*[-–]\s*a", "-a", t))
    found = m and _MODULE_MAP.get(m[1].replace(" ", ""))
    return (found, m[2].upper()) if found else (None, None)


def module_headings(line: list[Box]) -> list[tuple[Box, str, str | None]]:
    """Headings of modules on a line; up to three words that touch are one, the longest first."""
    out, k = [], 0
    while k < len(line):
        for span in (3, 2, 1):
            part = line[k : k + span]
            if len(part) == span and all(part[i + 1].x0 - part[i].x1 <= WORD_JOIN for i in range(span - 1)):
                if (first := part[0].text[:1]).isascii() and first not in _BEGIN:
                    continue
                box = part[0] if span == 1 else join(part, "")
                module, scenario = module_header(box.text)
                if module:
                    out.append((box, module, scenario))
                    k += span - 1
                    break
        k += 1
    return out
