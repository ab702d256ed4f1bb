"""Column boxes of a page and Markdown of its lines. Plain Python on one page's items."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

Box = tuple[float, float, float, float]
ALIGN, JOIN_GAP = 3.0, 10.0


def _union(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def _meets(a: Box, b: Box) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def _touches(a: Box, b: Box) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def column_boxes(blocks: list[Box], vertical: list[Box] = ()) -> list[Box]:
    """Column rectangles of a page from its text blocks, in reading order.

    Blocks, top down, extend the first rectangle they overlap sideways if the union meets no
    vertical text, no other rectangle and no block still to come; else they begin one. Then rows
    are straightened, near edges aligned, stacked rectangles of equal sides joined, and pairs
    whose union touches no third.
    """
    todo = sorted((b for b in blocks if b[0] < b[2] and b[1] < b[3]), key=lambda b: (b[1], b[0]))
    out: list[Box] = []
    for i, b in enumerate(todo):
        rest = todo[i + 1 :]
        for k, r in enumerate(out):
            if not (r[0] < b[2] and b[0] < r[2]):
                continue
            u = _union(r, b)
            if any(_touches(u, v) for v in vertical) or any(_meets(u, o) for j, o in enumerate(out) if j != k) or any(_meets(u, x) for x in rest if not _inside(x, u)):
                continue
            out[k] = u
            break
        else:
            out.append(b)
    return order_columns(_join_rest(_join_aligned(_straighten(out))))


def _inside(a: Box, b: Box) -> bool:
    return b[0] <= a[0] and b[1] <= a[1] and a[2] <= b[2] and a[3] <= b[3]


def _straighten(boxes: list[Box]) -> list[Box]:
    """Without repeated neighbours; runs of bottoms within ALIGN of the run's first by left edge."""
    seen = [b for i, b in enumerate(boxes) if not i or b != boxes[i - 1]]
    out: list[Box] = []
    run: list[Box] = []
    for b in seen:
        if run and abs(b[3] - run[0][3]) > ALIGN:
            out += sorted(run)
            run = []
        run.append(b)
    return out + sorted(run)


def _join_aligned(boxes: list[Box]) -> list[Box]:
    fixed: list[Box] = []
    for b in boxes:
        x0 = next((f[0] for f in fixed if abs(f[0] - b[0]) <= ALIGN), b[0])
        x1 = next((f[2] for f in fixed if abs(f[2] - b[2]) <= ALIGN), b[2])
        fixed.append((min(x0, b[0]), b[1], max(x1, b[2]), b[3]))
    out: list[Box] = []
    for b in sorted(fixed, key=lambda b: (b[0], b[1])):
        if out and abs(out[-1][0] - b[0]) <= ALIGN and abs(out[-1][2] - b[2]) <= ALIGN and b[1] - out[-1][3] <= JOIN_GAP:
            out[-1] = _union(out[-1], b)
        else:
            out.append(b)
    return out


def _join_rest(boxes: list[Box]) -> list[Box]:
    """Join pairs of one column whose union touches no third box, until none is left."""
    out = list(boxes)
    moved = True
    while moved and len(out) > 1:
        moved = False
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                if out[j][0] > out[i][2] or out[j][2] < out[i][0]:
                    continue  # another column
                u = _union(out[i], out[j])
                if not any(_touches(u, o) for k, o in enumerate(out) if k not in (i, j)):
                    out[i] = u
                    del out[j]
                    moved = True
                    break
            if moved:
                break
    return out


def order_columns(boxes: list[Box]) -> list[Box]:
    """By the top of the nearest left neighbour at the same height, else the own top, then left."""

    def key(b: Box):
        left = [o for o in boxes if o[2] < b[0] and o[1] <= b[3] and o[3] >= b[1]]
        return (max(left, key=lambda o: o[2])[1] if left else b[1], b[0])

    return sorted(boxes, key=key)


# --- lines to Markdown -------------------------------------------------------------------

ITALIC, MONO, BOLD, SUPER, CHAR_BOLD = 2, 8, 16, 1, 8
BULLETS = frozenset("*->o¶·‐‑‒–—―†‡•−∙�" + chr(0xF0A7) + chr(0xF0B7)) | {chr(c) for c in range(0x25A0, 0x2600)}


@dataclass
class Span:
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    size: float = 11.0
    flags: int = 0
    char_flags: int = 0
    block: int = 0
    level: int | None = None
    uri: str | None = None

    @property
    def bold(self) -> bool:
        return bool(self.flags & BOLD or self.char_flags & CHAR_BOLD)

    @property
    def italic(self) -> bool:
        return bool(self.flags & ITALIC)

    @property
    def mono(self) -> bool:
        return bool(self.flags & MONO)


@dataclass(frozen=True)
class Style:
    """What the element whitelist and the options leave."""

    bold: bool = True
    italic: bool = True
    code: bool = True
    code_block: bool = True
    header: bool = True
    bullets: bool = True
    links: bool = True


@dataclass
class Line:
    spans: list[Span] = field(default_factory=list)

    @property
    def box(self) -> Box:
        return min(s.x0 for s in self.spans), min(s.y0 for s in self.spans), max(s.x1 for s in self.spans), max(s.y1 for s in self.spans)


def raw_lines(spans: list[Span], tolerance: float = 3.0) -> list[Line]:
    """Visual lines by bottom edge, neighbours of equal flags joined."""
    rows: list[list[Span]] = []
    last: Span | None = None
    for s in sorted(spans, key=lambda s: s.y1):
        if last is not None and (abs(s.y1 - last.y1) <= tolerance or abs(s.y0 - last.y0) <= tolerance):
            rows[-1].append(s)
        else:
            rows.append([s])
        last = s
    return [Line(_joined(sorted(r, key=lambda s: s.x0))) for r in rows]


def _joined(row: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in row:
        p = out[-1] if out else None
        if p and s.x0 - p.x1 <= 0.1 * s.size and s.flags == p.flags and (s.char_flags & ~2) == (p.char_flags & ~2) and s.uri == p.uri:
            again = s.text == p.text and (s.x0, s.x1) == (p.x0, p.x1)
            out[-1] = Span(p.text if again else p.text + s.text, min(p.x0, s.x0), min(p.y0, s.y0), max(p.x1, s.x1), max(p.y1, s.y1), p.size, p.flags, p.char_flags, p.block, p.level, p.uri)
        else:
            out.append(Span(**vars(s)))
    return out


def _bullet(text: str) -> bool:
    return bool(text) and text[0] in BULLETS and (len(text) == 1 or text[1] == " ")


def _once(text: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        text = text.replace(a, b)
    return text


def write_lines(lines: list[Line], clip: Box, tables: list[tuple[Box, str]] = (), images: list[Box] = (), style: Style = Style()) -> tuple[str, list[int]]:
    """Markdown of one column box and the numbers of the tables it took in.

    A table goes before the first line at or below its bottom that overlaps it sideways. Lines
    over tables or images are left out.
    """
    out: list[str] = []
    used: list[int] = []
    heading, fence, before, block = 0, False, None, None
    shown = [ln for ln in lines if not any(_meets(ln.box, t) for t, _ in tables) and not any(_meets(ln.box, i) for i in images)]
    for ln in shown:
        x0, y0, x1, y1 = ln.box
        for k, (t, md) in enumerate(tables):
            if k not in used and t[3] <= y0 and x0 < t[2] and t[0] < x1:
                out.append("\n" + md + "\n")
                used.append(k)
                heading, before = 0, None
        gap = before is not None and y1 - before > 1.5 * (y1 - y0)
        before = y1
        level = min((s.level for s in ln.spans if s.level), default=0) if style.header else 0
        mono = style.code_block and all(s.mono for s in ln.spans)
        text = " ".join(s.text.strip() for s in ln.spans) if level or not mono else "".join(s.text for s in ln.spans)
        if fence and (level or not mono):
            out.append("```\n")
            fence = False
        if level:
            t = text
            if style.code and all(s.mono for s in ln.spans):
                t = f"`{t}`"
            if style.italic and all(s.italic for s in ln.spans):
                t = f"_{t}_"
            if style.bold and all(s.bold for s in ln.spans):
                t = f"**{t}**"
            if heading == level:
                while out and out[-1].endswith("\n"):
                    out[-1] = out[-1].rstrip("\n")
                    if not out[-1]:
                        out.pop()
                out.append(f" {t}\n\n")
            else:
                out.append(("\n" if gap else "") + "#" * level + f" {t}\n\n")
            heading, block = level, ln.spans[0].block
            continue
        heading = 0
        if gap and not fence:
            out.append("\n")
        if mono:
            if not fence:
                out.append("```\n")
                fence = True
            out.append(" " * max(0, int((x0 - clip[0]) / (ln.spans[0].size * 0.5))) + text + "\n")
            continue
        first = ln.spans[0]
        if block is not None and first.block != block or gap or first.text.startswith("[") or _bullet(first.text) or first.flags & SUPER:
            out.append("\n")
        block = first.block
        for s in ln.spans:
            t = s.text.strip()
            if style.bullets and s is first and _bullet(t):
                per = (s.x1 - s.x0) / len(s.text) if s.x1 > s.x0 and s.text else s.size / 2
                out.append(" " * max(0, int((s.x0 - clip[0]) / per + 0.5)) + "- " + t[1:].strip().replace("  ", " ") + " ")
                continue
            if style.links and s.uri:
                t = f"[{t}]({s.uri})"
            if style.code and s.mono:
                t = f"`{t}`"
            if style.bold and s.bold:
                t = f"**{t}**"
            if style.italic and s.italic:
                t = f"_{t}_"
            out.append(t + " ")
        out.append("\n")
    out.append("\n")
    if fence:
        out.append("```\n")
    return _once("".join(out) + "\n\n", (" \n", "\n"), ("  ", " "), ("\n\n\n", "\n\n")), used


def page_markdown(spans: list[Span], clip: Box, tables: list[tuple[Box, str]] = (), images: list[tuple[Box, str]] = (), style: Style = Style()) -> str:
    """Markdown of a page: its column boxes in order, then tables and images not placed yet."""
    seen = [s for s in spans if s.text.strip()]
    blocks: dict[int, Box] = {}
    for s in seen:
        b = (s.x0, s.y0, s.x1, s.y1)
        if any(_meets(b, t) for t, _ in tables):
            continue
        blocks[s.block] = _union(blocks[s.block], b) if s.block in blocks else b
    columns = column_boxes(list(blocks.values())) or [clip]
    left = list(enumerate(tables))
    out = []
    for col in columns:
        mine = [s for s in seen if _mostly(s, col)]
        md, used = write_lines(raw_lines(mine), col, [t for _, t in left], [b for b, _ in images], style)
        out.append(md)
        left = [x for k, x in enumerate(left) if k not in used]
    text = _once("".join(out), (" ,", ","), ("-\n", ""))
    for _, (_, md) in left:
        text += "\n" + md + "\n"
    for _, ref in images:
        if ref:
            text += f"\n![]({ref})\n"
    return re.sub(r"^\n+", "", text).replace("\x00", "�")


def _mostly(s: Span, box: Box, share: float = 0.8) -> bool:
    w, h = min(s.x1, box[2]) - max(s.x0, box[0]), min(s.y1, box[3]) - max(s.y0, box[1])
    return w > 0 and h > 0 and w * h > share * (s.x1 - s.x0) * (s.y1 - s.y0)
