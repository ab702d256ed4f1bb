"""Table structure on one page: rules to grids, grids to cells, aligned text to tables.

Plain Python on one page's items (tens to hundreds). Rules are tuples (pos, lo, hi): for a
horizontal rule pos is y and lo..hi an x range, for a vertical one the other way round. Words
are (x0, y0, x1, y1, text).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

SNAP = 3.0  # rules and borders nearer than this are one
OVERHANG = 1.0  # a word crosses a border if it stands out by more on both sides
EDGE_MIN = {"lines": 2.0, "lines_strict": 3.0}


def unique_sorted(values, tolerance: float = SNAP) -> list[float]:
    """Ascending values, each more than the tolerance above the last one kept."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > tolerance:
            out.append(v)
    return out


def merge_rules(rules, tolerance: float = SNAP) -> list[tuple[float, float, float]]:
    """Rules of nearly one position that overlap or continue each other become one. Positions
    band together within the tolerance of the band's first."""
    bands: list[list[tuple[float, float, float]]] = []
    for r in sorted(rules):
        if bands and r[0] - bands[-1][0][0] <= tolerance:
            bands[-1].append(r)
        else:
            bands.append([r])
    out: list[list[float]] = []
    for band in bands:
        first = len(out)
        for pos, lo, hi in sorted(band, key=lambda r: r[1:]):
            if len(out) > first and lo <= out[-1][2] + tolerance:
                out[-1][2] = max(out[-1][2], hi)
            else:
                out.append([pos, lo, hi])
    return [tuple(r) for r in out]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def groups(self) -> list[list[int]]:
        by = defaultdict(list)
        for i in range(len(self.up)):
            by[self.find(i)].append(i)
        return list(by.values())


def components(h, v) -> list[tuple[list, list]]:
    """Groups of rules that meet, each rule one point thick on either side; groups of four and
    more with two of each direction."""
    boxes = [(lo, p - 1, hi, p + 1) for p, lo, hi in h] + [(p - 1, lo, p + 1, hi) for p, lo, hi in v]
    u = Union(len(boxes))
    order = sorted(range(len(boxes)), key=lambda i: boxes[i][0])
    active: list[int] = []
    for i in order:  # sweep by left edge
        active = [j for j in active if boxes[j][2] > boxes[i][0]]
        for j in active:
            if boxes[i][1] < boxes[j][3] and boxes[j][1] < boxes[i][3]:
                u.join(i, j)
        active.append(i)
    out = []
    for g in u.groups():
        hs, vs = [h[i] for i in g if i < len(h)], [v[i - len(h)] for i in g if i >= len(h)]
        if len(g) >= 4 and len(hs) >= 2 and len(vs) >= 2:
            out.append((hs, vs))
    return out


@dataclass
class Grid:
    """A table: column and row borders, and the box of each cell (None: covered by a merged one)."""

    xs: list[float]
    ys: list[float]
    cells: list[list[tuple[float, float, float, float] | None]] = field(default_factory=list)

    @property
    def box(self):
        return self.xs[0], self.ys[0], self.xs[-1], self.ys[-1]


def _covered(rules, pos: float, lo: float, hi: float) -> bool:
    return any(abs(p - pos) <= SNAP and a <= lo + SNAP and b >= hi - SNAP for p, a, b in rules)


def build_cells(xs: list[float], ys: list[float], h, v, words) -> list[list[tuple | None]]:
    """Cells of a grid. In each row, a run of borders without a full rule falls if a word crosses
    any of them; likewise down each column. Groups that are no rectangles stay unmerged."""
    rows, cols = len(ys) - 1, len(xs) - 1
    u = Union(rows * cols)

    def crossed(border: float, lo: float, hi: float, axis: int) -> bool:
        for w in words:
            a, b, c = w[axis], w[axis + 2], (w[1 - axis] + w[3 - axis]) / 2
            if a < border - OVERHANG and b > border + OVERHANG and lo <= c < hi:
                return True
        return False

    for r in range(rows):
        run: list[int] = []
        for c in range(1, cols + 1):
            if c < cols and not _covered(v, xs[c], ys[r], ys[r + 1]):
                run.append(c)
                continue
            if run and any(crossed(xs[k], ys[r], ys[r + 1], 0) for k in run):
                for k in run:
                    u.join(r * cols + k - 1, r * cols + k)
            run = []
    for c in range(cols):
        run = []
        for r in range(1, rows + 1):
            if r < rows and not _covered(h, ys[r], xs[c], xs[c + 1]):
                run.append(r)
                continue
            if run and any(crossed(ys[k], xs[c], xs[c + 1], 1) for k in run):
                for k in run:
                    u.join((k - 1) * cols + c, k * cols + c)
            run = []
    out: list[list[tuple | None]] = [[(xs[c], ys[r], xs[c + 1], ys[r + 1]) for c in range(cols)] for r in range(rows)]
    for g in u.groups():
        rs, cs = [i // cols for i in g], [i % cols for i in g]
        r0, r1, c0, c1 = min(rs), max(rs), min(cs), max(cs)
        if len(g) > 1 and len(g) == (r1 - r0 + 1) * (c1 - c0 + 1):
            for i in g:
                out[i // cols][i % cols] = None
            out[r0][c0] = (xs[c0], ys[r0], xs[c1 + 1], ys[r1 + 1])
    return out


def grid_tables(h, v, words, strategy: str = "lines_strict") -> list[Grid]:
    """Tables of a page from its rules, by left edge and top."""
    least = EDGE_MIN[strategy]
    h = merge_rules([r for r in h if r[2] - r[1] >= least])
    v = merge_rules([r for r in v if r[2] - r[1] >= least])
    out = []
    for hs, vs in components(h, v):
        g = explicit_grid([r[0] for r in hs], [r[0] for r in vs], hs, vs, words)
        if g and len(g.ys) - 1 >= (2 if strategy == "lines_strict" else 1):
            out.append(g)
    return sorted(drop_contained(out), key=lambda g: (g.box[0], g.box[1]))


def explicit_grid(ys, xs, h, v, words) -> Grid | None:
    xs, ys = unique_sorted(xs), unique_sorted(ys)
    if len(xs) < 3 or len(ys) < 2:
        return None
    return Grid(xs, ys, build_cells(xs, ys, h, v, words))


def drop_contained(grids: list[Grid]) -> list[Grid]:
    """Without tables inside another; of equal ones the earlier stays."""
    out = []
    for i, g in enumerate(grids):
        a = g.box
        inside = lambda o, b, i=i, a=a: b[0] <= a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3] and (b != a or o < i)
        if not any(inside(o, x.box) for o, x in enumerate(grids) if o != i):
            out.append(g)
    return out


# --- tables without rules ----------------------------------------------------------------

SHARED = 6.0  # starts nearer than this are one column
MIN_SHARED = 2


@dataclass
class Row:
    box: list[float]
    pieces: list[list[float]]  # x0, y0, x1, y1 of each word group
    starts: list[float]
    lines: int = 1


def text_rows(pieces) -> list[Row]:
    """Pieces of text (x0, y0, x1, y1) banded to rows: vertical overlap of half the lower height,
    no overlap of more than 3 sideways; the same box again is overprint and falls."""
    rows: list[Row] = []
    for p in sorted({tuple(p) for p in pieces}, key=lambda p: (p[1], p[0])):
        best = None
        for r in reversed(rows):
            if r.box[3] <= p[1]:
                if p[1] - r.box[3] > 200:
                    break
                continue
            over = min(r.box[3], p[3]) - max(r.box[1], p[1])
            if over >= 0.5 * min(r.box[3] - r.box[1], p[3] - p[1]) and not any(min(q[2], p[2]) - max(q[0], p[0]) > SNAP for q in r.pieces):
                best = r
                break
        if best is None:
            rows.append(Row(list(p), [list(p)], [p[0]]))
        else:
            best.pieces.append(list(p))
            best.box = [min(best.box[0], p[0]), min(best.box[1], p[1]), max(best.box[2], p[2]), max(best.box[3], p[3])]
    for r in rows:
        r.pieces.sort()
        r.starts = [q[0] for q in r.pieces]
    return sorted(rows, key=lambda r: (r.box[1], r.box[0]))


def row_clusters(rows: list[Row]) -> list[list[Row]]:
    """Rows in a row: a gap over two heights or fewer than two shared starts ends a cluster."""
    out: list[list[Row]] = []
    for r in rows:
        if out:
            last = out[-1][-1]
            shared = sum(any(abs(s - t) <= SHARED for t in last.starts) for s in r.starts)
            if r.box[1] - last.box[3] <= 2 * (last.box[3] - last.box[1]) and shared >= min(MIN_SHARED, len(r.starts), len(last.starts)) and shared >= MIN_SHARED:
                out[-1].append(r)
                continue
        out.append([r])
    return [c for c in out if len(c) >= 2 and all(len(r.starts) >= 2 for r in c)]


HEADER_UP, HEADER_ASIDE = 6.0, 4.0  # row heights a header may reach above and beside its table


def header_above(rows: list[Row], cluster: list[Row], xs: list[float]) -> tuple[float, list[float]] | None:
    """Top of the header over a cluster, and the column borders moved left to its labels.

    Bands go upward from the first row while each is near. A piece that overlaps one column by
    more than SNAP labels it; one that overlaps several ends the search. Two labelled columns
    and half of all are needed.
    """
    first = cluster[0]
    tall = first.box[3] - first.box[1]
    gaps = sorted(b.box[1] - a.box[3] for a, b in zip(cluster, cluster[1:], strict=False))
    reach = max(0.0, gaps[len(gaps) // 2]) + 0.75 * tall
    limit, top, borders, labelled = first.box[1] - HEADER_UP * tall, first.box[1], list(xs), set()
    for r in sorted((r for r in rows if r.box[3] <= first.box[1] + SNAP and all(r is not c for c in cluster)), key=lambda r: -r.box[3]):
        if top - r.box[3] > reach or r.box[1] < limit:
            break
        found = []
        for p in r.pieces:
            if p[2] < xs[0] - HEADER_ASIDE * tall or p[0] > xs[-1] + HEADER_ASIDE * tall:
                continue
            over = [c for c in range(len(xs) - 1) if min(p[2], xs[c + 1]) - max(p[0], xs[c]) > SNAP]
            if len(over) > 1:
                # a label that begins just left of its column belongs to the one it covers most
                share = sorted(((min(p[2], xs[c + 1]) - max(p[0], xs[c])) / (p[2] - p[0]), c) for c in over)
                if share[-1][0] < 0.6:
                    found = []
                    break
                over = [share[-1][1]]
            found += [(c, p) for c in over]
        if not found:
            break
        for c, p in found:
            labelled.add(c)
            if 0 < c < len(xs) - 1 and p[0] < borders[c]:
                borders[c] = p[0]
        top = r.box[1]
    ok = len(labelled) >= 2 and 2 * len(labelled) >= len(xs) - 1 and all(a < b for a, b in zip(borders, borders[1:], strict=False))
    return (top, borders) if ok else None


def text_tables(pieces) -> list[Grid]:
    """Tables from the alignment of text alone, with header labels set above them."""
    out = []
    rows = text_rows(pieces)
    for cluster in row_clusters(rows):
        starts = unique_sorted([s for r in cluster for s in r.starts], SHARED)
        kept = []
        for s in starts:
            own = sum(any(abs(s - t) <= SHARED for t in r.starts) for r in cluster)
            cross = sum(any(q[0] < s - SHARED and q[2] > s + OVERHANG for q in r.pieces) for r in cluster)
            if cross < min(2, own) or not cross:
                kept.append(s)
        if len(kept) < 2:
            continue
        wide = [sum(q[2] - q[0] for q in r.pieces) / max(r.box[2] - r.box[0], 1e-9) for r in cluster if len(r.pieces) > 1]
        if wide and sorted(wide)[len(wide) // 2] > 0.95:
            continue  # running text set in columns, not a table
        right = max(r.box[2] for r in cluster) + 1
        ys = [cluster[0].box[1]]
        for a, b in zip(cluster, cluster[1:], strict=False):
            ys.append(max((a.box[3] + b.box[1]) / 2, b.box[1] - 1))
        ys.append(cluster[-1].box[3] + 1)
        xs = [*kept, right]
        if head := header_above(rows, cluster, xs):
            ys = [head[0], max((head[0] + ys[0]) / 2, ys[0] - 1), *ys[1:]]
            xs = head[1]
        if any(b <= a for a, b in zip(ys, ys[1:], strict=False)):
            continue
        out.append(Grid(xs, ys, [[(xs[c], ys[r], xs[c + 1], ys[r + 1]) for c in range(len(xs) - 1)] for r in range(len(ys) - 1)]))
    return sorted(drop_contained(out), key=lambda g: (g.box[0], g.box[1]))


def place(grid: Grid, x: float, y: float) -> tuple[int, int] | None:
    """Row and column of the cell that holds a point, half-open."""
    c, r = bisect_right(grid.xs, x) - 1, bisect_right(grid.ys, y) - 1
    if not (0 <= c < len(grid.xs) - 1 and 0 <= r < len(grid.ys) - 1):
        return None
    if grid.cells[r][c] is not None:
        return r, c
    for i in range(r, -1, -1):
        for j in range(c, -1, -1):
            b = grid.cells[i][j]
            if b and b[0] <= x < b[2] and b[1] <= y < b[3]:
                return i, j
    return None


def cell_texts(grid: Grid, words) -> list[list[str | None]]:
    """Text of each cell, words by line and left edge; None where a merged cell covers it."""
    held: dict[tuple[int, int], list] = defaultdict(list)
    for w in words:
        at = place(grid, (w[0] + w[2]) / 2, (w[1] + w[3]) / 2)
        if at:
            held[at].append(w)
    out: list[list[str | None]] = []
    for r, row in enumerate(grid.cells):
        line: list[str | None] = []
        for c, box in enumerate(row):
            if box is None:
                line.append(None)
                continue
            lines: list[list] = []
            for w in sorted(held.get((r, c), ()), key=lambda w: (w[3], w[0])):
                if lines and abs(w[3] - lines[-1][-1][3]) <= SNAP:
                    lines[-1].append(w)
                else:
                    lines.append([w])
            line.append("\n".join(" ".join(w[4] for w in sorted(ws)) for ws in lines))
        out.append(line)
    return out


def to_markdown(cells: list[list[str | None]], style=lambda s: s) -> str:
    """Header row, separator, body; line ends become ``<br>``, covered cells empty."""

    def one(s: str | None) -> str:
        return escape((s or "").replace("\n", "<br>"))

    rows = ["|" + "|".join(one(s) for s in cells[0]) + "|", "|" + "---|" * len(cells[0])]
    rows += ["|" + "|".join(style(one(s)) if s else "" for s in r) + "|" for r in cells[1:]]
    return "\n".join(rows) + "\n\n"


def escape(s: str) -> str:
    out, i = [], 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == "\\":
            j += 1
        if j > i:
            out.append("\\" * (2 * (j - i) if j == len(s) or s[j] == "|" else j - i))
            i = j
            continue
        out.append("\\|" if s[i] == "|" else s[i])
        i += 1
    return "".join(out)
