"""Page pixels: ink, skew, rules, grids, text lines, crops. numpy on one page's gray image.

A raster is an 8-bit gray array with ``scale`` pixels a point. Pixel (x, y) covers page
x / scale + ox to (x + 1) / scale + ox. All steps are deterministic and keep no state but the
raster's own memo.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np

from pagemill.operators.table_kernel import Grid, build_cells, components, drop_contained, merge_rules, unique_sorted

# Fixed values of the pixel strategy, in points unless said otherwise.
PAD, TILE, INK_RATIO, FAINT_RATIO, TYPICAL = 8, 24, 0.7, 0.9, 0.8
MIN_RULE, RULE_INK, MIN_COLUMN, DOUBLE, PIECE_GAP = 24.0, 0.9, 8.0, 4.0, 60.0
SIDE_MIN, SIDE_MAX, SIDE_LONG = 0.4, 0.9, 72.0
LEAN_RULE, LEAN_MAX, LEAN_SPREAD, LEAN_SAMPLES = 72.0, 3.0, 0.15, 10
AXIS_VOTES, MIN_GLYPHS, SAMPLE_LINES, FLIP_MARGIN = 3, 200, 4, 1.2
WHITE = 255


class Raster:
    def __init__(self, gray: np.ndarray, scale: float = 1.0, ox: float = 0.0, oy: float = 0.0):
        self.gray, self.scale, self.ox, self.oy = np.ascontiguousarray(gray, np.uint8), float(scale), float(ox), float(oy)
        self.height, self.width = self.gray.shape

    # coordinates
    def page_x(self, x: float) -> float:
        return (x + 0.5) / self.scale + self.ox

    def page_y(self, y: float) -> float:
        return (y + 0.5) / self.scale + self.oy

    def pixel_x(self, x: float) -> int:
        return int(min(max(math.floor((x - self.ox) * self.scale), 0), self.width - 1))

    def pixel_y(self, y: float) -> int:
        return int(min(max(math.floor((y - self.oy) * self.scale), 0), self.height - 1))

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.ox, self.oy, self.ox + self.width / self.scale, self.oy + self.height / self.scale

    # ink
    @cached_property
    def background(self) -> np.ndarray:
        """Brightness at the 90th percentile of each tile, and of the page the upper median of these."""
        t = max(1, round(TILE * self.scale))
        rows, cols = -(-self.height // t), -(-self.width // t)
        out = np.empty((rows, cols))
        for r in range(rows):
            for c in range(cols):
                part = np.sort(self.gray[r * t : (r + 1) * t, c * t : (c + 1) * t], axis=None)
                out[r, c] = part[min(len(part) - 1, int(0.9 * len(part)))]
        return out

    def darker(self, ratio: float) -> np.ndarray:
        """Pixels under the ratio of their tile's background; dark tiles count as TYPICAL of the page."""
        t = max(1, round(TILE * self.scale))
        flat = np.sort(self.background, axis=None)
        level = ratio * np.maximum(self.background, TYPICAL * flat[len(flat) // 2])
        full = np.repeat(np.repeat(level, t, axis=0), t, axis=1)[: self.height, : self.width]
        return self.gray < full

    @cached_property
    def ink(self) -> np.ndarray:
        m = self.darker(INK_RATIO)
        if self.scale >= 3:  # specks: fewer than two inked neighbours
            n = np.pad(m, 1).astype(np.int8)
            around = sum(n[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - m
            m = m & (around >= 2)
        return m

    @cached_property
    def faint(self) -> np.ndarray:
        return self.darker(FAINT_RATIO)

    # skew
    @cached_property
    def skew(self) -> float:
        """Degrees by which rows lean: the angle whose row profile is the sharpest, to 0.025."""
        ys, xs = np.nonzero(self.ink)
        if len(xs) < 50:
            return 0.0
        step = max(1, len(xs) // 20_000)
        ys, xs = ys[::step].astype(float), xs[::step] - self.width / 2

        def sharp(a: float) -> float:
            b = np.bincount(np.clip(np.round(ys - xs * math.tan(math.radians(a))).astype(int) + self.height, 0, 3 * self.height))
            return float((b.astype(float) ** 2).sum())

        best = max(np.arange(-3, 3.01, 0.2), key=lambda a: (sharp(a), -abs(a)))
        return round(float(max(np.arange(best - 0.2, best + 0.201, 0.025), key=lambda a: (sharp(a), -abs(a)))), 3)

    @cached_property
    def lean(self) -> float:
        """Degrees by which columns lean from the vertical, by fits through long vertical rules."""
        angles = []
        for x, lo, hi in rules(self, vertical=True, loose=True):
            if hi - lo < LEAN_RULE:
                continue
            c, a, b = self.pixel_x(x), self.pixel_y(lo), self.pixel_y(hi)
            reach = max(2, round(3 * self.scale))
            band = self.ink[a : b + 1, max(0, c - reach) : c + reach + 1]
            ys, xs = np.nonzero(band)
            if len(np.unique(ys)) < LEAN_SAMPLES:
                continue
            means = np.array([xs[ys == y].mean() for y in np.unique(ys)])
            slope = np.polyfit(np.unique(ys), means, 1)[0]
            angles.append(math.degrees(math.atan(slope)))
        if len(angles) < 2:
            return 0.0
        v = sorted(angles)
        mid = v[len(v) // 2]
        return mid if abs(mid) <= LEAN_MAX and max(abs(a - mid) for a in v) <= max(LEAN_SPREAD, 0.2 * abs(mid)) else 0.0

    def deskewed(self, lean: float = 0.0) -> Raster:
        """Rotated by the skew and sheared by the lean in one bilinear pass; outside is white."""
        a, s = math.radians(self.skew), math.tan(math.radians(lean))
        if not a and not s:
            return self
        cy, cx = (self.height - 1) / 2, (self.width - 1) / 2
        y, x = np.mgrid[0 : self.height, 0 : self.width].astype(float)
        dx, dy = x - cx, y - cy
        sx = cx + math.cos(a) * dx - math.sin(a) * dy + s * dy
        sy = cy + math.sin(a) * dx + math.cos(a) * dy
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        fx, fy = sx - x0, sy - y0
        pad = np.pad(self.gray, 1, constant_values=WHITE).astype(float)
        at = lambda yy, xx: pad[np.clip(yy + 1, 0, self.height + 1), np.clip(xx + 1, 0, self.width + 1)]
        v = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
        return Raster(np.round(v).astype(np.uint8), self.scale, self.ox, self.oy)

    def turned(self, quarter: int) -> Raster:
        """Turned by 90, 180 or 270 degrees clockwise."""
        return Raster(np.rot90(self.gray, -(quarter // 90) % 4), self.scale, self.ox, self.oy)

    # crops
    def crop(self, box: tuple[float, float, float, float], inset: float = 1.0) -> np.ndarray | None:
        """Gray image of a cell on a white pad, its border rules trimmed; None if next to blank."""
        x0, x1 = self.pixel_x(box[0] + inset), self.pixel_x(box[2] - inset)
        y0, y1 = self.pixel_y(box[1] + inset), self.pixel_y(box[3] - inset)
        if x1 <= x0 or y1 <= y0:
            return None
        ink, gray = self.ink[y0 : y1 + 1, x0 : x1 + 1].copy(), self.gray[y0 : y1 + 1, x0 : x1 + 1].copy()
        edge = max(1, round(2 * self.scale))
        for k in range(edge):  # rule pieces that reach into the crop
            for row in (k, -1 - k):
                if k < len(ink) and ink[row].mean() > 0.5:
                    ink[row], gray[row] = False, WHITE
            for col in (k, -1 - k):
                if k < ink.shape[1] and ink[:, col].mean() > 0.5:
                    ink[:, col], gray[:, col] = False, WHITE
        if ink.sum() < max(4, self.scale**2):
            return None
        ys, xs = np.nonzero(ink)
        part = gray[max(0, ys.min() - 1) : ys.max() + 2, max(0, xs.min() - 1) : xs.max() + 2]
        return np.pad(part, PAD, constant_values=WHITE)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of runs of True."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))


def _bridged(runs: list[tuple[int, int]], gap: int) -> list[list[int]]:
    """Runs joined over gaps; each with its inked length."""
    out: list[list[int]] = []
    for a, b in runs:
        if out and a - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = b, out[-1][2] + b - a
        else:
            out.append([a, b, b - a])
    return out


def rules(r: Raster, vertical: bool = False, loose: bool = False, mask: np.ndarray | None = None) -> list[tuple[float, float, float]]:
    """Straight dark lines (pos, lo, hi) in points: long, inked throughout, thin, and with paper
    on both sides."""
    ink = r.ink if mask is None else mask
    m = ink.T if vertical else ink
    gap, least, thick = int(max(2, r.scale)), max(12.0, MIN_RULE * r.scale), max(2.0, 4 * r.scale)
    lines: list[dict] = []
    open_: list[dict] = []
    for y in np.flatnonzero(m.sum(axis=1) >= RULE_INK * least * (0.5 if loose else 1.0)):
        y = int(y)
        open_ = [o for o in open_ if o["y1"] >= y - 1]
        for a, b, n in _bridged(_runs(m[y]), gap):
            if b - a < least * (0.5 if loose else 1.0) or n < RULE_INK * (b - a):
                continue
            met = [o for o in open_ if min(o["b"], b) - max(o["a"], a) > 0.5 * min(o["b"] - o["a"], b - a) and o["y1"] >= y - 1]
            if met:
                o = met[0]
                o["y1"], o["a"], o["b"] = y, min(o["a"], a), max(o["b"], b)
                o["ink"] += n
                o["sum"] += n * y
            else:
                o = {"y0": y, "y1": y, "a": a, "b": b, "ink": n, "sum": n * y}
                lines.append(o)
                open_.append(o)
    out = []
    for o in lines:
        if o["ink"] / (o["b"] - o["a"]) > thick or o["y1"] - o["y0"] + 1 > 3 * thick:
            continue
        pos = o["sum"] / o["ink"]
        if not loose and not _clear_side(m, o, r.scale, vertical):
            continue
        if vertical:
            out.append((r.page_x(pos), r.page_y(o["a"]) - 0.5 / r.scale, r.page_y(o["b"]) - 0.5 / r.scale))
        else:
            out.append((r.page_y(pos), r.page_x(o["a"]) - 0.5 / r.scale, r.page_x(o["b"]) - 0.5 / r.scale))
    return sorted(out)


def _clear_side(m: np.ndarray, o: dict, scale: float, vertical: bool) -> bool:
    """Paper beside a rule: one side nearly free of ink; a long vertical rule may have text by it."""
    d = max(1, round(scale))
    share = []
    for y in (o["y0"] - 1 - d, o["y1"] + 1 + d):
        share.append(float(m[y, o["a"] : o["b"]].mean()) if 0 <= y < m.shape[0] else 0.0)
    return min(share) < SIDE_MIN or (vertical and (o["b"] - o["a"]) / scale >= SIDE_LONG and max(share) < SIDE_MAX)


def text_lines(r: Raster, box: tuple[float, float, float, float], h, v, min_rule: float = 12.0) -> list[tuple[float, float]]:
    """(top, bottom) of the lines of text in a band, rules masked; a valley to a third of both
    peaks parts lines that touch."""
    x0, x1, y0, y1 = r.pixel_x(box[0]), r.pixel_x(box[2]), r.pixel_y(box[1]), r.pixel_y(box[3])
    m = r.ink[y0 : y1 + 1, x0 : x1 + 1].copy()
    d = max(1, round(1.5 * r.scale))
    for pos, lo, hi in h:
        if hi - lo >= min_rule:
            c = r.pixel_y(pos) - y0
            m[max(0, c - d) : max(0, c + d + 1)] = False
    for pos, lo, hi in v:
        if hi - lo >= min_rule:
            c = r.pixel_x(pos) - x0
            m[:, max(0, c - d) : max(0, c + d + 1)] = False
    rows = m.sum(axis=1)
    out = []
    for a, b in _runs(rows > 0):
        if b - a < max(2, 2 * r.scale):
            continue
        start, profile = a, rows[a:b]
        k = 2
        while k < len(profile) - 2:
            left, right = profile[start - a : k].max(initial=0), profile[k + 1 :].max(initial=0)
            if profile[k] <= 0.35 * min(left, right) and k - (start - a) >= 4 * r.scale and len(profile) - k >= 4 * r.scale:
                out.append((start, a + k))
                start = a + k
                k += int(3 * r.scale)
            k += 1
        out.append((start, b))
    return [(r.page_y(y0 + a) - 0.5 / r.scale, r.page_y(y0 + b) - 0.5 / r.scale) for a, b in out]


def row_breaks(lines: list[tuple[float, float]]) -> list[float]:
    """Borders between rows of text: midway where lines are a full line apart."""
    out = []
    for a, b in zip(lines, lines[1:], strict=False):
        if b[0] - a[1] >= 0.4 * min(a[1] - a[0], b[1] - b[0]):
            out.append((a[1] + b[0]) / 2)
    return out


def find_grids(r: Raster) -> list[Grid]:
    """Tables of a page from its pixels: meeting rules, faded column rules between dark ones, and
    rows by text lines where bands between rules are open."""
    h, v = merge_rules(rules(r)), merge_rules(rules(r, vertical=True))
    out = []
    for hs, vs in components(h, v):
        top, bottom = min(x[0] for x in hs), max(x[0] for x in hs)
        left, right = min(x[0] for x in vs), max(x[0] for x in vs)
        top, bottom = min(top, min(x[1] for x in vs)), max(bottom, max(x[2] for x in vs))
        xs = unique_sorted([x[0] for x in vs], MIN_COLUMN)
        if any(b - a > 120 for a, b in zip(xs, xs[1:], strict=False)):
            dark = {round(x) for x in xs}
            for pos, lo, hi in rules(r, vertical=True, mask=r.faint):
                cover = min(hi, bottom) - max(lo, top)
                if left + MIN_COLUMN < pos < right - MIN_COLUMN and cover >= 0.8 * (bottom - top) and all(abs(pos - x) >= MIN_COLUMN for x in xs) and round(pos) not in dark:
                    xs = sorted([*xs, pos])
                    vs.append((pos, lo, hi))
        hard = unique_sorted([pos for pos, lo, hi in hs if hi - lo >= 0.6 * (right - left)], DOUBLE)
        ys = unique_sorted([top, *hard, bottom], DOUBLE)
        filled = []
        for a, b in zip(ys, ys[1:], strict=False):
            inner = row_breaks(text_lines(r, (left, a, right, b), hs, vs)) if len(hard) <= 3 and b - a > 30 else []
            filled += [a, *inner]
        ys = [*filled, ys[-1]]
        if len(xs) >= 3 and len(ys) >= 2:
            hs = hs + [(y, left, right) for y in ys if y not in hard]
            out.append(Grid(xs, ys, build_cells(xs, ys, hs, vs, [])))
    return sorted(drop_contained(out), key=lambda g: (g.box[0], g.box[1]))


def crop_lines(img: np.ndarray, scale: float) -> list[tuple[int, int]]:
    """Rows [a, b) of the lines of text in a crop: tall enough, wide enough, inked enough."""
    m = img < 128
    rows = m.sum(axis=1)
    runs = _bridged(_runs(rows > 0), int(scale))
    if not runs:
        return []
    tall, most = max(b - a for a, b, _ in runs), max(int(rows[a:b].sum()) for a, b, _ in runs)
    out = []
    for a, b, _ in runs:
        xs = np.flatnonzero(m[a:b].any(axis=0))
        if b - a >= max(3 * scale, tall / 2) and (xs[-1] - xs[0] + 1) / (b - a) >= 0.5 and rows[a:b].sum() >= 0.08 * most:
            out.append((a, b))
    return out


def paper_tone(r: Raster, box: tuple[float, float, float, float]) -> float:
    """Median gray of the pixels without ink; NaN if there is none."""
    x0, x1, y0, y1 = r.pixel_x(box[0]), r.pixel_x(box[2]), r.pixel_y(box[1]), r.pixel_y(box[3])
    g, m = r.gray[y0 : y1 + 1, x0 : x1 + 1], r.ink[y0 : y1 + 1, x0 : x1 + 1]
    return float(np.median(g[~m])) if (~m).any() else math.nan


def glyph_boxes(r: Raster, least: float = 2.0, most: float = 40.0) -> np.ndarray:
    """Boxes (x0, y0, x1, y1) in pixels of connected ink the size of a glyph."""
    m = r.ink
    label = np.zeros(m.shape, np.int32)
    up, boxes = [0], []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    before: list[tuple[int, int, int]] = []
    runs_of: list[tuple[int, int, int, int]] = []
    for y in range(m.shape[0]):
        now = []
        for a, b in _runs(m[y]):
            mine = 0
            for c, d, k in before:
                if c <= b and a <= d:
                    k = find(k)
                    if mine and k != mine:
                        up[max(mine, k)] = min(mine, k)
                        mine = min(mine, k)
                    else:
                        mine = mine or k
            if not mine:
                mine = len(up)
                up.append(mine)
            now.append((a, b, mine))
            runs_of.append((y, a, b, mine))
        before = now
    del label
    if runs_of:
        by: dict[int, list[int]] = {}
        for y, a, b, k in runs_of:
            k = find(k)
            q = by.setdefault(k, [a, y, b, y + 1])
            q[0], q[1], q[2], q[3] = min(q[0], a), min(q[1], y), max(q[2], b), y + 1
        boxes = [q for q in by.values() if least * r.scale <= max(q[2] - q[0], q[3] - q[1]) <= most * r.scale]
    return np.array(boxes, float).reshape(-1, 4)


def ink_axis(boxes: np.ndarray) -> str:
    """``across``, ``down`` or ``unknown``: the way the nearest neighbours of glyphs lie."""
    n = len(boxes)
    if n < MIN_GLYPHS:
        return "unknown"
    cx, cy = (boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2
    cell = max(1.0, 3 * float(np.median(np.maximum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]))))
    grid: dict[tuple[int, int], list[int]] = {}
    for i in range(n):
        grid.setdefault((int(cx[i] // cell), int(cy[i] // cell)), []).append(i)
    across = down = 0
    for i in range(n):
        gx, gy = int(cx[i] // cell), int(cy[i] // cell)
        near = [j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in grid.get((gx + a, gy + b), ()) if j != i]
        if not near:
            continue
        gap = lambda j, i=i: math.hypot(max(0.0, boxes[i, 0] - boxes[j, 2], boxes[j, 0] - boxes[i, 2]), max(0.0, boxes[i, 1] - boxes[j, 3], boxes[j, 1] - boxes[i, 3]))
        j = min(near, key=lambda j: (gap(j), j))
        dx, dy = abs(cx[i] - cx[j]), abs(cy[i] - cy[j])
        across += dx > 2 * dy
        down += dy > 2 * dx
    return "across" if across > AXIS_VOTES * down else "down" if down > AXIS_VOTES * across else "unknown"


def scan_turn(r: Raster, has_text: bool) -> int:
    """90 for a page without a text layer whose ink runs down, else 0."""
    return 90 if not has_text and ink_axis(glyph_boxes(r)) == "down" else 0


def sample_lines(r: Raster) -> list[np.ndarray]:
    """Images of the widest lines of text, for a look at the page's direction."""
    found = []
    for a, b in _runs(r.ink.any(axis=1)):
        if 4 <= (b - a) / r.scale <= 40:
            for c, d, _ in _bridged(_runs(r.ink[a:b].any(axis=0)), int(10 * r.scale)):
                if r.ink[a:b, c:d].mean() < 0.5:
                    found.append((d - c, a, b, c, d))
    found.sort(key=lambda f: (-f[0], f[1], f[3]))
    return [np.pad(r.gray[a:b, c:d], PAD, constant_values=WHITE) for _, a, b, c, d in found[:SAMPLE_LINES]]


def upside_down(r: Raster, read, score) -> bool:
    """Whether the widest lines read better turned around; ``read`` is an engine's recognise."""
    as_is = turned = 0.0
    for img in sample_lines(r):
        as_is += score(read(img)[0])
        turned += score(read(img[::-1, ::-1])[0])
    return turned > 0 and turned > FLIP_MARGIN * max(0.0, as_is)


def render(width: float, height: float, edges=(), chars=(), images=(), scale: float = 2.0) -> Raster:
    """A page drawn from its relations: images, rules, and characters as bars of ink."""
    g = np.full((max(1, math.ceil(height * scale)), max(1, math.ceil(width * scale))), WHITE, np.uint8)

    def fill(x0, y0, x1, y1, tone):
        a, b = max(0, round(x0 * scale)), max(0, round(y0 * scale))
        g[b : max(b + 1, round(y1 * scale)), a : max(a + 1, round(x1 * scale))] = tone

    for box, pic in images:
        x0, y0, x1, y1 = (max(0, round(v * scale)) for v in box)
        x1, y1 = min(x1, g.shape[1]), min(y1, g.shape[0])
        if x1 > x0 and y1 > y0 and pic is not None:
            p = pic if pic.ndim == 2 else pic.mean(axis=2).astype(np.uint8)
            g[y0:y1, x0:x1] = p[(np.arange(y1 - y0) * p.shape[0] // (y1 - y0))[:, None], (np.arange(x1 - x0) * p.shape[1] // (x1 - x0))[None, :]]
    for kind, pos, lo, hi, wide in edges:
        half = max(wide, 1 / scale) / 2
        fill(*((lo, pos - half, hi, pos + half) if kind == "h" else (pos - half, lo, pos + half, hi)), 0)
    for x0, y0, x1, y1, c in chars:
        if not c.isspace():
            w, h = x1 - x0, y1 - y0
            fill(x0 + 0.15 * w, y0 + 0.2 * h, x0 + 0.4 * w, y1 - 0.2 * h, 40)
            fill(x0 + 0.15 * w, y0 + 0.45 * h, x1 - 0.15 * w, y0 + 0.6 * h, 40)
    return Raster(g, scale)
