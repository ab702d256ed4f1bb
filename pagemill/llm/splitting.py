"""Cut oversized Markdown texts into pieces under a limit, at natural boundaries.

Method: agglomerative merging. A text falls into atomic segments at every place where a cut
is conceivable; adjacent pairs wait in a heap, the weakest boundary first; a pair merges while
its combined size plus the overlap fits the limit. A boundary that no longer fits is final,
because segments only grow. What is left are the pieces.

Boundary strengths, strongest first: before a heading, blank line, edge of a table, list or
fenced block, list item, line end, line end inside code or a table, sentence end, clause end,
white space, none (a forced cut inside a stretch longer than a piece may be).

Defined results for unusual input:

* null or empty text, or a profile without limits: no pieces;
* a text within the limit: one piece, ``cut_kind`` ``whole``;
* a longer text is ``forced`` if one of its cuts had to be made inside a stretch without space,
  tab, CR or LF, which only stretches of more than max_chars characters need, else ``natural``;
* a stretch that fits the limit but not together with the overlap stays whole: its overlap is
  shortened to what fits;
* an overlap that is negative counts as 0, one not under the limit as the limit less 1; a
  limit under 1 gives no pieces;
* CR LF and a character with its combining marks are not parted where another place exists;
* repeated rows of an id: the newest counts, of equal ones any one;
* further columns: carried nowhere.

Scale: texts within the limit never leave the JVM; longer ones pass through Python in Arrow
batches, n log n in their length.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FORCED, WORD, CLAUSE, SENTENCE, INNER_LINE, LINE, ITEM, EDGE, BLANK, HEADING = range(10)
NAMES = ("forced", "word", "clause", "sentence", "inner_line", "line", "item", "edge", "blank", "heading")

#: zero-width joiner and variation selectors: they belong to their neighbours
JOINERS = (chr(0x200D), chr(0xFE0E), chr(0xFE0F))
_SPACE = re.compile(r"[ \t\r\n]+")
_NEWLINE = re.compile(r"\r\n|\r|\n")
_FENCE = re.compile(r"[ ]{0,3}(`{3,}|~{3,})")
_HEAD = re.compile(r"[ ]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]")
_ROW = re.compile(r"[ \t]*\|")
_QUOTE = re.compile(r"[ ]{0,3}>")


def line_boundaries(text: str) -> dict[int, int]:
    """Strength of a cut at the start of each line but the first."""
    out: dict[int, int] = {}
    fence, kind_before, blank_before, start = "", "", True, 0
    ends = [m.end() for m in _NEWLINE.finditer(text)]
    for end in [*ends, len(text)]:
        line = text[start:end].rstrip("\r\n")
        mark = _FENCE.match(line)
        if fence:
            kind, closes = "code", bool(mark) and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip()
        else:
            closes = False
            kind = "code" if mark else "" if not line.strip(" \t") else "head" if _HEAD.match(line) else "row" if _ROW.match(line) else "item" if _ITEM.match(line) else "quote" if _QUOTE.match(line) else "text"
        if start and start < len(text):
            if fence:
                strength = INNER_LINE
            elif kind == "head":
                strength = HEADING
            elif kind_before == "head":
                strength = SENTENCE  # a heading stays with what it heads
            elif blank_before and kind:
                strength = BLANK
            elif not kind:
                strength = INNER_LINE if blank_before else LINE
            elif kind == "row" and kind_before == "row":
                strength = INNER_LINE
            elif kind == "item":
                strength = ITEM
            elif kind != kind_before and "text" not in (kind, kind_before):
                strength = EDGE
            elif kind in ("code", "row") or kind_before in ("code", "row"):
                strength = EDGE
            else:
                strength = LINE
            out[start] = strength
        if kind or not kind_before == "head":
            kind_before = kind or kind_before
        blank_before = not kind
        if mark and not fence:
            fence = mark[1]
        elif closes:
            fence = ""
        start = end
    return out


def _clean_place(text: str, at: int, low: int) -> int:
    """The last place in (low, at] that parts neither CR LF nor a combined character."""
    i = at
    while i > low + 1 and i < len(text) and (unicodedata.combining(text[i]) or text[i] in JOINERS or text[i - 1] == JOINERS[0] or (text[i] == "\n" and text[i - 1] == "\r")):
        i -= 1
    return i if i > low + 1 or at == low + 1 else at


def _fitting(text: str, s: int, end: int, most: int, step: int) -> Iterator[tuple[int, int]]:
    """Cuts (place, strength) inside text[s:end], a stretch with the white space around it, that
    leave no part over ``most``. White space gives way first; only a stretch of more than
    ``most`` characters is cut by force, into parts of ``step``, which leaves room for overlaps."""
    a = s
    while a < end and text[a] in " \t\r\n":
        a += 1
    b = a
    while b < end and text[b] not in " \t\r\n":
        b += 1
    while s < a and b - s > most:
        s = min(a, s + most)
        yield s, WORD
    if b - a > most:
        while b - s > step:
            s = _clean_place(text, s + step, s)
            yield s, FORCED
    while end - s > most:
        s = max(b, s + most) if s < b else s + most
        yield s, WORD


def atoms(text: str, most: int, step: int | None = None) -> tuple[list[int], list[int]]:
    """Starts of the atomic segments, none longer than ``most``, and the strength before each."""
    lines = line_boundaries(text)
    starts, strengths = [0], [HEADING]
    for m in _SPACE.finditer(text):
        at = m.end()
        if at == len(text) or m.start() == 0 and at not in lines:
            continue
        # a line start inside the run is where the next line begins, indentation included
        inside = max((p for p in (m.start() + x.end() for x in _NEWLINE.finditer(m[0])) if p in lines and p < len(text)), default=None)
        if inside is not None:
            strength = max(lines[p] for p in (m.start() + x.end() for x in _NEWLINE.finditer(m[0])) if p in lines)
            at = inside
        else:
            before = text[m.start() - 1] if m.start() else ""
            if before in "\"'”’“»)]*_" and m.start() > 1:
                before = text[m.start() - 2] if text[m.start() - 2] in ".!?…" else before
            strength = SENTENCE if before and before in ".!?…" else CLAUSE if before and before in ",;:" else WORD
        if at > starts[-1]:
            starts.append(at)
            strengths.append(strength)
    out, power = [], []
    for i, s in enumerate(starts):
        end = starts[i + 1] if i + 1 < len(starts) else len(text)
        out.append(s)
        power.append(strengths[i])
        if end - s > most:
            for at, strength in _fitting(text, s, end, most, step or most):
                out.append(at)
                power.append(strength)
    return out, power


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, overlap, strength of the boundary at start) of each piece."""
    if limit < 1 or not text:
        return []
    overlap = min(max(overlap, 0), limit - 1)
    n = len(text)
    if n <= limit:
        return [(0, n, 0, HEADING)]
    begin, power = atoms(text, limit, limit - overlap)
    count = len(begin)
    end = [*begin[1:], n]
    right = [*range(1, count), -1]
    left = [-1, *range(count - 1)]
    alive = [True] * count
    heap = [(power[i], end[i] - begin[i - 1], i) for i in range(1, count)]
    heapq.heapify(heap)
    while heap:
        strength, size, i = heapq.heappop(heap)  # the boundary before segment i
        if not alive[i]:
            continue
        j = left[i]
        now = end[i] - begin[j]
        if now != size:
            if now + (overlap if begin[j] else 0) <= limit:
                heapq.heappush(heap, (strength, now, i))
            continue
        if now + (overlap if begin[j] else 0) > limit:
            continue
        alive[i] = False
        end[j] = end[i]
        right[j] = right[i]
        if right[i] != -1:
            left[right[i]] = j
    pieces, before = [], 0
    for i in range(count):
        if alive[i]:
            back = min(overlap, begin[i] - before, limit - (end[i] - begin[i])) if i else 0
            pieces.append((begin[i], end[i], back, power[i]))
            before = begin[i] - back
    return pieces


def cut_kind(pieces: list[tuple[int, int, int, int]]) -> str:
    """``whole``, ``natural``, or ``forced`` where a piece begins inside a stretch."""
    return "whole" if len(pieces) < 2 else "forced" if any(p[3] == FORCED for p in pieces) else "natural"


_OUT = "id long, profile string, piece_no int, n_pieces int, start_at int, end_at int, overlap int, boundary string, cut_kind string, piece string"
_ARROW = pa.schema([("id", pa.int64()), ("profile", pa.string()), *[(c, pa.int32()) for c in ("piece_no", "n_pieces", "start_at", "end_at", "overlap")], *[(c, pa.string()) for c in ("boundary", "cut_kind", "piece")]])
BATCH_CHARS = 4_000_000


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, chars = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    for b in batches:
        for i, profile, text, limit, overlap in zip(*(b.column(k) for k in range(5)), strict=True):
            text, limit = text.as_py(), limit.as_py()
            pieces = split_text(text, limit, overlap.as_py())
            kind = cut_kind(pieces)
            for k, (s, e, back, strength) in enumerate(pieces):
                rows.append((i.as_py(), profile.as_py(), k, len(pieces), s, e, back, NAMES[strength] if k else "start", kind, text[s - back : e]))
                chars += e - s + back
                if chars >= BATCH_CHARS:
                    yield flush()
                    rows, chars = [], 0
    if rows:
        yield flush()


def newest(df: DataFrame, key: str, at: str | None) -> DataFrame:
    """One row a key: the newest, of equal ones the one with the largest content hash."""
    order = [F.col(at).desc_nulls_last()] if at else []
    w = Window.partitionBy(key).orderBy(*order, F.xxhash64(*[c for c, t in df.dtypes if "map" not in t]).desc())
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def split_pieces(df: DataFrame, limits: DataFrame, id_col: str = "md_id", text_col: str = "md_string", profile_col: str = "profile", at_col: str | None = "made_at", oversized_only: bool = False) -> DataFrame:
    """Ordered pieces of each text: id, profile, piece_no, n_pieces, start_at, end_at (code
    points of the part that is new), overlap, boundary, cut_kind and the piece itself."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(profile_col).alias("profile"), F.col(text_col).alias("text"), *([F.col(at_col).alias("at")] if at_col else []))
    lim = limits.select("profile", F.col("max_chars").cast("int").alias("max_chars"), F.coalesce(F.col("overlap_chars").cast("int"), F.lit(0)).alias("overlap_chars")).filter("max_chars >= 1").dropDuplicates(["profile"])
    texts = newest(texts, "id", "at" if at_col else None).filter("text IS NOT NULL AND text <> ''").join(lim, "profile")
    long_ = texts.filter(F.length("text") > F.col("max_chars")).select("id", "profile", "text", "max_chars", "overlap_chars")
    cut = long_.mapInArrow(_split_batches, _OUT)
    if oversized_only:
        return cut
    zero = F.lit(0)
    whole = texts.filter(F.length("text") <= F.col("max_chars")).select("id", "profile", zero.alias("piece_no"), F.lit(1).alias("n_pieces"), zero.alias("start_at"), F.length("text").alias("end_at"), zero.alias("overlap"), F.lit("start").alias("boundary"), F.lit("whole").alias("cut_kind"), F.col("text").alias("piece"))
    return whole.unionByName(cut)
