"""Scanned pages as word streams: columns apart, broken words rejoined, all vectorised.

A batch of pages becomes flat arrays: one hash per word, with the offsets of each page. Words
are what stands between white space, reduced to letters and digits, lower case, with digits
and bars that scanners read for letters mapped back.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: marks at a line end that say the word goes on in the next line
BREAKS = "-¬=‐‑­"
#: what scanners read for a letter
MISREAD = {"0": "o", "1": "l", "|": "l", "!": "l", "5": "s", "ſ": "f"}
#: pixels between the left edges of two columns, at least
COLUMN_GAP = 120

_SPACE, _DROP, _LINE = 1, 0, 2


@lru_cache
def char_table() -> np.ndarray:
    """For each code point of the BMP: 0 dropped, 1 space, 2 line feed, else its folded letter."""
    t = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c == "\n":
            t[i] = _LINE
        elif c.isspace() or c == "\x00":
            t[i] = _SPACE
        elif c in MISREAD:
            t[i] = ord(MISREAD[c])
        elif unicodedata.category(c)[0] in "LN":
            t[i] = ord(c.lower()[0])
    return t


@lru_cache
def _is_break() -> np.ndarray:
    t = np.zeros(1 << 16, bool)
    t[[ord(c) for c in BREAKS]] = True
    return t


def column_order(text: str, x0: np.ndarray | None) -> str:
    """The text with its lines column by column, if their left edges tell columns apart."""
    if x0 is None or len(x0) < 2 or int(x0.max()) - int(x0.min()) <= COLUMN_GAP:
        return text
    lines = text.split("\n")
    if len(lines) != len(x0):
        return text
    edges = np.sort(np.unique(x0))
    starts = edges[1:][np.diff(edges) > COLUMN_GAP]
    if not len(starts):
        return text
    col = np.searchsorted(starts, x0, side="right")
    return "\n".join([lines[i] for i in np.argsort(col, kind="stable")])


def page_texts(texts: pa.Array, boxes: pa.Array | None) -> list[str]:
    """Texts of a batch, null as empty, in column order where there is a box for each line."""
    out = [t or "" for t in texts.to_pylist()]
    if boxes is None or boxes.null_count == len(boxes):
        return out
    if isinstance(boxes, pa.ChunkedArray):
        boxes = boxes.combine_chunks()
    inner = boxes.values
    x0 = inner.field("x0")
    ok = np.asarray(x0.is_valid())
    x0 = x0.fill_null(0).to_numpy(zero_copy_only=False)
    off = boxes.offsets.to_numpy()
    if not len(x0):
        return out
    valid = np.asarray(boxes.is_valid()) & (np.diff(off) > 1)
    for i in np.flatnonzero(valid):
        a, b = off[i], off[i + 1]
        part = x0[a:b]
        if part.max() - part.min() > COLUMN_GAP and ok[a:b].all():
            out[i] = column_order(out[i], part)
    return out


_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(33))
    h = h * _M2
    return h ^ (h >> np.uint64(33))


#: letters that damaged print confuses; with ``alike`` words hash by these classes
CLASSES = ("aceo", "bh", "nur", "iltfj", "gq", "vy")


@lru_cache
def _alike() -> np.ndarray:
    t = np.arange(1 << 16, dtype=np.uint32)
    for group in CLASSES:
        for c in group:
            t[ord(c)] = ord(group[0])
    for i in range(0xC0, 0x250):  # accented letters go with their base
        base = unicodedata.normalize("NFD", chr(i))[0]
        if base != chr(i):
            t[i] = t[ord(base)]
    return t


@lru_cache
def _letter_bit() -> np.ndarray:
    """Bit of each folded character: own bits for a to z, accented letters with their base."""
    bit = np.arange(1 << 16, dtype=np.uint32) % 6 + 26
    bit[ord("a") : ord("z") + 1] = np.arange(26)
    for i in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(i))[0]
        if "a" <= base <= "z":
            bit[i] = ord(base) - ord("a")
    return bit


class Words:
    """Word hashes of a batch of texts; ``offsets[i]:offsets[i+1]`` are those of text i.
    ``start``/``end`` address ``chars``, the folded characters; ``first``/``last`` are the lines
    a word begins and ends in, counted through the batch."""

    __slots__ = ("chars", "end", "first", "hashes", "last", "offsets", "start")

    def __init__(self, texts: list[str], alike: bool = False):
        joined = "\x00".join(texts) + "\x00"
        raw = np.frombuffer(joined.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "replace"), dtype=np.uint32)
        small = np.where(raw < 1 << 16, raw, 0xFFFD).astype(np.uint32)
        folded = char_table()[small]
        # a break mark directly before a line end (trailing spaces aside) goes with the line end
        line = np.flatnonzero(folded == _LINE)
        before = line - 1
        for _ in range(2):
            before = np.where((before > 0) & (folded[np.maximum(before, 0)] == _SPACE) & (raw[np.maximum(before, 0)] != 0), before - 1, before)
        joins = (before >= 0) & _is_break()[np.minimum(small[np.maximum(before, 0)], 0xFFFF)] & (folded[np.maximum(before - 1, 0)] > _LINE)
        folded[line] = _SPACE
        folded[line[joins]] = _DROP
        for p, q in zip(before[joins] + 1, line[joins], strict=True) if (line[joins] - before[joins] > 1).any() else ():
            folded[p:q] = _DROP
        keep = folded != _DROP
        lines = np.cumsum(raw == 10, dtype=np.int32)[keep]
        ends_text = np.cumsum(keep)[np.flatnonzero(raw == 0)]  # kept characters up to each separator
        chars = folded[keep]
        letter = chars > _LINE
        edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.chars, self.first, self.last = chars, lines[self.start], lines[self.end - 1]
        # polynomial hash by prefix sums: sum of c * B^i over the word, divided by B^start
        n = len(chars)
        power = _powers(n + 1)
        with np.errstate(over="ignore"):
            shape = _alike()[np.minimum(chars, 0xFFFF)] if alike else chars
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shape.astype(np.uint64) * _B) * power[0][:n], dtype=np.uint64)])
            self.hashes = mix((prefix[self.end] - prefix[self.start]) * power[1][self.start])
        self.offsets = np.concatenate([[0], np.searchsorted(self.start, ends_text)])

    def bags(self) -> np.ndarray:
        """Set of the letters of each word, as bits."""
        bits = np.uint32(1) << _letter_bit()[np.minimum(self.chars, 0xFFFF)]
        bits[self.chars <= _LINE] = 0
        return np.bitwise_or.reduceat(bits, self.start) if len(self.start) else np.zeros(0, np.uint32)

    def word(self, k: int) -> str:
        return "".join(map(chr, self.chars[self.start[k] : self.end[k]]))

    def words(self, a: int, b: int) -> list[str]:
        if b <= a:
            return []
        low = self.start[a]
        text = self.chars[low : self.end[b - 1]].astype("<u4").tobytes().decode("utf-32-le", "replace")
        return [text[x:y] for x, y in zip((self.start[a:b] - low).tolist(), (self.end[a:b] - low).tolist(), strict=True)]


_cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""
    have = _cache.get("p")
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (base, inverse))
        _cache["p"] = have
    return have
