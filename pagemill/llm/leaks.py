"""Find evaluation passages inside a training corpus, with all the damage of scanned pages.

Method: spaced-seed hashing. Fixed masks pick some of the words of a window and ignore the
others; the hashes of the evaluation items and of the pages are joined; around the hits the
overlap is verified with tolerance for misread letters, broken words and inserted lines.

A page is a hit of an item if it holds ``min_words`` (20) or more consecutive words of it. The
verified run may be broken between lines by any number of lines of something else (another
column, an advert); within a line every word must be there, read as written or with misread
letters. Verification goes over the whole page.

Which pairs are verified: those whose stretches (words alike side by side, grown from seeds)
follow each other in the item and between lines of the page and sum up to ``ENOUGH`` words, or
one of which has ``LONGEST``. A run of 20 is lost only if misreadings beyond likeness leave
less than that of it.

Seeds: of each distinct item text all windows of all masks. Seeds that stand in many items are
set phrases; they are left out only where every run of ``min_words`` words keeps at least
``SEEDS_A_RUN`` others, so no item loses its coverage whatever the item set looks like.

Defined results for unusual input: null and empty pages or items have no part; items with
fewer than ``min_words`` words cannot leak; items with equal words give a row each; repeated
pages and repeated item rows give one row a pair; pages whose boxes are missing, null or do not
match their lines are read in line order; further columns are ignored.

Scale: items are a stated query set; their seeds and words are broadcast in blocks of at most
``BLOCK_WORDS`` words (about 30 MB), each block against all pages, so neither side grows in
memory. Pages are read once per block in a narrow map, hashed and looked up in whole Arrow
batches; only verified pairs leave it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.pages import Words, mix, page_texts

#: offsets of the words that count; the gaps in between tolerate any word
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 5), (0, 1, 4, 5), (0, 1, 2, 5), (0, 3, 4, 6))
_WEIGHTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
MIN_WORDS = 20
SEEDS_A_RUN = 40
COMMON = 3
BLOCK_WORDS = 200_000
BITS = 22
#: words a stretch must have to count (a seed's least); a pair is verified from one stretch of
#: LONGEST words on, or from ENOUGH words in stretches that follow each other
PART, LONGEST, ENOUGH = 4, 10, 14
#: words of a run on one diagonal that may look unlike wherever they stand
ODD = 3
#: item words between stretches that may be misread beyond likeness
MISSED = 6


def seed_hashes(words: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The mask's hash at each start; windows over the end of the array are left out."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(n, np.uint64(number), np.uint64)
    with np.errstate(over="ignore"):
        for o, c in zip(mask, _WEIGHTS, strict=True):
            s += words[o : o + n] * np.uint64(c)
    return mix(s)


def owners(w: Words) -> np.ndarray:
    return np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))


class ItemIndex:
    """Seeds of a block of distinct item texts: sorted hashes with item and word position."""

    def __init__(self, texts: list[str], min_words: int = MIN_WORDS):
        w = Words(texts, alike=True)
        self.min_words = min_words
        self.words = [w.words(a, b) for a, b in zip(w.offsets, w.offsets[1:], strict=False)]
        self.hashes = [w.hashes[a:b] for a, b in zip(w.offsets, w.offsets[1:], strict=False)]
        self.flat, self.bags, self.lengths = w.hashes, w.bags(), (w.end - w.start).astype(np.int32)
        self.begin, self.size = w.offsets[:-1], np.diff(w.offsets)
        of = owners(w)
        parts = []
        for number, mask in enumerate(MASKS):
            h = seed_hashes(w.hashes, mask, number)
            if len(h):
                at = np.flatnonzero(of[: len(h)] == of[mask[-1] :])
                parts.append((h[at], of[at], at - w.offsets[of[at]], np.full(len(at), mask[-1])))
        if not parts:
            self.seeds = np.zeros(0, np.uint64)
            self.item = self.pos = np.zeros(0, np.int64)
        else:
            h, item, pos, span = (np.concatenate(x) for x in zip(*parts, strict=True))
            keep = self._select(h, item, pos, span)
            order = np.argsort(h[keep], kind="stable")
            self.seeds, self.item, self.pos = h[keep][order], item[keep][order], pos[keep][order]
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(self.seeds >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def _select(self, h, item, pos, span) -> np.ndarray:
        """Rare seeds, and of common ones as many as a run needs to have SEEDS_A_RUN."""
        _, inverse = np.unique(h, return_inverse=True)
        pairs = np.unique(np.stack([inverse, item]), axis=1)[0]
        count = np.bincount(pairs)[inverse]  # items a seed stands in
        keep = count <= COMMON
        for k in range(len(self.words)):
            n = len(self.words[k])
            if n < self.min_words:
                keep[item == k] = False
                continue
            mine = np.flatnonzero(item == k)
            mine = mine[np.argsort(count[mine], kind="stable")]
            held = np.zeros(n + 1, np.int64)  # kept seeds by start; runs are windows over starts
            np.add.at(held, pos[mine[keep[mine]]], 1)
            room = self.min_words - max(m[-1] for m in MASKS)
            for start in range(n - self.min_words + 1):
                short = SEEDS_A_RUN - int(held[start : start + room].sum())
                if short > 0:
                    more = [i for i in mine if not keep[i] and start <= pos[i] < start + room][:short]
                    keep[more] = True
                    np.add.at(held, pos[more], 1)
        return keep


def hits(w: Words, index: ItemIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(page, item, word of the page, word of the item) of each pair of equal seeds."""
    of = owners(w)
    out = []
    for number, mask in enumerate(MASKS):
        h = seed_hashes(w.hashes, mask, number)
        at = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        at = at[of[at] == of[at + mask[-1]]]
        lo, hi = np.searchsorted(index.seeds, h[at], "left"), np.searchsorted(index.seeds, h[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        rep = np.repeat(np.arange(len(at)), n)
        k = lo[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        out.append((of[at[rep]], index.item[k], at[rep], index.pos[k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _soft(h1, h2, b1, b2, l1, l2) -> np.ndarray:
    """Words that may be one: equal by letter classes, or nearly so in letters and length."""
    longest = np.maximum(l1, l2)
    near = np.bitwise_count(b1 ^ b2) * 3 <= np.bitwise_count(b1 | b2) + 1
    return (h1 == h2) | (near & (np.abs(l1 - l2) * 3 <= longest + 1))


WINDOW, LEAD = 96, 32


def _chained(parts: dict[tuple[int, int], int], head: np.ndarray, tail: np.ndarray) -> int:
    """Most words in stretches that follow each other in the item and on the page. Whatever
    stands between them there, it stands between lines: a stretch that does not go on beside the
    one before ends near a line end, and its successor begins near a line start."""
    best: list[tuple[int, int, int, bool]] = []  # diagonal, last item word, words so far, at a line end
    top = 0
    for (d, last), n in sorted(parts.items(), key=lambda x: x[0][1]):
        first = last - n + 1
        begins, ends = head[first + d] <= ODD, tail[last + d] <= ODD
        so_far = n + max((t - max(0, q - first + 1) for e, q, t, ended in best if -2 <= first - q - 1 <= MISSED and (-3 <= d - e <= 3 or (d > e and ended and begins))), default=0)
        best.append((d, last, so_far, ends))
        top = max(top, so_far)
    return top


def candidates(w: Words, index: ItemIndex, page, item, at, pos) -> list[tuple[int, int]]:
    """(page, item) worth verifying.

    Hits on one diagonal are one stretch: item and page words go side by side. A stretch counts
    as far as words stay alike on both sides of its hits. Words misread too badly to look alike
    part stretches; where most words between are alike, verification judges the rest.
    """
    if not len(page):
        return []
    diagonal, block = at - pos, pos // LEAD
    key = np.lexsort((block, diagonal, item, page))
    page, item, diagonal, block = page[key], item[key], diagonal[key], block[key]
    new = np.concatenate([[True], (page[1:] != page[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (block[1:] != block[:-1])])
    page, item, diagonal, block = page[new], item[new], diagonal[new], block[new]
    bags, lengths = w.bags(), (w.end - w.start).astype(np.int32)
    # words before and after each word in its line
    begin = np.concatenate([[0], np.flatnonzero(w.first[1:] > w.first[:-1]) + 1])
    size = np.diff(np.concatenate([begin, [len(w.first)]]))
    head = np.arange(len(w.first)) - np.repeat(begin, size)
    tail = np.repeat(size, size) - 1 - head
    total: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    dense: set[tuple[int, int]] = set()
    for c in range(0, len(page), 20_000):
        p, i, d = page[c : c + 20_000, None], item[c : c + 20_000, None], diagonal[c : c + 20_000, None]
        q = (block[c : c + 20_000, None] * LEAD - LEAD) + np.arange(WINDOW)[None, :]
        a = q + d
        inside = (q >= 0) & (q < index.size[i]) & (a >= w.offsets[p]) & (a < w.offsets[p + 1])
        k, a = np.where(inside, index.begin[i] + q, 0), np.where(inside, a, 0)
        ok = inside & _soft(index.flat[k], w.hashes[a], index.bags[k], bags[a], index.lengths[k], lengths[a])
        # every unbroken stretch of each row
        step = np.arange(1, WINDOW + 1)[None, :]
        run = step - np.maximum.accumulate(np.where(ok, 0, step), axis=1)
        ends = run >= PART
        ends[:, :-1] &= run[:, 1:] == 0
        g, z = np.nonzero(ends)
        for pg, it, dd, qq, n in zip(p[g, 0].tolist(), i[g, 0].tolist(), d[g, 0].tolist(), q[g, z].tolist(), run[g, z].tolist(), strict=True):
            have = total.setdefault((pg, it), {})
            have[dd, qq] = max(have.get((dd, qq), 0), n)
        # all words but ODD alike among as many as a run needs, however the others part them
        sums = np.cumsum(np.pad(ok, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
        held = sums[:, index.min_words :] - sums[:, : -index.min_words]
        g = np.flatnonzero(held.max(axis=1, initial=0) >= index.min_words - ODD)
        dense.update(zip(p[g, 0].tolist(), i[g, 0].tolist(), strict=True))
    return list(dense | {k for k, parts in total.items() if k not in dense and (max(parts.values()) >= LONGEST or (sum(parts.values()) >= ENOUGH and _chained(parts, head, tail) >= ENOUGH))})


_GROUPS = (("rn", "m"), ("nn", "m"), ("ni", "m"), ("cl", "d"), ("vv", "w"), ("ii", "n"), ("li", "h"))


@lru_cache(200_000)
def _folded(word: str) -> str:
    for a, b in _GROUPS:
        word = word.replace(a, b)
    return word


def _distance(a: str, b: str, most: int) -> int:
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        least = i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
            if row[j] < least:
                least = row[j]
        if least > most:
            return most + 1
    return row[-1]


@lru_cache(500_000)
def same_word(a: str, b: str) -> bool:
    """Whether b can be a misreading of a: at most a third of its letters, one at least."""
    if a == b:
        return True
    most = max(1, len(a) // 3)
    return _within(a, b, most) or _within(_folded(a), _folded(b), most)


def _within(a: str, b: str, most: int) -> bool:
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:  # an edit changes two letters of the sets
        return False
    return a == b or _distance(a, b, most) <= most


def _equal_twos(item: np.ndarray, page: np.ndarray) -> list[tuple[int, int]]:
    """Places (item, page), in order, where two words in a row are equal."""
    with np.errstate(over="ignore"):
        two = [h[:-1] * np.uint64(_WEIGHTS[0]) + h[1:] * np.uint64(_WEIGHTS[1]) for h in (item, page)]
    order = np.argsort(two[0], kind="stable")
    lo, hi = (np.searchsorted(two[0][order], two[1], side) for side in ("left", "right"))
    at = np.repeat(np.arange(len(two[1])), hi - lo)
    i = order[np.repeat(lo, hi - lo) + np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)] if len(at) else at
    return sorted(zip(i.tolist(), at.tolist(), strict=True))


def longest_run(item: list[str], item_hashes: np.ndarray, page: list[str], page_hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> int:
    """Most consecutive words of the item that the page words hold in order."""
    n, m = len(item), len(page)
    # parts: maximal stretches matched word by word, grown from two equal words
    seen: set[tuple[int, int]] = set()
    parts: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}  # by start: (item, page) from and to of each step
    for i, j in _equal_twos(item_hashes, page_hashes):
        if (i, j) in seen:
            continue
        a, b = int(i), int(j)
        while a > 0 and b > 0:
            if same_word(item[a - 1], page[b - 1]):
                a, b = a - 1, b - 1
            elif b > 1 and same_word(item[a - 1], page[b - 2] + page[b - 1]):
                a, b = a - 1, b - 2
            elif a > 1 and same_word(item[a - 2] + item[a - 1], page[b - 1]):
                a, b = a - 2, b - 1
            else:
                break
        x, y, path = a, b, []
        while x < n and y < m:
            seen.add((x, y))
            if same_word(item[x], page[y]):
                dx, dy = 1, 1
            elif y + 1 < m and same_word(item[x], page[y] + page[y + 1]):
                dx, dy = 1, 2
            elif x + 1 < n and same_word(item[x] + item[x + 1], page[y]):
                dx, dy = 2, 1
            else:
                break
            path.append((x, y, x + dx, y + dy))
            x, y = x + dx, y + dy
        if len(path) >= 2:
            parts[a, b] = path
    # runs: along a part, and from a line end of one part to a later line start of another
    best, ends = 0, defaultdict(list)
    for _, path in sorted(parts.items(), key=lambda p: (p[0][1], p[0][0])):
        length, mine = 0, []
        for x, y, x2, y2 in path:
            if y and first[y] > last[y - 1] or y and first[y] > first[y - 1]:  # y begins a line
                for back in (0, 1):  # 1: the word at the break is torn between the two parts
                    for y0, l0 in ends.get(x - back, ()):
                        if y0 <= y and first[y] > last[y0 - 1] and l0 + back > length and (not back or _torn(item[x - 1], page, y0, y)):
                            length = l0 + back
            length += x2 - x
            best = max(best, length)
            if y2 < m and first[y2] > first[y2 - 1] or y2 < m and last[y2] > last[y2 - 1]:  # the next word ends or begins another line
                mine.append((x2, y2, length))
        for x2, y2, length in mine:
            ends[x2].append((y2, length))
    return best


def _torn(word: str, page: list[str], y0: int, b: int) -> bool:
    """Whether the word begins page[y0] (glued to inserted text) or ends page[b - 1]."""
    head = page[y0] if y0 < len(page) else ""
    tail = page[b - 1] if b > y0 else ""
    k = next((k for k in range(min(len(word), len(head)), 0, -1) if head[:k] == word[:k]), 0)
    t = next((t for t in range(min(len(word), len(tail)), 0, -1) if tail[-t:] == word[-t:]), 0)
    return k >= 1 or t >= 2


def find_in_batch(texts: list[str], index: ItemIndex) -> list[tuple[int, int, int]]:
    """(page, item, words) of all pairs that share at least ``min_words`` consecutive words."""
    w = Words(texts, alike=True)
    out, page = [], -1
    for p, i in sorted(candidates(w, index, *hits(w, index))):
        a, b = w.offsets[p], w.offsets[p + 1]
        if p != page:
            page, words = p, w.words(a, b)
        n = longest_run(index.words[i], index.hashes[i], words, w.hashes[a:b], w.first[a:b], w.last[a:b])
        if n >= index.min_words:
            out.append((p, i, n))
    return out


# --- Spark side -------------------------------------------------------------------------

#: characters of text handled at once inside a batch
SLICE_CHARS = 1_500_000


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` characters, one row at least."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def item_blocks(items: DataFrame, id_col: str, text_col: str, min_words: int) -> Iterator[tuple[list[str], list[list[int]]]]:
    """Distinct texts with the ids they stand under, in blocks of at most BLOCK_WORDS words."""
    texts: dict[bytes, int] = {}
    block: list[str] = []
    ids: list[list[int]] = []
    words = 0
    rows = items.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).distinct()
    for i, text in rows.toLocalIterator():
        w = Words([text])
        if len(w.hashes) < min_words:
            continue
        key = w.hashes.tobytes()
        if key in texts:
            ids[texts[key]].append(i)
            continue
        if words and words + len(w.hashes) > BLOCK_WORDS:
            yield block, ids
            texts, block, ids, words = {}, [], [], 0
        texts[key] = len(block)
        block.append(text)
        ids.append([i])
        words += len(w.hashes)
    if block:
        yield block, ids


def find_leaks(pages: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", boxes_col: str | None = "line_boxes", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per page and item it leaks: doc_id, item_id, words (longest run found)."""
    spark = pages.sparkSession
    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    if boxes_col:
        cols.append(F.transform(F.col(boxes_col), lambda b: F.struct(b["x0"].cast("int").alias("x0"))).alias("boxes"))
    src = pages.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(*cols)
    found = None
    for texts, ids in item_blocks(items, item_id, item_text, min_words):
        index = ItemIndex(texts, min_words)
        shared = spark.sparkContext.broadcast((index, ids))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids = shared.value
            for b in batches:
                got = page_texts(b.column(1), b.column(2) if boxes_col else None)
                doc = b.column(0).to_pylist()
                rows = [(doc[lo + p], i, n) for lo, hi in slices(got) for p, k, n in find_in_batch(got[lo:hi], index) for i in ids[k]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "words"])

        part = src.mapInArrow(run, "doc_id long, item_id long, words int")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, words int")
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def leak_report(found: DataFrame) -> DataFrame:
    """One row per leaked item: pages that hold it and the longest run."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("pages"), F.max("words").alias("longest_run"))
