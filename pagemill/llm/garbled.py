"""Find text that was decoded with the wrong character encoding and restore it.

Method: adjacent character pairs are scored by their share of the corpus mutual information,
p(ab) * PMI(a, b), counted over all rows. Pairs that carry little of it are improbable. The
maximum-scoring segments of a text are its improbable runs. Only inside those runs inverse
mappings are tried: the run's characters back to bytes by the wrong encoding, the bytes to
characters by the right one. A mapping is kept if it makes the run clearly more probable.
Characters that no correct decoding leaves behind (U+FFFD, C1 controls) mark a text at once.
A misread UTF-8 sequence that lost its end has no inverse: it is found where its begin is
improbable and some character of the corpus that it can have been is clearly more probable.

Defined results for unusual input: null and empty texts are clean; a text of any length is
treated whole; repeated rows of an id give one row; texts whose bytes are lost (U+FFFD, or
the end of a sequence) are reported and keep what is left of those characters; an empty table gives no rows; further columns are
ignored.

Scale: pair counts go into tables of fixed size (2^18 pairs, 2^16 characters, hashed), summed
by a partial aggregation over at most ``COUNT_TASKS`` tables, so what reaches the driver and is broadcast has a constant bound of
about 3 MB whatever the corpus. The search is a narrow map, once per distinct value of a batch.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.visual import LOOK_ALIKES

PAIR_BITS, CHAR_BITS = 18, 16
#: a pair that carries less than this share of the mutual information counts as improbable
RARE = 1e-3
FLOOR = 2e-8
#: nats a restoration must win, in total and for each character it changes
MARGIN_UTF8, MARGIN_8BIT, PER_CHAR = 3.0, 6.0, 2.0
#: mean improbability a restored run may have in the pairs that hold a non-ASCII character
WORST_UTF8, WORST_8BIT = 6.5, 2.0
#: nats a lost end must explain and improbability that may be left; pairs searched for one
MARGIN_CUT, WORST_CUT, ODD_CUT = 7.0, 8.0, 6.0
#: misreadings on top of each other that are undone
ROUNDS = 3

# Names of the single-byte encodings that text is commonly misread with.
WRONG = ("cp1252", "latin-1", "iso8859-15", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp1250", "iso8859-2", "cp866", "mac_cyrillic")
RIGHT_8BIT = ("cp1252", "cp1251", "mac_roman", "koi8-r", "cp866", "cp850", "mac_cyrillic", "cp1250", "iso8859-15")


@lru_cache
def byte_chars(codec: str) -> tuple[str, ...]:
    """The character of each byte; bytes a codec leaves undefined read as C1 controls."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache
def to_bytes(codec: str) -> dict[int, str]:
    """Translation of this codec's non-ASCII characters to bytes, written as U+0080..U+00FF;
    other non-ASCII characters go to U+0100, which no byte sequence matches."""
    return {ord(c): chr(b) for b, c in reversed(list(enumerate(byte_chars(codec)))) if b >= 128}


@lru_cache
def eight_bit(wrong: str, right: str) -> dict[int, str]:
    chars = byte_chars(right)
    return {o: chars[ord(b)] for o, b in to_bytes(wrong).items()}


_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
#: a misread UTF-8 sequence has two non-ASCII characters in a row at least
_TWO = re.compile("[^\x00-\x7f]{2}")
_SURE = re.compile("[\x80-\x84\x86-\x9f�]")


def unread_utf8(text: str, codec: str) -> tuple[str, int]:
    """``text`` with the sequences that are UTF-8 read as ``codec`` decoded, and their number."""
    as_bytes = text.translate(to_bytes(codec))
    if len(as_bytes) != len(text):
        return text, 0
    out, last, n = [], 0, 0
    for m in _UTF8.finditer(as_bytes):
        # a character that is no byte of the codec keeps its own code point and may look like one
        if any(ord(c) not in to_bytes(codec) for c in text[m.start() : m.end()]):
            continue
        out += [text[last : m.start()], m[0].encode("latin-1").decode("utf-8")]
        last, n = m.end(), n + 1
    return ("".join(out) + text[last:], n) if n else (text, 0)


def pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bucket of each character pair; both ASCII has a range of its own without collisions."""
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - PAIR_BITS)
    return h.astype(np.int64)


def char_bucket(a: np.ndarray) -> np.ndarray:
    return (a & ((1 << CHAR_BITS) - 1)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


#: tasks that count, at most: each sends one table, so what is shuffled is bounded
COUNT_TASKS = 4096
#: a restored character must stand in the corpus at least this often
SEEN = 3


class PairScores(dict):
    """Improbability of adjacent pairs: log(RARE / share of the mutual information), by pair;
    computed on first use and kept."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        super().__init__()
        self.pairs, self.chars = pairs, chars
        self.memo: dict[tuple[str, str, str], tuple[float, str, str] | None] = {}
        self.cut: dict[tuple[str, str, str], bool] = {}
        self.ranges: dict[tuple[int, int], str] = {}
        self.n_pairs, self.n_chars = max(float(pairs.sum()), 1.0), max(float(chars.sum()), 1.0)

    def __missing__(self, pair: str) -> float:
        if len(self) > 1_000_000:
            self.clear()
        c = code_points(pair)
        n, (na, nb) = self.pairs[pair_bucket(c[:1], c[1:])[0]], self.chars[char_bucket(c)]
        p = n / self.n_pairs
        pmi = math.log(max(p, 1e-12) / (max(na, 0.5) / self.n_chars * (max(nb, 0.5) / self.n_chars)))
        self[pair] = got = math.log(RARE / max(p * min(max(pmi, 0.5), 6.0), FLOOR))
        return got

    def known(self, text: str) -> bool:
        return bool((self.chars[char_bucket(code_points(text))] >= SEEN).all()) if text else True

    def seen_in(self, lo: int, hi: int) -> str:
        """The characters of a range that stand in the corpus."""
        if (lo, hi) not in self.ranges:
            at = np.flatnonzero(self.chars[char_bucket(np.arange(lo, hi + 1))] >= SEEN) + lo
            self.ranges[lo, hi] = "".join(c for c in map(chr, at) if c.isprintable() or c.isspace())
        return self.ranges[lo, hi]

    def scores(self, text: str) -> list[float]:
        t = f"\n{text}\n"
        return list(map(self.__getitem__, map(add, t, t[1:])))


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring segments [i, j) of positive total, left to right (linear time)."""
    stack: list[tuple[int, int, float, float]] = []
    total = 0.0
    for k, s in enumerate(scores):
        if s > 0:
            seg = (k, k + 1, total, total + s)
            total += s
            while True:
                i = len(stack) - 1
                while i >= 0 and stack[i][2] >= seg[2]:
                    i -= 1
                if i < 0 or stack[i][3] >= seg[3]:
                    stack.append(seg)
                    break
                seg = (stack[i][0], seg[1], stack[i][2], seg[3])
                del stack[i:]
        else:
            total += s
    return [(a, b) for a, b, _, _ in stack]


@lru_cache(65_536)
def _utf8_chains(run: str, depth: int = ROUNDS) -> tuple[tuple[str, str], ...]:
    """Texts that come of undoing one or more UTF-8 misreadings, with their mappings."""
    out: dict[str, str] = {}
    front = {run: ""}
    for _ in range(depth):
        nxt: dict[str, str] = {}
        for text, how in front.items():
            for wrong in WRONG:
                new, n = unread_utf8(text, wrong)
                if n and new not in out and new != run:
                    nxt.setdefault(new, f"{how}; utf-8 as {wrong}" if how else f"utf-8 as {wrong}")
        out |= nxt
        front = {t: h for t, h in nxt.items() if not t.isascii()}
        if not front:
            break
    return tuple(out.items())


def _script(c: str) -> str:
    return "c" if "\u0400" <= c <= "\u052f" else "l" if c.isalpha() and ord(c) < 0x250 else ""


_WORD = re.compile(r"[^\W\d_]+")


def _eight_bit_text(run: str, new: str) -> bool:
    """Whether a single-byte remapping can be a reading of words at all: letters stay letters,
    most of what changes is no space, changed letters are not just look-alikes, marks turn into
    letters only beside letters, and no word mixes scripts."""
    pairs = [(a, b) for a, b in zip(run, new, strict=True) if a != b]
    if any(a.isalpha() and not b.isalpha() for a, b in pairs):
        return False
    solid = [(a, b) for a, b in pairs if not a.isspace() and a != "\xad" and b.isalpha()]
    if len(solid) * 2 <= len(pairs) or all(a in LOOK_ALIKES for a, _ in pairs):
        return False
    if all(not a.isalpha() for a, _ in solid):  # only marks become letters
        beside = sum(1 for k, (a, b) in enumerate(zip(run, new, strict=True)) if a != b and b.isalpha() and ((k and new[k - 1].isalpha()) or (k + 1 < len(new) and new[k + 1].isalpha())))
        if not beside:
            return False
    return all(len({_script(c) for c in w} - {""}) < 2 for w in _WORD.findall(new))


@lru_cache(65_536)
def _eight_bit_maps(odd: frozenset[int]) -> tuple[tuple[str, dict[int, str]], ...]:
    """The different remappings of a set of characters that keep letters letters."""
    seen, out = set(), []
    for wrong in WRONG:
        if not odd <= to_bytes(wrong).keys():
            continue
        for right in RIGHT_8BIT:
            table = eight_bit(wrong, right)
            part = {o: table[o] for o in odd if table[o] != chr(o)}
            key = frozenset(part.items())
            if not part or key in seen:
                continue
            seen.add(key)
            if all(b.isalpha() for o, b in part.items() if chr(o).isalpha()):
                out.append((f"{right} as {wrong}", part))
    return tuple(out)


@lru_cache(65_536)
def _eight_bit_readings(run: str) -> tuple[tuple[str, str, int], ...]:
    """Single-byte remappings of a run that could be words: (text, mapping, characters changed)."""
    out = []
    for how, table in _eight_bit_maps(frozenset(ord(c) for c in run if ord(c) > 127)):
        new = run.translate(table)
        if _eight_bit_text(run, new):
            out.append((new, how, sum(a != b for a, b in zip(run, new, strict=True))))
    return tuple(out)


def _odd_mean(text: str, scores: list[float]) -> float:
    """Mean improbability of the pairs that hold a non-ASCII character."""
    t = f"\n{text}\n"
    odd = [s for a, b, s in zip(t, t[1:], scores, strict=False) if a > "\x7f" or b > "\x7f"]
    return sum(odd) / len(odd) if odd else -9.0


def _best(text: str, lo: int, hi: int, model: PairScores) -> tuple[float, str, str] | None:
    """Best restoration of text[lo:hi] in its surroundings: (nats won, mapping, new run). The same
    words come again and again, so answers are kept."""
    key = (text[max(0, lo - 1) : lo], text[lo:hi], text[hi : hi + 1])
    memo = model.memo
    if key not in memo:
        if len(memo) > 200_000:
            memo.clear()
        memo[key] = _search(*key, model)
    return memo[key]


def _search(left: str, run: str, right: str, model: PairScores) -> tuple[float, str, str] | None:
    base = sum(model.scores(left + run + right))
    best = None
    for new, how in _utf8_chains(run) if _TWO.search(run) else ():
        if not model.known(new):
            continue
        after = model.scores(left + new + right)
        won = base - sum(after)
        if won >= MARGIN_UTF8 and _odd_mean(left + new + right, after) <= WORST_UTF8 and (best is None or won > best[0]):
            best = (won, how, new)
    if best:
        return best
    for new, how, changed in _eight_bit_readings(run):
        after = model.scores(left + new + right)
        won = base - sum(after)
        if won >= max(MARGIN_8BIT, PER_CHAR * changed) and _odd_mean(left + new + right, after) <= WORST_8BIT and (best is None or won > best[0]):
            best = (won, how, new)
    return best


def _runs(text: str, scores: list[float]) -> list[tuple[int, int]]:
    """Improbable runs as character ranges that hold non-ASCII, grown over adjoining non-ASCII."""
    out: list[list[int]] = []
    for a, b in segments(scores):
        lo, hi = max(0, a - 1), min(len(text), b)  # pair k joins characters k-1 and k of the text
        while lo > 0 and ord(text[lo]) > 127 and (ord(text[lo - 1]) > 127):
            lo -= 1
        while hi < len(text) and ord(text[hi - 1]) > 127 and ord(text[hi]) > 127:
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out if not text[lo:hi].isascii()]


_TOKEN = re.compile(r"[^ \n]+")


@lru_cache
def _cut_leads() -> dict[str, tuple[tuple[str, int], ...]]:
    """(codec, byte) of each character that a codec reads the first byte of a sequence as.
    Punctuation is left out: dashes and quotes stand alone in right text."""
    out: dict[str, dict[tuple[int, frozenset], tuple[str, int]]] = {}
    for wrong in WRONG:
        for b in range(0xC2, 0xF5):
            c = byte_chars(wrong)[b]
            if c.isalpha() or unicodedata.category(c)[0] == "S":
                out.setdefault(c, {})[b, frozenset(byte_chars(wrong)[0x80:0xC0])] = (wrong, b)
    return {c: tuple(v.values()) for c, v in out.items()}


@lru_cache(65_536)
def _cut_sequences(tail: str) -> tuple[tuple[int, int, int], ...]:
    """What ``tail`` may begin with of a UTF-8 sequence that lost its end: (characters left of
    it, first and last code point it can have been)."""
    out = set()
    for wrong, b in _cut_leads().get(tail[0], ()):
        size, code = (2, b & 31) if b < 0xE0 else (3, b & 15) if b < 0xF0 else (4, b & 7)
        n = 1
        while n < size and n < len(tail) and "\x80" <= to_bytes(wrong).get(ord(tail[n]), "") <= "\xbf":
            code, n = code << 6 | ord(to_bytes(wrong)[ord(tail[n])]) & 63, n + 1
        room = 6 * (size - n)
        if 0 < room <= 12:
            lo = max(code << room, (0x80, 0x800, 0x10000)[size - 2])
            out.add((n, lo, (code + 1 << room) - 1))
    return tuple(sorted(out))


def _cut_at(text: str, k: int, model: PairScores) -> bool:
    """Whether text[k] begins a sequence that lost its end: some character of the corpus that
    it can have been is clearly more probable there, alone or with a blank that was the end."""
    a, b = k, k + 1
    while a > 0 and text[a - 1].isalpha():
        a -= 1
    while b < len(text) and text[b].isalpha():
        b += 1
    rest = text[a:k] + text[k + 1 : b]
    key = (text[k - 1] if k else "\n", f"{text}\n"[k : k + 6], f"{rest.isupper()} {''.join(sorted({_script(c) for c in rest}))}")
    memo = model.cut
    if key not in memo:
        if len(memo) > 200_000:
            memo.clear()
        memo[key] = _cut_search(*key[:2], rest, model)
    return memo[key]


def _cut_search(left: str, tail: str, rest: str, model: PairScores) -> bool:
    scripts = {_script(c) for c in rest}
    if not tail[0].isalpha() and not (left.isalpha() or tail[1:2].isalpha()):
        return False  # a symbol that stands alone
    for n, lo, hi in _cut_sequences(tail[:4]):
        for end in (n, n + 1) if tail[n : n + 1] == " " else (n,):
            right = tail[end : end + 1]
            if not right:
                continue
            base = sum(map(model.__getitem__, map(add, left + tail[:end], tail[: end + 1])))
            for new in model.seen_in(lo, hi) if base >= MARGIN_CUT else ():
                if new.isalpha() and (len((scripts | {_script(new)}) - {""}) > 1 or (new.lower() == tail[0].lower() and not left.islower()) or (rest.isupper() and new.islower())):
                    continue  # mixed scripts, or capitals among capitals
                if not new.isalpha() and end == 1 and left.isalpha() and right.isalpha():
                    continue  # a letter inside a word
                after = max(0.0, model[left + new]) + max(0.0, model[new + right])
                if after <= WORST_CUT and base - after >= MARGIN_CUT:
                    return True
    return False


def cut_sequences(text: str, model: PairScores) -> list[int]:
    """Where ``text`` holds the begin of a UTF-8 sequence, misread, whose end was lost."""
    scores = model.scores(text)
    leads = _cut_leads()
    return [k for k, c in enumerate(text) if c > "\x7f" and c in leads and scores[k] + scores[k + 1] >= ODD_CUT and _cut_at(text, k, model)]


def restore(text: str, model: PairScores) -> tuple[bool, str, str]:
    """(garbled, restored text, mappings used)."""
    if not text or text.isascii():
        return False, text, ""
    used: list[str] = []
    for _ in range(ROUNDS):
        runs = _runs(text, model.scores(text))
        changed = False
        for lo, hi in reversed(runs):
            got = _best(text, lo, hi, model)
            if got:
                text = text[:lo] + got[2] + text[hi:]
                used += got[1].split("; ")
                changed = True
                continue
            # a run may hold right text as well, or parts that were misread differently: word by word
            for m in reversed(list(_TOKEN.finditer(text, lo, hi))):
                a, b = m.span()
                while a > 0 and text[a - 1] not in " \n":
                    a -= 1
                while b < len(text) and text[b] not in " \n":
                    b += 1
                if text[a:b].isascii():
                    continue
                part = _best(text, a, b, model)
                if part:
                    text = text[:a] + part[2] + text[b:]
                    used += part[1].split("; ")
                    changed = True
        if not changed:
            break
    sure = bool(_SURE.search(text)) or (not used and bool(cut_sequences(text, model)))
    return bool(used) or sure, text, "; ".join(dict.fromkeys(used)) or ("lost" if sure else "")


# --- Spark side -------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, chars = np.zeros(1 << PAIR_BITS, np.int64), np.zeros(1 << CHAR_BITS, np.int64)
    for b in batches:
        for col in b.columns:
            texts = col.drop_null().to_pylist()
            if texts:
                c = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
                pairs += np.bincount(pair_bucket(c[:-1], c[1:]), minlength=len(pairs))
                chars += np.bincount(char_bucket(c), minlength=len(chars))
    for kind, table in ((0, pairs), (1, chars)):
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["kind", "bucket", "n"])


def fit_pairs(df: DataFrame, text_cols: list[str]) -> PairScores:
    """Pair and character counts of all values of ``text_cols`` over all rows."""
    counts = df.select(*[F.col(c).cast("string") for c in text_cols]).coalesce(COUNT_TASKS).mapInArrow(_count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    pairs, chars = np.zeros(1 << PAIR_BITS), np.zeros(1 << CHAR_BITS)
    got = counts.toPandas()  # at most 2^18 + 2^16 rows
    for kind, table in ((0, pairs), (1, chars)):
        part = got[got["kind"] == kind]
        table[part["bucket"].to_numpy()] = part["n"].to_numpy()
    return PairScores(pairs, chars)


_OUT = "id long, field string, text string, restored string, mapping string"
_ARROW = pa.schema([("id", pa.int64()), *[(c, pa.string()) for c in ("field", "text", "restored", "mapping")]])


def find_garbled(df: DataFrame, id_col: str, text_cols: list[str], model: PairScores | None = None) -> DataFrame:
    """One row per id and field whose text is garbled, wholly or in part: the text, the text
    as far as it could be restored, and the mappings used (``lost`` if none applies)."""
    spark = df.sparkSession
    model = model or fit_pairs(df, text_cols)
    shared = spark.sparkContext.broadcast((model.pairs.astype(np.float32), model.chars.astype(np.float32)))
    fields = list(text_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PairScores(*shared.value)
        known: dict[str, tuple[bool, str, str]] = {}
        for b in batches:
            rows: list[tuple] = []
            ids = b.column(0).to_pylist()
            for k, field in enumerate(fields):
                enc = pc.dictionary_encode(b.column(k + 1))
                hits = {}
                for i, t in enumerate(enc.dictionary.to_pylist()):
                    if t is None or t.isascii():
                        continue
                    if t not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[t] = restore(t, m)
                    if known[t][0]:
                        hits[i] = (t, known[t][1].encode("utf-8", "replace").decode(), known[t][2])
                if hits:
                    rows += [(ids[r], field, *hits[i]) for r, i in enumerate(enc.indices.to_pylist()) if i in hits]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    found = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), *[F.col(c).cast("string") for c in fields]).mapInArrow(run, _OUT)
    return found.dropDuplicates(["id", "field"])
