"""Pages with template residue, filler, error messages or script notices in place of content.

Method: a linear classifier with an L2 penalty on hashed n-grams (characters, and shapes in
which all letters are one) of short windows, plus length and title features of the page,
trained on weak labels. Labels come from rules, not from a list of texts: status lines, words
of machinery side by side, placeholder syntax, filler. Short pages that the rules take for
residue teach further phrases: their runs of PHRASE words, where two such pages share one and
ordinary pages do not, also label pages. Hosts (newspapers) of the validation set are not in the training set, and
``fit_model(skip=...)`` measures rules that were left out. A page is found if any window of it
scores over the threshold, so residue inside an article counts as much as a page of nothing
else.

Windows are scored as differences of running sums over the whole page, so every window of every
page is looked at, whole texts, no sampling. Only training is bounded: labels come from about
``LABEL_PAGES`` pages drawn by hash, at most ``PAGE_WINDOWS`` windows of each, ``NEGATIVES``
ordinary windows a page and, in a second round, the ordinary window of each of these pages that
the model before took for residue most (what no rule and no learned phrase knows counts as
ordinary there, so wording of many pages must be known to one of them); phrases from about ``SHORT_PAGES`` short and
``ORDINARY_PAGES`` ordinary pages.

Defined results for unusual input: null texts and texts shorter than an n-gram are no residue; a
page shorter than a window is one window; without any labelled residue nothing is found; repeated pages give a row
per id; null hosts count as one host; missing boxes mean line order; extra columns are ignored.

Scale: training data and model have fixed bounds (the windows above, 2^18 weights = 1 MB,
broadcast); the drawn pages are written once; scoring is a narrow vectorised map without a
shuffle.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.leaks import slices
from pagemill.llm.pages import BREAKS, CLASSES, page_texts
from pagemill.session import cut

WINDOW = 40
#: orders of the character n-grams, and of those of the shape, in which all letters are one
ORDERS = (3, 5)
SHAPE_ORDER = 4
BITS = 18
LABEL_PAGES = 40_000
NEGATIVES = 3
#: rounds that add the ordinary windows taken for residue
MINED = 1
SEED = 11
BLOCK = 20_000
PENALTY = 2e-6
#: log odds from which a window counts as residue
THRESHOLD = 2.5

#: pages of at most this many characters count as short: a page of a few words is an article rarely
SHORT = 200
#: words of a learned phrase, windows a labelled page gives
PHRASE, PAGE_WINDOWS = 4, 16
#: short pages phrases are learned from; ordinary pages they are checked in, and how many of these may hold one
SHORT_PAGES, ORDINARY_PAGES, ORDINARY_HITS = 20_000, 5_000, 2

# Weak labels are rules, not a list of texts: kinds of words that stand side by side (or up to
# ``gap`` words apart) where a page speaks of its own machinery instead of the news.
KINDS = {
    "javascript": "javascript",
    "scripts": "scripts scripting skripte skripts cookies",
    "switch": "enable enabled enabling disabled allow allowed activate activated activer activez autoriser autorisez aktivieren aktiviert erlauben erlaubt turn turned switch switched block blocked unblock need needs require requires required accept",
    "your": "your votre ihr ihre ihren",
    "browser": "browser navigateur",
    "error": "error erreur fehler status http code",
    "number": "999",
    "reason": "forbidden gone unauthorized conflict",
    "page": "page file document issue seite datei dokument ausgabe", "not": "not nicht", "found": "found gefunden", "bad": "bad", "gateway": "gateway", "request": "request requests", "internal": "internal interner", "server": "server serveur", "service": "service",
    "unavailable": "unavailable indisponible", "timeout": "timeout time-out timed", "too": "too", "many": "many", "load": "connection loading request requête",
    "something": "something", "went": "went", "wrong": "wrong", "reload": "reload", "session": "session sitzung", "sign": "sign log", "in": "in", "again": "again",
    "mock": "dummy sample placeholder mock nonsense filler test", "copy": "text copy words paragraph", "filler": "blindtext fülltext platzhalter", "texte": "texte", "de": "de", "remplissage": "remplissage",
    "slot": "slug ort lieu place copy text caption headline picture photo title name date byline story advert subhead titel datum bild titre nom texte légende", "to": "to", "come": "come follow", "goes": "goes comes", "here": "here", "insert": "insert your enter type", "tbd": "tbd tbc tk slug",
    "fill": "einfügen ergänzen", "job": "job task worker thread", "fail": "failed lost aborted crashed", "on": "on at by for", "à": "à", "complete": "compléter insérer", "ici": "ici hier", "later": "viendra später", "of": "of", "person": "editor author reporter photographer writer",
    "keys": "asdf asdfgh qwer qwerty jkl jkl; hjkl zxcv", "bla": "bla blah",
    "undefined": "undefined nan.nan nan.nan.nan [object", "nan": "nan null", "null": "null",
}
#: kinds of words in order, words that may stand between two of them
RULES = (
    (("javascript",), 0), (("scripts", "switch"), 4), (("switch", "scripts"), 4),
    (("browser",), 0),
    (("error", "number"), 0), (("number", "not", "found"), 0), (("page", "not", "found"), 0), (("number", "reason"), 0), (("bad", "gateway"), 0), (("number", "bad", "request"), 0), (("server", "error"), 0), (("service", "unavailable"), 0), (("gateway", "timeout"), 0), (("too", "many", "request"), 0), (("load", "timeout"), 1),
    (("something", "went", "wrong"), 0), (("reload",), 0), (("your", "session"), 0), (("sign", "in", "again"), 0),
    (("mock", "copy"), 0), (("filler",), 0), (("texte", "de", "remplissage"), 0),
    (("slot", "to", "come"), 0), (("slot", "goes", "here"), 0), (("insert", "slot", "here"), 0), (("slot", "tbd"), 0), (("tbd", "tbd"), 0), (("slot", "fill"), 0), (("job", "fail"), 2), (("slot", "à", "complete"), 0), (("ici", "later"), 2), (("slot", "of", "person"), 0),
    (("keys", "keys"), 1), (("bla", "bla"), 0),
    (("undefined",), 0), (("on", "nan"), 0), (("null", "null"), 3),
)
#: words of machinery; a short page that holds two of them is residue
MACHINERY = frozenset(
    "error erreur fehler server serveur session sitzung request requests timed timeout browser viewer reader scripts skripte javascript cookies file access accès permission login loading load laden failed unavailable unable displayed maintenance offline reload retry cannot trace exception null introuvable indisponible délai zeitüberschreitung interner aktivieren erlauben autoriser activer veuillez bitte sign available fetched fetching address adresse ressource gefunden refused refusé device app job worker memory pointer overflow stack trace".split()
)
#: placeholder syntax of template languages and formats: what it cannot be without, and its pattern
SYNTAX = {
    "braces": ("{{", r"\{\{[^{}]{0,40}\}\}"), "block": ("{%", r"\{%[^{}]{0,40}%\}"), "dollar": ("${", r"\$\{[^{}]{0,40}\}"), "hash": ("#{", r"#\{[^{}]{0,40}\}"), "percent tag": ("<%", r"<%=?[^<>]{0,40}%>"), "double bracket": ("[[", r"\[\[[^\[\]]{0,40}\]\]"),
    "guillemets": ("<<", r"<<[^<>]{0,40}>>"), "at signs": ("@@", r"@@[^@]{1,40}@@"), "underscores": ("__", r"__[a-z]\w{0,30}__"), "format": ("%(", r"%\([a-z_]{1,30}\)[sd]"), "entity": ("&lt;", r"&lt;[^&]{1,40}&gt;"), "dollar name": ("$", r"\$[a-z_]{2,30}\$"), "question": ("?", r"\?[a-z_]{3,30}\?"),
    "numbered": ("9", r"\{\d+\}|%\d\$[sd]\b"), "printf": ("%", r"%[sd]\b.{0,20}%[sd]\b"), "identifier": ("", r"[\[({<][a-z]{2,20}[._][a-z_.]{2,30}[\])}>]"), "bracketed slot": ("", r"[\[<{](?:your|insert|name|enter|headline|caption|byline|subhead|title|date)\b[^\]>}]{0,40}[\]>}]"),
    "crosses": ("xxx", r"(?<!\w)x{3,}(?: x{2,})+"), "digits": ("99999999", r"\b9{8,}\b"), "source line": (".", r"\.(?:js|ts|py|java|php|cs|rb|cpp|dll|exe)\b"), "failed": ("failed: ", r"failed: "),
}
#: words of the customary filler passage; four in a row are filler
FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur".split())
#: names of all rules, to leave some out
RULE_NAMES = (*(" ".join(kinds) for kinds, _ in RULES), *SYNTAX, "lorem", "repeat", "short")


@lru_cache
def _lower() -> np.ndarray:
    t = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        t[i] = 32 if c.isspace() else 57 if c.isdigit() else ord("f") if c == "ſ" else ord(c.lower()[0])
    t[0] = 0
    return t


@lru_cache
def _break_marks() -> np.ndarray:
    t = np.zeros(1 << 16, bool)
    t[[ord(c) for c in BREAKS]] = True
    return t


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts, broken words joined, and the offsets of each text."""
    raw = np.frombuffer(("\x00".join(t.replace("\x00", " ") for t in texts) + "\x00").encode("utf-32-le", "replace"), dtype=np.uint32)
    raw = np.where(raw < 1 << 16, raw, 0xFFFD)
    c = _lower()[raw]
    line = np.flatnonzero(raw == 10)
    keep = np.ones(len(raw), bool)
    torn = line[(line > 0) & _break_marks()[raw[np.maximum(line - 1, 0)]]]
    keep[torn] = keep[torn - 1] = False
    stops = np.flatnonzero(raw == 0)
    keep[stops] = False
    ends = np.cumsum(keep)[stops]
    return c[keep], np.concatenate([[0], ends])


_BASE = np.uint32(0x01000193)


def gram_buckets(c: np.ndarray, order: int) -> np.ndarray:
    n = len(c) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, np.uint32(order * 7919), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(order):
            h *= _BASE
            h ^= c[k : k + n].astype(np.uint32, copy=False)
        h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


@lru_cache
def _shapes() -> np.ndarray:
    return np.array([ord("a") if chr(i).isalpha() else i for i in range(1 << 16)], np.uint32)


def window_grams(c: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(order, bucket at each start) of all kinds of n-grams; buckets under 32 are kept free."""
    grams = [(o, gram_buckets(c, o)) for o in ORDERS]
    grams.append((SHAPE_ORDER, gram_buckets(_shapes()[c.astype(np.int64)], SHAPE_ORDER)))
    return [(o, np.maximum(b, 32)) for o, b in grams]


def page_features(length: int, at_top: bool) -> list[int]:
    """Buckets of the page's length and of the window standing in its title."""
    size = 0 if length < 60 else 1 if length < 150 else 2 if length < 400 else 3 if length < 1500 else 4
    return [size, 5 + at_top, 7 + size * 2 + at_top]


def window_features(c: np.ndarray, length: int, at_top: bool) -> np.ndarray:
    return np.concatenate([*(b for _, b in window_grams(c)), page_features(length, at_top)]).astype(np.int32)


class Model:
    """Weights by bucket; buckets under 32 are the page features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def best_windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Highest window score of each text and its start in the folded stream, with the stream."""
        c, off = stream(texts)
        gaps = [(o, np.concatenate([[0.0], np.cumsum(self.weights[b], dtype=np.float64)])) for o, b in window_grams(c)]
        score, where = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        for k in range(len(texts)):
            a, z = int(off[k]), int(off[k + 1])
            n = z - a
            if n < min(ORDERS):
                continue  # nothing to judge by
            width = min(WINDOW, n)
            starts = n - width + 1
            s = np.zeros(starts)
            for o, g in gaps:
                if width >= o:
                    s += g[a + width - o + 1 : a + width - o + 1 + starts] - g[a : a + starts]
            low, top = (sum(float(self.weights[b]) for b in page_features(n, t)) for t in (False, True))
            s[0] += top - low
            j = int(s.argmax())
            score[k], where[k] = s[j] + low + self.bias, a + j
        return score, where, c, off


def train(features: list[np.ndarray], labels: np.ndarray, rounds: int = 80, penalty: float = PENALTY) -> Model:
    """Logistic regression with an L2 penalty, full-batch Adam; classes weigh the same."""
    size = 1 << BITS
    w, bias = np.zeros(size), 0.0
    if not len(labels) or labels.min() == labels.max():
        return Model(w, -10.0 if not len(labels) or not labels.max() else 0.0)
    parts = []  # blocks of windows: memory of a step does not grow with the training set
    for k in range(0, len(features), BLOCK):
        sizes = np.array([len(f) for f in features[k : k + BLOCK]])
        parts.append((np.concatenate(features[k : k + BLOCK]), sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])))
    weight = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        near = w.astype(np.float32)
        z = np.concatenate([np.add.reduceat(near[flat], begin, dtype=np.float64) for flat, _, begin in parts]) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        g = penalty * w
        for k, (flat, sizes, _) in enumerate(parts):
            g += np.bincount(flat, weights=np.repeat(err[k * BLOCK : (k + 1) * BLOCK], sizes), minlength=size)
        gb = err.sum()
        rate = 0.16 * min(1.0, 3 * (1 - t / (rounds + 1)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return Model(w, bias)


# --- weak labels -------------------------------------------------------------------------


@lru_cache
def _fold_table() -> dict[int, str]:
    table = {ord(c): g[0] for g in CLASSES for c in g}
    for a, b in (("àáâãäåçèéêëòóôõöø", "a"), ("ìíîï|!1", "i"), ("ùúûüñ", "n"), ("ý", "v")):
        for c in a:
            table[ord(c)] = b
    return table


def _fold(text: str) -> str:
    return text.translate(_fold_table())


@lru_cache
def _kinds() -> tuple[dict[str, frozenset[str]], dict[str, frozenset[str]]]:
    """Kinds by word as it is and, from six letters on, by word with confusable letters folded."""
    out: tuple[dict[str, set[str]], dict[str, set[str]]] = {}, {}
    for kind, names in KINDS.items():
        for w in names.split():
            out[0].setdefault(w, set()).add(kind)
            if len(w) >= 6:
                out[1].setdefault(_fold(w), set()).add(kind)
    return tuple({w: frozenset(k) for w, k in d.items()} for d in out)


@lru_cache
def _syntax(skip: frozenset[str]) -> tuple[tuple[str, re.Pattern], ...]:
    return tuple((need, re.compile(p)) for n, (need, p) in SYNTAX.items() if n not in skip)


@lru_cache
def _machinery() -> frozenset[str]:
    return frozenset(map(_fold, MACHINERY))


_EDGE = ".,;:!?\"'“”„«»()"


class PageWords:
    """Words of a folded stream without marks around them; places are worked out when asked for."""

    def __init__(self, text: str):
        self.raw = text.split(" ")
        self.plain = [w.strip(_EDGE) for w in self.raw]
        self.folded = [w.strip(_EDGE) for w in _fold(text).split(" ")]  # letter for letter, so words are the same
        self._at: list[int] = []

    def place(self, first: int, last: int) -> tuple[int, int]:
        """From the begin of a word to the end of another."""
        if not self._at:
            self._at = [0, *itertools.accumulate(len(w) + 1 for w in self.raw)]
        a = self._at[first] + (self.raw[first].index(self.plain[first]) if self.plain[first] else 0)
        return a, self._at[last] + len(self.raw[last].rstrip(_EDGE))


def phrases_of(words: PageWords) -> list[tuple[int, int, int]]:
    """(hash, first word, last word) of every run of PHRASE words; of all words where there are fewer."""
    w = [k for k, x in enumerate(words.folded) if x]
    n = min(PHRASE, len(w))
    return [(zlib.crc32(" ".join([words.folded[j] for j in w[k : k + n]]).encode()), w[k], w[k + n - 1]) for k in range(len(w) - n + 1)] if n else []


def _known_phrases(words: PageWords, known: frozenset[int]) -> list[tuple[int, int]]:
    return [words.place(a, z) for h, a, z in phrases_of(words) if h in known]


def weak_spans(text: str, known: frozenset[int] = frozenset(), skip: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Where a rule, or a phrase learned from short pages, finds residue in a folded stream
    (lower case, digits 9). ``skip`` names rules that are left out."""
    found = [m.span() for need, p in _syntax(skip) if need in text for m in p.finditer(text)]
    words = PageWords(text)
    plain, folded = _kinds()
    hits = [(k, plain.get(w) or folded[f]) for k, (w, f) in enumerate(zip(words.plain, words.folded, strict=True)) if w in plain or f in folded]
    for start, (k, mine) in enumerate(hits):
        for kind in mine:
            for wanted, gap, name in _rules().get(kind, ()):
                last, at = k, start
                for more in wanted[1:]:
                    at = next((j for j in range(at + 1, min(len(hits), at + gap + 2)) if hits[j][0] - last <= gap + 1 and more in hits[j][1]), -1)
                    if at < 0:
                        break
                    last = hits[at][0]
                if at >= 0 and name not in skip:
                    found.append(words.place(k, last))
    if "lorem" not in skip and len(FILLER.intersection(words.plain)) >= 3:
        found += [words.place(a, z) for a, z in _runs(w in FILLER for w in words.plain) if z - a >= 3]
    if "repeat" not in skip:
        same = [k for k, (a, b) in enumerate(zip(words.plain, words.plain[1:], strict=False)) if a == b and a.isalpha()]
        found += [words.place(same[a], same[z + 1] + 1) for a, z in _runs(b - a == 1 for a, b in zip(same, same[1:], strict=False)) if z - a >= 1] if len(same) >= 3 else []
    if len(text) <= SHORT and "short" not in skip and len(_machinery().intersection(words.folded)) >= 2:
        found.append((0, len(text)))
    if known:
        found += _known_phrases(words, known)
    return sorted(found)


def _runs(flags) -> list[tuple[int, int]]:
    """First and last index of each stretch of true values."""
    out, k = [], 0
    for yes, part in itertools.groupby(flags):
        n = sum(1 for _ in part)
        if yes:
            out.append((k, k + n - 1))
        k += n
    return out


@lru_cache
def _rules() -> dict[str, list[tuple[tuple[str, ...], int, str]]]:
    out: dict[str, list[tuple[tuple[str, ...], int, str]]] = {}
    for wanted, gap in RULES:
        out.setdefault(wanted[0], []).append((wanted, gap, " ".join(wanted)))
    return out


def _unit(text: str) -> str:
    c, _ = stream([text])
    return c.astype(np.uint32).tobytes().decode("utf-32-le", "replace")


def labelled_windows(text: str, rng: np.random.Generator, known: frozenset[int] = frozenset(), skip: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """(label, start, length of the page) of training windows of one folded page, at most
    PAGE_WINDOWS. A short page with residue is residue as a whole."""
    n = len(text)
    if not n:
        return []
    spans = weak_spans(text, known, skip)
    last = max(0, n - WINDOW)
    if not spans:
        return [(0, int(x), n) for x in rng.integers(0, last + 1, NEGATIVES)]
    if n <= SHORT:
        spans = [(0, n)]
    starts: set[int] = set()
    for a, b in spans:
        if b - a >= WINDOW:
            starts |= {min(last, int(x)) for x in np.linspace(a, b - WINDOW, min(6, 2 + (b - a - WINDOW) // 20))}
        else:
            lo, hi = max(0, b - WINDOW), min(a, last)
            starts |= {x for x in (min(lo, hi), hi, (lo + hi) // 2) if 0 <= x <= last}
    take = sorted(starts)
    if len(take) > PAGE_WINDOWS:
        take = [take[i] for i in np.linspace(0, len(take) - 1, PAGE_WINDOWS).astype(int)]
    return [(1, x, n) for x in take]


# --- Spark side --------------------------------------------------------------------------


def _source(df: DataFrame, id_col: str, text_col: str, boxes_col: str | None, host_col: str | None = None) -> DataFrame:
    boxes = F.transform(F.col(boxes_col), lambda b: F.struct(b["x0"].cast("int").alias("x0"))) if boxes_col else F.lit(None).cast("array<struct<x0:int>>")
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col else F.lit("")
    return df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), boxes.alias("boxes"), host.alias("host"))


def _share(rows: int, most: int) -> Column:
    """Rows drawn by hash so that about ``most`` of ``rows`` remain."""
    return F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < F.lit(int(min(1.0, most / max(rows, 1)) * (1 << 30)))


def _label_sample(src: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages to label, short pages to learn phrases from and pages to check these in, all bounded
    and written once."""
    size = F.length("text")
    n, short = src.agg(F.count(F.lit(1)), F.count(F.when(size <= 2 * SHORT, 1))).first()
    pages, brief = _share(n, LABEL_PAGES), (size <= 2 * SHORT) & _share(short, SHORT_PAGES)
    drawn = cut(src.filter(pages | brief).withColumns({"in_pages": pages, "in_short": brief, "in_check": _share(n, min(ORDINARY_PAGES, LABEL_PAGES))}))
    return tuple(drawn.filter(c).select(*src.columns) for c in ("in_pages", "in_short", "in_check"))


def learned_phrases(short: DataFrame, pages: DataFrame, skip: frozenset[str] = frozenset()) -> frozenset[int]:
    """Phrases that stand in two or more short pages which the rules take for residue and in
    hardly any page of ``pages`` that they do not."""

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[int] = []
            for text in page_texts(b.column(1), b.column(2)):
                unit = _unit(text)
                if 0 < len(unit) <= SHORT and weak_spans(unit, skip=skip):
                    got += {h for h, _, _ in phrases_of(PageWords(unit))}
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["phrase"])

    held = short.mapInArrow(teach, "phrase long").groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    learned = frozenset(r.phrase for r in held.select("phrase").toLocalIterator())  # at most SHORT_PAGES times the words of a short page
    if not learned:
        return learned

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[int] = []
            for text in page_texts(b.column(1), b.column(2)):
                unit = _unit(text)
                here = {h for h, _, _ in phrases_of(PageWords(unit))} & learned if len(unit) > SHORT else ()
                if here and not weak_spans(unit, skip=skip):
                    got += here
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64())], names=["phrase"])

    common = pages.mapInArrow(ordinary, "phrase long").groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ORDINARY_HITS)
    return learned - {r.phrase for r in common.select("phrase").toLocalIterator()}


_WINDOWS = "label int, host string, length int, top boolean, piece string"


def _piece(text: str, start: int) -> str:
    return text[start : start + WINDOW]


def _labeller(known: frozenset[int], skip: frozenset[str]):
    """Training windows: label 1 residue, 0 ordinary; 2 what only the rules left out find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, host in zip(b.column(0).to_pylist(), page_texts(b.column(1), b.column(2)), b.column(3).to_pylist(), strict=True):
                unit = _unit(text)
                got = labelled_windows(unit, np.random.default_rng([SEED, i & 0x7FFFFFFF]), known, skip)
                if skip and got and not got[0][0]:
                    got = [(2, x, n) for y, x, n in labelled_windows(unit, np.random.default_rng(SEED)) if y] or got
                rows += [(label, host, n, start == 0, _piece(unit, start)) for label, start, n in got]
            if rows:
                yield _windows(rows)

    return run


def _windows(rows) -> pa.RecordBatch:
    types = (pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["label", "host", "length", "top", "piece"])


def _vectors(pdf) -> list[np.ndarray]:
    return [window_features(np.frombuffer(p.encode("utf-32-le"), np.uint32), int(n), bool(t)) for p, n, t in zip(pdf["piece"], pdf["length"], pdf["top"], strict=True)]


def _unseen(hosts) -> np.ndarray:
    """Windows of every fifth host, by hash, are kept for validation."""
    return np.array([zlib.crc32(h.encode()) % 5 == 0 for h in hosts], bool)


def fit_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", boxes_col: str | None = "line_boxes", host_col: str | None = "paper_id", skip: frozenset[str] = frozenset(), validate: bool = True) -> tuple[Model, dict[str, float]]:
    """The classifier and, with ``validate``, its figures on windows of hosts it has not seen
    (every fifth by hash; without it the model learns from all hosts): precision and recall
    against the weak labels and, if rules are left out by ``skip``, the recall of windows in
    pages that only those rules find (in training they counted as ordinary)."""
    spark = df.sparkSession
    sample, short, check = _label_sample(_source(df, id_col, text_col, boxes_col, host_col))
    known = learned_phrases(short, check, skip)
    first = sample.mapInArrow(_labeller(known, skip), _WINDOWS).toPandas()  # LABEL_PAGES pages, PAGE_WINDOWS windows each
    held, vectors, labels = _unseen(first["host"]) & validate, _vectors(first), first["label"].to_numpy(float)
    hidden = labels == 2
    pick = lambda keep: ([v for v, k in zip(vectors, keep, strict=True) if k], labels[keep])
    model = train(*pick(~held & ~hidden))
    for _ in range(MINED if (labels == 1).any() else 0):
        shared = spark.sparkContext.broadcast(model)

        def hardest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                texts, hosts = page_texts(b.column(1), b.column(2)), b.column(3).to_pylist()
                rows = []
                for lo, hi in slices(texts):
                    score, where, c, off = m.best_windows(texts[lo:hi])
                    for k in np.flatnonzero(score > -2.0):
                        unit = c[off[k] : off[k + 1]].astype(np.uint32).tobytes().decode("utf-32-le", "replace")
                        if not weak_spans(unit, known, skip):
                            at = int(where[k] - off[k])
                            rows.append((0, hosts[lo + k], len(unit), at == 0, _piece(unit, at)))
                if rows:
                    yield _windows(rows)

        hard = sample.mapInArrow(hardest, _WINDOWS).toPandas()  # one window a page
        if not len(hard):
            break
        vectors += _vectors(hard)
        labels = np.concatenate([labels, np.zeros(len(hard))])
        held, hidden = np.concatenate([held, _unseen(hard["host"]) & validate]), np.concatenate([hidden, np.zeros(len(hard), bool)])
        model = train(*pick(~held & ~hidden))
    v, y = pick(held)
    hit = np.array([model.weights[f].sum() + model.bias for f in v]) >= THRESHOLD if len(v) else np.zeros(0, bool)
    share = lambda part, whole: float(part.sum() / whole.sum()) if whole.any() else 1.0
    figures = {
        "train_windows": float((~held).sum()), "held_windows": float(held.sum()), "held_positive": float((y == 1).sum()), "held_unlisted": float((y == 2).sum()),
        "precision": share(hit & (y > 0), hit), "recall": share(hit & (y == 1), y == 1), "recall_unlisted": share(hit & (y == 2), y == 2),
    }
    return model, figures


def score_pages(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", boxes_col: str | None = "line_boxes", threshold: float = THRESHOLD) -> DataFrame:
    """id, highest window score and that window, of pages from the threshold on."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, ids = page_texts(b.column(1), b.column(2)), b.column(0)
            rows = []
            for lo, hi in slices(texts):
                score, where, c, _ = m.best_windows(texts[lo:hi])
                for k in np.flatnonzero(score >= threshold):
                    rows.append((ids[lo + k].as_py(), float(score[k]), c[where[k] : where[k] + WINDOW].astype(np.uint32).tobytes().decode("utf-32-le", "replace")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.string()), strict=True)], names=["id", "score", "excerpt"])

    return _source(df, id_col, text_col, boxes_col).mapInArrow(run, "id long, score double, excerpt string")


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", boxes_col: str | None = "line_boxes", host_col: str | None = "paper_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per page that holds residue: id, score, excerpt (folded)."""
    model, _ = fit_model(df, id_col, text_col, boxes_col, host_col, validate=False)
    return score_pages(df, model, id_col, text_col, boxes_col, threshold).groupBy("id").agg(F.max(F.struct("score", "excerpt")).alias("m")).select("id", "m.score", "m.excerpt")


def without_residue(df: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The corpus without the found pages; rows with a null id stay."""
    gone = found.select(F.col("id").alias("__gone"))
    return df.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
