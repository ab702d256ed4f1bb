import numpy as np
import pytest

from pagemill.llm.garbled import PAIR_BITS, find_garbled, restore, segments, unread_utf8

LINES = [
    "Die Bürgerschaft hörte die müde Wäscherei über die große Brücke",
    "La société était fermée près de la rivière après l’été",
    "Господин Вензов сообщает, что дорога наконец открыта",
    "A estação de Tarnejão não será fechada pela irmã",
    "The baker of the old town closed the bridge again",
    "Český řez a žlutá šála",
]
DDL = "span_id long, text string, font string, field string"


def misread(s, right, wrong):
    b = s.encode(right)
    return "".join(bytes([x]).decode(wrong) if wrong == "latin-1" else bytes([x]).decode(wrong, "replace") for x in b)


GARBLED = [
    (misread(LINES[0], "utf-8", "latin-1"), LINES[0]),
    (misread("hörte die große", "utf-8", "mac_roman"), "hörte die große"),
    (misread("société était fermée", "utf-8", "cp437"), "société était fermée"),
    (misread("дорога наконец открыта", "cp1251", "latin-1"), "дорога наконец открыта"),
    (misread("дорога наконец открыта", "koi8-r", "cp1251"), "дорога наконец открыта"),
    (misread("дорога", "utf-8", "cp1251").replace("�", "\x98"), "дорога"),
    (misread(misread("irmã não", "utf-8", "latin-1"), "utf-8", "latin-1"), "irmã não"),
    ("Die große " + misread("Brücke", "utf-8", "latin-1"), "Die große Brücke"),
]
CLEAN = ["Ÿ 723 Žlutá", "├── plate 230", "√624 ≈ 287,4", "µ = 658 Ω", "23 °C, ¼ lb", "ATENÇÃO: A ESTAÇÃO", "a\xa0b\xa0c", "Die Brücke", "ДОРОГА НАКОНЕЦ ОТКРЫТА", "", "plain", "Тhе old tоwn"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, LINES[i % len(LINES)], "Größe-Antiqua" if i % 2 else None, "clash") for i in range(1200)]
    rows += [(5000 + i, g, misread("Größe-Antiqua", "utf-8", "latin-1") if i == 0 else "Größe-Antiqua", "c") for i, (g, _) in enumerate(GARBLED)]
    rows += [(6000 + i, c, "Plain", "c") for i, c in enumerate(CLEAN)]
    rows += [(7000, None, None, "c"), (7001, "f�r die Br�cke", "Plain", "c"), (7001, "f�r die Br�cke", "Plain", "c"), (7002, "x" * 100_000 + " " + misread("Brücke", "utf-8", "latin-1"), "Plain", "c"), (None, "Ã¼", "x", "c")]
    return spark.createDataFrame(rows, DDL)


def test_finds_and_restores(corpus):
    got = {(r.id, r.field): r for r in find_garbled(corpus, "span_id", ["text", "font"]).collect()}
    want = {(5000 + i, "text") for i in range(len(GARBLED))} | {(5000, "font"), (7001, "text"), (7002, "text")}
    assert set(got) == want
    for i, (_, clean) in enumerate(GARBLED):
        assert got[5000 + i, "text"].restored == clean
    assert got[7001, "text"].mapping == "lost" and got[7001, "text"].restored == "f�r die Br�cke"
    assert got[7002, "text"].restored.endswith(" Brücke") and len(got[7002, "text"].restored) == 100_007


def test_empty(spark):
    assert find_garbled(spark.createDataFrame([], DDL), "span_id", ["text"]).count() == 0


def test_segments_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(200):
        s = [float(x) for x in rng.integers(-4, 5, rng.integers(1, 12))]
        got = segments(s)
        assert all(sum(s[a:b]) > 0 for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
        best = max(sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1))
        if best > 0:
            assert max(sum(s[a:b]) for a, b in got) == best
        covered = {k for a, b in got for k in range(a, b)}
        assert {k for k, x in enumerate(s) if x > 0} <= covered


def test_symbols_of_a_codec_are_not_confused_with_bytes():
    assert unread_utf8("Ã¼", "mac_roman")[1] == 0 or unread_utf8("Ã¼", "mac_roman")[0] != "ü"
    assert unread_utf8("√º", "mac_roman") == ("ü", 1) and PAIR_BITS == 18


def test_clean_text_is_left(spark):
    from pagemill.llm.garbled import fit_pairs

    m = fit_pairs(spark.createDataFrame([(1, t, None, "") for t in LINES * 200], DDL), ["text"])
    for t in [*LINES, *CLEAN]:
        assert restore(t, m)[:2] == (False, t)


CUT = ["Die Bürgerschaft hörte die mÃde Wäscherei", "La société était fermÃe", "prÃs de la rivière après l’été", "Ãpicerie", "the baker said, with regret,â€ and", "die groГe Brücke", "die BrГcke", "La soci├t├ de la ville", "irmÃ  da velha"]


def test_sequences_that_lost_their_end_are_reported(spark):
    from pagemill.llm.garbled import fit_pairs

    more = ["épicerie de la ville", "“The bridge is closed, with regret,” said the baker", "A irmã da velha estação"]
    m = fit_pairs(spark.createDataFrame([(1, t, None, "") for t in [*LINES, *more] * 200], DDL), ["text"])
    for t in CUT:
        assert restore(t, m) == (True, t, "lost"), t
    for t in [*LINES, *more, *CLEAN, "MAÇÃ E LÃ, 978 RÉIS", "Âge moyen", "¬ 1935", "Реlumã e Реluzãо"]:
        assert not restore(t, m)[0], t
