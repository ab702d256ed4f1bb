import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm.visual import LOOK_ALIKES, canonical_form, print_classes, same_print_pairs, visible_form, with_forms

ZWSP, SHY, NBSP, NNBSP, BOM = map(chr, (0x200B, 0xAD, 0xA0, 0x202F, 0xFEFF))


def test_alike():
    for a, b in [
        ("Fähre", unicodedata.normalize("NFD", "Fähre")),
        ("a b", f"a{NBSP}b"),
        ("a b", f"a{NNBSP}b"),
        ("abc", f"a{ZWSP}b{SHY}c{BOM}"),
        ("Hotel 12", "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in "Hotel 12")),
        ("Marberg copy", "Маrbеrg сору"),
        (" x ", "x"),
        ("", ZWSP + " "),
    ]:
        assert visible_form(a) == visible_form(b) and canonical_form(visible_form(a)) == canonical_form(visible_form(b))


def test_visibly_different():
    for a, b in [("café", "cafe"), ("Test", "test"), ("m²", "m2"), ("a–b", "a-b"), ("½", "1/2"), ("a  b", "a b"), ("ﬁ", "fi"), ("…", "...")]:
        assert visible_form(a) != visible_form(b)
    for a, b in [("Test", "tEST"), ("m²", "m2"), ("ﬁ", "FI"), ("Straße", "STRASSE")]:
        assert canonical_form(visible_form(a)) == canonical_form(visible_form(b))


def test_table_is_lossless_on_latin():
    assert all(v.isascii() and not k.isascii() for k, v in LOOK_ALIKES.items())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_idempotent(text):
    v = visible_form(text)
    assert visible_form(v) == v
    c = canonical_form(v)
    assert canonical_form(visible_form(c)) == canonical_form(c) or not c.isascii()


DDL = "span_id long, doc_id long, text string, at int, visible string"


def test_pairs_and_classes(spark):
    rows = [(1, 1, "ab c"), (2, 1, f"ab{NBSP}c"), (3, 1, "ab c "), (4, 2, f"a{ZWSP}b c"), (5, 1, "AB c"), (6, 1, None), (7, None, "x"), (8, None, f"x{ZWSP}"), (9, 1, ""), (10, 1, ZWSP), (2, 1, f"ab{NBSP}c")]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows] + [(5, 1, f"a{SHY}b c", 2, "late")], DDL)
    got = sorted(map(tuple, same_print_pairs(df, "span_id", "doc_id", "text", "at").collect()))
    assert got == [(1, 2), (1, 5), (2, 3), (2, 5), (3, 5), (7, 8), (9, 10)]
    cls = {r.id: r for r in print_classes(df, "span_id", "doc_id", "text", "at").collect()}
    assert 6 not in cls and cls[1].print_class == cls[5].print_class and (cls[1].texts, cls[1].ids) == (3, 4) and cls[4].texts == 1
    assert same_print_pairs(df.limit(0), "span_id", "doc_id", "text").count() == 0


def test_forms_keep_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, None, 1, "v"), (2, 1, "A" * 200_000 + ZWSP, 1, "v"), (3, 1, "", 1, "v")], DDL)
    got = {r.span_id: r for r in with_forms(df).collect()}
    assert got[1].visible is None and got[2].visible == "A" * 200_000 and got[2].canonical == "a" * 200_000 and got[3].canonical == ""
