import itertools

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions.geometry import Box, derotate, js_round


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(col(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("value", "want"), [("", True), (" \t 　", True), ("a", False), (" .", False), ("﻿", False), (None, None)])
def test_white(spark, value, want):
    assert one(spark, X.is_white, value) is want


@pytest.mark.parametrize(("value", "want"), [("o x", True), ("• x", True), ("-", True), ("-x", False), ("ox", False), ("■ y", True), ("x", False), ("", False)])
def test_bullets(spark, value, want):
    assert one(spark, X.starts_with_bullet, value) is want


@pytest.mark.parametrize(("value", "want"), [("x\\|y", "x\\\\\\|y"), ("a|b", "a\\|b"), ("end\\", "end\\\\"), ("a\\b", "a\\b"), ("", "")])
def test_escape(spark, value, want):
    from pagemill.operators.table_kernel import escape

    assert one(spark, X.escape_cell, value) == want == escape(value)


@pytest.mark.parametrize(("value", "want"), [("Smith-\nJones", "Smith-Jones"), ("a\nb", "a b"), ("3-\n4", "3- 4")])
def test_join_lines(spark, value, want):
    assert one(spark, X.join_cell_lines, value) == want


@pytest.mark.parametrize(("value", "want"), [("Name ..... 12", "Name 12"), ("a . . . b", "a b"), ("..", ".."), (". .", ". ."), ("x\n....\ny", "x\ny"), ("." * 20_000, "")])
def test_leaders(spark, value, want):
    assert one(spark, X.strip_leaders, value) == want


@pytest.mark.parametrize(("value", "want"), [("", True), ("ok text", False), ("a�b", True), ("", True), ("%%%%", True), ("12,5", False), ("a\x01", True), ("!?", False)])
def test_broken(spark, value, want):
    assert one(spark, X.looks_broken, value) is want


def test_stray_letter(spark):
    assert one(spark, X.stray_letter, "wоrd") is True  # Cyrillic o
    assert one(spark, X.stray_letter, "слoво") is True  # Latin o
    assert one(spark, X.stray_letter, "word слово") is False


def test_homoglyphs():
    assert X.fix_homoglyphs("cлово дорога") == "слово дорога"
    assert X.fix_homoglyphs("copy of word") == "copy of word"
    assert X.fix_homoglyphs("он и oна вместе, cop") == "он и она вместе, сор"
    assert X.fix_homoglyphs(None) is None and X.fix_homoglyphs("") == ""


def test_clean(spark):
    assert one(spark, X.clean_block, "a \nb  c\n\n\nd") == "a\nb c\n\nd"
    assert one(spark, X.clean_page, "\n\na ,b-\nc\x00") == "a,bc�"


def test_plausibility(spark):
    assert one(spark, X.plausibility, "good words 12") == 1.0 and one(spark, X.plausibility, "") == 0.0
    assert one(spark, X.plausibility, "~~ x") == -0.5


def test_colors_and_rounding(spark):
    assert one(spark, lambda c: X.pack_color(c), 1.0, "double") == 0xFFFFFF
    assert one(spark, lambda c: X.pack_color(c, F.lit(0.5), F.lit(0.0)), 1.0, "double") == 0xFF8000
    assert one(spark, js_round, -2.5, "double") == -2 and one(spark, js_round, 2.5, "double") == 3
    assert one(spark, lambda c: X.font_flags(c, F.lit(False), c, c), True, "boolean") == 2 | 8 | 16


def test_styles(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, lambda c: X.inline_style(c, t, t, t), "x ") == "_**`x`**_ "
    assert one(spark, lambda c: X.inline_style(c, f, f, f, F.lit("u")), "x") == "[x](u) "
    assert one(spark, lambda c: X.heading_style(c, F.lit("# "), t, t, f), "x") == "# **_x_**"
    assert one(spark, lambda c: X.bullet_text(c, F.lit(60.0), F.lit(50.0), F.lit(10.0), F.lit(15.0)), "• a") == "  - a"


def test_box_algebra(spark):
    rows = [(a, b) for a, b in itertools.product([(0, 0, 10, 10), (10, 0, 20, 10), (2, 2, 4, 4), (30, 30, 30, 40)], repeat=2)]
    df = spark.createDataFrame([tuple(float(v) for v in (*a, *b)) for a, b in rows], ", ".join(f"{n} double" for n in ("ax0", "ay0", "ax1", "ay1", "bx0", "by0", "bx1", "by1")))
    a, b = Box.of("a"), Box.of("b")
    got = df.select(a.disjoint(b).alias("d"), a.disjoint(b, True).alias("s"), a.intersects(b).alias("i"), b.contains(a).alias("c"), a.almost_in(b).alias("m"), a.is_empty.alias("e"), a.union(b).area.alias("u")).collect()
    for (p, q), r in zip(rows, got, strict=True):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        assert r.d == (w <= 0 or h <= 0) and r.s == (w < 0 or h < 0) and r.i == (w > 0 and h > 0)
        assert r.c == (q[0] <= p[0] and p[2] <= q[2] and q[1] <= p[1] and p[3] <= q[3])
        assert r.m == (max(w, 0) * max(h, 0) > 0.8 * (p[2] - p[0]) * (p[3] - p[1])) and r.e == (p[0] >= p[2] or p[1] >= p[3])
        assert r.u == (max(p[2], q[2]) - min(p[0], q[0])) * (max(p[3], q[3]) - min(p[1], q[1]))
    turned = df.limit(1).select(*derotate(Box.of("a"), 90, 100.0, 50.0)).first()
    assert tuple(turned) == (0.0, 90.0, 10.0, 100.0)
