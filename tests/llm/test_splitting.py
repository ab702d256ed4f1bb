import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm.splitting import cut_kind, split_pieces, split_text

LIMITS = "profile string, max_chars int, overlap_chars int"


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    overlap = min(max(overlap, 0), limit - 1)
    assert "".join(text[s:e] for s, e, _, _ in pieces) == text
    before = ""
    for k, (s, e, back, _) in enumerate(pieces):
        piece = text[s - back : e]
        assert 0 < len(piece) <= limit and e > s
        if k:
            assert back == min(overlap, len(before), limit - (e - s)) and piece[:back] == before[len(before) - back :]
            if back < min(overlap, len(before)):  # only for a stretch that leaves no room for all of it
                assert max(map(len, re.split(r"[ \t\r\n]", text))) > limit - overlap or text[s:e].isspace() or text[s:e][0] in " \t\r\n" or text[s:e][-1] in " \t\r\n"
        before = piece
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n\r\t#|`-é́😀，", max_size=300), st.integers(1, 40), st.integers(0, 50))
def test_round_trip_size_and_overlap(text, limit, overlap):
    if text:
        check(text, limit, overlap)


def test_cuts_where_the_text_allows():
    text = "# One\n\n" + "A sentence here. " * 6 + "\n\n# Two\n\n" + "Another one, longer. " * 5
    starts = [text[s : s + 5] for s, *_ in check(text, 140, 10)]
    assert "# Two" in starts


def test_no_cut_inside_words_when_avoidable():
    text = "lorem ipsum dolor sit amet " * 50
    for s, e, _, strength in check(text, 100, 20):
        assert s == 0 or text[s - 1] == " "


def test_crlf_and_marks_stay_together():
    text = ("a" * 9 + "\r\n") * 20
    assert all(not (text[s - 1] == "\r" and text[s] == "\n") for s, *_ in check(text, 30, 4)[1:])
    text = "é" * 100
    assert all(text[s] != "́" for s, *_ in check(text, 31, 4)[1:])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\r\t ", max_size=80), st.integers(1, 20))
def test_cut_kind(text, limit):
    want = "whole" if len(text) <= limit else "forced" if max(map(len, re.split(r"[ \t\r\n]", text))) > limit else "natural"
    if text:
        for overlap in (0, 1, limit // 2, limit):
            assert cut_kind(split_text(text, limit, overlap)) == want


def test_a_stretch_that_fits_is_not_cut():
    text = "a " * 60 + "w" * 95 + " b" * 60
    pieces = check(text, 100, 20)
    assert all(s == 0 or text[s - 1] == " " for s, *_ in pieces) and cut_kind(pieces) == "natural"


def test_operator(spark):
    rows = [(1, "p", None, "t"), (2, "p", "", "t"), (3, "p", "short", "t"), (3, "p", "short", "t"), (4, "q", "x" * 99, "t"), (5, "p", "y" * 25, "a"), (5, "p", "z " * 12, "b"), (6, None, "w" * 50, "t")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "md_id long, profile string, md_string string, made_at string, piece string")
    lim = spark.createDataFrame([("p", 10, 3), ("p", 10, 3), (None, 5, 1), ("bad", 0, 0)], LIMITS)
    got = split_pieces(df, lim).orderBy("id", "piece_no").collect()
    assert [(r.id, r.piece) for r in got if r.id < 5] == [(3, "short")]
    five = [r for r in got if r.id == 5]
    assert {r.cut_kind for r in five} == {"natural"} and all(0 < len(r.piece) <= 10 for r in five) and {r.id for r in got} == {3, 5}
    assert split_pieces(df.limit(0), lim).count() == 0
    assert split_pieces(df, lim.limit(0)).count() == 0


@pytest.mark.parametrize("n", [200_000])
def test_very_long(n):
    check("word " * n, 4000, 400)
    check("x" * n, 4000, 400)
