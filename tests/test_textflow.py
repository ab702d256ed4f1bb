from pagemill.operators import layout_kernel as K
from pagemill.operators import pages as P
from pagemill.operators import textflow as L
from pagemill.options import MarkdownOptions

SPAN = "doc_id long, page int, block int, line int, span int, text string, font string, size double, color int, flags int, char_flags int, x0 double, y0 double, x1 double, y1 double, extra string"
CHAR = "doc_id long, page int, block int, line int, seq int, c string, x0 double, y0 double, x1 double, y1 double, font string, font_id int, size double, color int, flags int, char_flags int"


def spans(spark, rows):
    return spark.createDataFrame([(1, 0, b, ln, s, t, None, size, None, fl, 16, x0, y0, x1, y1, "e") for b, ln, s, t, size, fl, x0, y0, x1, y1 in rows], SPAN)


def chars(spark, text, font=lambda i: "F", x=lambda i: 5.0 * i):
    return spark.createDataFrame([(1, 0, 0, 0, i, c, x(i), 0.0, x(i) + 5, 8.0, font(i), None, 9.0, None, 0, 16) for i, c in enumerate(text)], CHAR)


def test_spans_break_at_style_and_null_fonts_are_one(spark):
    got = L.build_spans(chars(spark, "abcd", lambda i: [None, None, "G", "G"][i])).orderBy("span").collect()
    assert [(r.text, r.font, r.x0, r.x1) for r in got] == [("ab", None, 0.0, 10.0), ("cd", "G", 10.0, 20.0)]


def test_words_and_gaps(spark):
    assert [r.text for r in L.extract_words(chars(spark, " ab  c d ")).orderBy("word").collect()] == ["ab", "c", "d"]
    far = L.word_boxes(chars(spark, "abcd", x=lambda i: 5.0 * i + (9 if i > 1 else 0))).orderBy("first_seq").collect()
    assert [r.text for r in far] == ["ab", "cd"]
    assert L.extract_words(chars(spark, "a").limit(0)).count() == 0


def test_visual_lines_tolerance(spark):
    rows = [(0, 0, 0, "a", 9.0, 0, 0.0, 0.0, 5.0, 8.0), (0, 0, 1, "b", 9.0, 0, 5.0, 3.0, 9.0, 11.0), (0, 0, 2, "c", 9.0, 0, 9.0, 7.0, 12.0, 14.01), (0, 0, 3, "d", 9.0, 0, 9.0, 7.0, 12.0, 30.0)]
    got = {r.text: r.vline for r in L.visual_lines(spans(spark, rows)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_sanitize(spark):
    rows = [(0, 0, 0, "ab", 10.0, 0, 0.0, 0.0, 10.0, 8.0), (0, 0, 1, "cd", 10.0, 0, 10.5, 0.0, 20.0, 8.0), (0, 0, 2, "ef", 10.0, 0, 30.0, 0.0, 40.0, 8.0), (0, 0, 3, "gh", 10.0, 2, 40.0, 0.0, 50.0, 8.0)]
    got = L.sanitize_spans(L.visual_lines(spans(spark, rows))).orderBy("piece").collect()
    assert [r.text for r in got] == ["abcd", "ef", "gh"]


def test_headings(spark):
    rows = [(0, 0, 0, "Title", 24.0, 0, 0.0, 0.0, 10.0, 8.0), (1, 0, 0, "Sub", 18.4, 0, 0.0, 20.0, 10.0, 28.0), (2, 0, 0, "body text that is long", 11.0, 0, 0.0, 40.0, 10.0, 48.0)]
    h = L.size_histogram(spans(spark, rows))
    assert L.body_sizes(h).first().body == 12
    assert {(r.size_r, r.level) for r in L.heading_levels(h).collect()} == {(24, 1), (18, 2)}
    assert {(r.size_r, r.level) for r in L.heading_levels(h, max_levels=1).collect()} == {(24, 1)}
    tie = spark.createDataFrame([(1, 13, 50), (1, 15, 50), (1, 20, 3)], "doc_id long, size_r int, n_chars long")
    assert L.body_sizes(tie).first().body == 15


def test_dedupe_takes_the_latest(spark):
    df = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, "new", 2), (2, None, None)], "k long, v string, loaded_at int")
    assert sorted(map(tuple, L.dedupe(df, ["k"]).collect())) == [(1, "new", 2), (2, None, None)]


def test_outline_entries_serve_once(spark):
    rows = [(0, k, 0, "Intro", 20.0, 0, 0.0, 10.0 * k, 9.0, 10.0 * k + 8) for k in range(3)] + [(1, 0, 0, "Introduction more", 20.0, 0, 0.0, 90.0, 9.0, 98.0)]
    toc = spark.createDataFrame([(1, 0, 1, "Intro", 1), (1, 1, 9, "Introduction", 1), (1, 2, 1, "Else", 1)], "doc_id long, seq int, level int, title string, page int")
    got = sorted((r.block, r.line, r.seq, r.level) for r in L.match_outline(spans(spark, rows), toc).collect())
    assert got == [(0, 0, 0, 1), (0, 1, 1, 6)]


def test_stripes_and_order(spark):
    rows = [(0, 0, 0, "x", 9.0, 0, 50.0, 0.0, 100.0, 10.0), (0, 0, 1, "y", 9.0, 0, 0.0, 2.0, 40.0, 12.0), (0, 0, 2, "z", 9.0, 0, 0.0, 50.0, 50.0, 60.0)]
    got = L.reading_order(spans(spark, rows), L.PAGE, ["span"]).orderBy("position").collect()
    assert [r.text for r in got] == ["y", "x", "z"] and [r.stripe for r in got] == [0, 0, 1]


def test_two_columns_read_one_after_the_other():
    left = [K.Span(f"l{k}", 50, 12 * k, 250, 12 * k + 10, block=k) for k in range(6)]
    right = [K.Span(f"r{k}", 300, 12 * k, 500, 12 * k + 10, block=10 + k) for k in range(6)]
    boxes = K.column_boxes([(s.x0, s.y0, s.x1, s.y1) for s in left + right])
    assert boxes == [(50, 0, 250, 70), (300, 0, 500, 70)]
    md = K.page_markdown(left + right, (0, 0, 600, 800))
    assert md.index("l5") < md.index("r0")


def test_code_fence_list_and_heading():
    s = [K.Span("Head", 50, 0, 90, 20, 20, level=2), K.Span("x = 1", 50, 30, 90, 40, flags=8), K.Span("y = 2", 60, 42, 90, 52, flags=8), K.Span("• item", 50, 60, 90, 70), K.Span("plain", 50, 74, 90, 84)]
    md = K.page_markdown(s, (50, 0, 600, 800))
    assert "## Head" in md and "```\nx = 1\n y = 2\n```\n" in md and "\n- item\n" in md
    assert "```" not in K.page_markdown(s, (50, 0, 600, 800), style=MarkdownOptions(ignore_code=True).style)


def test_pages_operator_handles_odd_rows(spark):
    rows = [(0, 0, 0, None, 11.0, 0, 0.0, 0.0, 9.0, 8.0), (0, 1, 0, "text", 11.0, 0, 0.0, 20.0, 90.0, 28.0), (0, 2, 0, "  ", 11.0, 0, 0.0, 40.0, 9.0, 48.0)]
    assert P.page_markdown(spans(spark, rows)).first().text.strip() == "text"
    assert P.page_markdown(spans(spark, rows).limit(0)).count() == 0
    assert P.column_boxes(spans(spark, rows)).count() == 1
