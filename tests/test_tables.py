import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.operators import table_kernel as K
from pagemill.operators import tables as B


def grid(xs, ys):
    return [(y, xs[0], xs[-1]) for y in ys], [(x, ys[0], ys[-1]) for x in xs]


def word(x0, y0, x1, y1, t):
    return (float(x0), float(y0), float(x1), float(y1), t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0, 100), max_size=30))
def test_unique_sorted_kept_values(values):
    k = K.unique_sorted(values)
    assert all(b - a > 3 for a, b in zip(k, k[1:], strict=False)) and all(any(0 <= v - x <= 3 for x in k) for v in values)
    assert K.unique_sorted(k) == k


def test_unique_sorted_column(spark):
    df = spark.createDataFrame([([1.0, 3.5, 5.0, 10.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(B.unique_sorted(F.col("v"))).collect()] == [[1.0, 5.0, 10.0], [], None]


def test_grid_and_text():
    h, v = grid([0, 50, 100], [0, 20, 40, 60])
    g = K.grid_tables(h, v, [])
    assert len(g) == 1 and g[0].xs == [0, 50, 100] and len(g[0].cells) == 3
    t = K.cell_texts(g[0], [word(2, 2, 20, 10, "a"), word(22, 2, 40, 10, "b"), word(2, 11, 20, 19, "c"), word(50, 22, 60, 30, "edge")])
    assert t == [["a b\nc", ""], ["", "edge"], ["", ""]]
    assert K.to_markdown(t) == "|a b<br>c||\n|---|---|\n||edge|\n|||\n\n"


def test_merged_cells_only_where_a_word_crosses_an_open_border():
    xs, ys = [0, 50, 100, 150], [0, 20, 40]
    h = [(y, 0, 150) for y in ys]
    v = [(0, 0, 40), (50, 20, 40), (100, 20, 40), (150, 0, 40)]
    wide = [word(30, 5, 120, 15, "across")]
    assert K.build_cells(xs, ys, h, v, [])[0] == [(0, 0, 50, 20), (50, 0, 100, 20), (100, 0, 150, 20)]
    c = K.build_cells(xs, ys, h, v, wide)
    assert c[0] == [(0, 0, 150, 20), None, None] and None not in c[1]
    full = K.build_cells(xs, ys, h, [(x, 0, 40) for x in xs], wide)
    assert None not in full[0]


def test_components_and_acceptance():
    h1, v1 = grid([0, 50, 100], [0, 20, 40])
    h2, v2 = grid([300, 350, 400], [0, 20, 40])
    assert len(K.components(h1 + h2, v1 + v2)) == 2
    assert K.components(h1, []) == [] and K.grid_tables(h1, v1[:1], []) == []
    one_row = grid([0, 50, 100], [0, 20])
    assert not K.grid_tables(*one_row, []) and len(K.grid_tables(*one_row, [], "lines")) == 1


def test_components_match_pairwise_closure():
    rng = random.Random(3)
    for _ in range(30):
        h = [(rng.randint(0, 60), a := rng.randint(0, 50), a + rng.randint(5, 40)) for _ in range(6)]
        v = [(rng.randint(0, 60), a := rng.randint(0, 50), a + rng.randint(5, 40)) for _ in range(6)]
        boxes = [(lo, p - 1, hi, p + 1) for p, lo, hi in h] + [(p - 1, lo, p + 1, hi) for p, lo, hi in v]
        comp = list(range(12))
        for _ in range(12):
            for i in range(12):
                for j in range(12):
                    a, b = boxes[i], boxes[j]
                    if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]:
                        comp[i] = comp[j] = min(comp[i], comp[j])
        want = sorted(sorted(i for i in range(12) if comp[i] == c) for c in set(comp))
        want = [g for g in want if len(g) >= 4 and sum(i < 6 for i in g) >= 2 and sum(i >= 6 for i in g) >= 2]
        got = sorted(sorted([h.index(x) for x in hs] + [6 + v.index(x) for x in vs]) for hs, vs in K.components(h, v)) if len(set(h)) == 6 == len(set(v)) else want
        assert got == want


def test_merge_rules_with_jitter():
    assert K.merge_rules([(50.2, 0, 10), (50.0, 80, 90), (50.1, 10.5, 30)]) == [(50.2, 0, 30), (50.0, 80, 90)]


def test_text_tables():
    words = [word(x, y, x + 30, y + 8, f"{x}{y}") for y in range(100, 160, 12) for x in (50, 150, 250)]
    g = K.text_tables([w[:4] for w in words])
    assert len(g) == 1 and len(g[0].cells) == 5 and K.cell_texts(g[0], words)[0] == ["50100", "150100", "250100"]
    prose = [word(50, y, 400, y + 8, "running text") for y in range(100, 160, 12)]
    assert K.text_tables([w[:4] for w in prose]) == []


def test_header_labels_above_a_text_table():
    body = [word(x, y, x + 30, y + 8, f"{x}{y}") for y in range(124, 172, 12) for x in (50, 150, 250)]
    head = [word(140, 112, 185, 120, "middle"), word(255, 112, 280, 120, "last")]
    title = [word(50, 60, 300, 68, "A title far above")]
    g = K.text_tables([w[:4] for w in title + head + body])
    assert len(g) == 1 and g[0].xs[1] == 140 and K.cell_texts(g[0], head + body)[0] == ["", "middle", "last"] and len(g[0].cells) == 5
    across = [word(60, 112, 260, 120, "one caption over everything")]
    assert len(K.text_tables([w[:4] for w in across + body])[0].cells) == 4


def test_find_tables_operator(spark):
    h, v = grid([0.0, 50.0, 100.0], [0.0, 20.0, 40.0])
    e = spark.createDataFrame([(1, 0, k, *r, "x") for k, rs in (("h", h), ("v", v)) for r in rs] * 2 + [(2, 0, "h", None, 0.0, 1.0, "x")], "doc_id long, page int, kind string, pos double, lo double, hi double, text string")
    w = spark.createDataFrame([(1, 0, 2.0, 2.0, 9.0, 9.0, "a"), (1, 0, 2.0, 2.0, 9.0, 9.0, "a"), (1, 0, None, 2.0, 9.0, 9.0, "b")], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = B.find_tables(e, w).orderBy("row", "col").collect()
    assert len(got) == 4 and got[0].text == "a" and got[3].x1 == 100.0
    assert B.find_tables(e.limit(0), w).count() == 0
    with pytest.raises(ValueError):
        B.find_tables(e, w, "guess")


def test_placement_and_containment(spark):
    t = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 50.0, 50.0), (1, 0, 1, 10.0, 10.0, 20.0, 20.0), (1, 0, 2, 0.0, 0.0, 50.0, 50.0), (1, 0, 3, 5.0, 5.0, 5.0, 9.0)], "doc_id long, page int, table_no int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.table_no for r in B.contained(t, ["doc_id"], "table_no").collect()) == [1, 2, 3]
    assert [r.table_no for r in B.dedupe_images(t, ["doc_id"], "table_no").collect()] == [0]
    ln = spark.createDataFrame([(1, 0, 0, 0.0, 50.0, 10.0, 58.0), (1, 0, 1, 0.0, 60.0, 10.0, 68.0), (1, 0, 2, 90.0, 50.0, 99.0, 58.0)], "doc_id long, page int, seq int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.table_no, r.seq) for r in B.table_before_line(t, ln, ["y0", "seq"]).collect()}
    assert (0, 0) in got and all(s == 0 for _, s in got)
    assert B.lines_beside(ln, t).count() == 3


def test_char_in_cell_is_joined_by_page_without_broadcast(spark, tmp_path):
    from pagemill.plans import layout_queries as Q
    from pagemill.plans import table_queries as T

    rng = random.Random(5)
    box = "x0 double, y0 double, x1 double, y1 double, font string, font_id int, size double, color int, flags int, char_flags int"
    put = lambda x, y: (x, y, x and x + 4.0, y and y + 8.0, rng.choice("FG"), 1, 8.0, 0, 0, 0)
    chars = [(1 + k % 3, None if k % 50 == 7 else k % 2, k % 5, 0, k % 40, rng.choice(["a", "b", None]), *put(rng.choice([None, 5.0, 90.0, 200.0, float("nan")]), float(rng.randint(0, 300))), 1.0, 0.0) for k in range(600)]
    spans = [(k, 1 + k % 3, k % 2, k % 8, 0, k % 2, rng.choice(["t", None]), *put(rng.choice([None, 0.0, 60.0, 150.0, 260.0]), float(rng.randint(0, 300))), k % 4) for k in range(200)]
    spark.createDataFrame(chars, f"doc_id long, page int, block int, line int, seq int, c string, {box}, dir_x double, dir_y double").write.parquet(str(tmp_path / "chars.parquet"))
    spark.createDataFrame(spans, f"span_id long, doc_id long, page int, block int, line int, span int, text string, {box}, loaded_at int").drop("font_id").write.parquet(str(tmp_path / "spans.parquet"))
    d = str(tmp_path)
    got = T.q_chars_in_cells(spark, d)
    cells = [r for r in B.explicit_cells(T.page_grids(spark, d), 20.0).collect()]
    want = [(*(r[k] for k in ("doc_id", "page", "block", "line", "seq")), c.row, c.col) for r in Q.chars_of(spark, d).collect() for c in cells if (r.doc_id, r.page) == (c.doc_id, c.page) and None not in (r.x0, r.y0) and c.x0 <= (r.x0 + r.x1) / 2 < c.x1 and c.y0 <= (r.y0 + r.y1) / 2 < c.y1]
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == 2 * (1 + ("Final Plan" in plan))
