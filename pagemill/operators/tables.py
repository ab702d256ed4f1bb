"""Tables as DataFrames: grids from rules, cells, text in cells, rendering, placement.

Everything groups by page, so a long document spreads; joins are range joins on (doc_id, page).
Empty inputs give empty tables; null cells are positions covered by a merged cell; repeated
rules and words count once; rows with null geometry take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import escape_cell
from pagemill.operators import table_kernel as K
from pagemill.operators.pagewise import fold, gathered

PAGE = ["doc_id", "page"]


def unique_sorted(values: Column, tolerance: float = 3.0) -> Column:
    """Ascending values of an array, each more than the tolerance above the last one kept."""
    empty = F.filter(values, lambda _: F.lit(False))
    return F.aggregate(F.array_sort(values), empty, lambda acc, v: F.when((F.size(acc) == 0) | (v - F.element_at(acc, -1) > tolerance), F.array_append(acc, v)).otherwise(acc))


def merge_segments(edges: DataFrame, by: Sequence[str], tolerance: float = 3.0) -> DataFrame:
    """Rules (pos, lo, hi) of a group that continue each other, joined: sorted by position and
    start, a rule extends the last one within the tolerance of that one's first position."""
    seg = F.struct(*(F.col(c).cast("double").alias(c) for c in ("pos", "lo", "hi")))
    start = F.filter(F.collect_list(seg), lambda _: F.lit(False))
    last = lambda acc: F.element_at(acc, -1)

    def step(acc: Column, v: Column) -> Column:
        joins = (F.size(acc) > 0) & (v["pos"] - last(acc)["pos"] <= tolerance) & (v["lo"] <= last(acc)["hi"] + tolerance)
        grown = F.struct(last(acc)["pos"].alias("pos"), F.least(last(acc)["lo"], v["lo"]).alias("lo"), F.greatest(last(acc)["hi"], v["hi"]).alias("hi"))
        return F.when(joins, F.array_append(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.array_append(acc, v))

    got = edges.groupBy(*by).agg(F.collect_list(seg).alias("__all"))
    return got.withColumn("__m", F.explode(F.aggregate(F.array_sort("__all"), F.filter("__all", lambda _: F.lit(False)), step))).select(*by, "__m.pos", "__m.lo", "__m.hi")


def segment_edges(segments: DataFrame, least: float = 1.0) -> DataFrame:
    """Straight segments (px, py, qx, qy, width) near an axis as edges: kind, pos, lo, hi, width.
    Allowed deviation: half a point or half a degree, the larger."""
    dx, dy = F.abs(F.col("qx") - F.col("px")), F.abs(F.col("qy") - F.col("py"))
    slope = 0.008726867790758789  # tan 0.5 degrees
    h = (dx >= least) & (dy <= F.greatest(F.lit(0.5), dx * slope)) & (dx >= dy)
    v = (dy >= least) & (dx <= F.greatest(F.lit(0.5), dy * slope)) & (dy > dx)
    rows = segments.withColumn("kind", F.when(h, "h").when(v, "v")).filter("kind IS NOT NULL")
    pick = lambda a, b: F.when(F.col("kind") == "h", a).otherwise(b)
    return rows.withColumns(
        {
            "pos": pick((F.col("py") + F.col("qy")) / 2, (F.col("px") + F.col("qx")) / 2),
            "lo": pick(F.least("px", "qx"), F.least("py", "qy")),
            "hi": pick(F.greatest("px", "qx"), F.greatest("py", "qy")),
        }
    ).drop("px", "py", "qx", "qy")


def rect_edges(rects: DataFrame, thin: float = 3.0, edge_min: float = 3.0) -> DataFrame:
    """Filled rectangles as edges: a thin one its centre line, a broad one its four sides."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def edge(kind, pos, lo, hi, width):
        return F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), lo.alias("lo"), hi.alias("hi"), width.alias("width"))

    zero = F.lit(0.0)
    sides = F.array(
        edge("h", F.col("y0"), F.col("x0"), F.col("x1"), zero), edge("h", F.col("y1"), F.col("x0"), F.col("x1"), zero), edge("v", F.col("x0"), F.col("y0"), F.col("y1"), zero), edge("v", F.col("x1"), F.col("y0"), F.col("y1"), zero)
    )
    thin_h = F.array(edge("h", (F.col("y0") + F.col("y1")) / 2, F.col("x0"), F.col("x1"), h))
    thin_v = F.array(edge("v", (F.col("x0") + F.col("x1")) / 2, F.col("y0"), F.col("y1"), w))
    made = F.when((h <= thin) & (w >= h), thin_h).when(w <= thin, thin_v).when((w >= edge_min) & (h >= edge_min), sides)
    return rects.withColumn("__e", F.explode(made)).select(*[c for c in rects.columns if c not in ("x0", "y0", "x1", "y1")], "__e.*")


_CELLS = "doc_id long, page int, table_no int, row int, col int, x0 double, y0 double, x1 double, y1 double, text string"


def _emit(doc, page, grids, words):
    for t, g in enumerate(grids):
        texts = K.cell_texts(g, words)
        for r, row in enumerate(g.cells):
            for c, box in enumerate(row):
                yield (doc, page, t, r, c, *(box or (None,) * 4), texts[r][c])


def _words(items) -> list[tuple]:
    return sorted({(w["x0"], w["y0"], w["x1"], w["y1"], w["text"]) for w in items or () if None not in w.values()})


def _rules(items, kind: str) -> list[tuple]:
    return sorted({(e["pos"], e["lo"], e["hi"]) for e in items or () if e["kind"] == kind and None not in e.values()})


def find_tables(edges: DataFrame | None, words: DataFrame, strategy: str = "lines_strict") -> DataFrame:
    """Cells of the tables of each page: (table_no, row, col), box (null: covered) and text.

    ``lines`` and ``lines_strict`` read edges (kind, pos, lo, hi); ``text`` reads words alone.
    """
    w = gathered(words, PAGE, ["x0", "y0", "x1", "y1", "text"], "words")
    if strategy == "text":

        def by_text(doc, page, items):
            ws = _words(items)
            return _emit(doc, page, K.text_tables([x[:4] for x in ws]), ws)

        return fold(w, by_text, _CELLS)
    if strategy not in K.EDGE_MIN:
        raise ValueError(f"unknown table strategy {strategy!r}")
    e = gathered(edges, PAGE, ["kind", "pos", "lo", "hi"], "edges")

    def by_rules(doc, page, rules, items):
        ws = _words(items)
        return _emit(doc, page, K.grid_tables(_rules(rules, "h"), _rules(rules, "v"), ws, strategy), ws)

    return fold(e.join(w, PAGE, "left").select(*PAGE, "edges", "words"), by_rules, _CELLS)


def explicit_cells(grids: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Cells of grids given as arrays of line positions (h_lines, v_lines), two and more rows and
    columns of borders after near ones are joined."""
    g = grids.select(*PAGE, unique_sorted(F.col("h_lines"), tolerance).alias("ys"), unique_sorted(F.col("v_lines"), tolerance).alias("xs")).filter("size(ys) >= 2 AND size(xs) >= 2")
    r = g.select("*", F.posexplode(F.slice("ys", 1, F.size("ys") - 1)).alias("row", "y0"))
    c = r.select("*", F.posexplode(F.slice("xs", 1, F.size("xs") - 1)).alias("col", "x0"))
    return c.select(*PAGE, "row", "col", "x0", "y0", F.get("xs", F.col("col") + 1).alias("x1"), F.get("ys", F.col("row") + 1).alias("y1"))


def chars_in_cells(chars: DataFrame, cells: DataFrame) -> DataFrame:
    """Characters with the cell that holds their centre, half-open. Cells are never broadcast: a
    page's grid makes rows times columns of them, which the optimizer's estimate leaves out."""
    b = cells.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), "row", "col", *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (cx >= F.col("__x0")) & (cx < F.col("__x1")) & (cy >= F.col("__y0")) & (cy < F.col("__y1"))
    return chars.join(b.hint("merge"), (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & inside).drop("__d", "__p", "__x0", "__y0", "__x1", "__y1")


def cell_text(held: DataFrame) -> DataFrame:
    """Text of each cell from its characters, lines joined by a line end."""
    lines = held.groupBy(*PAGE, "row", "col", "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "c"))), lambda s: s["c"]), "").alias("t"))
    return lines.groupBy(*PAGE, "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "t"))), lambda s: s["t"]), "\n").alias("text"))


def table_markdown(df: DataFrame, keys: Sequence[str], cells: str = "cells") -> DataFrame:
    """Markdown of nested cells: the first row as header, covered cells empty, pipes escaped."""
    one = lambda s: F.coalesce(escape_cell(F.replace(s, F.lit("\n"), F.lit("<br>"))), F.lit(""))
    row = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r, one), "|"), F.lit("|"))
    body = F.transform(F.slice(F.col(cells), 2, F.size(cells)), row)
    head = F.concat(row(F.get(F.col(cells), F.lit(0))), F.lit("\n|"), F.repeat(F.lit("---|"), F.size(F.get(F.col(cells), F.lit(0)))))
    ok = F.col(cells).isNotNull() & (F.size(cells) > 0) & ~F.exists(F.col(cells), lambda r: r.isNull())
    return df.filter(ok).select(*keys, F.concat(F.array_join(F.concat(F.array(head), body), "\n"), F.lit("\n\n")).alias("markdown"))


def override_cells(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Texts of ``base`` cells (keys, text) replaced by those of ``other`` where it has any, with
    the source each text comes from."""
    o = other.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("text").alias("__t"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return base.join(o, cond, "left").select(*keys, F.coalesce("__t", "text").alias("text"), F.when(F.col("__t").isNotNull(), "ocr").otherwise("pdf").alias("source"))


def contained(boxes: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """Boxes that lie inside another of their group and come after it by (area descending, seq)."""
    names = [*by, "x0", "y0", "x1", "y1", seq]
    o = boxes.select(*[F.col(c).alias(f"__{c}") for c in names])
    cond = F.lit(True)
    for k in by:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    inside = (F.col("x0") >= F.col("__x0")) & (F.col("x1") <= F.col("__x1")) & (F.col("y0") >= F.col("__y0")) & (F.col("y1") <= F.col("__y1"))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    after = (area("__") > area("")) | ((area("__") == area("")) & (F.col(f"__{seq}") < F.col(seq)))
    return boxes.join(o, cond & inside & after, "left_semi")


def dedupe_images(images: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """Images largest first without empty ones and those inside another, numbered in that order."""
    solid = images.filter("x0 < x1 AND y0 < y1")
    names = [*by, "x0", "y0", "x1", "y1", seq]
    o = solid.select(*[F.col(c).alias(f"__{c}") for c in names])
    cond = F.lit(True)
    for k in by:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    inside = (F.col("x0") >= F.col("__x0")) & (F.col("x1") <= F.col("__x1")) & (F.col("y0") >= F.col("__y0")) & (F.col("y1") <= F.col("__y1"))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    after = (area("__") > area("")) | ((area("__") == area("")) & (F.col(f"__{seq}") < F.col(seq)))
    kept = solid.join(o, cond & inside & after, "left_anti")
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(area("").desc(), seq)) - 1)


def lines_beside(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines that touch no table of their page; boxes that merely meet at an edge are apart."""
    t = tables.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")])
    over = (F.col("x0") < F.col("__x1")) & (F.col("__x0") < F.col("x1")) & (F.col("y0") < F.col("__y1")) & (F.col("__y0") < F.col("y1"))
    return lines.join(t, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & over, "left_anti")


def table_before_line(tables: DataFrame, lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each table with the first line that begins at or below its bottom and overlaps it sideways."""
    ln = lines.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.struct(*order).alias("__o"), *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1")])
    below = (F.col("y1") <= F.col("__y0")) & (F.col("__x0") < F.col("x1")) & (F.col("x0") < F.col("__x1"))
    met = tables.join(ln, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & below)
    return met.groupBy(*PAGE, "table_no").agg(F.min("__o").alias("__m")).select(*PAGE, "table_no", *[F.col(f"__m.{c}").alias(c) for c in order])


def rule_components(edges: DataFrame) -> DataFrame:
    """Edges of each page with the number of the group of meeting rules they belong to; groups
    under four rules or without two of each direction are left out."""

    def run(doc, page, items):
        for n, (hs, vs) in enumerate(sorted(K.components(_rules(items, "h"), _rules(items, "v")))):
            for kind, rules in (("h", hs), ("v", vs)):
                for r in rules:
                    yield (doc, page, n, kind, *r)

    return fold(gathered(edges, PAGE, ["kind", "pos", "lo", "hi"]), run, "doc_id long, page int, component int, kind string, pos double, lo double, hi double")


def nearest(points: DataFrame, others: DataFrame, cell: float, by: Sequence[str] = (), k: int = 1) -> DataFrame:
    """The k nearest of ``others`` (id, x, y) within one grid cell's reach of each point, by a
    grid hash: each of the others stands in its cell and the eight around it."""
    gx, gy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    near = F.explode(F.array(*(F.struct((gx + i).alias("gx"), (gy + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    o = others.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("id").alias("__id"), F.col("x").alias("__x"), F.col("y").alias("__y"), near.alias("__g"))
    p = points.withColumn("__gx", gx).withColumn("__gy", gy)
    cond = (F.col("__gx") == F.col("__g.gx")) & (F.col("__gy") == F.col("__g.gy")) & (F.col("id") != F.col("__id"))
    for c in by:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    d = (F.col("x") - F.col("__x")) * (F.col("x") - F.col("__x")) + (F.col("y") - F.col("__y")) * (F.col("y") - F.col("__y"))
    met = p.join(o, cond).withColumn("d2", d).filter(F.col("d2") <= cell * cell)
    if k == 1:
        return met.groupBy(*by, "id").agg(F.min(F.struct("d2", "__id")).alias("__m")).select(*by, "id", F.col("__m.__id").alias("other"), F.col("__m.d2").alias("d2"))
    w = Window.partitionBy(*by, "id").orderBy("d2", "__id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*by, "id", F.col("__id").alias("other"), "d2", "rank")
