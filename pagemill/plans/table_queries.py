"""Queries and oracle SQL of rules, grids, cells, containment and nearest neighbours.

Geometry comes from the test tables: extracted tables (tables_run_a/b) are laid out again as
ruled grids of cells 60 wide and 12 high, orders' lines serve as rectangles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import tables as B
from pagemill.operators import textflow as L
from pagemill.plans.data_queries import TABLE_KEY
from pagemill.plans.layout_queries import chars_of, spans_of
from pagemill.session import table

W, H = 60.0, 12.0


def run_tables(spark: SparkSession, d: str, run: str = "a", parts: int | None = None) -> DataFrame:
    """Newest row of each table key; a page's tables of all configs get places of their own.
    ``parts``: pages are spread over so many tasks from the start, however few bytes they have."""
    from pyspark.sql.window import Window

    t = table(spark, d, f"tables_run_{run}")
    t = L.dedupe(t.repartition(parts, "doc_id", "page") if parts else t, list(TABLE_KEY)).filter("cells IS NOT NULL AND size(cells) > 0")
    w = Window.partitionBy("doc_id", "page").orderBy("config", "table_no")
    t = t.withColumn("place", F.row_number().over(w) - 1).withColumn("rows", F.size("cells")).withColumn("cols", F.array_max(F.transform("cells", F.size)))
    return t.withColumn("top", F.coalesce(F.sum(F.col("rows") + 3).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * H)


def table_edges() -> Column:
    """Rules around and between the cells of a row of ``run_tables``."""
    edge = lambda k, pos, lo, hi: F.struct(F.lit(k).alias("kind"), pos.alias("pos"), lo.alias("lo"), hi.alias("hi"))
    left, right, bottom = F.lit(50.0), F.lit(50.0) + F.col("cols") * W, F.col("top") + F.col("rows") * H
    h = F.transform(F.sequence(F.lit(0), F.col("rows")), lambda i: edge("h", F.col("top") + i * H, left, right))
    v = F.transform(F.sequence(F.lit(0), F.col("cols")), lambda i: edge("v", left + i * W, F.col("top"), bottom))
    return F.concat(h, v)


def run_edges(spark, d, run="a") -> DataFrame:
    return run_tables(spark, d, run).select("doc_id", "page", F.explode(table_edges()).alias("e")).select("doc_id", "page", "e.*")


def run_words(spark, d, run="a") -> DataFrame:
    t = run_tables(spark, d, run).select("doc_id", "page", "top", F.posexplode("cells").alias("row", "r"))
    c = t.select("doc_id", "page", "top", "row", F.posexplode("r").alias("col", "text")).filter("text IS NOT NULL AND text <> ''")
    x0, y0 = F.lit(52.0) + F.col("col") * W, F.col("top") + F.col("row") * H + 2
    return c.select("doc_id", "page", x0.alias("x0"), y0.alias("y0"), (x0 + 50).alias("x1"), (y0 + 8).alias("y1"), "text")


def q_find_tables(spark, d):
    return B.find_tables(run_edges(spark, d), run_words(spark, d)).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("table_no").alias("n_tables"), F.count_if(F.col("text") != "").alias("n_filled"))


def q_table_cells(spark, d):
    return B.find_tables(run_edges(spark, d), run_words(spark, d), "lines")


def q_text_tables(spark, d):
    return B.find_tables(None, run_words(spark, d), "text")


def q_merged_cells(spark, d):
    """Grids without their inner column rules; wide words tie cells together."""
    e = run_edges(spark, d).filter((F.col("kind") == "h") | (F.pmod((F.col("pos") - 50) / W, F.lit(2)) == 0))
    w = run_words(spark, d).withColumn("x1", F.when(F.length("text") > 20, F.col("x0") + 80).otherwise(F.col("x1")))
    return B.find_tables(e.unionAll(run_edges(spark, d).filter("kind = 'v'").withColumn("hi", F.col("lo") + H)), w)


def q_table_markdown(spark, d):
    return B.table_markdown(L.dedupe(table(spark, d, "tables_run_a"), list(TABLE_KEY)), list(TABLE_KEY))


def _flat(spark, d, run):
    t = L.dedupe(table(spark, d, f"tables_run_{run}"), list(TABLE_KEY))
    r = t.select(*TABLE_KEY, F.posexplode("cells").alias("row", "r"))
    return r.select(*TABLE_KEY, "row", F.posexplode("r").alias("col", "text"))


def q_override_cells(spark, d):
    return B.override_cells(_flat(spark, d, "a"), _flat(spark, d, "b").filter("text IS NOT NULL"), [*TABLE_KEY, "row", "col"])


def page_grids(spark, d, spans: DataFrame | None = None) -> DataFrame:
    """Line positions of each page from the edges of its spans."""
    s = spans_of(spark, d) if spans is None else spans
    return s.groupBy("doc_id", "page").agg(F.collect_set("y0").alias("h_lines"), F.collect_set(F.col("x0") - 0.5).alias("v_lines"))


def q_unique_sorted(spark, d):
    g = page_grids(spark, d)
    u = B.unique_sorted(F.col("v_lines"))
    return g.select("doc_id", "page", F.size(u).alias("n"), F.array_join(F.transform(u, lambda x: F.floor(x * 100).cast("string")), ",").alias("kept"))


def q_explicit_cells(spark, d):
    return B.explicit_cells(page_grids(spark, d), 20.0)


def _by_page(df: DataFrame, *narrow: str) -> DataFrame:
    """All rows of a page brought together, columns that change from row to row last: such rows
    take a third less room on the way. ``narrow``: columns of the result, in their old order."""
    steady = ["block", "line", "loaded_at", "size", "color", "flags", "char_flags", "y0", "y1", "font", "c"]
    order = [c for c in [*L.PAGE, *steady] if c in narrow] + [c for c in narrow if c not in L.PAGE and c not in steady]
    return df.select(*order).repartition(*L.PAGE).select(*narrow)


def placed_chars(spark, d) -> DataFrame:
    """Texts and boxes of ``chars_of``: its largest row begins with the largest of these columns.
    Its rows stand by page, so repeats and cells need no other exchange."""
    return L.dedupe(_by_page(table(spark, d, "chars"), *L.LINE, "seq", "c", "x0", "y0", "x1", "y1"), [*L.LINE, "seq"])


def placed_spans(spark, d) -> DataFrame:
    """``spans_of`` up to the left upper corner, by page like ``placed_chars``."""
    s = table(spark, d, "spans").drop("x1", "y1")
    return L.dedupe(_by_page(s, *s.columns), L.SPAN)


def q_chars_in_cells(spark, d):
    return B.chars_in_cells(placed_chars(spark, d), B.explicit_cells(page_grids(spark, d, placed_spans(spark, d)), 20.0)).select("doc_id", "page", "block", "line", "seq", "row", "col")


def q_cell_text(spark, d):
    return B.cell_text(B.chars_in_cells(chars_of(spark, d), B.explicit_cells(page_grids(spark, d), 20.0)))


def rects(spark, d) -> DataFrame:
    """One rectangle a line of an order; doc_id is the order, page 0."""
    from pyspark.sql.window import Window

    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x0, y0 = F.pmod("l_partkey", F.lit(500)).cast("double"), F.pmod(F.col("l_suppkey") * 37, F.lit(700)).cast("double")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), (F.row_number().over(w) - 1).alias("seq"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + F.col("l_linenumber") * 4).alias("y1"))


def rules(spark, d) -> DataFrame:
    r = rects(spark, d)
    return r.select("doc_id", "page", F.lit("h").alias("kind"), (F.floor(F.col("y0") / 50) * 2).cast("double").alias("pos"), "x0", "x1").select("doc_id", "page", "kind", "pos", F.col("x0").alias("lo"), F.col("x1").alias("hi"))


def q_merge_segments(spark, d):
    return B.merge_segments(rules(spark, d), ["doc_id"])


def q_segment_edges(spark, d):
    r = rects(spark, d)
    return B.segment_edges(r.select("doc_id", "seq", F.col("x0").alias("px"), F.col("y0").alias("py"), F.col("x1").alias("qx"), (F.col("y0") + F.col("seq") * 0.2).alias("qy")))


def q_rect_edges(spark, d):
    return B.rect_edges(rects(spark, d).select("doc_id", "seq", "x0", "y0", "x1", "y1"))


def q_components(spark, d):
    return B.rule_components(B.rect_edges(rects(spark, d).drop("seq")).select("doc_id", "page", "kind", "pos", "lo", "hi"))


def q_image_dedupe(spark, d):
    return B.dedupe_images(rects(spark, d), ["doc_id"], "seq").select("doc_id", "seq", F.col("number").cast("int").alias("number"))


def q_contained(spark, d):
    return B.contained(rects(spark, d), ["doc_id"], "seq").select("doc_id", "seq")


def _lines(spark, d):
    return rects(spark, d).filter("seq % 2 = 1")


def _tabs(spark, d):
    return rects(spark, d).filter("seq % 2 = 0").withColumnRenamed("seq", "table_no")


def q_text_over_tables(spark, d):
    return B.lines_beside(_lines(spark, d), _tabs(spark, d)).select("doc_id", "seq")


def q_table_before_line(spark, d):
    return B.table_before_line(_tabs(spark, d), _lines(spark, d), ["y0", "seq"]).select("doc_id", "table_no", "seq")


def q_nearest(spark, d):
    """Nearest neighbour of every vector in its label, on two of its dimensions."""
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), (F.get("embedding", F.lit(0)).cast("double") * 100).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 100).alias("y"))
    return B.nearest(e, e, 5.0, ["label"]).select("label", "id", "other")


QUERIES = {
    "find_tables": q_find_tables,
    "table_cells": q_table_cells,
    "text_tables": q_text_tables,
    "merged_cells": q_merged_cells,
    "table_markdown": q_table_markdown,
    "override_cells": q_override_cells,
    "unique_sorted": q_unique_sorted,
    "explicit_grid_cells": q_explicit_cells,
    "char_in_cell": q_chars_in_cells,
    "cell_text": q_cell_text,
    "merge_segments": q_merge_segments,
    "segment_edges": q_segment_edges,
    "rect_edges": q_rect_edges,
    "component_edges": q_components,
    "image_dedupe": q_image_dedupe,
    "table_containment": q_contained,
    "text_over_tables_anti": q_text_over_tables,
    "table_before_line": q_table_before_line,
    "nearest_neighbour": q_nearest,
}

_KEY = "doc_id, config, page, table_no"


def _run(r: str) -> str:
    return f"SELECT {_KEY}, arg_max(cells, loaded_at) AS cells FROM tables_run_{r} GROUP BY {_KEY}"


_T = f"t AS (SELECT *, len(cells) AS nr, list_max(list_transform(cells, lambda x: len(x))) AS nc FROM ({_run('a')}) WHERE cells IS NOT NULL AND len(cells) > 0)"
_FLAT = "{r}1 AS (SELECT doc_id, config, page, table_no, unnest(cells) AS x, unnest(range(len(cells))) AS row FROM ({run})), {r} AS (SELECT doc_id, config, page, table_no, CAST(row AS INTEGER) AS row, unnest(x) AS text, CAST(unnest(range(len(x))) AS INTEGER) AS col FROM {r}1)"
_R = """r AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS seq,
CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST((l_suppkey * 37) % 700 AS DOUBLE) AS y0, l_quantity, l_linenumber FROM lineitem),
q AS (SELECT doc_id, seq, x0, y0, x0 + l_quantity AS x1, y0 + l_linenumber * 4 AS y1 FROM r)"""
_SPANS = "s AS (SELECT DISTINCT doc_id, page, block, line, span, x0, y0 FROM spans)"
_GRID = f"{_SPANS}, g AS (SELECT doc_id, page, list(DISTINCT y0) AS hl, list(DISTINCT x0 - 0.5) AS vl FROM s GROUP BY ALL)"


def _fold(x: str, tol: str) -> str:
    return f"list_reduce(list_transform(list_sort({x}), lambda v: [v]), lambda a, b: CASE WHEN b[1] - a[-1] > {tol} THEN list_concat(a, b) ELSE a END)"


_CELL = f"""{_GRID}, u AS (SELECT doc_id, page, {_fold('hl', '20.0')} AS ys, {_fold('vl', '20.0')} AS xs FROM g),
k AS (SELECT doc_id, page, xs, ys, unnest(range(1, len(ys))) AS i FROM u WHERE len(ys) >= 2 AND len(xs) >= 2),
m AS (SELECT *, unnest(range(1, len(xs))) AS j FROM k),
cl AS (SELECT doc_id, page, CAST(i - 1 AS INTEGER) AS row, CAST(j - 1 AS INTEGER) AS col, xs[j] AS x0, ys[i] AS y0, xs[j + 1] AS x1, ys[i + 1] AS y1 FROM m)"""
_CHARS = "c AS (SELECT doc_id, page, block, line, seq, max(c) AS c, max(x0) AS a0, max(y0) AS b0, max(x1) AS a1, max(y1) AS b1 FROM chars GROUP BY 1, 2, 3, 4, 5)"
_HELD = f"{_CELL}, {_CHARS}, hd AS (SELECT c.doc_id, c.page, block, line, seq, c, row, col FROM c JOIN cl ON c.doc_id = cl.doc_id AND c.page = cl.page AND (a0 + a1) / 2 >= x0 AND (a0 + a1) / 2 < x1 AND (b0 + b1) / 2 >= y0 AND (b0 + b1) / 2 < y1)"
_IN = "b.doc_id = a.doc_id AND a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AND ((b.x1 - b.x0) * (b.y1 - b.y0) > (a.x1 - a.x0) * (a.y1 - a.y0) OR ((b.x1 - b.x0) * (b.y1 - b.y0) = (a.x1 - a.x0) * (a.y1 - a.y0) AND b.seq < a.seq))"
_EDGES = """e AS (SELECT doc_id, seq, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h FROM q),
f AS (SELECT doc_id, seq, 'h' AS kind, (y0 + y1) / 2 AS pos, x0 AS lo, x1 AS hi, h AS width FROM e WHERE h <= 3 AND w >= h
UNION ALL SELECT doc_id, seq, 'v', (x0 + x1) / 2, y0, y1, w FROM e WHERE NOT (h <= 3 AND w >= h) AND w <= 3
UNION ALL SELECT doc_id, seq, 'h', y0, x0, x1, 0.0 FROM e WHERE h > 3 AND w > 3 UNION ALL SELECT doc_id, seq, 'h', y1, x0, x1, 0.0 FROM e WHERE h > 3 AND w > 3
UNION ALL SELECT doc_id, seq, 'v', x0, y0, y1, 0.0 FROM e WHERE h > 3 AND w > 3 UNION ALL SELECT doc_id, seq, 'v', x1, y0, y1, 0.0 FROM e WHERE h > 3 AND w > 3)"""

ORACLES = {
    "table_cells": f"""WITH {_T}, p AS (SELECT *, coalesce(sum(nr + 3) OVER (PARTITION BY doc_id, page ORDER BY config NULLS FIRST, table_no NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 12.0 AS top FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top) - 1 AS no FROM p WHERE nr >= 2 AND nc >= 2),
r AS (SELECT doc_id, page, no, top, nc, cells, unnest(range(nr)) AS i FROM k), c AS (SELECT doc_id, page, no, top, cells, i, unnest(range(nc)) AS j FROM r)
SELECT doc_id, page, CAST(no AS INTEGER) AS table_no, CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, 50 + j * 60.0::DOUBLE AS x0, top + i * 12.0::DOUBLE AS y0, 110 + j * 60.0::DOUBLE AS x1, top + i * 12.0::DOUBLE + 12 AS y1, coalesce(trim(cells[i + 1][j + 1]), '') AS text FROM c""",
    "find_tables": f"WITH {_T} SELECT doc_id, page, CAST(sum(nr * nc) FILTER (nr >= 2 AND nc >= 2) AS BIGINT) AS n_cells, count(*) FILTER (nr >= 2 AND nc >= 2) AS n_tables, CAST(sum(len(list_filter(flatten(cells), lambda x: x <> ''))) FILTER (nr >= 2 AND nc >= 2) AS BIGINT) AS n_filled FROM t GROUP BY doc_id, page HAVING count(*) FILTER (nr >= 2 AND nc >= 2) > 0",
    "table_markdown": f"""SELECT {_KEY}, '|' || array_to_string(list_transform(cells[1], lambda x: coalesce(replace(replace(x, chr(10), '<br>'), '|', chr(92) || '|'), '')), '|') || '|' || chr(10) || '|' || repeat('---|', len(cells[1]))
|| array_to_string(list_transform(cells[2:], lambda r: chr(10) || '|' || array_to_string(list_transform(r, lambda x: coalesce(replace(replace(x, chr(10), '<br>'), '|', chr(92) || '|'), '')), '|') || '|'), '') || chr(10) || chr(10) AS markdown FROM ({_run('a')}) WHERE len(cells) > 0""",
    "override_cells": "WITH " + _FLAT.format(r="a", run=_run("a")) + ", " + _FLAT.format(r="b", run=_run("b")) + " SELECT a.doc_id, a.config, a.page, a.table_no, a.row, a.col, coalesce(b.text, a.text) AS text, CASE WHEN b.text IS NOT NULL THEN 'ocr' ELSE 'pdf' END AS source FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.config = b.config AND a.page = b.page AND a.table_no = b.table_no AND a.row = b.row AND a.col = b.col AND b.text IS NOT NULL",
    "unique_sorted": f"WITH {_GRID}, u AS (SELECT doc_id, page, {_fold('vl', '3.0')} AS k FROM g) SELECT doc_id, page, CAST(len(k) AS INTEGER) AS n, array_to_string(list_transform(k, lambda x: CAST(CAST(floor(x * 100) AS BIGINT) AS VARCHAR)), ',') AS kept FROM u",
    "explicit_grid_cells": f"WITH {_CELL} SELECT * FROM cl",
    "char_in_cell": f"WITH {_HELD} SELECT doc_id, page, block, line, seq, row, col FROM hd",
    "cell_text": f"WITH {_HELD}, ln AS (SELECT doc_id, page, row, col, block, line, string_agg(c, '' ORDER BY seq) AS t FROM hd GROUP BY ALL) SELECT doc_id, page, row, col, string_agg(t, chr(10) ORDER BY block, line) AS text FROM ln GROUP BY ALL",
    "segment_edges": f"WITH {_R}, p AS (SELECT *, x1 - x0 AS dx, seq * 0.2::DOUBLE AS dy FROM q) SELECT doc_id, seq, 'h' AS kind, (y0 + (y0 + dy)) / 2 AS pos, x0 AS lo, x1 AS hi FROM p WHERE dx >= 1 AND (y0 + dy) - y0 <= greatest(0.5, dx * 0.008726867790758789) AND dx >= (y0 + dy) - y0 UNION ALL SELECT doc_id, seq, 'v', (x0 + x1) / 2, y0, y0 + dy FROM p WHERE (y0 + dy) - y0 >= 1 AND dx <= greatest(0.5, ((y0 + dy) - y0) * 0.008726867790758789) AND (y0 + dy) - y0 > dx",
    "rect_edges": f"WITH {_R}, {_EDGES} SELECT * FROM f",
    "component_edges": f"""WITH RECURSIVE {_R}, {_EDGES}, d AS (SELECT DISTINCT doc_id, kind, pos, lo, hi FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, pos, lo, hi) AS id, CASE kind WHEN 'h' THEN lo ELSE pos - 1 END AS x0, CASE kind WHEN 'h' THEN hi ELSE pos + 1 END AS x1, CASE kind WHEN 'h' THEN pos - 1 ELSE lo END AS y0, CASE kind WHEN 'h' THEN pos + 1 ELSE hi END AS y1 FROM d),
m AS (SELECT a.doc_id, a.id AS a, b.id AS b FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
w AS (SELECT doc_id, id AS root, id FROM n UNION SELECT w.doc_id, w.root, m.b FROM w JOIN m ON m.doc_id = w.doc_id AND m.a = w.id),
c AS (SELECT doc_id, id, min(root) AS root FROM w GROUP BY doc_id, id),
g AS (SELECT n.*, root, count(*) FILTER (kind = 'h') OVER z AS nh, count(*) FILTER (kind = 'v') OVER z AS nv FROM n JOIN c USING (doc_id, id) WINDOW z AS (PARTITION BY doc_id, root))
SELECT doc_id, CAST(0 AS INTEGER) AS page, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY root) - 1 AS INTEGER) AS component, kind, pos, lo, hi FROM g WHERE nh >= 2 AND nv >= 2""",
    "image_dedupe": f"WITH {_R}, s AS (SELECT * FROM q WHERE x0 < x1 AND y0 < y1) SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY (x1 - x0) * (y1 - y0) DESC, seq) - 1 AS INTEGER) AS number FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE {_IN})",
    "table_containment": f"WITH {_R} SELECT doc_id, seq FROM q a WHERE EXISTS (SELECT 1 FROM q b WHERE {_IN})",
    "text_over_tables_anti": f"WITH {_R} SELECT doc_id, seq FROM q a WHERE seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM q b WHERE b.doc_id = a.doc_id AND b.seq % 2 = 0 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)",
    "table_before_line": f"WITH {_R} SELECT a.doc_id, a.seq AS table_no, arg_min(b.seq, (b.y0, b.seq)) AS seq FROM q a JOIN q b ON a.doc_id = b.doc_id WHERE a.seq % 2 = 0 AND b.seq % 2 = 1 AND a.y1 <= b.y0 AND b.x0 < a.x1 AND a.x0 < b.x1 GROUP BY 1, 2",
    "nearest_neighbour": "WITH p AS (SELECT label, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings), j AS (SELECT a.label, a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id) SELECT label, id, arg_min(other, (d, other)) AS other FROM j WHERE d <= 25 GROUP BY 1, 2",
    "merge_segments": f"""WITH RECURSIVE {_R}, u AS (SELECT doc_id, CAST(floor(y0 / 50) * 2 AS DOUBLE) AS pos, x0 AS lo, x1 AS hi FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, lo, hi) AS k FROM u),
f AS (SELECT doc_id, k, pos, lo, hi, 1 AS grp FROM n WHERE k = 1
UNION ALL SELECT n.doc_id, n.k, CASE WHEN n.pos - f.pos <= 3 AND n.lo <= f.hi + 3 THEN f.pos ELSE n.pos END, CASE WHEN n.pos - f.pos <= 3 AND n.lo <= f.hi + 3 THEN least(f.lo, n.lo) ELSE n.lo END,
CASE WHEN n.pos - f.pos <= 3 AND n.lo <= f.hi + 3 THEN greatest(f.hi, n.hi) ELSE n.hi END, CASE WHEN n.pos - f.pos <= 3 AND n.lo <= f.hi + 3 THEN f.grp ELSE f.grp + 1 END FROM f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1)
SELECT doc_id, arg_max(pos, k) AS pos, arg_max(lo, k) AS lo, arg_max(hi, k) AS hi FROM f GROUP BY doc_id, grp""",
}
