"""Characters to spans, words, visual lines, reading order and heading levels.

Sequence steps are gaps-and-islands windows inside one line or page; a page is the largest
group, so a document of any size spreads over its pages. The only document-wide step is the
size histogram, a partial aggregation. Ties keep scan order: block, line, span or seq.

Repeated rows of a key count once (``dedupe``). Null fonts and colours equal each other. Rows
with a null key are kept together as one group; null texts are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.geometry import envelope, js_round
from pagemill.functions.text import TRIM_CLASS, is_white, trim_all
from pagemill.operators.pagewise import fold, gathered

PAGE = ["doc_id", "page"]
LINE = [*PAGE, "block", "line"]
SPAN = [*LINE, "span"]
TOLERANCE = 3.0


def dedupe(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row a key: delivered twice, a row counts once; of different ones the latest, then the
    largest in column order, nulls smallest."""
    rest = [c for c in df.columns if c not in key]
    order = sorted(rest, key=lambda c: c != "loaded_at")
    return df.groupBy(*key).agg(F.max(F.struct(*order)).alias("__m")).select(*[c if c in key else F.col(f"__m.{c}").alias(c) for c in df.columns])


def ordered_text(order: Sequence[str], text: str = "text", sep: str = "") -> Column:
    """Texts of a group joined in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return F.array_join(F.transform(items, lambda s: s["__t"]), sep)


def first_of(col: str, order: Sequence[str]) -> Column:
    return F.min_by(F.struct(col), F.struct(*order))[col]


def islands(df: DataFrame, by: Sequence[str], order: Sequence, starts: Column, name: str) -> DataFrame:
    """``name``: 0-based number of the island a row is in; ``starts`` tells where one begins."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, (F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))


def changed(cols: Sequence[str], w) -> Column:
    """First row of the window, or a value that differs from the row before, null-safe."""
    c = F.row_number().over(w) == 1
    for x in cols:
        c = c | ~F.col(x).eqNullSafe(F.lag(x).over(w))
    return c


def build_spans(chars: DataFrame) -> DataFrame:
    """Runs of equal font, size and colour inside a line, with joined text and envelope."""
    w = Window.partitionBy(*LINE).orderBy("seq")
    runs = chars.filter(F.col("c").isNotNull()).withColumn("__start", changed(["font", "size", "color"], w))
    runs = islands(runs, LINE, ["seq"], F.col("__start"), "span")
    return runs.groupBy(*SPAN).agg(
        ordered_text(["seq"], "c").alias("text"),
        *(first_of(c, ["seq"]).alias(c) for c in ("font", "size", "color", "flags", "char_flags")),
        *envelope(),
        F.count(F.lit(1)).cast("int").alias("n_chars"),
    )


def extract_words(chars: DataFrame) -> DataFrame:
    """Words with boxes: broken by white characters, counted from 0 in each line. ``block`` is
    the rank of the block among those of its page."""
    w = Window.partitionBy(*LINE).orderBy("seq")
    white = is_white(F.col("c"))
    rows = chars.filter(F.col("c").isNotNull()).withColumn("__white", white)
    rows = rows.withColumn("__island", F.sum(F.col("__white").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = rows.filter(~F.col("__white")).groupBy(*LINE, "__island").agg(ordered_text(["seq"], "c").alias("text"), *envelope())
    blocks = chars.select(*PAGE, "block").distinct().withColumn("__b", F.row_number().over(Window.partitionBy(*PAGE).orderBy("block")) - 1)
    words = words.withColumn("word", F.row_number().over(Window.partitionBy(*LINE).orderBy("__island")) - 1)
    b = blocks.select(*[F.col(c).alias(f"__{c}") for c in (*PAGE, "block")], "__b")
    cond = (F.col("doc_id") == F.col("__doc_id")) & (F.col("page") == F.col("__page")) & (F.col("block") == F.col("__block"))
    return words.join(b, cond).select(*PAGE, F.col("__b").cast("int").alias("block"), "line", "word", "text", "x0", "y0", "x1", "y1")


def word_boxes(chars: DataFrame, gap_share: float = 1 / 3) -> DataFrame:
    """Words inside a run of one style, also broken by gaps over a third of the size; the gap is
    that to the right edge of what the word holds so far."""
    w = Window.partitionBy(*LINE).orderBy("seq")
    rows = chars.filter(F.col("c").isNotNull()).withColumn("__style", F.sum(F.when(changed(["font", "size", "color"], w), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__white", is_white(F.col("c")))
    rows = rows.withColumn("__stretch", F.sum(F.col("__white").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("__white"))
    v = Window.partitionBy(*LINE, "__style", "__stretch").orderBy("seq")
    reach = F.max("x1").over(v.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__start", reach.isNull() | (F.col("x0") - reach > F.col("size") * gap_share))
    rows = rows.withColumn("__piece", F.sum(F.col("__start").cast("int")).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    words = rows.groupBy(*LINE, "__style", "__stretch", "__piece").agg(ordered_text(["seq"], "c").alias("text"), *envelope(), F.min("seq").alias("first_seq"))
    return words.drop("__style", "__stretch", "__piece")


def line_spans(spans: DataFrame, size_limit: float = 0.0) -> DataFrame:
    """Spans that take part in lines: something visible, not under the size limit."""
    return spans.filter(F.col("text").isNotNull() & ~is_white(F.col("text")) & (F.col("size") >= size_limit))


def visual_lines(spans: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``vline``: the visual line of each span of a page, by order of bottom edges. A span joins
    the line of the span before it if their bottoms or their tops differ by the tolerance at most."""
    order = ["y1", "block", "line", "span"]
    w = Window.partitionBy(*PAGE).orderBy(*order)
    near = (F.abs(F.col("y1") - F.lag("y1").over(w)) <= tolerance) | (F.abs(F.col("y0") - F.lag("y0").over(w)) <= tolerance)
    rows = spans.withColumn("__start", F.coalesce(~near, F.lit(True)))
    return islands(rows, PAGE, order, F.col("__start"), "vline").drop("__start")


def sanitize_spans(spans: DataFrame) -> DataFrame:
    """Join neighbours of a visual line, left to right, unless the gap is over a tenth of the
    right one's size or their flags differ (underline aside). Repeated spans join once."""
    by = [*PAGE, "vline"]
    order = ["x0", "block", "line", "span"]
    w = Window.partitionBy(*by).orderBy(*order)
    bare = F.col("char_flags").bitwiseAND(~2)
    apart = (F.col("x0") - F.lag("x1").over(w) > F.col("size") * 0.1) | (F.col("flags") != F.lag("flags").over(w)) | (bare != F.lag(bare).over(w))
    rows = spans.withColumn("__start", F.coalesce(apart, F.lit(True)))
    rows = rows.withColumn("__again", F.coalesce((F.col("text") == F.lag("text").over(w)) & (F.col("x0") == F.lag("x0").over(w)) & (F.col("x1") == F.lag("x1").over(w)), F.lit(False)))
    rows = islands(rows, by, order, F.col("__start"), "piece")
    rows = rows.withColumn("__t", F.when(F.col("__again"), "").otherwise(F.col("text")))
    return rows.groupBy(*by, "piece").agg(
        ordered_text(order, "__t").alias("text"), *(first_of(c, order).alias(c) for c in ("font", "size", "flags", "char_flags", "block", "line", "span")), *envelope(), F.count(F.lit(1)).cast("int").alias("n_spans")
    )


def stripes(boxes: DataFrame, by: Sequence[str], seq: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """``stripe``: bands of boxes from top to bottom; a new one begins where a box starts at or
    below everything before it."""
    order = ["y0", "x0", *seq]
    w = Window.partitionBy(*by).orderBy(*order)
    below = F.col("y0") >= F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1)) - tolerance
    return islands(boxes.withColumn("__start", F.coalesce(below, F.lit(True))), by, order, F.col("__start"), "stripe").drop("__start")


def reading_order(boxes: DataFrame, by: Sequence[str], seq: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """``position``: 0-based rank by stripe, then left to right."""
    rows = stripes(boxes, by, seq, tolerance)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("stripe", "x0", "y0", *seq)) - 1)


# --- headings ----------------------------------------------------------------------------


def size_histogram(spans: DataFrame) -> DataFrame:
    """Visible characters by document and rounded size."""
    rows = line_spans(spans).withColumn("size_r", js_round(F.col("size")).cast("int"))
    return rows.groupBy("doc_id", "size_r").agg(F.sum(F.length(trim_all(F.col("text")))).alias("n_chars"))


def body_sizes(histogram: DataFrame, body_limit: int = 12) -> DataFrame:
    """Size of body text: the commonest, of equal ones the larger, but no less than the limit."""
    return histogram.groupBy("doc_id").agg(F.greatest(F.lit(body_limit), F.max_by("size_r", F.struct("n_chars", "size_r"))).alias("body"))


def heading_levels(histogram: DataFrame, max_levels: int = 6, body_limit: int = 12) -> DataFrame:
    """(doc_id, size_r, level, prefix) of the largest sizes over the body size."""
    if not 1 <= max_levels <= 6:
        raise ValueError("max_levels must be between 1 and 6")
    body = body_sizes(histogram, body_limit).select(F.col("doc_id").alias("__doc"), "body")
    over = histogram.join(body, F.col("doc_id") == F.col("__doc")).filter("size_r > body")
    over = over.withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("size_r").desc())))
    return over.filter(F.col("level") <= max_levels).select("doc_id", "size_r", "level", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" ")).alias("prefix"))


def span_levels(spans: DataFrame, levels: DataFrame) -> DataFrame:
    """Spans with the heading level of their size, null for body text."""
    lv = levels.select(F.col("doc_id").alias("__doc"), F.col("size_r").alias("__size"), "level")
    return spans.join(lv, (F.col("doc_id") == F.col("__doc")) & (js_round(F.col("size")).cast("int") == F.col("__size")), "left").drop("__doc", "__size")


def heading_lines(spans: DataFrame, levels: DataFrame) -> DataFrame:
    """Lines with their most prominent level and joined text."""
    rows = span_levels(line_spans(spans), levels)
    lines = rows.groupBy(*LINE).agg(F.min("level").alias("level"), ordered_text(["span"], "text").alias("text"))
    return lines.filter("level IS NOT NULL").withColumn("text", trim_all(F.col("text")))


def match_outline(spans: DataFrame, toc: DataFrame) -> DataFrame:
    """Outline entries to the spans that show them: same page, equal texts or one the beginning
    of the other. Spans go in order; each takes the first entry left, each entry serves once.

    Candidate pairs are joined on the page; the greedy pass runs inside a page.
    """
    s = line_spans(spans).select(*SPAN, trim_all(F.col("text")).alias("t"))
    o = toc.select(F.col("doc_id").alias("__doc"), (F.col("page") - 1).alias("__page"), "seq", F.least("level", F.lit(6)).alias("level"), trim_all(F.col("title")).alias("title"))
    hit = (F.col("t") == F.col("title")) | F.col("t").startswith(F.col("title")) | F.col("title").startswith(F.col("t"))
    pairs = s.join(o, (F.col("doc_id") == F.col("__doc")) & (F.col("page") == F.col("__page")) & hit & (F.col("title") != "")).drop("__doc", "__page", "t")

    def greedy(doc, page, items):
        used, taken = set(), set()
        for i in sorted(items, key=lambda i: (i["block"], i["line"], i["span"], i["seq"])):
            at = (i["block"], i["line"], i["span"])
            if at not in taken and i["title"] not in used:
                taken.add(at)
                used.add(i["title"])
                yield doc, page, *at, i["seq"], i["level"], i["title"]

    return fold(gathered(pairs, PAGE, ["block", "line", "span", "seq", "level", "title"]), greedy, pairs.select(*SPAN, "seq", "level", "title").schema)


def resolve_links(spans: DataFrame, links: DataFrame) -> DataFrame:
    """Spans with the first link whose hot rectangle has its centre inside them."""
    a = links.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "page", "link_seq", "x0", "y0", "x1", "y1")], "uri")
    cx, cy = (F.col("__x0") + F.col("__x1")) / 2, (F.col("__y0") + F.col("__y1")) / 2
    inside = (cx >= F.col("x0")) & (cx <= F.col("x1")) & (cy >= F.col("y0")) & (cy <= F.col("y1"))
    met = spans.join(a, (F.col("doc_id") == F.col("__doc_id")) & (F.col("page") == F.col("__page")) & inside)
    return met.groupBy(*SPAN).agg(F.min_by("uri", "__link_seq").alias("uri"), F.min_by("text", "__link_seq").alias("text"))


def broken_fonts(chars: DataFrame) -> DataFrame:
    """Font instances whose text layer cannot be trusted: three and more broken characters that
    are five per cent and more, or four and more different control characters. White characters
    do not count, unless they are controls."""
    control = F.col("c").rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]")
    broken = control | F.col("c").rlike("[\\x{FFFD}\\x{E000}-\\x{F8FF}]")
    rows = chars.filter(F.col("c").isNotNull() & (control | ~is_white(F.col("c"))))
    g = rows.groupBy("font", "font_id").agg(F.count_if(broken).alias("n_broken"), F.count(F.lit(1)).alias("n_chars"), F.count_distinct(F.when(control, F.col("c"))).alias("n_controls"))
    bad = ((F.col("n_broken") >= 3) & (F.col("n_broken") * 20 >= F.col("n_chars"))) | (F.col("n_controls") >= 4)
    return g.withColumn("broken", bad)


def page_has_text(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*PAGE).agg(F.coalesce(F.bool_or(~is_white(F.col("text"))), F.lit(False)).alias("has_text"))


def sections(df: DataFrame, text_col: str = "md_string", keys: Sequence[str] = ("md_id",)) -> DataFrame:
    """Markdown split before headings of level 1 to 3; blank sections are dropped."""
    parts = F.split(F.col(text_col), "(?m)^(?=#{1,3} )")
    return df.select(*keys, F.posexplode(F.filter(parts, lambda p: ~p.rlike(f"^[{TRIM_CLASS}]*$"))).alias("section", "text"))
