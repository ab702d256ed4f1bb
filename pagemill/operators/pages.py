"""Pages from their relations: column boxes, Markdown, page records, joined documents.

Inputs are flat relations keyed by (doc_id, page): spans, links, cells of tables, images. The
heading model of a document is aggregated once and joined to its spans; all else is per page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import layout_kernel as K
from pagemill.operators import table_kernel as TK
from pagemill.operators import textflow as L
from pagemill.operators.pagewise import fold, gathered
from pagemill.options import MarkdownOptions

PAGE = L.PAGE
_SPAN = ["block", "line", "span", "text", "x0", "y0", "x1", "y1", "size", "flags", "char_flags"]
WHOLE = (0.0, 0.0, 10_000.0, 10_000.0)


def column_boxes(spans: DataFrame) -> DataFrame:
    """Column rectangles of each page in reading order, from the envelopes of its text blocks."""
    blocks = L.line_spans(spans).groupBy(*PAGE, "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))

    def run(doc, page, items):
        for k, b in enumerate(K.column_boxes([(i["x0"], i["y0"], i["x1"], i["y1"]) for i in items])):
            yield (doc, page, k, *b)

    return fold(gathered(blocks, PAGE, ["block", "x0", "y0", "x1", "y1"]), run, "doc_id long, page int, number int, x0 double, y0 double, x1 double, y1 double")


def _spans(items, source) -> list[K.Span]:
    rows = sorted(items or (), key=lambda s: (s["block"], s["line"], s["span"]))
    return [K.Span(s["text"], s["x0"], s["y0"], s["x1"], s["y1"], s["size"] or 11.0, s["flags"] or 0, s["char_flags"] or 0, s["block"], s.get("level"), s.get("uri")) for s in rows if s["text"] is not None and s["x0"] is not None]


def _tables(cells) -> list[tuple[K.Box, str]]:
    by: dict[int, dict] = {}
    for c in cells or ():
        by.setdefault(c["table_no"], {})[c["row"], c["col"]] = c
    out = []
    for _, t in sorted(by.items()):
        rows, cols = max(r for r, _ in t) + 1, max(c for _, c in t) + 1
        texts = [[(t[r, c]["text"] if (r, c) in t else "") for c in range(cols)] for r in range(rows)]
        boxes = [c for c in t.values() if c["x0"] is not None]
        box = (min(c["x0"] for c in boxes), min(c["y0"] for c in boxes), max(c["x1"] for c in boxes), max(c["y1"] for c in boxes))
        out.append((box, TK.to_markdown(texts)))
    return out


def page_markdown(spans: DataFrame, options: MarkdownOptions = MarkdownOptions(), cells: DataFrame | None = None, links: DataFrame | None = None, images: DataFrame | None = None, toc: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, text): Markdown of each page that has spans or tables. Heading levels come
    from the sizes of the document, or with ``hdr_info="toc"`` from the outline ``toc``."""
    s = spans.filter(F.col("page").isin(list(options.pages))) if options.pages is not None else spans
    s = s.filter(F.coalesce(F.col("size"), F.lit(11.0)) >= options.fontsize_limit)
    if options.hdr_info is None:
        model = L.heading_levels(L.size_histogram(spans), options.max_levels, options.body_limit)
        s = L.span_levels(s, model)
    elif options.hdr_info == "toc" and toc is not None:
        named = L.match_outline(s, toc).select(*[F.col(c).alias(f"__{c}") for c in L.SPAN], "level")
        cond = F.lit(True)
        for c in L.SPAN:
            cond = cond & (F.col(c) == F.col(f"__{c}"))
        s = s.join(named, cond, "left").drop(*[f"__{c}" for c in L.SPAN])
    else:
        s = s.withColumn("level", F.lit(None).cast("int"))
    if links is not None and options.has("link"):
        met = L.resolve_links(s, links).select(*[F.col(c).alias(f"__{c}") for c in L.SPAN], "uri")
        cond = F.lit(True)
        for c in L.SPAN:
            cond = cond & (F.col(c) == F.col(f"__{c}"))
        s = s.join(met, cond, "left").drop(*[f"__{c}" for c in L.SPAN])
    else:
        s = s.withColumn("uri", F.lit(None).cast("string"))
    g = gathered(s, PAGE, [*_SPAN, "level", "uri"], "spans")
    if cells is not None and options.tables:
        g = g.join(gathered(cells, PAGE, ["table_no", "row", "col", "x0", "y0", "x1", "y1", "text"], "cells"), PAGE, "full")
    else:
        g = g.withColumn("cells", F.lit(None).cast("array<struct<table_no:int,row:int,col:int,x0:double,y0:double,x1:double,y1:double,text:string>>"))
    if images is not None and options.has("image"):
        g = g.join(gathered(images, PAGE, ["number", "x0", "y0", "x1", "y1", "ref"], "images"), PAGE, "full")
    else:
        g = g.withColumn("images", F.lit(None).cast("array<struct<number:int,x0:double,y0:double,x1:double,y1:double,ref:string>>"))
    style, named = options.style, options.hdr_info
    separators = options.page_separators

    def run(doc, page, items, cells, images):
        rows = _spans(items, None)
        if callable(named):
            for r in rows:
                prefix = named({"text": r.text, "size": r.size, "flags": r.flags, "page": page}) or ""
                r.level = prefix.count("#") or None
        pics = [((i["x0"], i["y0"], i["x1"], i["y1"]), i["ref"]) for i in sorted(images or (), key=lambda i: i["number"])]
        text = K.page_markdown(rows, WHOLE, _tables(cells), pics, style)
        if separators:
            text += f"\n\n--- end of page={page} ---\n\n"
        yield doc, page, text

    return fold(g.select(*PAGE, "spans", "cells", "images"), run, "doc_id long, page int, text string")


def join_pages(pages: DataFrame) -> DataFrame:
    """One text a document, its pages in order without a separator."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), "").alias("text"))


def page_chunks(pages: DataFrame, spans: DataFrame, toc: DataFrame | None = None, cells: DataFrame | None = None, images: DataFrame | None = None, words: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """One record a page: metadata, outline entries, tables, images, text and words."""
    out = pages
    count = spans.groupBy("doc_id").agg((F.max("page") + 1).alias("page_count"))
    out = out.join(count, "doc_id", "left")
    if metadata is not None:
        out = out.join(metadata, "doc_id", "left")
    known = [c for c in ("format", "title", "author", "subject", "keywords", "creator", "producer", "creation_date", "mod_date", "encryption", "file_path") if c in out.columns]
    none = lambda c: F.lit("").alias(c)
    names = ("format", "title", "author", "subject", "keywords", "creator", "producer", "creation_date", "mod_date", "encryption", "file_path")
    meta = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in known else none(c) for c in names], F.col("page_count"), (F.col("page") + 1).alias("page"))
    out = out.select(*PAGE, meta.alias("metadata"), "text")

    def side(df, struct, name, order):
        nonlocal out
        if df is None:
            return
        g = df.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*order, struct.alias("__v")))).alias("__a")).select(*PAGE, F.transform("__a", lambda s: s["__v"]).alias(name))
        out = out.join(g, PAGE, "left")

    if toc is not None:
        side(toc.withColumn("page", F.col("page") - 1), F.struct("level", "title", (F.col("page") + 1).alias("page")), "toc_items", ["seq"])
    if cells is not None:
        t = cells.groupBy(*PAGE, "table_no").agg(
            F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("bbox"),
            (F.max("row") + 1).alias("rows"),
            (F.max("col") + 1).alias("columns"),
            F.array_sort(F.collect_list(F.struct("row", "col", "text"))).alias("cells"),
        )
        side(t, F.struct("bbox", "rows", "columns", "cells"), "tables", ["table_no"])
    if images is not None:
        side(images, F.struct("x0", "y0", "x1", "y1", "ref"), "images", ["number"])
    if words is not None:
        side(words, F.struct("x0", "y0", "x1", "y1", "text", "block", "line", "word"), "words", ["block", "line", "word"])
    return out
