"""Queries of whole pages: columns, Markdown, page records, documents, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import pages as P
from pagemill.operators import textflow as L
from pagemill.operators.tables import find_tables
from pagemill.options import MarkdownOptions
from pagemill.plans.layout_queries import _BOLD, _HEAD, _ITAL, _MONO, _NOT_WHITE, _inline, chars_of, links_of, spans_of, toc_of
from pagemill.plans.table_queries import run_edges, run_words


def q_column_boxes(spark, d):
    return P.column_boxes(spans_of(spark, d))


def q_page_markdown(spark, d):
    return P.page_markdown(spans_of(spark, d), links=links_of(spark, d))


def q_document_markdown(spark, d):
    return P.join_pages(P.page_markdown(spans_of(spark, d)))


def q_page_with_tables(spark, d):
    """Spans of the text below the page's tables, which are laid out from run a."""
    s = spans_of(spark, d).withColumns({"y0": F.col("y0") + 2000, "y1": F.col("y1") + 2000})
    return P.page_markdown(s, MarkdownOptions(page_separators=True), cells=find_tables(run_edges(spark, d), run_words(spark, d)))


def q_plain_elements(spark, d):
    return P.page_markdown(spans_of(spark, d), MarkdownOptions(elements=("table",)))


def q_page_chunks(spark, d):
    s = spans_of(spark, d)
    pages = P.page_markdown(s)
    c = P.page_chunks(pages, s, toc=toc_of(spark, d), cells=find_tables(run_edges(spark, d), run_words(spark, d)), words=L.extract_words(chars_of(spark, d)))
    return c.select(
        "doc_id", "page", F.col("metadata.page_count").alias("page_count"), F.col("metadata.page").alias("page_no"), F.coalesce(F.size("toc_items"), F.lit(0)).alias("n_toc"), F.coalesce(F.size("tables"), F.lit(0)).alias("n_tables"), F.coalesce(F.size("words"), F.lit(0)).alias("n_words"), (F.length("text") > 0).alias("has_text")
    )


def q_stream_styles(spark, d):
    """Inline Markdown of spans read as a stream, every delivered row."""
    from pagemill.functions import text as X
    from pagemill.streaming.relations import drain, read_relation

    s = L.line_spans(read_relation(spark, f"{d}/spans.parquet"))
    return drain(s.select("span_id", X.inline_style(F.col("text"), X.is_bold(F.col("flags"), F.col("char_flags")), X.is_italic(F.col("flags")), X.is_mono(F.col("flags"))).alias("md")))


QUERIES = {"stream_styles": q_stream_styles, "column_boxes": q_column_boxes, "page_markdown": q_page_markdown, "document_markdown": q_document_markdown, "page_with_tables": q_page_with_tables, "plain_elements": q_plain_elements, "page_chunks": q_page_chunks}

ORACLES = {
    "stream_styles": f"SELECT span_id, {_inline(_BOLD, _ITAL, _MONO)} AS md FROM spans WHERE text IS NOT NULL AND regexp_matches(text, '{_NOT_WHITE}')",
    "page_chunks": f"""WITH {_HEAD}, pg AS (SELECT doc_id, page FROM s GROUP BY ALL), pc AS (SELECT doc_id, CAST(max(page) + 1 AS INTEGER) AS page_count FROM s GROUP BY 1),
tc AS (SELECT doc_id, page, count(*) AS n FROM hl GROUP BY ALL), tb AS (SELECT doc_id, page, count(*) AS n FROM (SELECT doc_id, config, page, table_no, arg_max(cells, loaded_at) AS c FROM tables_run_a GROUP BY ALL) WHERE len(c) >= 2 AND list_max(list_transform(c, lambda x: len(x))) >= 2 GROUP BY ALL),
ch AS (SELECT doc_id, page, block, line, string_agg(c, '' ORDER BY seq) AS t FROM (SELECT doc_id, page, block, line, seq, max(c) AS c FROM chars GROUP BY ALL) GROUP BY ALL),
wd AS (SELECT doc_id, page, sum(len(list_filter(regexp_split_to_array(t, '[\\x00-\\x20\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> ''))) AS n FROM ch GROUP BY ALL)
SELECT pg.doc_id, pg.page, page_count, CAST(pg.page + 1 AS INTEGER) AS page_no, CAST(coalesce(tc.n, 0) AS INTEGER) AS n_toc, CAST(coalesce(tb.n, 0) AS INTEGER) AS n_tables, CAST(coalesce(wd.n, 0) AS INTEGER) AS n_words, true AS has_text
FROM pg JOIN pc USING (doc_id) LEFT JOIN tc ON pg.doc_id = tc.doc_id AND pg.page = tc.page LEFT JOIN tb ON pg.doc_id = tb.doc_id AND pg.page = tb.page LEFT JOIN wd ON pg.doc_id = wd.doc_id AND pg.page = wd.page""",
}
