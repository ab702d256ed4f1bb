"""Queries and oracle SQL of text flow: spans, words, lines, headings, links, text clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import text as X
from pagemill.functions.geometry import Box
from pagemill.operators import textflow as L
from pagemill.session import table


def spans_of(spark: SparkSession, d: str) -> DataFrame:
    return L.dedupe(table(spark, d, "spans"), L.SPAN)


def chars_of(spark: SparkSession, d: str) -> DataFrame:
    return L.dedupe(table(spark, d, "chars").select(*L.LINE, "seq", "c", "x0", "y0", "x1", "y1", "font", "font_id", "size", "color", "flags", "char_flags", "dir_x", "dir_y"), [*L.LINE, "seq"])


def links_of(spark: SparkSession, d: str) -> DataFrame:
    """Links for the link join: in files with a url, over every span that is not printed in black."""
    s = spans_of(spark, d)
    from pyspark.sql.window import Window

    inked = s.filter("color <> 0").withColumn("link_seq", F.row_number().over(Window.partitionBy(*L.PAGE).orderBy("block", "line", "span")) - 1)
    files = table(spark, d, "corpus_files").filter("url IS NOT NULL").select(F.col("doc_id").alias("__d"), F.col("url").alias("uri"))
    return inked.join(files, F.col("doc_id") == F.col("__d")).select(*L.PAGE, "link_seq", F.concat("uri", F.lit("#"), F.col("link_seq").cast("string")).alias("uri"), "x0", "y0", "x1", "y1")


def toc_of(spark: SparkSession, d: str) -> DataFrame:
    """An outline from the headings themselves: (doc_id, seq, level, title, 1-based page)."""
    s = spans_of(spark, d)
    h = L.heading_lines(s, L.heading_levels(L.size_histogram(s)))
    return h.select("doc_id", (F.col("block") * 1000 + F.col("line")).alias("seq"), "level", F.col("text").alias("title"), (F.col("page") + 1).alias("page"))


def q_spans_from_chars(spark, d):
    return L.build_spans(chars_of(spark, d))


def q_words(spark, d):
    return L.extract_words(chars_of(spark, d))


def q_word_boxes_gap(spark, d):
    return L.word_boxes(chars_of(spark, d))


def q_visual_lines(spark, d):
    return L.visual_lines(L.line_spans(spans_of(spark, d))).select(*L.SPAN, "vline")


def q_sanitize_spans(spark, d):
    return L.sanitize_spans(L.visual_lines(L.line_spans(spans_of(spark, d)))).select(*L.PAGE, "vline", "piece", "text", "flags", "n_spans", "x0", "y0", "x1", "y1")


def q_stripes(spark, d):
    return L.stripes(spans_of(spark, d), L.PAGE, ["block", "line", "span"]).select(*L.SPAN, "stripe")


def q_reading_order(spark, d):
    return L.reading_order(spans_of(spark, d), L.PAGE, ["block", "line", "span"]).select(*L.SPAN, "position")


def q_heading_histogram(spark, d):
    return L.size_histogram(spans_of(spark, d))


def q_body_size(spark, d):
    return L.body_sizes(L.size_histogram(spans_of(spark, d)))


def q_heading_levels(spark, d):
    return L.heading_levels(L.size_histogram(spans_of(spark, d)))


def q_heading_lines(spark, d):
    s = spans_of(spark, d)
    return L.heading_lines(s, L.heading_levels(L.size_histogram(s)))


def q_heading_style(spark, d):
    s = L.span_levels(L.line_spans(spans_of(spark, d)), L.heading_levels(L.size_histogram(spans_of(spark, d)))).filter("level IS NOT NULL")
    b, i, m = X.is_bold(F.col("flags"), F.col("char_flags")), X.is_italic(F.col("flags")), X.is_mono(F.col("flags"))
    return s.select(*L.SPAN, X.heading_style(X.trim_all(F.col("text")), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" ")), b, i, m).alias("md"))


def q_inline_style(spark, d):
    s = L.line_spans(spans_of(spark, d))
    return s.select(*L.SPAN, X.inline_style(F.col("text"), X.is_bold(F.col("flags"), F.col("char_flags")), X.is_italic(F.col("flags")), X.is_mono(F.col("flags"))).alias("md"))


def q_span_styling(spark, d):
    """Lines that are bold, italic or mono throughout."""
    s = spans_of(spark, d)
    return s.groupBy(*L.LINE).agg(F.bool_and(X.is_bold(F.col("flags"), F.col("char_flags"))).alias("bold"), F.bool_and(X.is_italic(F.col("flags"))).alias("italic"), F.bool_and(X.is_mono(F.col("flags"))).alias("mono"))


def q_elements(spark, d):
    """Spans with the styles that an element whitelist of bold and code leaves."""
    s = L.line_spans(spans_of(spark, d))
    return s.select(*L.SPAN, X.inline_style(F.col("text"), X.is_bold(F.col("flags"), F.col("char_flags")), F.lit(False), X.is_mono(F.col("flags"))).alias("md"))


def q_bullets(spark, d):
    s = L.line_spans(spans_of(spark, d)).filter(X.starts_with_bullet(F.col("text")))
    return s.select(*L.SPAN, X.bullet_text(F.col("text"), F.col("x0"), F.lit(50.0), F.col("size"), F.col("x1") - F.col("x0")).alias("md"))


def q_code_indent(spark, d):
    s = spans_of(spark, d).filter(X.is_mono(F.col("flags")) & F.col("text").isNotNull())
    return s.select(*L.SPAN, X.code_indent(F.col("text"), F.col("x0"), F.lit(50.0), F.col("size")).alias("code"))


def q_links(spark, d):
    return L.resolve_links(spans_of(spark, d), links_of(spark, d)).select(*L.SPAN, F.concat(F.lit("["), X.trim_all(F.col("text")), F.lit("]("), F.col("uri"), F.lit(")")).alias("md"))


def q_toc_pages(spark, d):
    """Outline entries gathered by page."""
    t = toc_of(spark, d)
    e = F.array_sort(F.collect_list(F.struct("seq", "level", "title")))
    return t.groupBy("doc_id", (F.col("page") - 1).alias("page")).agg(F.count(F.lit(1)).alias("n_entries"), F.array_join(F.transform(e, lambda s: F.concat(s["level"].cast("string"), F.lit(":"), s["title"])), "|").alias("entries"))


def q_toc_match(spark, d):
    return L.match_outline(spans_of(spark, d), toc_of(spark, d))


def q_broken_fonts(spark, d):
    return L.broken_fonts(chars_of(spark, d))


def q_page_has_text(spark, d):
    return L.page_has_text(spans_of(spark, d))


def q_looks_broken(spark, d):
    s = spans_of(spark, d).filter("text IS NOT NULL")
    return s.select(*L.SPAN, X.looks_broken(F.col("text")).alias("broken"))


def q_stray_letter(spark, d):
    s = spans_of(spark, d).filter("text IS NOT NULL")
    return s.filter(X.stray_letter(F.col("text"))).select(*L.SPAN, "text")


def q_fix_homoglyphs(spark, d):
    @F.pandas_udf(T.StringType())
    def fix(s):
        return s.map(X.fix_homoglyphs)

    s = spans_of(spark, d).filter("text IS NOT NULL")
    return s.select(*L.SPAN, fix("text").alias("text"))


def q_plausibility(spark, d):
    s = spans_of(spark, d).filter("text IS NOT NULL")
    return s.select(*L.SPAN, X.plausibility(F.col("text")).alias("score"))


def q_strip_leaders(spark, d):
    return table(spark, d, "page_markdown").filter("md_string IS NOT NULL").select("md_id", "made_at", X.strip_leaders(F.col("md_string")).alias("text")).drop("made_at").distinct()


def q_clean_page(spark, d):
    return table(spark, d, "page_markdown").filter("md_string IS NOT NULL").select("md_id", X.clean_page(X.clean_block(F.col("md_string"))).alias("text")).distinct()


def q_join_lines(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.join_cell_lines(F.col("text")).alias("text"))


def q_escape_cell(spark, d):
    return table(spark, d, "page_markdown").filter("md_string IS NOT NULL").select("md_id", X.escape_cell(F.col("md_string")).alias("text")).distinct()


def q_sections(spark, d):
    md = table(spark, d, "page_markdown").select("md_id", "md_string").filter("md_string IS NOT NULL").distinct()
    return L.sections(md)


def q_rect_algebra(spark, d):
    from pyspark.sql.window import Window

    s = spans_of(spark, d)
    w = Window.partitionBy(*L.LINE).orderBy("span")
    s = s.withColumns({f"n{c}": F.lead(c).over(w) for c in ("x0", "y0", "x1", "y1")}).filter("nx0 IS NOT NULL")
    a, b = Box.of(), Box.of("n")
    i, u = a.intersect(b), a.union(b)
    return s.select(*L.SPAN, i.x0.alias("ix0"), i.x1.alias("ix1"), u.x0.alias("ux0"), u.x1.alias("ux1"), u.area.alias("area"), a.gap(b).alias("gap"), a.disjoint(b).alias("apart"), a.disjoint(b, strict=True).alias("apart_strict"), a.intersects(b).alias("meets"), u.contains(a).alias("holds"), a.almost_in(u).alias("mostly"), a.irect().x1.cast("int").alias("right"))


def q_pack_color(spark, d):
    s = spans_of(spark, d).filter("color IS NOT NULL")
    part = lambda n: F.shiftright("color", n).bitwiseAND(255) / F.lit(255.0)
    return s.select(*L.SPAN, X.pack_color(part(16), part(8), part(0)).alias("rgb"), X.pack_color(part(0)).alias("gray"))


def q_page_rotation(spark, d):
    """Page boxes of files turned by quarter turns, brought upright."""
    from pagemill.functions.geometry import derotate

    s = spans_of(spark, d)
    out = [s.filter(F.pmod("doc_id", F.lit(4)) == k).select(*L.SPAN, *derotate(Box.of(), 90 * k, 595.0, 842.0).columns()) for k in range(4)]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


_COLS = "doc_id, page, block, line, span, text, font, size, color, flags, char_flags, x0, y0, x1, y1"
_S = f"s AS (SELECT DISTINCT {_COLS} FROM spans)"
_C = "c AS (SELECT doc_id, page, block, line, seq, " + ", ".join(f"max({x}) AS {x}" for x in ("c", "x0", "y0", "x1", "y1", "font", "font_id", "size", "color", "flags", "char_flags")) + " FROM chars GROUP BY doc_id, page, block, line, seq)"
_K = "doc_id, page, block, line, span"
_L = "doc_id, page, block, line"
_WHITE = r"[\x00-\x20\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_NOT_WHITE = r"[^\x00-\x20\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_TRIM = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_TRIM}+|{_TRIM}+$', '', 'g')"


_V = f"v AS (SELECT * FROM s WHERE text IS NOT NULL AND regexp_matches(text, '{_NOT_WHITE}'))"
_ISL = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_STYLE = f"""r AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR font IS DISTINCT FROM lag(font) OVER w OR size IS DISTINCT FROM lag(size) OVER w OR color IS DISTINCT FROM lag(color) OVER w THEN 1 ELSE 0 END AS st
FROM c WHERE c IS NOT NULL WINDOW w AS (PARTITION BY {_L} ORDER BY seq)),
i AS (SELECT *, CAST(sum(st) OVER (PARTITION BY {_L} ORDER BY seq {_ISL}) - 1 AS INTEGER) AS span FROM r)"""
_VL = f"""o AS (SELECT *, CASE WHEN abs(y1 - lag(y1) OVER w) <= 3 OR abs(y0 - lag(y0) OVER w) <= 3 THEN 0 ELSE 1 END AS st FROM v WINDOW w AS (PARTITION BY doc_id, page ORDER BY y1, block, line, span)),
l AS (SELECT *, CAST(sum(st) OVER (PARTITION BY doc_id, page ORDER BY y1, block, line, span {_ISL}) - 1 AS INTEGER) AS vline FROM o)"""
_STRIPE = f"""o AS (SELECT *, CASE WHEN y0 < max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block, line, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS st FROM s),
p AS (SELECT *, CAST(sum(st) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block, line, span {_ISL}) - 1 AS INTEGER) AS stripe FROM o)"""
_HIST = f"h AS (SELECT doc_id, CAST(floor(size + 0.5) AS INTEGER) AS size_r, CAST(sum(length({_trim('text')})) AS BIGINT) AS n_chars FROM v GROUP BY ALL)"
_BODY = "b AS (SELECT doc_id, CAST(greatest(12, arg_max(size_r, (n_chars, size_r))) AS INTEGER) AS body FROM h GROUP BY 1)"
_LEVELS = "lv AS (SELECT * FROM (SELECT h.doc_id, size_r, CAST(dense_rank() OVER (PARTITION BY h.doc_id ORDER BY size_r DESC) AS INTEGER) AS level FROM h JOIN b USING (doc_id) WHERE size_r > body) WHERE level <= 6)"
_HL = f"""sl AS (SELECT v.*, level FROM v LEFT JOIN lv ON v.doc_id = lv.doc_id AND CAST(floor(size + 0.5) AS INTEGER) = size_r),
hl AS (SELECT {_L}, min(level) AS level, {_trim("string_agg(text, '' ORDER BY span)")} AS text FROM sl GROUP BY {_L} HAVING min(level) IS NOT NULL)"""
_HEAD = f"{_S}, {_V}, {_HIST}, {_BODY}, {_LEVELS}, {_HL}"
_TOC = f"{_HEAD}, toc AS (SELECT doc_id, block * 1000 + line AS seq, level, text AS title, page + 1 AS page FROM hl)"
_BOLD, _ITAL, _MONO = "((flags & 16) <> 0 OR (char_flags & 8) <> 0)", "((flags & 2) <> 0)", "((flags & 8) <> 0)"


def _inline(bold: str, italic: str, mono: str) -> str:
    t = _trim("text")
    t = f"CASE WHEN {mono} THEN '`' || {t} || '`' ELSE {t} END"
    t = f"CASE WHEN {bold} THEN '**' || ({t}) || '**' ELSE ({t}) END"
    return f"CASE WHEN {italic} THEN '_' || ({t}) || '_' ELSE ({t}) END || ' '"


_BUL = "'" + "', '".join(X.BULLETS) + "'"
_ODD = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{FFFD}\x{E000}-\x{F8FF}]"
_CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"

QUERIES = {
    "spans_from_chars": q_spans_from_chars,
    "words": q_words,
    "word_boxes_gap": q_word_boxes_gap,
    "visual_lines": q_visual_lines,
    "sanitize_spans": q_sanitize_spans,
    "stripes": q_stripes,
    "reading_order": q_reading_order,
    "heading_histogram": q_heading_histogram,
    "body_size": q_body_size,
    "heading_levels": q_heading_levels,
    "heading_lines": q_heading_lines,
    "heading_style": q_heading_style,
    "inline_style": q_inline_style,
    "span_styling": q_span_styling,
    "element_whitelist": q_elements,
    "bullet_rewrite": q_bullets,
    "code_indent": q_code_indent,
    "link_resolution": q_links,
    "toc_page_join": q_toc_pages,
    "toc_header_match": q_toc_match,
    "broken_font_stats": q_broken_fonts,
    "page_has_text": q_page_has_text,
    "looks_broken": q_looks_broken,
    "stray_letter": q_stray_letter,
    "fix_homoglyphs": q_fix_homoglyphs,
    "text_plausibility": q_plausibility,
    "strip_leaders": q_strip_leaders,
    "page_cleanup": q_clean_page,
    "join_cell_lines": q_join_lines,
    "escape_cell": q_escape_cell,
    "markdown_sections": q_sections,
    "rect_algebra": q_rect_algebra,
    "pack_color": q_pack_color,
    "page_rotation": q_page_rotation,
}

_HEADING_STYLE = f"CASE WHEN {_BOLD} THEN '**' ELSE '' END || CASE WHEN {_ITAL} THEN '_' ELSE '' END || CASE WHEN {_MONO} THEN '`' ELSE '' END || {_trim('text')} || CASE WHEN {_MONO} THEN '`' ELSE '' END || CASE WHEN {_ITAL} THEN '_' ELSE '' END || CASE WHEN {_BOLD} THEN '**' ELSE '' END"

ORACLES = {
    "spans_from_chars": f"WITH {_C}, {_STYLE} SELECT {_K}, string_agg(c, '' ORDER BY seq) AS text, arg_min(font, seq) FILTER (font IS NOT NULL) AS font, arg_min(size, seq) AS size, arg_min(color, seq) FILTER (color IS NOT NULL) AS color, arg_min(flags, seq) AS flags, arg_min(char_flags, seq) AS char_flags, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(count(*) AS INTEGER) AS n_chars FROM i GROUP BY {_K}",
    "words": f"""WITH {_C}, w AS (SELECT *, NOT regexp_matches(c, '{_NOT_WHITE}') AS wh FROM c WHERE c IS NOT NULL),
i AS (SELECT *, sum(CAST(wh AS INTEGER)) OVER (PARTITION BY {_L} ORDER BY seq {_ISL}) AS isl FROM w),
g AS (SELECT {_L}, isl, string_agg(c, '' ORDER BY seq) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i WHERE NOT wh GROUP BY {_L}, isl),
b AS (SELECT doc_id, page, block, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY block) - 1 AS INTEGER) AS nb FROM (SELECT DISTINCT doc_id, page, block FROM c))
SELECT doc_id, page, nb AS block, line, CAST(row_number() OVER (PARTITION BY {_L} ORDER BY isl) - 1 AS INTEGER) AS word, text, x0, y0, x1, y1 FROM g JOIN b USING (doc_id, page, block)""",
    "word_boxes_gap": f"""WITH {_C}, {_STYLE}, w AS (SELECT *, NOT regexp_matches(c, '{_NOT_WHITE}') AS wh FROM i),
k AS (SELECT * FROM (SELECT *, sum(CAST(wh AS INTEGER)) OVER (PARTITION BY {_L} ORDER BY seq {_ISL}) AS stretch FROM w) WHERE NOT wh),
m AS (SELECT *, max(x1) OVER (PARTITION BY {_K}, stretch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > size * {1 / 3!r} THEN 1 ELSE 0 END) OVER (PARTITION BY {_K}, stretch ORDER BY seq {_ISL}) AS piece FROM m)
SELECT {_L}, string_agg(c, '' ORDER BY seq) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(seq) AS first_seq FROM n GROUP BY {_K}, stretch, piece""",
    "visual_lines": f"WITH {_S}, {_V}, {_VL} SELECT {_K}, vline FROM l",
    "sanitize_spans": f"""WITH {_S}, {_V}, {_VL}, q AS (SELECT *,
CASE WHEN x0 - lag(x1) OVER w > size * 0.1 OR flags <> lag(flags) OVER w OR (char_flags & -3) <> lag(char_flags & -3) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw,
CASE WHEN text = lag(text) OVER w AND x0 = lag(x0) OVER w AND x1 = lag(x1) OVER w THEN '' ELSE text END AS t FROM l WINDOW w AS (PARTITION BY doc_id, page, vline ORDER BY x0, block, line, span)),
z AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY doc_id, page, vline ORDER BY x0, block, line, span {_ISL}) - 1 AS INTEGER) AS piece FROM q)
SELECT doc_id, page, vline, piece, string_agg(t, '' ORDER BY x0, block, line, span) AS text, arg_min(flags, (x0, block, line, span)) AS flags, CAST(count(*) AS INTEGER) AS n_spans, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM z GROUP BY doc_id, page, vline, piece""",
    "stripes": f"WITH {_S}, {_STRIPE} SELECT {_K}, stripe FROM p",
    "reading_order": f"WITH {_S}, {_STRIPE} SELECT {_K}, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY stripe, x0, y0, block, line, span) - 1 AS INTEGER) AS position FROM p",
    "heading_histogram": f"WITH {_S}, {_V}, {_HIST} SELECT * FROM h",
    "body_size": f"WITH {_S}, {_V}, {_HIST}, {_BODY} SELECT * FROM b",
    "heading_levels": f"WITH {_S}, {_V}, {_HIST}, {_BODY}, {_LEVELS} SELECT doc_id, size_r, level, repeat('#', level) || ' ' AS prefix FROM lv",
    "heading_lines": f"WITH {_HEAD} SELECT {_L}, level, text FROM hl",
    "heading_style": f"WITH {_HEAD} SELECT {_K}, repeat('#', level) || ' ' || {_HEADING_STYLE} AS md FROM sl WHERE level IS NOT NULL",
    "inline_style": f"WITH {_S}, {_V} SELECT {_K}, {_inline(_BOLD, _ITAL, _MONO)} AS md FROM v",
    "span_styling": f"WITH {_S} SELECT {_L}, bool_and({_BOLD}) AS bold, bool_and({_ITAL}) AS italic, bool_and({_MONO}) AS mono FROM s GROUP BY {_L}",
    "element_whitelist": f"WITH {_S}, {_V} SELECT {_K}, {_inline(_BOLD, 'false', _MONO)} AS md FROM v",
    "bullet_rewrite": f"""WITH {_S}, {_V}, u AS (SELECT * FROM v WHERE (substr(text, 1, 1) IN ({_BUL}) OR (unicode(text) BETWEEN 9632 AND 9727)) AND (length(text) = 1 OR substr(text, 2, 1) = ' '))
SELECT {_K}, repeat(' ', CAST(greatest(0, floor((x0 - 50.0) / (CASE WHEN x1 > x0 THEN (x1 - x0) / length(text) ELSE size / 2 END) + 0.5)) AS INTEGER)) || '- ' || replace(regexp_replace(substr(text, 2), '^ +', ''), '  ', ' ') AS md FROM u""",
    "code_indent": f"WITH {_S} SELECT {_K}, repeat(' ', CAST(greatest(0, floor((x0 - 50.0) / (size * 0.5))) AS INTEGER)) || text AS code FROM s WHERE {_MONO} AND text IS NOT NULL",
    "link_resolution": f"""WITH {_S}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY block, line, span) - 1 AS q FROM s WHERE color <> 0),
k AS (SELECT f.doc_id, f.page, q, url || '#' || q AS uri, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM f JOIN corpus_files USING (doc_id) WHERE url IS NOT NULL)
SELECT {", ".join("s." + x for x in _K.split(", "))}, '[' || {_trim("any_value(text)")} || '](' || arg_min(uri, q) || ')' AS md FROM s JOIN k ON s.doc_id = k.doc_id AND s.page = k.page AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY {", ".join("s." + x for x in _K.split(", "))}""",
    "toc_page_join": f"WITH {_TOC} SELECT doc_id, page - 1 AS page, count(*) AS n_entries, string_agg(level || ':' || title, '|' ORDER BY seq, level, title) AS entries FROM toc GROUP BY doc_id, page - 1",
    "broken_font_stats": f"""WITH {_C}, k AS (SELECT font, font_id, c, regexp_matches(c, '{_CTRL}') AS ctl, regexp_matches(c, '{_CTRL}|[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}]') AS bad FROM c WHERE c IS NOT NULL),
g AS (SELECT font, font_id, count(*) FILTER (bad) AS n_broken, count(*) AS n_chars, count(DISTINCT CASE WHEN ctl THEN c END) AS n_controls FROM k WHERE ctl OR regexp_matches(c, '{_NOT_WHITE}') GROUP BY ALL)
SELECT *, (n_broken >= 3 AND n_broken * 20 >= n_chars) OR n_controls >= 4 AS broken FROM g""",
    "page_has_text": f"WITH {_S} SELECT doc_id, page, coalesce(bool_or(regexp_matches(text, '{_NOT_WHITE}')), false) AS has_text FROM s GROUP BY ALL",
    "looks_broken": f"""WITH {_S}, k AS (SELECT {_K}, text, regexp_replace(text, '{_TRIM}', '', 'g') AS t FROM s WHERE text IS NOT NULL)
SELECT {_K}, length(t) = 0 OR regexp_matches(text, '{_ODD}') OR (length(t) >= 4 AND length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) * 2 < length(t)) AS broken FROM k""",
    "text_plausibility": rf"""WITH {_S}, k AS (SELECT {_K}, list_filter(regexp_split_to_array(text, '{_TRIM}+'), lambda t: t <> '') AS t FROM s WHERE text IS NOT NULL),
g AS (SELECT {_K}, len(t) AS n, len(list_filter(t, lambda x: regexp_matches(regexp_replace(x, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g'), '^(\p{{N}}[\p{{N}}.,:/-]*|\p{{L}}{{2,}}([-''’]\p{{L}}+)*)$'))) AS g FROM k)
SELECT {_K}, CASE WHEN n > 0 THEN (g - (n - g) * 0.5) / n ELSE 0.0 END AS score FROM g""",
    "strip_leaders": r"""SELECT DISTINCT md_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(md_string, '[.·…•_][ \t]*[.·…•_][ \t]*[.·…•_][.·…•_ \t]*', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM page_markdown WHERE md_string IS NOT NULL""",
    "markdown_sections": rf"""WITH m AS (SELECT DISTINCT md_id, md_string FROM page_markdown WHERE md_string IS NOT NULL),
p AS (SELECT md_id, md_string, list_filter(string_split(regexp_replace(md_string, '(^|[\n\r\x{{85}}\x{{2028}}\x{{2029}}])(#{{1,3}} )', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: NOT regexp_matches(x, '^{_TRIM}*$')) AS parts FROM m)
SELECT md_id, CAST(unnest(range(len(parts))) AS INTEGER) AS section, unnest(parts) AS text FROM p""",
    "page_cleanup": r"""SELECT DISTINCT md_id, replace(regexp_replace(replace(replace(replace(replace(replace(md_string, ' ' || chr(10), chr(10)), '  ', ' '), chr(10) || chr(10) || chr(10), chr(10) || chr(10)), ' ,', ','), '-' || chr(10), ''), '^\n+', ''), chr(0), chr(65533)) AS text FROM page_markdown WHERE md_string IS NOT NULL""",
    "join_cell_lines": r"""SELECT doc_id, replace(regexp_replace(regexp_replace(text, '(\p{L}-)\n(\p{L})', '\1\2', 'g'), '(\p{L}-)\n(\p{L})', '\1\2', 'g'), chr(10), ' ') AS text FROM documents WHERE text IS NOT NULL""",
    "escape_cell": "SELECT DISTINCT md_id, replace(md_string, '|', chr(92) || '|') AS text FROM page_markdown WHERE md_string IS NOT NULL AND NOT contains(md_string, chr(92)) UNION ALL SELECT DISTINCT md_id, regexp_replace(regexp_replace(md_string, '(\\\\+)(\\||$)', '\\1\\1\\2', 'g'), '\\|', '\\\\|', 'g') FROM page_markdown WHERE contains(md_string, chr(92))",
    "rect_algebra": f"""WITH {_S}, n AS (SELECT *, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1 FROM s WINDOW w AS (PARTITION BY {_L} ORDER BY span)),
m AS (SELECT *, least(x0, nx0) AS ux0, least(y0, ny0) AS uy0, greatest(x1, nx1) AS ux1, greatest(y1, ny1) AS uy1 FROM n WHERE nx0 IS NOT NULL)
SELECT {_K}, greatest(x0, nx0) AS ix0, least(x1, nx1) AS ix1, ux0, ux1, greatest(0.0, ux1 - ux0) * greatest(0.0, uy1 - uy0) AS area, sqrt(pow(greatest(0.0, x0 - nx1, nx0 - x1), 2) + pow(greatest(0.0, y0 - ny1, ny0 - y1), 2)) AS gap,
x1 <= nx0 OR nx1 <= x0 OR y1 <= ny0 OR ny1 <= y0 AS apart, x1 < nx0 OR nx1 < x0 OR y1 < ny0 OR ny1 < y0 AS apart_strict, x0 < nx1 AND nx0 < x1 AND y0 < ny1 AND ny0 < y1 AS meets, ux0 <= x0 AND x1 <= ux1 AND uy0 <= y0 AND y1 <= uy1 AS holds,
greatest(0.0, least(x1, ux1) - greatest(x0, ux0)) * greatest(0.0, least(y1, uy1) - greatest(y0, uy0)) > greatest(0.0, x1 - x0) * greatest(0.0, y1 - y0) * 0.8 AS mostly, CAST(ceil(x1) AS INTEGER) AS right FROM m""",
    "pack_color": f"WITH {_S} SELECT {_K}, CAST(color & 16777215 AS INTEGER) AS rgb, CAST((color & 255) * 65793 AS INTEGER) AS gray FROM s WHERE color IS NOT NULL",
    "page_rotation": f"""WITH {_S} SELECT {_K}, CASE doc_id % 4 WHEN 0 THEN x0 WHEN 1 THEN y0 WHEN 2 THEN 595.0 - x1 ELSE 842.0 - y1 END AS x0, CASE doc_id % 4 WHEN 0 THEN y0 WHEN 1 THEN 595.0 - x1 WHEN 2 THEN 842.0 - y1 ELSE x0 END AS y0,
CASE doc_id % 4 WHEN 0 THEN x1 WHEN 1 THEN y1 WHEN 2 THEN 595.0 - x0 ELSE 842.0 - y0 END AS x1, CASE doc_id % 4 WHEN 0 THEN y1 WHEN 1 THEN 595.0 - x0 WHEN 2 THEN 842.0 - y0 ELSE x1 END AS y1 FROM s""",
}
