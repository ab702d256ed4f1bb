"""Queries and oracle SQL of the general data problems 1 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.diff import diff_copies
from pagemill.operators.nested import flat_tables, write_tagged
from pagemill.session import table

TABLE_KEY = ("doc_id", "config", "page", "table_no")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return diff_copies(table(spark, d, "tables_run_a"), table(spark, d, "tables_run_b"), TABLE_KEY, ("n_rows", "n_columns"), "cells", latest_by="loaded_at").filter("diff_kind <> 'cells_shape'")


def p1_all_copies(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered row counts: duplicate keys are cancelled and paired, with both values."""
    return diff_copies(table(spark, d, "tables_run_a"), table(spark, d, "tables_run_b"), TABLE_KEY, ("n_rows", "n_columns"), "cells", values=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return write_tagged(table(spark, d, "page_dicts")).select("rec_id", "node_kind", "node_path")


def _p4(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = flat_tables(table(spark, d, "page_dicts"))[kind]
        if kind == "line":
            t = t.withColumns({"dir_x": F.get("dir", F.lit(0)), "dir_y": F.get("dir", F.lit(1))}).drop("dir")
        return t.drop("extra")

    run.__name__ = f"p4_{kind}s"
    return run


QUERIES = {"p1_found": p1_found, "p1_all_copies": p1_all_copies, "p4_found": p4_found, **{f"p4_{k}s": _p4(k) for k in ("block", "line", "span", "char")}}

_P1 = """
WITH a AS (SELECT DISTINCT doc_id, config, page, table_no, n_rows, n_columns, cells FROM (
    SELECT *, rank() OVER (PARTITION BY doc_id, config, page, table_no ORDER BY loaded_at DESC NULLS LAST) AS r FROM tables_run_a) WHERE r = 1),
b AS (SELECT DISTINCT doc_id, config, page, table_no, n_rows, n_columns, cells FROM (
    SELECT *, rank() OVER (PARTITION BY doc_id, config, page, table_no ORDER BY loaded_at DESC NULLS LAST) AS r FROM tables_run_b) WHERE r = 1),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.config, b.config) AS config, coalesce(a.page, b.page) AS page,
    coalesce(a.table_no, b.table_no) AS table_no, a.doc_id IS NOT NULL AS ka, b.doc_id IS NOT NULL AS kb,
    a.n_rows AS ar, b.n_rows AS br, a.n_columns AS ac, b.n_columns AS bc, a.cells AS ax, b.cells AS bx
    FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.config = b.config AND a.page = b.page AND a.table_no = b.table_no),
r AS (SELECT doc_id, config, page, table_no, ax, bx, unnest(range(1, least(len(ax), len(bx)) + 1)) AS i FROM j WHERE ka AND kb),
c AS (SELECT doc_id, config, page, table_no, i, ax[i] AS ra, bx[i] AS rb, unnest(range(1, least(len(ax[i]), len(bx[i])) + 1)) AS k FROM r)
SELECT doc_id, config, page, table_no, CASE WHEN ka THEN 'only_a' ELSE 'only_b' END AS diff_kind, CAST(-1 AS INTEGER) AS cell_row, CAST(-1 AS INTEGER) AS cell_col FROM j WHERE NOT (ka AND kb)
UNION ALL SELECT doc_id, config, page, table_no, 'n_rows', -1, -1 FROM j WHERE ka AND kb AND ar IS DISTINCT FROM br
UNION ALL SELECT doc_id, config, page, table_no, 'n_columns', -1, -1 FROM j WHERE ka AND kb AND ac IS DISTINCT FROM bc
UNION ALL SELECT doc_id, config, page, table_no, 'cell', CAST(i - 1 AS INTEGER), CAST(k - 1 AS INTEGER) FROM c WHERE ra[k] IS DISTINCT FROM rb[k]
"""


def _nodes() -> str:
    """Four levels of unnest over valid JSON; one object counts as a list of one."""

    def items(x: str) -> str:
        return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"

    parts = ["d AS (SELECT rec_id, CAST(payload AS JSON) AS j FROM page_dicts WHERE json_valid(payload))"]
    parts.append(f"l0 AS (SELECT rec_id, {items('x')} AS a FROM (SELECT rec_id, coalesce(json_extract(j, '$.blocks'), json_extract(j, '$.text_dict.blocks')) AS x FROM d))")
    prev = "l0"
    for i, (kind, child) in enumerate((("block", "lines"), ("line", "spans"), ("span", "chars"), ("char", None))):
        path = "CAST(i - 1 AS VARCHAR)" if i == 0 else "path || '/' || CAST(i - 1 AS VARCHAR)"
        parts.append(f"u{i} AS (SELECT rec_id, {'path,' if i else ''} unnest(a) AS o, unnest(range(1, len(a) + 1)) AS i FROM {prev})")
        parts.append(f"n{i} AS (SELECT rec_id, '{kind}' AS node_kind, {path} AS path, o FROM u{i} WHERE json_type(o) = 'OBJECT')")
        if child:
            parts.append(f"l{i + 1} AS (SELECT rec_id, path, {items('x')} AS a FROM (SELECT rec_id, path, json_extract(o, '$.{child}') AS x FROM n{i}))")
            prev = f"l{i + 1}"
    return "WITH " + ",\n".join(parts) + "\n"


_P4 = _nodes() + " UNION ALL ".join(f"SELECT rec_id, node_kind, path AS node_path FROM n{i}" for i in range(4))


def _num(x: str, typ: str) -> str:
    return f"TRY_CAST(TRY_CAST(json_extract_string(o, '$.{x}') AS DOUBLE) AS {typ})"


def _box() -> str:
    return ", ".join(f"TRY_CAST(CASE json_type(json_extract(o, '$.bbox')) WHEN 'ARRAY' THEN json_extract_string(o, '$.bbox[{i}]') ELSE json_extract_string(o, '$.bbox.{k}') END AS DOUBLE) AS {k}" for i, k in enumerate(("x0", "y0", "x1", "y1")))


_POSITION = "CAST(string_split(path, '/')[-1] AS INTEGER) AS position"
_PARENT = "regexp_replace(path, '/[0-9]+$', '')"

ORACLES = {
    "p1_found": _P1,
    "p4_found": _P4,
    "p4_blocks": _nodes() + f"SELECT rec_id, path AS block_path, {_POSITION}, {_num('type', 'INTEGER')} AS type, {_num('number', 'INTEGER')} AS number, TRY_CAST(json_extract_string(o, '$.isrect') AS BOOLEAN) AS isrect, {_box()} FROM n0",
    "p4_lines": _nodes()
    + f"SELECT rec_id, path AS line_path, {_PARENT} AS block_path, {_POSITION}, {_num('wmode', 'INTEGER')} AS wmode, {_num('dir[0]', 'DOUBLE')} AS dir_x, {_num('dir[1]', 'DOUBLE')} AS dir_y, {_box()} FROM n1",
    "p4_spans": _nodes()
    + f"SELECT rec_id, path AS span_path, {_PARENT} AS line_path, {_POSITION}, json_extract_string(o, '$.text') AS text, json_extract_string(o, '$.font') AS font, {_num('size', 'DOUBLE')} AS size, {_num('flags', 'INTEGER')} AS flags, {_num('color', 'INTEGER')} AS color, {_num('alpha', 'INTEGER')} AS alpha, {_box()} FROM n2",
    "p4_chars": _nodes() + f"SELECT rec_id, path AS char_path, {_PARENT} AS span_path, {_POSITION}, json_extract_string(o, '$.c') AS c, {_num('fontId', 'INTEGER')} AS \"fontId\", {_box()} FROM n3",
}
