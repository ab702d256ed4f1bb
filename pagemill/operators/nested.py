"""Deeply nested JSON records to related flat tables.

``flatten_records`` visits each payload depth first, once, and emits a tagged row for every
object in the nested lists ``blocks`` > ``lines`` > ``spans`` > ``chars``: table tag, primary
key (the path of positions), parent key and the object's own fields as payload.
``write_tagged`` writes the rows partitioned by tag; ``apply_schema`` makes the typed table of a
tag, ``flat_tables`` all four from one write.

Defined results for unusual input:

* a payload that is null, empty, cut short, followed by more text or otherwise not complete
  strict JSON (also with ``NaN``), or nested deeper than Python's parser goes: no nodes;
* ``null`` or any other non-object in a list: keeps its position, is no node;
* one object in place of a list: a list of one; an absent, null or empty list: no nodes;
* an envelope, however deep: the first object inside, depth first, that holds ``blocks`` is
  the record; further ones beside it have no nodes, as paths begin at a block and would clash;
* boxes as ``[x0,y0,x1,y1]`` or ``{"x0":..}``, numbers as strings: brought to one form; what
  does not fit a column's type becomes null there; it and fields without a column are in
  ``extra`` as JSON;
* lone surrogates in escapes: U+FFFD; repeated payloads: repeated rows, one set a ``rec_id``;
* further input columns, whatever their names: ignored.

Scale: a narrow map over the input; memory is one payload plus one output batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import shared_dir

#: kind, the field that holds its list
LEVELS = (("block", "blocks"), ("line", "lines"), ("span", "spans"), ("char", "chars"))
BATCH_ROWS = 20_000

BOX = "x0 double, y0 double, x1 double, y1 double"
SCHEMAS = {
    "block": f"type int, number int, isrect boolean, {BOX}",
    "line": f"wmode int, dir array<double>, {BOX}",
    "span": f"text string, font string, size double, flags int, color int, alpha int, {BOX}",
    "char": f"c string, fontId int, {BOX}",
}
TAGGED = "rec_id long, node_kind string, node_path string, parent_path string, payload string, extra string"
_TYPES = {kind: {n: t for n, t in (f.strip().split(" ") for f in ddl.split(", "))} for kind, ddl in SCHEMAS.items()}
_CHILD = {kind: name for (kind, _), (_, name) in zip(LEVELS, LEVELS[1:], strict=False)}
_CORNERS = ("x0", "y0", "x1", "y1")


def _no_constant(name: str):
    raise ValueError(name)


def parse_record(payload: str | None):
    """The parsed payload, or None when it is not complete strict JSON."""
    if not payload:
        return None
    try:
        return json.loads(payload, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def find_record(doc) -> dict | None:
    """The object that holds ``blocks``: the document itself or the first inside an envelope."""
    stack = [doc]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if "blocks" in v:
                return v
            v = list(v.values())
        if isinstance(v, list):
            stack += [x for x in reversed(v) if isinstance(x, dict | list)]
    return None


def visit(record: dict) -> Iterator[tuple[str, str, str | None, dict]]:
    """Depth-first (kind, path, parent path, object) of every node."""

    def walk(holder: dict, level: int, prefix: str):
        kind, name = LEVELS[level]
        items = holder.get(name)
        if isinstance(items, dict):
            items = (items,)
        elif not isinstance(items, list):
            return
        for i, node in enumerate(items):
            if isinstance(node, dict):
                path = f"{prefix}/{i}" if prefix else str(i)
                yield kind, path, prefix or None, node
                if level + 1 < len(LEVELS):
                    yield from walk(node, level + 1, path)

    yield from walk(record, 0, "")


def _clean(s: str) -> str:
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in s) else s


def _fits(v, typ: str) -> bool:
    """Whether a value can stand in a column of the type; null and any text can."""
    if v is None or typ == "string":
        return True
    if typ == "boolean":
        return isinstance(v, bool) or (isinstance(v, str) and v.strip().lower() in ("true", "false"))
    if typ.startswith("array"):
        return isinstance(v, list) and all(_fits(x, "double") for x in v)
    if isinstance(v, bool) or not isinstance(v, int | float | str):
        return False
    try:
        x = float(v)
    except (ValueError, OverflowError):
        return False
    return typ != "int" or abs(x) < 2**31


def _text(own: dict) -> str:
    text = json.dumps(own)
    return _clean(json.dumps(own, ensure_ascii=False)) if "\\ud" in text else text


def _own(kind: str, node: dict) -> tuple[str, str | None]:
    """The node's own fields as JSON, the child list left out and the box in one form, and what
    of it no column of its table takes."""
    child, types = _CHILD.get(kind), _TYPES[kind]
    own = {k: v for k, v in node.items() if k not in (child, "bbox")}
    box = node.get("bbox")
    if isinstance(box, list) and len(box) == 4:
        own |= dict(zip(_CORNERS, box, strict=True))
    elif isinstance(box, dict) and not box.keys() - set(_CORNERS):
        own |= box
    elif box is not None:
        own["bbox"] = box
        if isinstance(box, list | dict):  # what there is of the corners
            own |= dict(zip(_CORNERS, box, strict=False)) if isinstance(box, list) else {k: box[k] for k in _CORNERS if k in box}
    extra = {k: v for k, v in own.items() if k not in types or not _fits(v, types[k])}
    return _text(own), _text(extra) if extra else None


_ARROW = pa.schema([("rec_id", pa.int64()), *[(n, pa.string()) for n in ("node_kind", "node_path", "parent_path", "payload", "extra")]])


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    for batch in batches:
        for rec_id, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            record = find_record(parse_record(payload.as_py()))
            if record is None:
                continue
            for kind, path, parent, node in visit(record):
                rows.append((rec_id, kind, path, parent, *_own(kind, node)))
                if len(rows) >= BATCH_ROWS:
                    yield flush()
                    rows.clear()
    if rows:
        yield flush()


def flatten_records(df: DataFrame, id_col: str = "rec_id", payload_col: str = "payload") -> DataFrame:
    """Tagged rows of all nodes: rec_id, node_kind, node_path, parent_path (null for blocks),
    payload (the node's own fields as JSON) and extra (what no column of its table takes)."""
    return df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(payload_col).cast("string").alias("payload")).mapInArrow(_tagged, TAGGED)


def apply_schema(tagged: DataFrame, kind: str) -> DataFrame:
    """The flat table of one tag: rec_id, its key, its parent's key and typed columns."""
    fields = [f.strip().split(" ") for f in SCHEMAS[kind].split(", ")]
    rows = tagged.filter(F.col("node_kind") == kind)
    cols = []
    for name, typ in fields:
        raw = F.get_json_object("payload", f"$.{name}")
        if typ.startswith("array"):
            col = F.from_json(raw, typ)
        elif typ == "string":
            col = raw
        elif typ == "int":
            col = raw.try_cast("double").try_cast("int")
        else:
            col = raw.try_cast(typ)
        cols.append(col.alias(name))
    parent = {"block": [], "line": [F.col("parent_path").alias("block_path")], "span": [F.col("parent_path").alias("line_path")], "char": [F.col("parent_path").alias("span_path")]}[kind]
    return rows.select("rec_id", F.col("node_path").alias(f"{kind}_path"), *parent, F.element_at(F.split("node_path", "/"), -1).cast("int").alias("position"), *cols, "extra")


def write_tagged(df: DataFrame, id_col: str = "rec_id", payload_col: str = "payload", path: str | None = None) -> DataFrame:
    """One pass over the payloads: the tagged rows written partitioned by tag, and read back.
    ``path`` defaults to the shared checkpoint folder."""
    import uuid

    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/flat-{uuid.uuid4().hex}"
    flatten_records(df, id_col, payload_col).write.mode("overwrite").partitionBy("node_kind").parquet(path)
    return spark.read.schema(TAGGED).parquet(path)


def flat_tables(df: DataFrame, id_col: str = "rec_id", payload_col: str = "payload", path: str | None = None) -> dict[str, DataFrame]:
    """The four typed tables, each read from its partition of one write."""
    tagged = write_tagged(df, id_col, payload_col, path)
    return {kind: apply_schema(tagged, kind) for kind, _ in LEVELS}
