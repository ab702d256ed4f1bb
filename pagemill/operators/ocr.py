"""Text of table cells from pixels, through a pluggable engine.

An engine is any object with ``recognize(gray) -> (text, confidence | None)`` and, if it holds
resources, ``dispose()``. A factory makes one per task when the first cell needs it. No engine
comes with the library; the caller brings one.

Which cells are read: mode ``pdf`` none, ``ocr`` all, ``auto`` those whose text layer is broken
or set in a broken font. Blank crops give empty text. What the engine gives is cleaned of
leaders and look-alike letters; an empty answer fails the cell, which then keeps its layer text
under ``auto``. An answer of the wrong type or a confidence outside 0..1 stops the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import fix_homoglyphs
from pagemill.operators.pagewise import _batch, rows_of
from pagemill.operators.raster import PAD, WHITE, Raster, crop_lines


class Engine(Protocol):
    def recognize(self, gray: np.ndarray) -> tuple[str, float | None]: ...


class OcrSetupError(RuntimeError):
    """The engine cannot be made or breaks its contract."""


@dataclass(frozen=True)
class CellText:
    text: str | None
    source: str  # pdf, ocr or failed
    confidence: float | None = None


def checked(answer) -> tuple[str, float | None]:
    """The engine's answer, or an error if it breaks the contract."""
    try:
        text, confidence = answer
    except (TypeError, ValueError):
        raise OcrSetupError("the engine must return (text, confidence)") from None
    if not isinstance(text, str):
        raise OcrSetupError("the engine's text must be a string")
    if confidence is not None and not (isinstance(confidence, int | float) and 0 <= confidence <= 1):
        raise OcrSetupError("the engine's confidence must be from 0 to 1")
    return text, None if confidence is None else float(confidence)


_LEADERS = re.compile(r"[.·…•_][ \t]*[.·…•_][ \t]*[.·…•_][.·…•_ \t]*")
_BROKEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�" + chr(0xE000) + "-" + chr(0xF8FF) + "]")


def clean(text: str) -> str:
    lines = (re.sub(r"[ \t]+", " ", x).strip(" ") for x in _LEADERS.sub(" ", text).split("\n"))
    return fix_homoglyphs("\n".join(x for x in lines if x)) or ""


def broken(text: str | None) -> bool:
    solid = re.sub(r"\s", "", text or "")
    return not solid or bool(_BROKEN.search(text)) or len(solid) >= 4 and sum(c.isalnum() for c in solid) * 2 < len(solid)


def _twice(img: np.ndarray) -> np.ndarray:
    return np.repeat(np.repeat(img, 2, axis=0), 2, axis=1)


def read_image(engine: Engine, img: np.ndarray, scale: float) -> tuple[str, float | None]:
    """Text of a crop: whole; again at twice the size if nothing came; and by lines if it shows
    more lines than were read, kept when that gives more. Confidence is that of the least sure."""
    text, sure = checked(engine.recognize(img))
    if not text.strip():
        text, sure = checked(engine.recognize(_twice(img)))
    lines = crop_lines(img, scale)
    if len(lines) > len([x for x in text.split("\n") if x.strip()]):
        parts = [checked(engine.recognize(np.pad(img[max(0, a - 2) : b + 2], PAD, constant_values=WHITE))) for a, b in lines]
        joined = "\n".join(t for t, _ in parts if t.strip())
        if len(joined.replace("\n", "")) > len(text.replace("\n", "").strip()):
            known = [c for t, c in parts if t.strip() and c is not None]
            return joined, min(known) if known else None
    return text, sure


def read_cell(engine: Engine, raster: Raster, box, layer: str | None, mode: str) -> CellText:
    img = raster.crop(box)
    if img is None:
        return CellText("", "pdf" if mode == "auto" and not (layer or "").strip() else "ocr")
    try:
        text, sure = read_image(engine, img, raster.scale)
    except OcrSetupError:
        raise
    except Exception:  # noqa: BLE001  a failed cell is reported, the others go on
        return CellText(layer if mode == "auto" else "", "failed")
    text = clean(text)
    if not text:
        return CellText(layer if mode == "auto" else "", "failed")
    return CellText(text, "ocr", sure)


def lazy_engine(factory: Callable[[], Engine]) -> Callable[[], Engine]:
    """Makes the engine on first use and keeps it."""
    made: list[Engine] = []

    def get() -> Engine:
        if not made:
            try:
                made.append(factory())
            except Exception as e:
                raise OcrSetupError(f"the engine cannot be made: {e}") from e
        return made[0]

    get.made = made
    return get


_CELL = "table_no int, row int, col int, x0 double, y0 double, x1 double, y1 double, text string"
_OUT = "doc_id bigint, page int, table_no int, row int, col int, text string, source string, confidence double"


def ocr_cells(cells: DataFrame, rasters: DataFrame, factory: Callable[[], Engine], mode: str = "auto", distrusted: DataFrame | None = None) -> DataFrame:
    """Texts of cells (doc_id, page, table_no, row, col, box, text) with their source.

    ``rasters``: doc_id, page, width, height, scale, data (gray bytes). ``distrusted``: keys of
    cells set in broken fonts. Only pages with a cell to read carry pixels to Python.
    """
    key = ["doc_id", "page", "table_no", "row", "col"]
    c = cells.filter("x0 IS NOT NULL")
    if distrusted is not None:
        c = c.join(distrusted.select(*key).distinct().withColumn("__bad", F.lit(True)), key, "left").withColumn("__bad", F.coalesce("__bad", F.lit(False)))
    else:
        c = c.withColumn("__bad", F.lit(False))
    from pagemill.functions.text import looks_broken, stray_letter

    t = F.coalesce(F.col("text"), F.lit(""))
    want = {"pdf": F.lit(False), "ocr": F.lit(True), "auto": F.col("__bad") | looks_broken(t) | stray_letter(t)}
    if mode not in want:
        raise ValueError(f"unknown text source {mode!r}")
    c = c.withColumn("__read", want[mode])
    kept = c.filter(~F.col("__read")).select(*key, "text", F.lit("pdf").alias("source"), F.lit(None).cast("double").alias("confidence"))
    if mode == "pdf":
        return kept
    grouped = c.filter("__read").groupBy("doc_id", "page").agg(F.collect_list(F.struct(*_names(_CELL))).alias("cells"))
    todo = grouped.join(rasters.select("doc_id", "page", "width", "height", "scale", "data"), ["doc_id", "page"]).select("doc_id", "page", "cells", "width", "height", "scale", "data")

    def page(doc, page, items, w, h, scale, data):
        r = Raster(np.frombuffer(data, np.uint8).reshape(h, w), scale)
        return doc, page, r, ((i["table_no"], i["row"], i["col"], (i["x0"], i["y0"], i["x1"], i["y1"]), i["text"]) for i in items)

    return kept.unionByName(read_pages(todo, page, factory, mode))


def read_pages(pages: DataFrame, page: Callable[..., tuple], factory: Callable[[], Engine], mode: str = "ocr") -> DataFrame:
    """Texts of the cells that ``page(*columns of one row)`` gives with its raster: (doc_id, page,
    raster, cells as (table_no, row, col, box, text)). One page's pixels are held at a time."""
    arrow = pa.schema([("doc_id", pa.int64()), *[(n, pa.int32()) for n in ("page", "table_no", "row", "col")], ("text", pa.string()), ("source", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = lazy_engine(factory)
        try:
            for b in batches:
                rows = []
                for row in rows_of(b, 1):
                    doc, no, raster, cells = page(*row)
                    for t, r, c, box, text in cells:
                        got = read_cell(engine(), raster, box, text, mode)
                        rows.append((doc, no, t, r, c, got.text, got.source, got.confidence))
                    if len(rows) >= 10_000:
                        yield _batch(rows, arrow)
                        rows = []
                if rows:
                    yield _batch(rows, arrow)
        finally:
            for e in engine.made:
                if hasattr(e, "dispose"):
                    e.dispose()

    return pages.mapInArrow(run, _OUT)


def _names(ddl: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in ddl.split(",")]
