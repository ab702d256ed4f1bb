import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill import sinks
from pagemill.operators import raster as R
from pagemill.operators.ocr import OcrSetupError, broken, checked, clean, lazy_engine, ocr_cells, read_cell


def ruled(scale=2.0, rows=4, cols=3, lean=0.0):
    edges = [("h", 20 + 20 * r, 20, 20 + 60 * cols, 1.0) for r in range(rows + 1)] + [("v", 20 + 60 * c, 20, 20 + 20 * rows, 1.0) for c in range(cols + 1)]
    chars = [(26 + 60 * c + 6 * k, 25 + 20 * r, 32 + 60 * c + 6 * k, 35 + 20 * r, "x") for r in range(rows) for c in range(cols) for k in range(5)]
    return R.render(240, 120, edges, chars, scale=scale)


def rotated(r, degrees):
    back = R.Raster(r.gray, r.scale)
    back.__dict__["skew"] = degrees
    return back.deskewed()


@pytest.mark.parametrize("scale", [1.5, 2.0, 4.0])
def test_grid_found_at_any_scale(scale):
    g = R.find_grids(ruled(scale))
    assert len(g) == 1 and len(g[0].cells) == 4 and len(g[0].cells[0]) == 3
    assert np.allclose(g[0].xs, [20, 80, 140, 200], atol=1)


def test_skew_is_measured_and_undone():
    bent = rotated(ruled(3.0), -1.2)
    assert abs(bent.skew - 1.2) < 0.15
    assert abs(bent.deskewed().skew) < 0.1
    assert R.Raster(np.full((50, 50), 255, np.uint8)).skew == 0.0


def test_text_rows_without_rules():
    edges = [("h", 20, 20, 200, 1.0), ("h", 110, 20, 200, 1.0)] + [("v", x, 20, 110, 1.0) for x in (20, 110, 200)]
    chars = [(30 + 6 * k, y, 36 + 6 * k, y + 10, "x") for y in (26, 48, 70, 92) for k in range(5)]
    g = R.find_grids(R.render(240, 140, edges, chars, scale=3.0))
    assert len(g) == 1 and len(g[0].cells) == 4


def test_text_is_no_rule_and_blank_is_nothing():
    prose = R.render(300, 200, chars=[(20 + 6 * k, 20 + 14 * r, 26 + 6 * k, 30 + 14 * r, "x") for r in range(10) for k in range(40)])
    assert R.rules(prose, vertical=True) == [] and R.find_grids(prose) == []
    assert R.find_grids(R.Raster(np.full((40, 40), 255, np.uint8))) == []


def test_crop_trims_rules_and_rejects_blank():
    r = ruled()
    assert r.crop((20, 20, 80, 40)) is not None and r.crop((205, 20, 235, 40)) is None and r.crop((5, 5, 5, 5)) is None
    img = r.crop((20, 20, 80, 40))
    assert (img[: R.PAD] == 255).all() and (img < 128).any()


def test_axis_and_turns():
    page = R.render(400, 300, chars=[(10 + 9 * k, 10 + 20 * r, 17 + 9 * k, 22 + 20 * r, "x") for r in range(14) for k in range(40)], scale=2.0)
    boxes = R.glyph_boxes(page)
    assert len(boxes) >= 400 and R.ink_axis(boxes) == "across" and R.scan_turn(page, False) == 0
    side = page.turned(90)
    assert R.ink_axis(R.glyph_boxes(side)) == "down" and R.scan_turn(side, False) == 90 and R.scan_turn(side, True) == 0
    assert R.ink_axis(boxes[:10]) == "unknown"
    read = lambda img: ("good" if img[0, 0] == 7 else "bad", None)
    assert R.upside_down(page, read, lambda t: -1.0) is False


def test_coordinates_and_tone():
    r = ruled()
    assert r.pixel_x(r.page_x(17)) == 17 and r.pixel_y(-5) == 0 and r.bounds[2] == 240 and R.paper_tone(r, (0, 0, 10, 10)) == 255
    assert R.crop_lines(np.pad(np.zeros((6, 40), np.uint8), ((4, 4), (4, 4)), constant_values=255), 1.0) == [(4, 10)]


def test_png_round_trip():
    import struct
    import zlib

    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    p = sinks.png(a)
    size = struct.unpack(">I", p[33:37])[0]
    assert zlib.decompress(p[41 : 41 + size]) == b"".join(b"\0" + bytes(x) for x in a) and sinks.data_uri(p).startswith("data:image/png;base64,")


class Fake:
    def __init__(self, answers=(("Text", 0.9),)):
        self.answers, self.calls = answers, 0

    def recognize(self, gray):
        self.calls += 1
        return self.answers[min(self.calls, len(self.answers)) - 1]


def test_cell_reading():
    r = ruled()
    box = (20, 20, 80, 40)
    assert read_cell(Fake(), r, box, "x", "auto") == read_cell(Fake(), r, box, None, "ocr")
    assert read_cell(Fake(), r, (205, 20, 235, 40), None, "auto").source == "pdf" and read_cell(Fake(), r, (205, 20, 235, 40), None, "ocr").source == "ocr"
    assert read_cell(Fake((("", None),)), r, box, "layer", "auto").text == "layer" and read_cell(Fake((("", None),)), r, box, "layer", "ocr").source == "failed"
    for bad in ("text", (1, 0.5), ("a", 2.0), None):
        with pytest.raises(OcrSetupError):
            checked(bad)
    with pytest.raises(OcrSetupError):
        lazy_engine(lambda: 1 / 0)()
    assert clean("Name ..... 5\n\n x") == "Name 5\nx" and broken("") and broken("") and not broken("fine")


def test_ocr_operator(spark):
    r = ruled()
    pages = spark.createDataFrame([(1, 0, r.width, r.height, r.scale, bytearray(r.gray.tobytes()))], "doc_id long, page int, width int, height int, scale double, data binary")
    cells = spark.createDataFrame([(1, 0, 0, 0, 0, 20.0, 20.0, 80.0, 40.0, "ok text"), (1, 0, 0, 0, 1, 80.0, 20.0, 140.0, 40.0, "�"), (1, 0, 0, 0, 2, None, None, None, None, None)], "doc_id long, page int, table_no int, row int, col int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(x.col): (x.text, x.source) for x in ocr_cells(cells, pages, Fake).collect()}
    assert got == {0: ("ok text", "pdf"), 1: ("Text", "ocr")}
    assert {x.source for x in ocr_cells(cells, pages, Fake, "pdf").collect()} == {"pdf"} and ocr_cells(cells, pages, Fake, "ocr").filter(F.col("source") == "ocr").count() == 2
    with pytest.raises(ValueError):
        ocr_cells(cells, pages, Fake, "maybe")


@pytest.mark.parametrize("name", ["raster_tables", "raster_rules", "raster_ocr"])
def test_pages_are_drawn_and_looked_at_in_one_step(spark, tmp_path, name):
    import datetime

    import duckdb

    import __spark_entry__ as entry

    cells = [["a", "", "b" * 30], ["c", None], None, ["d", "e", "f"]]
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(d, "default", p, n, 4, 3, cells[: 2 + n] if n else cells, t0) for d in (1, 2, None) for p in (0, None) for n in range(3)]
    rows += [(1, "default", 0, 0, 4, 3, [["old", "x"], ["y", "z"]], t0 - datetime.timedelta(1)), (3, "default", 0, 0, 0, 0, None, t0), (4, "default", 0, 0, 1, 1, [None], t0), rows[0]]
    schema = "doc_id long, config string, page int, table_no int, n_rows int, n_columns int, cells array<array<string>>, loaded_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "tables_run_a.parquet"))
    got = entry.queries()[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "data#" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1
    out = [tuple(r) for r in got.collect()]
    if name in entry.oracle_sql():
        con = duckdb.connect()
        con.sql(f"CREATE VIEW tables_run_a AS FROM '{tmp_path}/tables_run_a.parquet/*.parquet'")
        assert sorted(out, key=repr) == sorted(con.sql(entry.oracle_sql()[name]).fetchall(), key=repr)
    assert {(r[0], r[1]) for r in out} == {(d, p) for d in (1, 2, None) for p in (0, None)}


def test_rows_of_a_batch_come_few_at_once():
    import pyarrow as pa

    from pagemill.operators.pagewise import rows_of

    b = pa.RecordBatch.from_pydict({"a": list(range(10)), "b": [[x] for x in range(10)]})
    assert list(rows_of(b, 3)) == [(x, [x]) for x in range(10)] and list(rows_of(b.slice(0, 0))) == []
