from pdf_maker import make_pdf, text

from pagemill.api import MarkdownOptions, files_from_bytes, to_markdown, to_markdown_pages
from pagemill.operators import raster as R


class Reader:
    """Answers with the width of the ink, so that equal cells read alike."""

    def recognize(self, gray):
        return f"w{int((gray < 128).any(axis=0).sum()) // 12}", 0.8


def scanned(turn=0):
    edges = [("h", 20 + 20 * r, 20, 200, 1.0) for r in range(4)] + [("v", 20 + 60 * c, 20, 80, 1.0) for c in range(4)]
    chars = [(26 + 60 * c + 6 * k, 25 + 20 * r, 32 + 60 * c + 6 * k, 35 + 20 * r, "x") for r in range(3) for c in range(3) for k in range(c + 3)]
    g = R.render(220, 110, edges, chars, scale=3.0).turned(turn).gray
    return make_pdf([f"q {g.shape[1] / 3} 0 0 {g.shape[0] / 3} 0 0 cm /I0 Do Q"], box=(0, 0, g.shape[1] / 3, g.shape[0] / 3), images=[(g.shape[1], g.shape[0], g.tobytes())])


def test_table_in_a_scan_without_engine_and_with(spark):
    files = files_from_bytes(spark, {"s.pdf": scanned()})
    bare = to_markdown(files, MarkdownOptions(table_strategy="pixels", ocr_dpi=216)).first().text
    assert bare.count("|---|---|---|") == 1 and bare.count("||||") == 3
    read = to_markdown(files, MarkdownOptions(table_strategy="pixels", ocr_dpi=216, ocr=Reader)).first().text
    rows = [r for r in read.split("\n") if r.startswith("|w")]
    assert len(rows) == 3 and rows[0] == rows[1] == rows[2] and len(set(rows[0].strip("|").split("|"))) == 3


def test_text_layer_wins_unless_broken(spark):
    ruled = "".join(f"50 {y} m 250 {y} l S\n" for y in (600, 620, 640)) + "".join(f"{x} 600 m {x} 640 l S\n" for x in (50, 150, 250))
    page = ruled + text(60, 625, "good", 10) + text(160, 625, "\x01\x02\x03\x04", 10, 2) + text(60, 605, "fine", 10)
    rows = to_markdown_pages(files_from_bytes(spark, {"a.pdf": make_pdf([page])}), MarkdownOptions(ocr=Reader)).first()
    cells = {(c.row, c.col): c.text for c in rows.tables[0].cells}
    assert cells[0, 0] == "good" and cells[1, 0] == "fine" and cells[0, 1].startswith("w") and cells[1, 1] == ""
