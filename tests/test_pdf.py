import pytest
from pdf_maker import make_pdf, rule, text

from pagemill import sinks
from pagemill.api import MarkdownOptions, PDFMarkdownReader, extract_words, files_from_bytes, get_key_values, pages_of, to_markdown, to_markdown_pages
from pagemill.sources.pdf_parser import Document, glyph_text, read_page, widget_type

TABLE = "".join(rule(50, y, 450, y) for y in range(600, 701, 25)) + "".join(rule(x, 600, x, 700) for x in (50, 180, 310, 450))
CELLS = "".join(text(x + 5, y + 8, f"r{r}c{c}", 10) for r, y in enumerate((675, 650, 625, 600)) for c, x in enumerate((50, 180, 310)))
PAGE = text(50, 780, "Great Title", 24) + text(50, 750, "First line of the body text goes here,") + text(50, 735, "and the second line (of two).") + TABLE + CELLS + text(50, 560, "After the table comes bold", 12, 1)


def convert(spark, pdf, **kw):
    return to_markdown(files_from_bytes(spark, {"a.pdf": pdf}), MarkdownOptions(**kw)).first()


@pytest.mark.parametrize("packed", [False, True])
def test_headings_body_table(spark, packed):
    got = convert(spark, make_pdf([PAGE], packed=packed))
    assert got.error is None
    assert got.text.startswith("# Great Title\n")
    assert "First line of the body text goes here,\nand the second line (of two).\n" in got.text
    assert "|r0c0|r0c1|r0c2|\n|---|---|---|\n|r1c0|r1c1|r1c2|\n" in got.text
    assert got.text.index("|r3c2|") < got.text.index("**After the table comes bold**") and got.text.count("r2c1") == 1


def test_elements_and_options(spark):
    pdf = make_pdf([PAGE, text(50, 700, "Second page")])
    assert "|" not in convert(spark, pdf, elements=("header",)).text
    assert "**" not in convert(spark, pdf, elements=("header",)).text
    assert not convert(spark, pdf, hdr_info=False).text.startswith("#")
    assert convert(spark, pdf, pages=[1]).text.strip() == "Second page"
    assert "--- end of page=1 ---" in convert(spark, pdf, page_separators=True).text
    assert convert(spark, pdf, hdr_info=lambda s: "## " if s["size"] > 20 else "").text.startswith("## Great Title")
    for bad in ({"force_text": False}, {"table_strategy": "x"}, {"elements": ("x",)}, {"max_levels": 7}, {"margins": (1, 2, 3)}):
        with pytest.raises(ValueError):
            MarkdownOptions(**bad)


def test_chunks_links_outline_words(spark):
    pdf = make_pdf([PAGE, text(50, 700, "See the site today")], info={"Title": "A (file)".replace("(", "\\(").replace(")", "\\)"), "Author": "Nobody"}, outline=[("Great Title", 0), ("Second", 1)], links=[(1, 70, 695, 100, 715, "https://x.example/a")])
    rows = to_markdown_pages(files_from_bytes(spark, {"a.pdf": pdf}), MarkdownOptions(extract_words=True)).orderBy("page").collect()
    assert rows[0].metadata.title == "A (file)" and rows[0].metadata.page_count == 2 and rows[1].metadata.page == 2
    assert [(t.level, t.title, t.page) for t in rows[1].toc_items] == [(1, "Second", 2)]
    assert rows[0].tables[0].rows == 4 and rows[0].tables[0].columns == 3
    assert [w.text for w in rows[1].words] == ["See", "the", "site", "today"]
    assert "[See the site today](https://x.example/a)" in rows[1].text


def test_rotation_gives_upright_pages(spark):
    turned = "0 1 -1 0 595 0 cm " + text(100, 500, "Turned around")
    w = extract_words(files_from_bytes(spark, {"a.pdf": make_pdf([turned], rotate=90, box=(0, 0, 595, 842))})).orderBy("word").collect()
    assert [x.text for x in w] == ["Turned", "around"] and w[0].x1 - w[0].x0 > w[0].y1 - w[0].y0 and w[0].x0 < w[1].x0


def test_form_fields(spark):
    f = [(0, "/FT /Tx /T (name) /V (Ada) /TU (Your name)"), (0, "/FT /Btn /T (ok) /AS /Yes"), (0, "/FT /Ch /Ff 131072 /T (pick) /V (b)"), (0, "/FT /Sig /T (sig)")]
    got = get_key_values(files_from_bytes(spark, {"a.pdf": make_pdf([text(1, 1, "x")], fields=f)})).orderBy("name").collect()
    assert [(r.name, r.value, r.type) for r in got] == [("name", "Ada", "text"), ("ok", "Yes", "checkbox"), ("pick", "b", "combobox"), ("sig", "", "signature")]
    assert widget_type("Btn", 1 << 15) == "radio" and widget_type("CheckBox") == "checkbox" and widget_type("") == "unknown"


def test_bad_files_do_not_end_the_job(spark):
    good = make_pdf([text(50, 700, "fine")])
    files = files_from_bytes(spark, {"bad": b"nothing", "cut": good[: len(good) // 2], "noxref": good.replace(b"startxref", b"start----"), "good": good, "empty": b""})
    got = {r.path: r for r in to_markdown(files).collect()}
    assert got["good"].text.strip() == "fine" == got["noxref"].text.strip()
    assert got["bad"].error and got["empty"].error and len(got) == 5


def test_images(spark, tmp_path):
    pdf = make_pdf(["q 200 0 0 100 50 600 cm /I0 Do Q q 3 0 0 3 10 10 cm /I0 Do Q " + text(50, 500, "below")], images=[(4, 2, range(8))])
    got = convert(spark, pdf, embed_images=True).text
    assert got.count("![](data:image/png;base64,") == 1 and "below" in got
    convert(spark, pdf, write_images=True, image_path=str(tmp_path / "img"), filename="my doc")
    assert [p.name for p in (tmp_path / "img").iterdir()] == ["my-doc-0-0.png"]


def test_reader(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(make_pdf([text(50, 700, "one"), text(50, 700, "two")], info={"Title": "T"}))
    rows = PDFMarkdownReader().load_data(spark, str(tmp_path / "x.pdf"), {"tag": "k", "page": "no"}).collect()
    assert {r.metadata["page"] for r in rows} == {"1", "2"} and rows[0].metadata["tag"] == "k" and rows[0].metadata["total_pages"] == "2"


def test_progress_and_pages():
    import io

    out = io.StringIO()
    assert list(sinks.ProgressBar([1, 2], stream=out)) == [1, 2] and out.getvalue().rstrip().endswith("100%")
    assert pages_of(None, 2) == [0, 1] and pages_of([3, 1], 2) == [1]
    assert glyph_text("eacute") == "é" and glyph_text("uni00E9") == "é" and glyph_text("A") == "A" and glyph_text("germandbls") == "ß"


def test_edges_of_fills_and_strokes():
    p = read_page(d := Document(make_pdf(["0.5 g 100 100 200 1 re f 1 g 10 10 100 100 re f 0 g 50 50 100 60 re f 300 300 m 300.5 400 l S"])), d.pages()[0])
    kinds = sorted((e["kind"], round(e["pos"])) for e in p.edges)
    assert ("h", 742) in kinds and len([k for k in kinds if k[0] == "h"]) == 3 and len([k for k in kinds if k[0] == "v"]) == 3


def test_headings_from_the_outline_and_flattened_forms(spark):
    page = text(50, 780, "Chapter one", 12) + text(50, 760, "and its text", 12)
    pdf = make_pdf([page], outline=[("Chapter one", 0)])
    assert convert(spark, pdf, hdr_info="toc").text.startswith("# Chapter one\n")
    look = "<< /Length 46 /BBox [0 0 80 20] /Resources << /Font << /F0 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >> >> >>\nstream\nBT /F0 10 Tf 2 5 Td (typed in) Tj ET           \nendstream"
    d = Document(make_pdf([page], fields=[(0, "/FT /Tx /T (n) /AP << /N 99 0 R >>")]))
    from pagemill.sources.pdf_parser import Lexer, Stream

    d.cache[99] = Stream(Lexer(look.encode()).next(), b"BT /F0 10 Tf 2 5 Td (typed in) Tj ET")
    del d.cache[99].dict["Length"]
    p = read_page(d, d.pages()[0])
    shown = "".join(c["c"] for c in p.chars)
    assert shown.endswith("typed in") and p.chars[-1]["y0"] > 800
    assert "typed" not in "".join(c["c"] for c in read_page(d, d.pages()[0], flatten=False).chars)
