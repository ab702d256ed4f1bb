"""Conversions of PDF files: Markdown by document, records by page, form fields, words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import sinks
from pagemill.operators import pages as P
from pagemill.operators import raster as R
from pagemill.operators import table_kernel as TK
from pagemill.operators import textflow as L
from pagemill.operators.ocr import lazy_engine, ocr_cells
from pagemill.operators.pagewise import fold, gathered
from pagemill.operators.tables import dedupe_images, explicit_cells, find_tables
from pagemill.options import MarkdownOptions
from pagemill.session import cut
from pagemill.sources import pdf as S


def files_from_bytes(spark: SparkSession, named: dict[str, bytes]) -> DataFrame:
    """A (path, content) frame of files held in memory."""
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "path string, content binary")


class Conversion:
    """The relations of some files under one set of options; each is built when asked for."""

    def __init__(self, files: DataFrame, options: MarkdownOptions | None = None):
        self.options = options or MarkdownOptions()
        # headings look at all pages of a file, so the page choice comes after the scan
        self.scan = cut(S.scan(files.select("path", "content"), None, self.options.remove_rotation))
        self.chars = S.relation(self.scan, "chars")
        self.spans = L.build_spans(self.chars)
        self.links = S.relation(self.scan, "links")
        self.toc = S.outline_of(self.scan)
        self.errors = S.errors_of(self.scan)

    @property
    def words(self) -> DataFrame:
        return L.extract_words(self.chars)

    @property
    def cells(self) -> DataFrame | None:
        o = self.options
        if not o.tables:
            return None
        words = L.word_boxes(self.chars)
        if o.table_strategy == "pixels":
            return self._read(self._pixel_cells(words))
        if o.explicit_table_grids:
            grids = self.scan.sparkSession.createDataFrame([(list(map(float, g["h_lines"])), list(map(float, g["v_lines"])), g.get("page")) for g in o.explicit_table_grids], "h_lines array<double>, v_lines array<double>, at int")
            placed = self.scan.filter("error IS NULL").select("doc_id", "page").join(F.broadcast(grids), F.col("at").isNull() | (F.col("at") == F.col("page")))
            c = explicit_cells(placed)
            inside = (F.col("wx") >= F.col("x0")) & (F.col("wx") < F.col("x1")) & (F.col("wy") >= F.col("y0")) & (F.col("wy") < F.col("y1"))
            w = words.select(F.col("doc_id").alias("wd"), F.col("page").alias("wp"), ((F.col("x0") + F.col("x1")) / 2).alias("wx"), ((F.col("y0") + F.col("y1")) / 2).alias("wy"), F.col("text").alias("wt"))
            met = c.join(w, (F.col("doc_id") == F.col("wd")) & (F.col("page") == F.col("wp")) & inside, "left")
            return met.groupBy("doc_id", "page", F.lit(0).alias("table_no"), "row", "col", "x0", "y0", "x1", "y1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wy", "wx", "wt"))), lambda s: s["wt"]), " ").alias("text"))
        if o.table_strategy == "text":
            return self._read(find_tables(None, words, "text"))
        return self._read(find_tables(self._clipped(S.relation(self.scan, "edges")), words, "lines" if o.table_strategy == "lines" else "lines_strict"))

    @property
    def rasters(self) -> DataFrame:
        """Gray pixels of each page at ``ocr_dpi``: its images, strokes and characters drawn, straightened,
        and a page without text turned upright where its ink runs down."""
        scale, turn = self.options.ocr_dpi / 72, self.options.detect_orientation
        factory = self.options.ocr

        def draw(doc, page, width, height, chars, edges, images):
            pics = [((i["x0"], i["y0"], i["x1"], i["y1"]), sinks.pixels(i["data"], i["width"], i["height"], i["codec"])) for i in images or ()]
            r = R.render(width, height, [(e["kind"], e["pos"], e["lo"], e["hi"], e["width"]) for e in edges or ()], [(c["x0"], c["y0"], c["x1"], c["y1"], c["c"]) for c in chars or ()], pics, scale)
            quarter = R.scan_turn(r, any(not c["c"].isspace() for c in chars or ())) if turn else 0
            if quarter:
                r = r.turned(quarter)
                if factory and R.upside_down(r, lazy_engine(factory)().recognize, lambda t: sum(ch.isalnum() for ch in t) - 0.5 * sum(not ch.isalnum() and not ch.isspace() for ch in t)):
                    r = r.turned(180)
            elif not chars:
                r = r.deskewed(r.lean)
            yield doc, page, r.width, r.height, scale, quarter, r.gray.tobytes()

        src = self.scan.filter("error IS NULL").select("doc_id", "page", "width", "height", "chars", "edges", "images")
        return fold(src, draw, "doc_id bigint, page int, width int, height int, scale double, turned int, data binary")

    def _pixel_cells(self, words: DataFrame) -> DataFrame:
        w = gathered(words, ["doc_id", "page"], ["x0", "y0", "x1", "y1", "text"], "words")

        def find(doc, page, width, height, scale, data, words):
            grids = R.find_grids(R.Raster(np.frombuffer(data, np.uint8).reshape(height, width), scale))
            for t, g in enumerate(grids):
                texts = TK.cell_texts(g, [(i["x0"], i["y0"], i["x1"], i["y1"], i["text"]) for i in words or ()])
                for r, row in enumerate(g.cells):
                    for c, box in enumerate(row):
                        yield (doc, page, t, r, c, *(box or (None,) * 4), texts[r][c])

        pages = self.rasters.select("doc_id", "page", "width", "height", "scale", "data").join(w, ["doc_id", "page"], "left").select("doc_id", "page", "width", "height", "scale", "data", "words")
        return fold(pages, find, "doc_id bigint, page int, table_no int, row int, col int, x0 double, y0 double, x1 double, y1 double, text string")

    def _read(self, cells: DataFrame) -> DataFrame:
        """Cells with the engine's text where the text source asks for it and an engine is given."""
        o = self.options
        if o.ocr is None or o.text_source == "pdf":
            return cells
        cells = cut(cells)
        key = ["doc_id", "page", "table_no", "row", "col"]
        distrusted = None
        if o.text_source == "auto":
            bad = L.broken_fonts(self.chars.withColumn("font", F.concat("doc_id", F.lit(":"), "font"))).filter("broken").select(F.col("font").alias("__f"), F.col("font_id").alias("__i"))
            ch = self.chars.withColumn("font", F.concat("doc_id", F.lit(":"), "font")).join(bad, (F.col("font") == F.col("__f")) & F.col("font_id").eqNullSafe(F.col("__i")), "left_semi")
            held = cells.filter("x0 IS NOT NULL").select(*[F.col(k).alias(f"k_{k}") for k in key], *[F.col(c).alias(f"k_{c}") for c in ("x0", "y0", "x1", "y1")])
            cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
            inside = (F.col("doc_id") == F.col("k_doc_id")) & (F.col("page") == F.col("k_page")) & (cx >= F.col("k_x0")) & (cx < F.col("k_x1")) & (cy >= F.col("k_y0")) & (cy < F.col("k_y1"))
            distrusted = ch.join(held, inside).select(*[F.col(f"k_{k}").alias(k) for k in key])
        read = ocr_cells(cells, self.rasters, o.ocr, o.text_source, distrusted).select(*key, F.col("text").alias("__t"))
        return cells.join(read, key, "left").withColumn("text", F.coalesce("__t", "text")).drop("__t")

    def _clipped(self, edges: DataFrame) -> DataFrame:
        left, top, right, bottom = self.options.margin_box
        if not any((left, top, right, bottom)):
            return edges
        g = self.scan.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.col("width").alias("__w"), F.col("height").alias("__h"))
        inside = F.when(F.col("kind") == "h", (F.col("pos") >= top) & (F.col("pos") <= F.col("__h") - bottom)).otherwise((F.col("pos") >= left) & (F.col("pos") <= F.col("__w") - right))
        return edges.join(g, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p"))).filter(inside).drop("__d", "__p", "__w", "__h")

    @property
    def images(self) -> DataFrame | None:
        """Images by area, with a reference when they are to be embedded or written."""
        o = self.options
        if not o.has("image") or not (o.embed_images or o.write_images):
            return None
        limit = o.image_size_limit
        i = S.relation(self.scan, "images")
        g = self.scan.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.col("width").alias("pw"), F.col("height").alias("ph"))
        i = i.join(g, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p"))).filter((F.col("x1") - F.col("x0") >= F.col("pw") * limit) & (F.col("y1") - F.col("y0") >= F.col("ph") * limit))
        i = dedupe_images(i.withColumnRenamed("number", "seq"), ["doc_id", "page"], "seq")
        base, folder, embed = o.filename, o.image_path, o.embed_images

        def refer(doc, page, number, x0, y0, x1, y1, width, height, codec, data):
            a = sinks.pixels(data, width, height, codec)
            made = sinks.png(a) if a is not None else data if codec == "DCTDecode" else None
            kind = "png" if a is not None else "jpeg"
            name = sinks.image_name(base, page, number, "png" if kind == "png" else "jpg")
            ref = (sinks.data_uri(made, kind) if embed else f"{folder.rstrip('/')}/{name}" if folder else name) if made else ""
            yield doc, page, number, x0, y0, x1, y1, ref, made

        cols = ["doc_id", "page", "number", "x0", "y0", "x1", "y1", "width", "height", "codec", "data"]
        return fold(i.select(*cols), refer, "doc_id bigint, page int, number int, x0 double, y0 double, x1 double, y1 double, ref string, bytes binary")

    def write_images(self) -> int:
        """Write the referred images under ``image_path``; the number written."""
        done = self.images
        if done is None or self.options.embed_images:
            return 0

        def put(rows):
            import os

            for r in rows:
                if r.ref and r.bytes:
                    os.makedirs(os.path.dirname(r.ref) or ".", exist_ok=True)
                    with open(r.ref, "wb") as f:
                        f.write(r.bytes)

        done = cut(done)
        done.foreachPartition(put)
        return done.filter("ref <> ''").count()

    def pages(self) -> DataFrame:
        o = self.options
        got = P.page_markdown(self.spans, o, self.cells, self.links, self.images, self.toc)
        want = self.scan.filter("error IS NULL").select("doc_id", "page")
        if o.pages is not None:
            want = want.filter(F.col("page").isin(list(o.pages)))
        return want.join(got, ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def to_markdown(files: DataFrame, options: MarkdownOptions | None = None) -> DataFrame:
    """(doc_id, path, text, error): one Markdown text per file of (path, content)."""
    c = Conversion(files, options)
    paths = c.scan.groupBy("doc_id").agg(F.first("path").alias("path"), F.min(F.when(F.col("page").isNull(), F.col("error"))).alias("error"))
    if c.options.write_images:
        c.write_images()
    return paths.join(P.join_pages(c.pages()), "doc_id", "left").select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"), "error")


def to_markdown_pages(files: DataFrame, options: MarkdownOptions | None = None) -> DataFrame:
    """One record per page: metadata, toc_items, tables, images, text and, if asked for, words."""
    c = Conversion(files, options)
    images = c.images
    return P.page_chunks(c.pages(), c.spans, c.toc, c.cells, images, c.words if c.options.extract_words else None, S.metadata_of(c.scan))


def get_key_values(files: DataFrame) -> DataFrame:
    """Form fields of the files: doc_id, page, name, label, value, type, box."""
    return S.relation(S.scan(files.select("path", "content")), "fields")


def extract_words(files: DataFrame) -> DataFrame:
    """Words with boxes of the files."""
    return L.extract_words(S.relation(S.scan(files.select("path", "content")), "chars"))


class PDFMarkdownReader:
    """Records (text, metadata) by page for retrieval frameworks.

    ``meta_filter`` maps the metadata column (a map) to another one.
    """

    def __init__(self, meta_filter: Callable | None = None):
        self.meta_filter = meta_filter

    def load_data(self, spark: SparkSession, path: str, extra_info: dict[str, str] | None = None, options: MarkdownOptions | None = None) -> DataFrame:
        c = Conversion(spark.read.format("binaryFile").load(path), options)
        info = S.metadata_of(c.scan)
        total = c.scan.filter("error IS NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"))
        rows = c.pages().join(info, "doc_id").join(total, "doc_id")
        names = ("title", "author", "subject", "keywords", "creator", "producer", "creation_date", "mod_date", "file_path")
        own = [x for n in names for x in (F.lit(n), F.col(n))] + [F.lit("page"), (F.col("page") + 1).cast("string"), F.lit("total_pages"), F.col("total_pages").cast("string")]
        own_map = F.create_map(*own)
        if extra_info:
            extra = {k: v for k, v in extra_info.items() if k not in (*names, "page", "total_pages")}
            if extra:
                own_map = F.map_concat(F.create_map(*[F.lit(x) for kv in extra.items() for x in kv]), own_map)
        meta = self.meta_filter(own_map) if self.meta_filter else own_map
        return rows.select("text", meta.alias("metadata"))


def pages_of(numbers: Sequence[int] | None, count: int) -> list[int]:
    """0-based page choice, all by default, in the order given; numbers outside are left out."""
    return list(range(count)) if numbers is None else [n for n in numbers if 0 <= n < count]
