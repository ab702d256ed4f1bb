"""PDF files as relations: characters, strokes, images, links, form fields, outline, metadata.

``scan`` turns binary files (``spark.read.format("binaryFile")``) into one row per page; the
relations are projections of it, so what a query does not use is pruned before it leaves the
scan's output. A file that cannot be read gives one row with its error instead of failing the
job; so does a page. Files are parsed one at a time in a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagemill.sources import pdf_parser as R

_BOX = "x0:double,y0:double,x1:double,y1:double"
CHAR = f"block:int,line:int,seq:int,c:string,{_BOX},ox:double,oy:double,font:string,font_id:int,size:double,color:int,flags:int,char_flags:int,dir_x:double,dir_y:double"
SCHEMA = f"""doc_id bigint, path string, page int, error string, width double, height double, rotation int,
metadata map<string,string>, toc array<struct<seq:int,level:int,title:string,page:int>>, chars array<struct<{CHAR}>>,
edges array<struct<kind:string,pos:double,lo:double,hi:double,width:double>>, links array<struct<link_seq:int,uri:string,{_BOX}>>,
fields array<struct<name:string,label:string,value:string,type:string,{_BOX}>>, images array<struct<number:int,{_BOX},width:int,height:int,codec:string,data:binary>>"""


def segment(chars: list[dict]) -> list[dict]:
    """Characters with block, line and seq, spaces put in at gaps.

    Characters of one direction whose baselines differ by a fifth of the size at most form a
    line; a gap over the size breaks it unless a space bridges it; a gap over a fifth of the size
    is a space. A new block begins at a step over one and a half line heights, sideways, or
    where the size changes.
    """
    lines: list[list[dict]] = []
    for ch in chars:
        last = lines[-1][-1] if lines else None
        if last is not None:
            em = max(ch["size"], last["size"], 1e-6)
            dx, dy = ch["ox"] - last["ox"], ch["oy"] - last["oy"]
            along, across = dx * ch["dir_x"] + dy * ch["dir_y"], dy * ch["dir_x"] - dx * ch["dir_y"]
            width = last["x1"] - last["x0"] if abs(ch["dir_x"]) >= abs(ch["dir_y"]) else last["y1"] - last["y0"]
            gap = along - width
            same = abs(ch["dir_x"] - last["dir_x"]) < 0.05 and abs(ch["dir_y"] - last["dir_y"]) < 0.05 and abs(across) <= 0.2 * em
            if same and -em < gap <= em:
                if gap > 0.2 * em and not ch["c"].isspace() and not last["c"].isspace():
                    lines[-1].append(last | {"c": " ", "x0": min(last["x1"], ch["x0"]), "x1": max(last["x1"], ch["x0"])})
                lines[-1].append(ch)
                continue
        lines.append([ch])
    out, block, number, before = [], -1, 0, None
    for ln in lines:
        y0, y1, x0, x1, size = min(c["y0"] for c in ln), max(c["y1"] for c in ln), min(c["x0"] for c in ln), max(c["x1"] for c in ln), median(c["size"] for c in ln)
        if before is not None and abs(size - before[4]) < 0.5 and -0.5 * (y1 - y0) <= y0 - before[0] <= 1.5 * max(y1 - y0, before[1] - before[0]) and x0 <= before[3] + size and x1 >= before[2] - size:
            number += 1
        else:
            block, number = block + 1, 0
        before = (y0, y1, x0, x1, size)
        out += [c | {"block": block, "line": number, "seq": k} for k, c in enumerate(ln)]
    return out


def read_file(doc_id: int, path: str, content: bytes, pages: Sequence[int] | None = None, remove_rotation: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA for one file."""
    none = (None,) * 10
    try:
        doc = R.Document(content)
        dicts = doc.pages()
        if not dicts:
            raise R.PdfError("no pages")
        meta = R.metadata(doc, path, len(dicts))
        toc = [{"seq": k, "level": lv, "title": t, "page": p} for k, (lv, t, p) in enumerate(R.outline(doc, dicts))]
    except Exception as e:  # noqa: BLE001  one bad file must not end the job
        yield (doc_id, path, None, f"{type(e).__name__}: {e}", *none)
        return
    for k, d in enumerate(dicts) if pages is None else [(k, dicts[k]) for k in pages if 0 <= k < len(dicts)]:
        try:
            p = R.read_page(doc, d, remove_rotation)
        except Exception as e:  # noqa: BLE001
            yield (doc_id, path, k, f"{type(e).__name__}: {e}", *none)
            continue
        yield doc_id, path, k, None, p.width, p.height, p.rotation, list(meta.items()), toc, segment(p.chars), p.edges, p.links, p.fields, p.images


def scan(files: DataFrame, pages: Sequence[int] | None = None, remove_rotation: bool = True) -> DataFrame:
    """One row per page of each file of (path, content); ``doc_id`` is a hash of the path."""
    struct = T._parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path, content in zip(*(c for c in b.columns), strict=True):
                for row in read_file(i.as_py(), path.as_py(), content.as_py() or b"", pages, remove_rotation):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow.types, strict=True)], schema=arrow)

    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content").mapInArrow(run, struct)


def read_pdfs(spark: SparkSession, path: str, **options) -> DataFrame:
    return scan(spark.read.format("binaryFile").load(path).select("path", "content"), **options)


def relation(pages: DataFrame, name: str) -> DataFrame:
    """One of chars, edges, images, links, fields as a flat relation keyed by (doc_id, page)."""
    return pages.filter("error IS NULL").select("doc_id", "page", F.explode(name).alias("__r")).select("doc_id", "page", "__r.*")


def outline_of(pages: DataFrame) -> DataFrame:
    one = pages.filter("error IS NULL").groupBy("doc_id").agg(F.min_by("toc", "page").alias("toc"))
    return one.select("doc_id", F.explode("toc").alias("__t")).select("doc_id", "__t.*")


def metadata_of(pages: DataFrame) -> DataFrame:
    one = pages.filter("error IS NULL").groupBy("doc_id").agg(F.min_by("metadata", "page").alias("m"))
    names = ("format", "title", "author", "subject", "keywords", "creator", "producer", "creation_date", "mod_date", "encryption", "file_path")
    return one.select("doc_id", *[F.coalesce(F.col("m")[n], F.lit("")).alias(n) for n in names])


def errors_of(pages: DataFrame) -> DataFrame:
    return pages.filter("error IS NOT NULL").select("doc_id", "path", "page", "error")
