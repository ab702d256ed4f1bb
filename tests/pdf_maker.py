"""Small PDF files for tests, made from text and path operators."""

import zlib


def make_pdf(pages, fonts=("Helvetica", "Helvetica-Bold", "Courier"), info=None, outline=(), links=(), fields=(), rotate=0, box=(0, 0, 595, 842), packed=False, images=()):
    objs: list[bytes] = []

    def add(body) -> int:
        objs.append(body if isinstance(body, bytes) else body.encode("latin-1"))
        return len(objs)

    def stream(data: bytes, extra="") -> int:
        z = zlib.compress(data)
        return add(f"<< /Length {len(z)} /Filter /FlateDecode {extra} >>\nstream\n".encode() + z + b"\nendstream")

    catalog, tree = add(""), add("")
    font = " ".join(f"/F{i} {add(f'<< /Type /Font /Subtype /Type1 /BaseFont /{n} /Encoding /WinAnsiEncoding >>')} 0 R" for i, n in enumerate(fonts))
    pics = " ".join(f"/I{k} {stream(bytes(p), f'/Type /XObject /Subtype /Image /Width {w} /Height {h} /BitsPerComponent 8 /ColorSpace /DeviceGray')} 0 R" for k, (w, h, p) in enumerate(images))
    kids = []
    for k, content in enumerate(pages):
        c = stream(content.encode("cp1252"))
        annots = [add(f"<< /Type /Annot /Subtype /Link /Rect [{x0} {y0} {x1} {y1}] /A << /S /URI /URI ({uri}) >> >>") for p, x0, y0, x1, y1, uri in links if p == k]
        annots += [add(f"<< /Type /Annot /Subtype /Widget /Rect [10 10 90 30] {f} >>") for p, f in fields if p == k]
        kids.append(add(f"<< /Type /Page /Parent {tree} 0 R /Contents {c} 0 R /Annots [{' '.join(f'{a} 0 R' for a in annots)}] /Rotate {rotate} >>"))
    objs[tree - 1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} /MediaBox [{' '.join(map(str, box))}] /Resources << /Font << {font} >> /XObject << {pics} >> >> >>".encode()
    extra = ""
    if outline:
        root = add("")
        items = [add("") for _ in outline]
        for i, (title, page) in enumerate(outline):
            nxt = f"/Next {items[i + 1]} 0 R" if i + 1 < len(items) else ""
            objs[items[i] - 1] = f"<< /Title ({title}) /Parent {root} 0 R /Dest [{kids[page]} 0 R /Fit] {nxt} >>".encode("latin-1")
        objs[root - 1] = f"<< /First {items[0]} 0 R /Last {items[-1]} 0 R /Count {len(items)} >>".encode()
        extra = f"/Outlines {root} 0 R"
    objs[catalog - 1] = f"<< /Type /Catalog /Pages {tree} 0 R {extra} >>".encode()
    inf = f"/Info {add('<< ' + ' '.join(f'/{k} ({v})' for k, v in info.items()) + ' >>')} 0 R" if info else ""
    out, at = bytearray(b"%PDF-1.5\n"), {}
    plain = [i for i, o in enumerate(objs, 1) if not packed or b"stream" in o]
    for i in plain:
        at[i] = len(out)
        out += f"{i} 0 obj\n".encode() + objs[i - 1] + b"\nendobj\n"
    if not packed:
        x = len(out)
        out += f"xref\n0 {len(objs) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{at[i]:010d} 00000 n \n".encode() for i in range(1, len(objs) + 1))
        out += f"trailer\n<< /Size {len(objs) + 1} /Root {catalog} 0 R {inf} >>\nstartxref\n{x}\n%%EOF".encode()
        return bytes(out)
    inside = [i for i in range(1, len(objs) + 1) if i not in at]
    heads, body = [], b""
    for i in inside:
        heads.append(f"{i} {len(body)}")
        body += objs[i - 1] + b"\n"
    head = (" ".join(heads) + "\n").encode()
    z, num = zlib.compress(head + body), len(objs) + 1
    at[num] = len(out)
    out += f"{num} 0 obj\n<< /Type /ObjStm /N {len(inside)} /First {len(head)} /Length {len(z)} /Filter /FlateDecode >>\nstream\n".encode() + z + b"\nendstream\nendobj\n"
    x, rows = len(out), [b"\x00" + b"\x00" * 5]
    for i in range(1, num + 1):
        rows.append(b"\x01" + at[i].to_bytes(4) + b"\x00" if i in at else b"\x02" + num.to_bytes(4) + bytes([inside.index(i)]))
    rows.append(b"\x01" + x.to_bytes(4) + b"\x00")
    pred = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, p, strict=True)) for r, p in zip(rows, [bytes(6), *rows], strict=False))
    z = zlib.compress(pred)
    out += f"{num + 1} 0 obj\n<< /Type /XRef /Size {num + 2} /W [1 4 1] /Root {catalog} 0 R {inf} /Length {len(z)} /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> >>\nstream\n".encode() + z + f"\nendstream\nendobj\nstartxref\n{x}\n%%EOF".encode()
    return bytes(out)


def text(x, y, s, size=12, font=0):
    s = s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    return f"BT /F{font} {size} Tf {x} {y} Td ({s}) Tj ET\n"


def rule(x0, y0, x1, y1):
    return f"{x0} {y0} m {x1} {y1} l S\n"
