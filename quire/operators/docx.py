"""Word documents, written as plain OOXML."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BULLETS = "•●○■□▪▫-*0123456789. \t"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    '<Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
)
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/></Relationships>'


def _styles() -> str:
    names = [("Title", "Title", "paragraph"), ("ListBullet", "List Bullet", "paragraph"), ("LightGridAccent1", "Light Grid Accent 1", "table")] + [(f"Heading{n}", f"heading {n}", "paragraph") for n in range(1, 10)]
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:styles {_W}>' + "".join(f'<w:style w:type="{kind}" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n, kind in names) + "</w:styles>"


def _clean(text: str) -> str:
    return escape("".join(c for c in text if c in "\t\n" or (c >= " " and not 0xD800 <= ord(c) <= 0xDFFF and c not in "\ufffe\uffff")))


def _paragraph(text: str, style: str | None = None) -> str:
    runs = "<w:br/>".join(f'<w:t xml:space="preserve">{_clean(x)}</w:t>' for x in text.split("\n"))
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r>{runs}</w:r></w:p>"


def document(elements, tables=()) -> bytes:
    """A file of (type, text, level) elements and, after a page break, (columns, cells, page_num) tables."""
    body = []
    for kind, text, level in elements:
        if kind == "title":
            body.append(_paragraph(text, "Title"))
        elif kind == "heading":
            body.append(_paragraph(text, f"Heading{min(int(level or 1), 9)}"))
        elif kind == "list_item":
            body.append(_paragraph(text.lstrip(BULLETS), "ListBullet"))
        else:
            body.append(_paragraph(text))
    if len(tables):
        body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + _paragraph("Tables", "Heading1"))
    for n, (columns, cells, page) in enumerate(tables):
        body.append(_paragraph(f"Table {n + 1} (Page {page + 1})", "Heading2"))
        rows = "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in [columns, *cells])
        body.append(f'<w:tbl><w:tblPr><w:tblStyle w:val="LightGridAccent1"/></w:tblPr>{rows}</w:tbl><w:p/>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS.format("officeDocument", "word/document.xml")), ("word/_rels/document.xml.rels", _RELS.format("styles", "styles.xml")), ("word/styles.xml", _styles()), ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document {_W}><w:body>{"".join(body)}</w:body></w:document>')):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(style, text) of the paragraphs outside tables; no style is empty."""
    name = "{" + _W.split('"')[1] + "}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    out = []
    for p in body.findall(f"{name}p"):
        style = p.find(f"{name}pPr/{name}pStyle")
        text = "".join("\n" if x.tag == f"{name}br" else x.text or "" for x in p.iter() if x.tag in (f"{name}br", f"{name}t"))
        out.append(("" if style is None else style.get(f"{name}val"), text))
    return out


def read_paragraphs(files: DataFrame) -> DataFrame:
    """(doc_id, n, style, text) of (doc_id, content)."""

    def run(batches):
        for b in batches:
            rows = [(i, n, *p) for i, content in zip(b.doc_id, b.content, strict=True) for n, p in enumerate(paragraphs(bytes(content)))]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "style", "text"])

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id {dict(files.dtypes)['doc_id']}, n int, style string, text string")


def docx(elements: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, content) of elements and (doc_id, table_idx, page_num, columns, cells) tables."""
    e = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "text", "level"))).alias("e"))
    if tables is None:
        e = e.withColumn("t", F.array().cast("array<struct<table_idx:int,columns:array<string>,cells:array<array<string>>,page_num:int>>"))
    else:
        t = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_idx", "columns", "cells", "page_num"))).alias("t"))
        e = e.join(t, "doc_id", "left")

    def run(batches):
        for b in batches:
            made = [document([(x["type"], x["text"], x["level"]) for x in es], [(x["columns"], x["cells"], x["page_num"]) for x in (ts if ts is not None else [])]) for es, ts in zip(b.e, b.t, strict=True)]
            yield pd.DataFrame({"doc_id": b.doc_id, "content": made})

    return e.mapInPandas(run, f"doc_id {dict(e.dtypes)['doc_id']}, content binary")
