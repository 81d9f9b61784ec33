"""PDF files made of plain documents, so that decoding has something to read.

Lines, the long ones in pieces, are text strings of two-byte codes in a font with
a ToUnicode map, 40 a page. Code points beyond the basic plane, which such a
map can't name by range, become question marks.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame

from .scan import WIDEST

LINES = 40


def pieces(text: str) -> list[str]:
    return [line[k : k + WIDEST] for line in text.split("\n") for k in range(0, max(len(line), 1), WIDEST)]


def document(text: str, title: str) -> bytes:
    lines = pieces(re.sub("[\U00010000-\U0010ffff]", "?", text))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /BaseFont /Paper /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>", 4: b"<< /Type /Font /DW 500 >>"}
    cmap = b"1 beginbfrange <0000> <ffff> <0000> endbfrange"
    objects[5] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    objects[6] = b"<< /Title <%s> >>" % ("﻿" + title).encode("utf-16-be").hex().encode()
    kids = []
    for k in range(0, len(lines), LINES):
        shown = "\n".join(f"1 0 0 1 40 {800 - 18 * j} Tm <{x.encode('utf-16-be', 'replace').hex()}> Tj" for j, x in enumerate(lines[k : k + LINES]) if x)
        raw = zlib.compress(f"BT /F1 10 Tf\n{shown}\nET".encode())
        n = 7 + 2 * len(kids)
        objects[n] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(raw), raw)
        objects[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % n
        kids.append(b"%d 0 R" % (n + 1))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(kids), b" ".join(kids))
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for n, body in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % at[n] for n in sorted(objects))
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info 6 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table)
    return bytes(out)


def pdfs(documents: DataFrame) -> DataFrame:
    """(path, content): a PDF file for each document with an id and a text, named by its id."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": [f"{i}.pdf" for i in batch.doc_id], "content": [document(t, f"Document {i}") for i, t in zip(batch.doc_id, batch.text, strict=True)]})

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, "path string, content binary")
