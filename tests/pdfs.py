"""Small PDF files for tests."""

import zlib


def pdf(pages, info=None, images=(), packed=False, predictor=False) -> bytes:
    """``pages``: lists of (x, y from the bottom, size, font, text); fonts F1 regular, F2 bold, F3 with a ToUnicode map of two-byte codes."""
    objects = {}
    kids = []
    n = 10
    for spans in pages:
        parts = ["q BT"]
        for x, y, size, font, text in spans:
            shown = "<" + "".join(f"{ord(c):04x}" for c in text) + ">" if font == "F3" else "(" + text.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") + ")"
            parts.append(f"/{font} {size} Tf 1 0 0 1 {x} {y} Tm {shown} Tj")
        parts.append("ET Q")
        content = "\n".join(parts).encode("latin-1")
        if images:
            content += b"\n/I0 Do"
        raw = zlib.compress(content)
        objects[n] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(raw), raw)
        objects[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % n
        kids.append(b"%d 0 R" % (n + 1))
        n += 2
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    x = b" /XObject << /I0 8 0 R >>" if images else b""
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R /F3 5 0 R >>%s >> >>" % (len(kids), b" ".join(kids), x)
    objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    objects[4] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>"
    objects[5] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Any-Italic /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>"
    objects[6] = b"<< /Type /Font /DW 600 >>"
    cmap = b"1 beginbfrange <0020> <ffff> <0020> endbfrange"
    objects[7] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    if images:
        objects[8] = b"<< /Subtype /Image /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (len(images[0]), images[0])
    objects[9] = b"<< " + b" ".join(b"/%s (%s)" % (k.encode(), v.encode()) for k, v in (info or {}).items()) + b" >>"
    out, at = bytearray(b"%PDF-1.5\n"), {}
    loose = objects
    if packed:
        inner = {k: v for k, v in objects.items() if b"stream" not in v}
        loose = {k: v for k, v in objects.items() if k not in inner}
        head, body = b"", b""
        for k, v in inner.items():
            head += b"%d %d " % (k, len(body))
            body += v + b" "
        raw = zlib.compress(head + body)
        loose[n] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(inner), len(head), len(raw), raw)
    for k, v in loose.items():
        at[k] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    start = len(out)
    if not packed:
        top = max(objects) + 1
        out += b"xref\n0 %d\n" % top + b"".join(b"%010d %05d %s\r\n" % ((at[k], 0, b"n") if k in at else (0, 65535, b"f")) for k in range(top))
        out += b"trailer\n<< /Size %d /Root 1 0 R /Info 9 0 R >>\nstartxref\n%d\n%%%%EOF" % (top, start)
        return bytes(out)
    rows = b""
    order = list(inner)
    for k in range(n + 2):
        if k == n + 1:
            f = (1, start, 0)
        elif k in at:
            f = (1, at[k], 0)
        elif k in inner:
            f = (2, n, order.index(k))
        else:
            f = (0, 0, 0)
        row = bytes([f[0]]) + f[1].to_bytes(3, "big") + bytes([f[2]])
        rows += b"\x02" + bytes((c - (rows_prev[j] if k else 0)) & 255 for j, c in enumerate(row)) if predictor else row
        rows_prev = row
    raw = zlib.compress(rows)
    parms = b"/DecodeParms << /Predictor 12 /Columns 5 >> " if predictor else b""
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 3 1] /Root 1 0 R /Info 9 0 R %s/Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (n + 1, n + 2, parms, len(raw), raw, start)
    return bytes(out)
