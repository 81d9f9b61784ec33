import base64
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import imaging
from quire.sources import files, filters, glyphs, raster
from quire.sources import pdf as pdf_source
from tests.pdfs import pdf


def pack_lzw(data: bytes, early: int = 1) -> bytes:
    """A plain encoder."""
    table, width, bits = {bytes([k]): k for k in range(256)}, 9, []
    size, word = 258, b""
    put = lambda code: bits.append(f"{code:0{width}b}")
    put(256)
    for c in data:
        c = bytes([c])
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c], size, word = size, size + 1, c
        if size - 1 + early >= 1 << width:
            width += 1
        if size >= 4094:
            put(table[word])
            put(256)
            table, width, size, word = {bytes([k]): k for k in range(256)}, 9, 258, b""
    if word:
        put(table[word])
    put(257)
    s = "".join(bits)
    s += "0" * (-len(s) % 8)
    return bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_filters_undo_what_encoders_do(data, times):
    data = data * times
    assert filters.lzw(pack_lzw(data)) == data
    assert filters.ascii85(base64.a85encode(data) + b"~>") == data
    assert filters.ascii_hex(data.hex().encode() + b">") == data
    packed = b"".join(bytes([len(data[k : k + 128]) - 1]) + data[k : k + 128] for k in range(0, len(data), 128)) + b"\x80"
    assert filters.run_length(packed) == data and filters.flate(zlib.compress(data)) == data


def test_predictors():
    x = np.random.RandomState(1).randint(0, 256, (5, 4, 3)).astype(np.uint8)
    tiff = np.diff(x, axis=1, prepend=0).astype(np.uint8)
    assert filters.unpredict(tiff.tobytes(), 2, 4, 3, 8) == x.tobytes()
    sub = np.diff(x.astype(int), axis=1, prepend=0).astype(np.uint8).reshape(5, -1)
    assert filters.unpredict(np.hstack([np.ones((5, 1), np.uint8), sub]).tobytes(), 15, 4, 3, 8) == x.tobytes()


def test_glyph_names():
    assert [glyphs.character(n) for n in ("A", "ntilde", "Eacute", "quoteright", "uni00E9", "u1F600", "fi", "Aring", "scaron", "zero.alt")] == ["A", "ñ", "É", "’", "é", "😀", "fi", "Å", "š", "0"]
    assert {glyphs.character(n) for n in ("g23", "", "zz", "uniD800", "qacute")} == {glyphs.UNKNOWN}


def test_encodings_by_differences():
    own = pdf([[(50, 700, 10, "F1", "abc A")]]).replace(b"/BaseFont /Helvetica >>", b"/BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [97 /ntilde /Eacute 99 /g7] >> >>")
    assert pdf_source.decode("p", own)[0]["spans"][0]["text"] == "ñÉ� A"


@pytest.mark.parametrize("name, pack", [("LZWDecode", pack_lzw), ("ASCII85Decode", lambda b: base64.a85encode(b) + b"~>"), ("ASCIIHexDecode", lambda b: b.hex().encode() + b">")])
def test_page_content_of_other_filters(name, pack):
    content = pack(b"BT /F1 12 Tf 1 0 0 1 10 700 Tm (Shown text) Tj ET")
    raw = zlib.compress(b"q BT\nET Q")
    data = pdf([[]]).replace(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s" % (len(raw), raw), b"<< /Length %d /Filter /%s >>\nstream\n%s" % (len(content), name.encode(), content))
    assert pdf_source.decode("p", data)[0]["spans"][0]["text"] == "Shown text"


def test_text_operators_without_operands_are_errors():
    raw = zlib.compress(b"q BT\nET Q")
    bad = zlib.compress(b"BT /F1 12 Tf Tj ET")
    data = pdf([[]]).replace(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s" % (len(raw), raw), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s" % (len(bad), bad))
    assert "operands" in pdf_source.decode("p", data)[0]["error"]


def scan(image: np.ndarray, text: bool = False) -> bytes:
    """A page that an image fills."""
    h, w = image.shape[:2]
    raw = zlib.compress(image.tobytes())
    x = b"<< /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /%s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (w, h, b"DeviceRGB" if image.ndim == 3 else b"DeviceGray", len(raw), raw)
    data = pdf([[(50, 700, 10, "F1", "text")] if text else []], images=[b"JPEG"])
    content = zlib.compress(b"q 595 0 0 842 0 0 cm /I0 Do Q" + (b" BT /F1 10 Tf (t) Tj ET" if text else b""))
    a, b = data.index(b"<< /Length"), data.index(b"endstream")
    data = data[:a] + b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\n" % (len(content), content) + data[b:]
    a = data.index(b"<< /Subtype /Image")
    b = data.index(b"endstream", a) + len(b"endstream")
    return data[:a] + x + data[b:]


def test_scans_are_drawn_and_prepared(spark, tmp_path):
    page = np.full((84, 60), 255, np.uint8)
    page[20:30, 10:50] = 0
    (tmp_path / "a.pdf").write_bytes(scan(page))
    (tmp_path / "b.pdf").write_bytes(scan(page, text=True))
    (tmp_path / "c.pdf").write_bytes(pdf([[]], images=[b"\xff\xd8"]))
    source = files.pdf_files(spark, str(tmp_path)).select("path", "content", F.array(F.lit(0)).alias("pages"))
    rows = {r.path[-5:]: r for r in raster.render_pages(source, 36).collect()}
    x = np.frombuffer(rows["a.pdf"].pixels, np.uint8).reshape(rows["a.pdf"].height, rows["a.pdf"].width, 3)
    assert x.shape == (421, 298, 3) and x[125, 150].max() == 0 and x[300, 150].min() == 255 and x[125, 10].min() == 255
    assert "text is drawn" in rows["b.pdf"].error and rows["b.pdf"].pixels is None and rows["c.pdf"].error
    ready = imaging.prepare_pages(raster.render_pages(source, 36), deskewed=False).collect()
    assert [(r.path[-5:], r.width, r.height, set(r.pixels)) for r in ready] == [("a.pdf", 298, 421, {0, 255})]


def test_images_and_raw_text(spark, tmp_path):
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "a.pdf").write_bytes(scan(image, text=True))
    decoded = pdf_source.decode_pages(files.pdf_files(spark, str(tmp_path)))
    i = pdf_source.page_images(decoded).collect()
    assert [(r.img_idx, r.ext) for r in i] == [(0, "png")] and zlib.decompress(i[0].content[41:-16]) == b"".join(b"\0" + row.tobytes() for row in image)
    assert [r.text for r in pdf_source.page_texts(decoded).collect()] == ["t\n"]
    assert [r.path[-5:] for r in files.pdf_listing(spark, str(tmp_path)).collect()] == ["a.pdf"] and "content" not in files.pdf_listing(spark, str(tmp_path)).columns


def test_many_files_are_few_batches(spark):
    """Rows of many files go to Spark together, not each file's on its own."""
    from quire.plans import paper

    docs = spark.createDataFrame([(i, f"text of {i}\n\U0001f600") for i in range(60)], "doc_id long, text string").coalesce(1)
    pages = pdf_source.decode_pages(paper.pdfs(docs)).select("path", pdf_source.page_text().alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    assert [r.n for r in pages.mapInArrow(sizes, "n long").collect()] == [60]
    assert {r.t for r in pages.collect()} == {f"text of {i}\n?\n" for i in range(60)}
    font = pdf_source.Font.__new__(pdf_source.Font)
    font.wide, font.map, font.ranges, font.widths, font.default = True, {}, [(0, 65535, "\0")], {65: 0.25}, 0.5
    assert font.show(b"\0A\0B\0") == ("AB\0", 1.25, 3, 0)
