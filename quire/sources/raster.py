"""Raster images of PDF files: losslessly stored images as arrays and PNG, and pages made of nothing else.

A scanned page is images on paper; ``render_pages`` draws those. Pages with
drawn text or lines, or with images in lossy formats, need a renderer of the
user's: their rows carry ``error``, never a picture with something missing.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.imaging import resize_to

RENDERED = "path string, page_num int, width int, height int, pixels binary, error string"


class NeedsRenderer(ValueError):
    pass


def _space(pdf, space) -> tuple[str, int, bytes | None]:
    """(kind, components, palette) of a colour space."""
    space = pdf.get(space)
    parts = [pdf.get(x) for x in space] if isinstance(space, list) else [space]
    names = {"DeviceGray": ("gray", 1), "CalGray": ("gray", 1), "G": ("gray", 1), "DeviceRGB": ("rgb", 3), "CalRGB": ("rgb", 3), "RGB": ("rgb", 3), "DeviceCMYK": ("cmyk", 4), "CMYK": ("cmyk", 4)}
    if parts[0] in names:
        return *names[parts[0]], None
    if parts[0] == "ICCBased":
        n = pdf.get(parts[1].info.get("N"))
        return {1: "gray", 3: "rgb", 4: "cmyk"}[n], n, None
    if parts[0] in ("Indexed", "I"):
        kind, n, _ = _space(pdf, parts[1])
        table = parts[3] if isinstance(parts[3], bytes) else pdf.bytes(parts[3])
        return kind, n, table
    raise NeedsRenderer(f"colour space {parts[0]} isn't read")


def pixels(pdf, image) -> np.ndarray:
    """An image as uint8: rows x columns, or rows x columns x 3."""
    get, info = pdf.get, image.info
    w, h = int(get(info["Width"])), int(get(info["Height"]))
    mask = bool(get(info.get("ImageMask", False)))
    bits = 1 if mask else int(get(info.get("BitsPerComponent", 8)))
    kind, n, palette = ("gray", 1, None) if mask else _space(pdf, info.get("ColorSpace", "DeviceGray"))
    per = 1 if palette is not None else n
    data = np.frombuffer(pdf.bytes(image), np.uint8)
    stride = (w * per * bits + 7) // 8
    if len(data) < stride * h:
        raise NeedsRenderer("an image is cut short")
    data = data[: stride * h].reshape(h, stride)
    if bits == 8:
        x = data[:, : w * per]
    elif bits in (1, 2, 4):
        x = np.unpackbits(data, axis=1)[:, : w * per * bits].reshape(h, w * per, bits)
        x = (x << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)
    else:
        raise NeedsRenderer(f"images of {bits} bits aren't read")
    x = x.reshape(h, w, per)
    if palette is not None:
        table = np.zeros((256, n), np.uint8)
        own = np.frombuffer(palette, np.uint8)[: 256 * n]
        table[: len(own) // n] = own[: len(own) // n * n].reshape(-1, n)
        x = table[x[:, :, 0]]
    elif bits < 8:
        x = (x * (255 // ((1 << bits) - 1))).astype(np.uint8)
    decode = [float(get(v)) for v in get(info.get("Decode")) or []]
    if decode[:2] == [1.0, 0.0] and palette is None:
        x = 255 - x
    if kind == "cmyk":
        c = x.astype(np.uint16)
        x = ((255 - c[:, :, :3]) * (255 - c[:, :, 3:]) // 255).astype(np.uint8)
    return x[:, :, 0] if x.shape[2] == 1 else x


def encode_png(x: np.ndarray) -> bytes:
    h, w = x.shape[:2]
    rows = np.zeros((h, 1 + x.size // h), np.uint8)
    rows[:, 1:] = x.reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if x.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png(pdf, image) -> bytes | None:
    """A losslessly stored image as PNG; None for masks and kinds that aren't read."""
    try:
        return None if pdf.get(image.info.get("ImageMask", False)) else encode_png(pixels(pdf, image))
    except (ValueError, KeyError, IndexError, TypeError):
        return None


def render(pdf, page: dict, dpi: float = 300) -> np.ndarray:
    """A page of images on white paper, gray or RGB."""
    from .pdf import Op, Reader, Stream, _ONE, _times

    get, zoom = pdf.get, dpi / 72
    box = [float(get(v)) for v in get(page.get("CropBox") or page.get("MediaBox") or [0, 0, 612, 792])]
    canvas = np.full((max(1, round((box[3] - box[1]) * zoom)), max(1, round((box[2] - box[0]) * zoom)), 3), 255, np.uint8)

    def draw(image, m):
        if abs(m[1]) > 1e-6 or abs(m[2]) > 1e-6 or m[0] <= 0 or m[3] <= 0:
            raise NeedsRenderer("an image is turned")
        x0, x1 = round((m[4] - box[0]) * zoom), round((m[4] + m[0] - box[0]) * zoom)
        y0, y1 = round((box[3] - m[5] - m[3]) * zoom), round((box[3] - m[5]) * zoom)
        x = resize_to(pixels(pdf, image), max(1, y1 - y0), max(1, x1 - x0))
        x = np.repeat(x[:, :, None], 3, 2) if x.ndim == 2 else x
        top, left, low, right = max(y0, 0), max(x0, 0), min(y1, len(canvas)), min(x1, canvas.shape[1])
        if top < low and left < right:
            canvas[top:low, left:right] = x[top - y0 : low - y0, left - x0 : right - x0]

    def run(content, resources, ctm, depth):
        xobjects, stack, args, r, hidden = get(resources.get("XObject")) or {}, [], [], Reader(content), False
        while (x := r.object()) is not None:
            if not isinstance(x, Op):
                args.append(x)
                continue
            if x == "q":
                stack.append(ctm)
            elif x == "Q" and stack:
                ctm = stack.pop()
            elif x == "cm":
                ctm = _times(tuple(float(v) for v in args[-6:]), ctm)
            elif x == "Tr":
                hidden = args[-1] == 3
            elif x in ("Tj", "TJ", "'", '"') and not hidden:
                raise NeedsRenderer("text is drawn")
            elif x in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "sh", "BI"):
                raise NeedsRenderer("shapes are drawn")
            elif x == "Do":
                o = get(xobjects.get(args[-1]))
                if isinstance(o, Stream) and get(o.info.get("Subtype")) == "Image":
                    draw(o, ctm)
                elif isinstance(o, Stream) and depth < 8:
                    run(pdf.bytes(o), get(o.info.get("Resources")) or resources, _times(tuple(float(get(v)) for v in get(o.info.get("Matrix")) or _ONE), ctm), depth + 1)
            args.clear()

    parts = get(page.get("Contents")) or []
    parts = parts if isinstance(parts, list) else [parts]
    run(b"\n".join(pdf.bytes(get(p)) for p in parts if isinstance(get(p), Stream)), get(page.get("Resources")) or {}, _ONE, 0)
    return canvas


def render_pages(files: DataFrame, dpi: float = 300) -> DataFrame:
    """(path, page_num, width, height, pixels, error) from (path, content, pages): RGB bytes of each page in the array ``pages``."""

    def run(batches):
        from .pdf import Pdf

        for batch in batches:
            for path, content, wanted in zip(batch.path, batch.content, batch.pages, strict=True):
                try:
                    pdf = Pdf(bytes(content))
                    all_pages = list(pdf.pages())
                except Exception as e:
                    yield pd.DataFrame([(path, int(n), None, None, None, f"{type(e).__name__}: {e}") for n in wanted], columns=["path", "page_num", "width", "height", "pixels", "error"]).astype(object)
                    continue
                for n in wanted:
                    try:
                        x = render(pdf, all_pages[n], dpi)
                        row = (path, int(n), x.shape[1], x.shape[0], x.tobytes(), None)
                    except Exception as e:
                        row = (path, int(n), None, None, None, f"{type(e).__name__}: {e}")
                    yield pd.DataFrame([row], columns=["path", "page_num", "width", "height", "pixels", "error"]).astype(object)

    return files.select("path", "content", "pages").mapInPandas(run, RENDERED)
