"""PDF decoding in plain Python: pages, positioned text spans, metadata and embedded images.

Reads cross-reference tables and streams, object streams, streams of the
lossless filters with predictors, page trees with inherited attributes, and the
text operators. Text is decoded by ToUnicode maps, else by the font's encoding
and its differences; glyph widths by the font's Widths, else half the size.
Encrypted files, other filters on page content and text operators without their
operands are errors, never empty text: their rows carry ``error``.
"""

from __future__ import annotations

import re
import struct
import time
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters, glyphs, raster

SPAN = "struct<span_no:int,text:string,x0:double,y0:double,x1:double,y1:double,font_size:double,font_name:string,is_bold:boolean,is_italic:boolean>"
IMAGE = "struct<img_idx:int,ext:string,content:binary,x0:double,y0:double,x1:double,y1:double>"
META = "struct<title:string,author:string,subject:string,creator:string,producer:string,creation_date:string,page_count:int>"
SEGMENT = "struct<x0:double,y0:double,x1:double,y1:double>"
#: ``seconds`` is what decoding the page took.
SCHEMA = f"path string, page_num int, width double, height double, spans array<{SPAN}>, images array<{IMAGE}>, segments array<{SEGMENT}>, metadata {META}, error string, seconds double"


def _arrow(ddl: str) -> list[tuple]:
    types = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return [(name, types[kind]) for name, kind in (x.split(":") for x in ddl.removeprefix("struct<").removesuffix(">").split(","))]


_NESTED = {"spans": pa.list_(pa.struct(_arrow(SPAN))), "images": pa.list_(pa.struct(_arrow(IMAGE))), "segments": pa.list_(pa.struct(_arrow(SEGMENT))), "metadata": pa.struct(_arrow(META))}
ARROW = pa.schema([("path", pa.string()), ("page_num", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), *_NESTED.items(), ("error", pa.string()), ("seconds", pa.float64())])
#: A batch of decoded pages goes to Spark when it has so many texts and segments, or so many bytes of images.
BATCH, BATCH_BYTES = 20_000, 8 << 20


class PdfError(ValueError):
    pass


class Name(str):
    pass


@dataclass(frozen=True)
class Ref:
    number: int


class Op(str):
    pass


class Stream:
    def __init__(self, info, raw):
        self.info, self.raw = info, raw


_SPACE, _DELIMITER = b"\0\t\n\f\r ", b"()<>[]{}/%"
_BLANK = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_TOKEN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_PLAIN = re.compile(rb"[\0\t\n\f\r ]*([^\0\t\n\f\r ()<>\[\]{}/%]+)")
_ESCAPE = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}


@lru_cache(4096)
def _word(word: bytes):
    """A number, a truth value or an ``Op``."""
    try:
        return int(word)
    except ValueError:
        try:
            return float(word)
        except ValueError:
            return {b"true": True, b"false": False}.get(word, Op(word.decode("latin-1")))


class Reader:
    """Objects of PDF syntax from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def blank(self):
        self.at = _BLANK.match(self.data, self.at).end()

    def object(self):
        """The next object; an ``Op`` for a bare word; None at the end."""
        d = self.data
        if m := _PLAIN.match(d, self.at):
            self.at = m.end()
            return _word(m[1])
        self.blank()
        if self.at >= len(d):
            return None
        c = d[self.at : self.at + 1]
        if c == b"/":
            m = _TOKEN.match(d, self.at + 1)
            self.at = m.end() if m else self.at + 1
            raw = m.group() if m else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self._string()
        if d[self.at : self.at + 2] == b"<<":
            self.at += 2
            out = {}
            while True:
                self.blank()
                if d[self.at : self.at + 2] == b">>" or self.at >= len(d):
                    self.at += 2
                    return out
                key = self.object()
                out[key] = self.value()
        if c == b"<":
            end = d.index(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.blank()
                if self.at >= len(d) or d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value())
        m = _TOKEN.match(d, self.at)
        if not m:
            self.at += 1
            return Op(c.decode("latin-1"))
        self.at = m.end()
        return _word(m.group())

    def value(self):
        """An object, with ``n g R`` read as a reference and ``null`` as None."""
        x = self.object()
        if isinstance(x, int) and not isinstance(x, bool):
            m = re.compile(rb"[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])").match(self.data, self.at)
            if m:
                self.at = m.end()
                return Ref(x)
        return None if isinstance(x, Op) and x == "null" else x

    def _string(self):
        d, out, depth = self.data, bytearray(), 1
        self.at += 1
        while self.at < len(d):
            c = d[self.at]
            self.at += 1
            if c == 92 and self.at < len(d):
                c = d[self.at]
                self.at += 1
                if 48 <= c <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(d, self.at - 1)
                    self.at = m.end()
                    out.append(int(m.group(), 8) & 255)
                elif c not in b"\r\n":
                    out.append(_ESCAPE.get(c, c))
                continue
            depth += (c == 40) - (c == 41)
            if not depth:
                break
            out.append(c)
        return bytes(out)


class Pdf:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise PdfError("no PDF header")
        self.data, self.at, self.packed, self.cache, self.trailer, self.fonts = data, {}, {}, {}, {}, {}
        m = re.findall(rb"startxref\s+(\d+)", data)
        try:
            self._tables(int(m[-1]))
        except Exception:  # a damaged table: look for the objects themselves
            self._scan()
        if "Root" not in self.trailer:
            self._scan()
        if "Encrypt" in self.trailer:
            raise PdfError("encrypted files aren't read")
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise PdfError("no document catalogue")

    def _tables(self, at: int) -> None:
        seen = set()
        while at is not None and at not in seen:
            seen.add(at)
            r = Reader(self.data, at)
            first = r.object()
            if first == "xref":
                while isinstance(start := r.object(), int):
                    for k in range(r.object()):
                        offset, _, kind = r.object(), r.object(), r.object()
                        if kind == "n":
                            self.at.setdefault(start + k, offset)
                info = r.object()
                if "XRefStm" in info:
                    self._stream_table(info["XRefStm"])
            else:
                info = self._stream_table(at)
            self.trailer = info | self.trailer
            at = info.get("Prev")

    def _stream_table(self, at: int) -> dict:
        s = self._object_at(at)
        data, w, index = self.bytes(s), s.info["W"], s.info.get("Index") or [0, s.info["Size"]]
        k = 0
        for start, count in zip(index[::2], index[1::2], strict=True):
            for n in range(start, start + count):
                f = []
                for width in w:
                    f.append(int.from_bytes(data[k : k + width], "big") if width else None)
                    k += width
                kind = 1 if f[0] is None else f[0]
                if kind == 1:
                    self.at.setdefault(n, f[1])
                elif kind == 2:
                    self.packed.setdefault(n, (f[1], f[2] or 0))
        return s.info

    def _scan(self) -> None:
        self.at = {int(m[1]): m.start() for m in re.finditer(rb"(?<!\d)(\d+)[ \t\r\n]+\d+[ \t\r\n]+obj\b", self.data)}
        for m in re.finditer(rb"\btrailer\b", self.data):
            info = Reader(self.data, m.end()).object()
            if isinstance(info, dict):
                self.trailer |= info
        for n in list(self.at):
            s = self.get(Ref(n))
            if isinstance(s, Stream) and s.info.get("Type") == "ObjStm":
                for k, (number, _) in enumerate(self._members(s)):
                    self.packed.setdefault(number, (n, k))
            if isinstance(s, dict) and s.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(n))

    def _object_at(self, at: int):
        r = Reader(self.data, at)
        r.object(), r.object(), r.object()
        x = r.value()
        r.blank()
        if isinstance(x, dict) and self.data[r.at : r.at + 6] == b"stream":
            start = r.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else 1
            n = self.get(x.get("Length"))
            if not isinstance(n, int) or self.data[start + n : start + n + 20].lstrip()[:9] != b"endstream":
                n = self.data.index(b"endstream", start) - start
            return Stream(x, self.data[start : start + n])
        return x

    def _members(self, s: Stream) -> list[tuple[int, int]]:
        r = Reader(self.bytes(s))
        return [(r.object(), r.object()) for _ in range(self.get(s.info["N"]))]

    def get(self, x):
        while isinstance(x, Ref):
            if x.number not in self.cache:
                self.cache[x.number] = None
                if x.number in self.at:
                    self.cache[x.number] = self._object_at(self.at[x.number])
                elif x.number in self.packed:
                    holder, k = self.packed[x.number]
                    s = self.get(Ref(holder))
                    self.cache[x.number] = Reader(self.bytes(s), self.get(s.info["First"]) + self._members(s)[k][1]).value()
            x = self.cache[x.number]
        return x

    def bytes(self, s: Stream) -> bytes:
        data = s.raw
        names, parms = self.get(s.info.get("Filter")) or [], self.get(s.info.get("DecodeParms")) or {}
        names = names if isinstance(names, list) else [names]
        parms = parms if isinstance(parms, list) else [parms]
        for k, name in enumerate(names):
            name = self.get(name)
            p = self.get(parms[k]) if k < len(parms) else None
            p = p if isinstance(p, dict) else {}
            if name not in filters.NAMED:
                raise PdfError(f"filter {name} isn't read")
            early = {"early": self.get(p["EarlyChange"])} if name in ("LZWDecode", "LZW") and "EarlyChange" in p else {}
            data = filters.NAMED[name](data, **early)
            if (kind := self.get(p.get("Predictor", 1))) > 1:
                data = filters.unpredict(data, kind, *(self.get(p.get(x, y)) for x, y in (("Columns", 1), ("Colors", 1), ("BitsPerComponent", 8))))
        return data

    def font(self, info: dict) -> "Font":
        """Read once for the whole file."""
        if id(info) not in self.fonts:
            self.fonts[id(info)] = info, Font(self, info)
        return self.fonts[id(info)][1]

    def pages(self):
        def walk(node, inherited, seen):
            node = self.get(node)
            if not isinstance(node, dict) or id(node) in seen:
                return
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]):
                    yield from walk(kid, own, seen | {id(node)})
            else:
                yield own | node

        yield from walk(self.get(self.trailer["Root"]).get("Pages"), {}, frozenset())

    def metadata(self) -> dict:
        info = self.get(self.trailer.get("Info")) or {}
        names = {"title": "Title", "author": "Author", "subject": "Subject", "creator": "Creator", "producer": "Producer", "creation_date": "CreationDate"}
        return {k: _text(self.get(info.get(v)) or b"") for k, v in names.items()}


def _text(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


class Font:
    def __init__(self, pdf: Pdf, info: dict):
        get = pdf.get
        self.name = str(get(info.get("BaseFont")) or "")
        self.wide = get(info.get("Subtype")) == "Type0"
        self.map, self.ranges, self.widths, self.default = {}, [], {}, 0.5
        if isinstance(s := get(info.get("ToUnicode")), Stream):
            self._unicode(pdf.bytes(s).decode("latin-1"))
        elif self.wide:
            raise PdfError(f"font {self.name} has no ToUnicode map")
        self.coded = self._encoding(get, info.get("Encoding")) if not self.wide else {}
        if self.wide:
            below = get(get(info.get("DescendantFonts"))[0])
            self.default = get(below.get("DW", 1000)) / 1000
            w = get(below.get("W")) or []
            k = 0
            while k < len(w):
                first, second = get(w[k]), get(w[k + 1])
                if isinstance(second, list):
                    self.widths |= {first + j: get(x) / 1000 for j, x in enumerate(second)}
                    k += 2
                else:
                    self.widths |= dict.fromkeys(range(first, second + 1), get(w[k + 2]) / 1000)
                    k += 3
        elif get(info.get("Widths")):
            first = get(info.get("FirstChar", 0))
            self.widths = {first + k: get(x) / 1000 for k, x in enumerate(get(info["Widths"]))}

    def _encoding(self, get, encoding) -> dict[int, str]:
        """Characters of one-byte codes."""
        encoding = get(encoding)
        base = encoding if isinstance(encoding, str) else get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else None
        out = {c: bytes([c]).decode("mac_roman" if base == "MacRomanEncoding" else "cp1252", "replace") for c in range(256)}
        if base == "StandardEncoding":
            out |= {39: "’", 96: "‘"}
        code = 0
        for x in (get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
            x = get(x)
            if isinstance(x, str):
                out[code], code = glyphs.character(x), code + 1
            else:
                code = int(x)
        return out

    def _unicode(self, cmap: str) -> None:
        hexed = lambda h: bytes.fromhex(h).decode("utf-16-be", "replace")
        for block in re.findall(r"beginbfchar(.*?)endbfchar", cmap, re.S):
            for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                self.map[int(a, 16)] = hexed(b)
        for block in re.findall(r"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, to, many in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
                first, last = int(a, 16), int(b, 16)
                if to:
                    self.ranges.append((first, last, hexed(to)))
                else:
                    self.map |= {first + k: hexed(x) for k, x in enumerate(re.findall(r"<([0-9A-Fa-f]+)>", many)[: last - first + 1])}

    def character(self, code: int) -> str:
        if code not in self.map:
            found = next((base[:-1] + chr(ord(base[-1]) + code - first) for first, last, base in self.ranges if first <= code <= last and base), None)
            self.map[code] = found or ("" if self.wide else self.coded[code])
        return self.map[code]

    def show(self, raw: bytes) -> tuple[str, float, int, int]:
        """Text, width in ems, number of codes, and of spaces of one byte."""
        codes = raw
        if self.wide:
            even = len(raw) // 2 * 2
            codes = struct.unpack(f">{even // 2}H", raw[:even]) + tuple(raw[even:])
        for code in set(codes).difference(self.map):
            self.character(code)
        width = sum(self.widths.get(c, self.default) for c in codes) if self.widths else self.default * len(codes)
        return "".join(map(self.map.__getitem__, codes)), width, len(codes), 0 if self.wide else raw.count(b" ")


def _times(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _length(side) -> float:
    (a, b), (c, d) = side
    return ((a - c) ** 2 + (b - d) ** 2) ** 0.5


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


#: A filled box of at most so many points across counts as a drawn line.
THIN = 3.0


def page_content(pdf: Pdf, page: dict) -> tuple[list[dict], list[dict], list[dict]]:
    """Spans, from the top left corner, images, and drawn segments. Neighbouring strings of one font and line are one span.

    Segments are the straight sides of stroked paths, and of filled boxes the long sides of thin ones.
    """
    get = pdf.get
    box = [float(get(x)) for x in get(page.get("CropBox") or page.get("MediaBox") or [0, 0, 612, 792])]
    spans: list[dict] = []
    images: list[dict] = []
    segments: list[dict] = []

    def run(content: bytes, resources: dict, ctm, depth: int):
        fonts, xobjects = get(resources.get("Font")) or {}, get(resources.get("XObject")) or {}
        state = {"font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "ctm": ctm}
        stack, args, tm, line = [], [], _ONE, _ONE
        sides: list[tuple] = []  # of the path that is being built: two points each
        boxes: list[list[tuple]] = []
        point = first = (0.0, 0.0)

        def placed(x, y):
            at = _times((1, 0, 0, 1, x, y), state["ctm"])
            return at[4] - box[0], box[3] - at[5]

        def show(raw):
            nonlocal tm
            font = state["font"]
            if font is None or not isinstance(raw, bytes):
                return
            size, start = state["size"], tm
            text, width, codes, blanks = font.show(raw)
            move = width * size + codes * state["char"] + blanks * state["word"]
            tm = _times((1, 0, 0, 1, move * state["scale"], 0), tm)
            a, b = _times(start, state["ctm"]), _times(tm, state["ctm"])
            high = (abs(a[2]) ** 2 + abs(a[3]) ** 2) ** 0.5 * size
            base = box[3] - a[5] - state["rise"]
            lower = font.name.lower()
            s = {"text": text, "x0": a[4] - box[0], "x1": b[4] - box[0], "y0": base - 0.8 * high, "y1": base + 0.2 * high, "font_size": round(high, 4), "font_name": font.name, "is_bold": "bold" in lower, "is_italic": "italic" in lower or "oblique" in lower}
            last = spans[-1] if spans else None
            if last and all(last[k] == s[k] for k in ("font_name", "font_size")) and abs(last["y1"] - s["y1"]) < 0.01 * high + 1e-6 and -0.3 * high <= s["x0"] - last["x1"] <= 1.5 * high:
                gap = s["x0"] - last["x1"] > 0.2 * high and not last["text"].endswith(" ") and not s["text"].startswith(" ")
                last["text"] += " " * gap + s["text"]
                last["x1"] = s["x1"]
            else:
                spans.append(s)

        r = Reader(content)
        while (x := r.object()) is not None:
            if not isinstance(x, Op):
                args.append(x)
                continue
            try:
                if x == "q":
                    stack.append(dict(state))
                elif x == "Q" and stack:
                    state.update(stack.pop())
                elif x == "cm":
                    state["ctm"] = _times(tuple(args[-6:]), state["ctm"])
                elif x == "m":
                    point = first = placed(*args[-2:])
                elif x == "l":
                    before, point = point, placed(*args[-2:])
                    sides.append((before, point))
                elif x in ("c", "v", "y"):
                    point = placed(*args[-2:])
                elif x == "h":
                    sides.append((point, first))
                    point = first
                elif x == "re":
                    left, low, wide, high = (float(v) for v in args[-4:])
                    corners = [placed(*c) for c in ((left, low), (left + wide, low), (left + wide, low + high), (left, low + high))]
                    boxes.append(list(zip(corners, corners[1:] + corners[:1], strict=True)))
                    point = first = corners[0]
                elif x in ("S", "s", "B", "B*", "b", "b*", "f", "F", "f*", "n"):
                    stroked = x in ("S", "s", "B", "B*", "b", "b*")
                    if x in ("s", "b", "b*"):
                        sides.append((point, first))
                    drawn = sides + [side for b in boxes for side in b] if stroked else [side for b in boxes if x != "n" and min(_length(b[0]), _length(b[1])) <= THIN for side in b]
                    segments.extend({"x0": a[0], "y0": a[1], "x1": b[0], "y1": b[1]} for a, b in drawn if a != b)
                    sides, boxes = [], []
                elif x == "BT":
                    tm = line = _ONE
                elif x == "Tf":
                    name = args[-2]
                    state["font"], state["size"] = pdf.font(get(fonts.get(name)) or {}), float(args[-1])
                elif x in ("Tc", "Tw", "TL", "Ts"):
                    state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[x]] = float(args[-1])
                elif x == "Tz":
                    state["scale"] = args[-1] / 100
                elif x in ("Td", "TD"):
                    if x == "TD":
                        state["lead"] = -args[-1]
                    tm = line = _times((1, 0, 0, 1, args[-2], args[-1]), line)
                elif x == "Tm":
                    tm = line = tuple(float(v) for v in args[-6:])
                elif x == "T*":
                    tm = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
                elif x == "Tj":
                    show(args[-1])
                elif x in ("'", '"'):
                    if x == '"':
                        state["word"], state["char"] = float(args[-3]), float(args[-2])
                    tm = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
                    show(args[-1])
                elif x == "TJ":
                    for part in args[-1]:
                        if isinstance(part, bytes):
                            show(part)
                        else:
                            tm = _times((1, 0, 0, 1, -part / 1000 * state["size"] * state["scale"], 0), tm)
                elif x == "Do":
                    o = get(xobjects.get(args[-1]))
                    if isinstance(o, Stream) and get(o.info.get("Subtype")) == "Image":
                        f = get(o.info.get("Filter"))
                        f = get(f[-1]) if isinstance(f, list) and f else f
                        corners = [placed(*c) for c in ((0, 0), (1, 0), (0, 1), (1, 1))]
                        at = {f"{k}{n}": pick(c[j] for c in corners) for j, k in enumerate("xy") for n, pick in ((0, min), (1, max))}
                        if f in ("DCTDecode", "JPXDecode"):
                            images.append({"img_idx": len(images), "ext": "jpeg" if f == "DCTDecode" else "jp2", "content": o.raw} | at)
                        elif (png := raster.png(pdf, o)) is not None:
                            images.append({"img_idx": len(images), "ext": "png", "content": png} | at)
                    elif isinstance(o, Stream) and depth < 8:
                        m = tuple(float(get(v)) for v in get(o.info.get("Matrix")) or _ONE)
                        run(pdf.bytes(o), get(o.info.get("Resources")) or resources, _times(m, state["ctm"]), depth + 1)
                elif x == "BI":
                    end = re.compile(rb"\sEI(?=[\s]|$)").search(content, r.at)
                    r.at = end.end() if end else len(content)
            except (IndexError, TypeError) as e:
                if x in ("Tf", "Tj", "TJ", "'", '"'):
                    raise PdfError(f"text operator {x} without its operands") from e
                # any other operator without its operands does nothing
            args.clear()

    parts = get(page.get("Contents")) or []
    parts = parts if isinstance(parts, list) else [parts]
    content = b"\n".join(pdf.bytes(get(p)) for p in parts if isinstance(get(p), Stream))
    run(content, get(page.get("Resources")) or {}, _ONE, 0)
    spans = [s | {"text": s["text"].strip()} for s in spans if s["text"].strip()]
    return [{"span_no": k} | s for k, s in enumerate(spans)], images, segments


def decode_rows(path: str, data: bytes, wanted: list[int] | None = None, part: tuple[int, int] = (0, 1), keep=None):
    """Rows of the wanted pages (none wanted: all), or one with the error of a file that can't be read.

    Of ``part`` (k, n) only the k-th of n shares of them; the first share has a
    file's error. ``keep`` says of a page's number whether it is decoded; with it
    there are no rows for files.
    """
    try:
        pdf = Pdf(data)
        all_pages = list(pdf.pages())
        meta = pdf.metadata() | {"page_count": len(all_pages)}
    except Exception as e:
        if part[0] == 0 and keep is None:
            yield {"path": path, "error": f"{type(e).__name__}: {e}"}
        return
    chosen = [n for n in wanted or range(len(all_pages)) if 0 <= n < len(all_pages)]
    for n in chosen[len(chosen) * part[0] // part[1] : len(chosen) * (part[0] + 1) // part[1]]:
        if keep and not keep(n):
            continue
        row, began = {"path": path, "page_num": n, "metadata": meta}, time.perf_counter()
        try:
            box = [float(pdf.get(x)) for x in pdf.get(all_pages[n].get("CropBox") or all_pages[n].get("MediaBox") or [0, 0, 612, 792])]
            spans, images, segments = page_content(pdf, all_pages[n])
            row |= {"width": box[2] - box[0], "height": box[3] - box[1], "spans": spans, "images": images, "segments": segments}
        except Exception as e:
            row["error"] = f"{type(e).__name__}: {e}"
        yield row | {"seconds": time.perf_counter() - began}


def decode(path: str, data: bytes, wanted: list[int] | None = None) -> list[dict]:
    """All of ``decode_rows``."""
    return list(decode_rows(path, data, wanted))


def decode_pages(files: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """A row for each page of (path, content), read where the files are: pages that aren't wanted aren't decoded."""

    def run(batches):
        rows, texts, size = [], 0, 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for row in decode_rows(path.as_py(), content.as_py(), wanted):
                    rows.append(row)
                    texts += 1 + len(row.get("spans", ())) + len(row.get("segments", ()))
                    size += sum(len(x["content"]) for x in row.get("images", ()))
                    if texts >= BATCH or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, texts, size = [], 0, 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def page_text(spans_: str = "spans") -> Column:
    """The raw text of a page, a line for each span; empty for a page without text."""
    return F.array_join(F.transform(spans_, lambda s: F.concat(s["text"], F.lit("\n"))), "")


def page_texts(pages: DataFrame) -> DataFrame:
    """(path, page_num, text) of decoded pages."""
    return pages.where("error is null").select("path", "page_num", page_text().alias("text"))


def page_images(pages: DataFrame) -> DataFrame:
    """(path, page_num, img_idx, ext, content) of the images on decoded pages."""
    return pages.where("error is null").select("path", "page_num", F.explode("images").alias("i")).select("path", "page_num", "i.*")


def spans(pages: DataFrame, key: str = "path") -> DataFrame:
    """(doc_id, page_num, span_no, text, ...) of decoded pages."""
    return pages.where("error is null").select(F.col(key).alias("doc_id"), "page_num", F.explode("spans").alias("s")).select("doc_id", "page_num", "s.*")


def segments(pages: DataFrame, key: str = "path") -> DataFrame:
    """(doc_id, page_num, x0, y0, x1, y1): straight lines drawn on decoded pages."""
    return pages.where("error is null").select(F.col(key).alias("doc_id"), "page_num", F.explode("segments").alias("s")).select("doc_id", "page_num", "s.*")
