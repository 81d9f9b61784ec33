"""Stream filters of PDF: Flate, LZW, ASCII85, ASCIIHex, RunLength, and predictors."""

from __future__ import annotations

import zlib

import numpy as np


class FilterError(ValueError):
    pass


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256 or not table:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            if code == 256:
                continue
        if last is None:
            word = table[code]
        elif code < len(table):
            word = table[code]
            table.append(last + word[:1])
        elif code == len(table):
            word = last + last[:1]
            table.append(word)
        else:
            raise FilterError("LZW code out of range")
        out += word
        last = word
        if len(table) + early >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    data = data.split(b"~>")[0].translate(None, b"\0\t\n\f\r ").removeprefix(b"<~")
    out, at = bytearray(), 0
    while at < len(data):
        if data[at] == 122:  # z
            out += bytes(4)
            at += 1
            continue
        group = data[at : at + 5]
        value = 0
        for c in group.ljust(5, b"u"):
            if not 33 <= c <= 117:
                raise FilterError("not an ASCII85 digit")
            value = value * 85 + c - 33
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
        at += 5
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = data.split(b">")[0].translate(None, b"\0\t\n\f\r ")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("latin-1"))


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def flate(data: bytes) -> bytes:
    return zlib.decompressobj().decompress(data)


NAMED = {
    "FlateDecode": flate, "Fl": flate, "LZWDecode": lzw, "LZW": lzw, "ASCII85Decode": ascii85, "A85": ascii85,
    "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "RunLengthDecode": run_length, "RL": run_length,
}


def unpredict(data: bytes, predictor: int, columns: int, colors: int, bits: int) -> bytes:
    """Undoes the PNG predictors, by row, and the TIFF one of whole bytes."""
    width, step = (columns * colors * bits + 7) // 8, max(1, colors * bits // 8)
    if predictor == 2:
        if bits != 8:
            raise FilterError("a TIFF predictor of other than 8 bits isn't read")
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, 1, dtype=np.uint8).tobytes()
    out, before = bytearray(), bytearray(width)
    for a in range(0, len(data), width + 1):
        kind, row = data[a], bytearray(data[a + 1 : a + 1 + width])
        for i in range(len(row)):
            left, up, corner = (row[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
            if kind == 4:
                p = left + up - corner
                add = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            else:
                add = (0, left, up, (left + up) // 2)[kind] if kind < 4 else 0
            row[i] = row[i] + add & 255
        out += row
        before = row
    return bytes(out)
