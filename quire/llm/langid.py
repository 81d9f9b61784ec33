"""Language identification by hyperdimensional profiles.

Every letter, of any alphabet and in lower case, has a random vector of +1 and
-1, and so has the gap between words. A trigram is the product of its
letters' vectors, each permuted (rotated) by its place; a document is the sum
of its trigrams and a language the sum of its documents. Documents go to the
language with the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import id_remainder, table
from ._text import mix

DIM = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Letters:
    """Random vectors of +1 and -1, one for each letter in lower case, made when first met.

    Letters are numbered as they come, 0 for whatever isn't one; a number's row
    in ``table`` is the letter's vector after its last two components, so that
    slices of a row are the vector rotated by 2, 1 and 0. All letters of Unicode
    would take 150 MB.
    """

    def __init__(self, dim: int):
        self.dim, self.number, self.n = dim, {}, 1
        self.of = np.full(0x110000, -1, np.int32)
        self.table = np.zeros((64, dim + 2), np.int8)

    def vector(self, code: int) -> np.ndarray:
        """The vector of a code point, the same on every machine."""
        bits = mix((np.uint64(code) << np.uint64(32)) + np.arange(self.dim, dtype=np.uint64) * _MIX)
        return (bits >> np.uint64(63)).astype(np.int8) * 2 - 1

    def numbers(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.of[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                self.of[p] = self._add(ord(chr(p).lower()[0])) if chr(p).isalpha() else 0
            out = self.of[points]
        return out

    def _add(self, code: int) -> int:
        if code not in self.number:
            if self.n == len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            v = self.vector(code)
            self.table[self.n, 2:], self.table[self.n, :2] = v, v[-2:]
            self.number[code], self.n = self.n, self.n + 1
        return self.number[code]


_letters: dict[int, Letters] = {}


def _gap(dim: int) -> np.ndarray:
    """The vector of the gap between words."""
    return Letters(dim).vector(0x110000)


def bundle(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """The document's vector; None for a null text or one without a letter."""
    if dim not in _letters:
        own = _letters[dim] = Letters(dim)
        v = _gap(dim)
        own.table[0, 2:], own.table[0, :2] = v, v[-2:]
    own = _letters[dim]
    s = own.numbers(text) if text else np.zeros(0, np.int32)
    if not s.any():
        return None
    s = np.concatenate(([0], s, [0])).astype(np.int64)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]  # one gap between words
    grams, counts = np.unique((s[:-2] << 40) | (s[1:-1] << 20) | s[2:], return_counts=True)
    first, second, third = own.table[:, :dim], own.table[:, 1 : dim + 1], own.table[:, 2:]
    out = np.zeros(dim)
    for a in range(0, len(grams), 2048):
        g = grams[a : a + 2048]
        v = first[g >> 40]
        v *= second[g >> 20 & 0xFFFFF]
        v *= third[g & 0xFFFFF]
        out += counts[a : a + 2048].astype(np.float32) @ v.astype(np.float32)
    return out


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = 2000, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Language names and their unit prototypes.

    Learned from a sample of about ``per_language`` documents of each language,
    chosen by a hash of id and text; rows with a null language or no letter teach
    nothing. Every other language is learned: a prototype is ``dim`` numbers.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    # one short row a language, less than the prototypes that the driver holds
    shares = rows.groupBy("l").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    rows = rows.join(F.broadcast(shares), "l").where(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("i", "t", "l")

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist(), strict=True):
                if (v := bundle(text, dim)) is not None:
                    total[lang] = total.get(lang, 0) + v
        if total:
            yield pa.RecordBatch.from_pydict({"l": list(total), "v": [x.tolist() for x in total.values()]}, pa.schema([("l", pa.string()), ("v", pa.list_(pa.float64()))]))

    found: dict[str, np.ndarray] = {}
    for r in rows.repartition(16, "i").mapInArrow(sums, "l string, v array<double>").collect():
        found[r.l] = found.get(r.l, 0) + np.array(r.v)
    names = sorted(found)
    return names, np.array([found[x] / max(np.linalg.norm(found[x]), 1e-9) for x in names]).reshape(len(names), dim)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col="doc_id", text_col="text", flag=None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    ``score`` is the cosine with the chosen prototype, at least 0; ties go to
    the first name. ``und`` with score 0 where the text is null, empty or
    without a letter, or where no language was learned. Repeated rows get equal
    results; null ids stay null; further columns are ignored. Texts of any length
    are read as wholes, in parts; no rows give no rows.
    """
    names, protos = model
    dim = protos.shape[1]
    protos = protos.astype(np.float32)

    def run(batches):
        for batch in batches:
            lang, score = [], []
            for text in batch.column("t"):
                v = bundle(text.as_py(), dim) if names else None
                if v is None:
                    lang.append("und")
                    score.append(0.0)
                else:
                    c = protos @ v / max(float(np.linalg.norm(v)), 1e-9)
                    best = int(np.argmax(c))
                    lang.append(names[best])
                    score.append(float(np.clip(c[best], 0, 1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (F.lit(False) if flag is None else flag).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def op8_hyperdimensional_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = id_remainder(F.col("doc_id"), 4) == 2
    return identify(docs, learn(docs.where(~held)), flag=held)
