"""Collocations by contiguous pattern growth over projected occurrences.

Four passes read the texts. The first counts words, the second pairs of frequent
words. The third finds which three words in sequence may be frequent: it counts
those of two frequent pairs in cells by hash, which can only say too much. The
fourth projects: every occurrence of a prefix that can grow becomes a pointer with
what it can grow into, the words to its right as long as each three may be
frequent. Equal projections of a task are one row with a count. Each prefix goes
to one task, which walks its sorted pointers depth first: the pointers of a longer
prefix are a run of them, so a stack of the words on the way is all that the task
holds, and prefixes that aren't frequent end there.

A prefix that has over a share of one in ``HOT`` of all words is grown before it
is dealt: such words by their next word, and such pairs by all words. What
several tasks have counted of one phrase is added up.

Filters between the passes are bitmaps of fixed size with every frequent word or
pair in them; what they let through by chance is counted and found rare.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import FILTER_BITS, holds, partitions, table, written
from ._text import mix, sequence_hashes, word_hashes, words

LONGEST, LEAST, FIRST = 5, 100, 2000
#: Prefixes with over one in so many of all words are fewer than so many.
HOT = 1 << 14
_LOWER = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK, _HELD = 1 << 20, 1 << 18
#: Cells that count three words: one for so many words of the texts, but at most 2 to the power of MOST_BITS, 32 MB a task.
WORDS_A_CELL, LEAST_BITS, MOST_BITS = 64, 16, 25
_BLOCK = 1 << 16
_UND = "und"
_STRING = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)


def _texts(batches):
    """(lang, bytes): lower-cased texts of one language, words apart by spaces and pieces by newlines, about a megabyte together or one text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, t in zip(batch.column("lang").to_pylist(), batch.column("t"), strict=True):
            own = held.setdefault(lang, [])
            own.append((t.as_py() or b"").translate(_LOWER))
            size += len(own[-1])
            if size > _CHUNK:
                for k in list(held):
                    yield k, b"\n".join(held.pop(k)) + b"\n"
                size = 0
    for k, v in held.items():
        yield k, b"\n".join(v) + b"\n"


def _key(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _strings(values) -> pa.Array:
    return pa.array(values, pa.binary()).cast(options=_STRING)


def _word_rows(lang: str, counts: Counter) -> pa.RecordBatch:
    own = list(counts)
    data = np.frombuffer(b" ".join(own), np.uint8)
    starts, ends, _ = words(data, np.zeros(1, np.int64))
    h = mix(word_hashes(data, starts, ends) ^ _key(lang)).view(np.int64)
    total = sum(counts.values())
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * (len(own) + 1)), pa.concat_arrays([_strings(own), pa.nulls(1, pa.string())]), pa.array(np.append(h, 0)), pa.array([*counts.values(), total], pa.int64())], ["lang", "word", "h", "n"]
    )


def _count_words(batches):
    """(lang, word, h, n): words with their hashes; a row without a word has the number of all."""
    held: dict[str, Counter] = {}
    for lang, data in _texts(batches):
        own = held.setdefault(lang, Counter())
        own.update(data.split())
        if sum(map(len, held.values())) > _HELD:
            yield from (_word_rows(k, c) for k, c in held.items() if c)
            held.clear()
    yield from (_word_rows(k, c) for k, c in held.items() if c)


class _Chunk:
    """Words of a chunk: their bounds and hashes, and for each word but the last whether the next is of its piece, and the pair's hash."""

    def __init__(self, lang: str, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.starts, self.ends, _ = words(self.data, np.zeros(1, np.int64))
        self.h = mix(word_hashes(self.data, self.starts, self.ends) ^ _key(lang)) if len(self.starts) else np.zeros(0, np.uint64)
        piece = np.searchsorted(np.flatnonzero(self.data == 10), self.starts)
        self.near = piece[1:] == piece[:-1]
        self.pairs = sequence_hashes(self.h, 2)

    def threes(self, bits: int) -> np.ndarray:
        """The cells of three words, for each word but the last two."""
        return (sequence_hashes(self.h, 3) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """The words with a space behind each, and where each begins, with an end."""
        gap = (self.data == 10) | (self.data == 32)
        kept = ~gap
        kept[self.ends] = True  # the first of the gap behind each word
        text = np.where(gap, np.uint8(32), self.data)[kept].tobytes()
        return text, np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))


def _place(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _bitmap(hashes: DataFrame):
    """A broadcast of 8 MB in which ``holds`` finds every ``h`` by its ``_place``."""
    at = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    rows = hashes.select(at.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[np.asarray(rows.column("at"))] = np.asarray(rows.column("bits"))
    return hashes.sparkSession.sparkContext.broadcast(bits)


class _Pairs:
    """Pairs of one language, counted: their hashes, numbers and texts."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, h: np.ndarray, n: np.ndarray, texts: np.ndarray) -> None:
        self.parts.append((h, n, texts))
        self.size += len(h)

    def merge(self) -> None:
        h, n, texts = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        u, first, of = np.unique(h, return_index=True, return_inverse=True)
        self.parts = [(u, np.bincount(of, n, len(u)).astype(np.int64), texts[first])]
        self.size = len(u)

    def rows(self, lang: str) -> pa.RecordBatch:
        self.merge()
        ((h, n, texts),) = self.parts
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), _strings(texts.tolist()), pa.array(n)], ["lang", "phrase", "n"])


def _count_pairs(frequent):
    """(lang, phrase, n): pairs of frequent words, those of some megabytes counted."""

    def run(batches):
        held: dict[str, _Pairs] = {}
        for lang, data in _texts(batches):
            c = _Chunk(lang, data)
            keep = holds(frequent.value, _place(c.h))
            at = np.flatnonzero(c.near & keep[:-1] & keep[1:])
            h, first, n = np.unique(c.pairs[at], return_index=True, return_counts=True)
            at = at[first]
            spaced, begins = c.spaced()
            texts = np.empty(len(at), object)
            texts[:] = [spaced[a:b] for a, b in zip(begins[at].tolist(), (begins[at + 2] - 1).tolist(), strict=True)]
            own = held.setdefault(lang, _Pairs())
            own.add(h, n, texts)
            if sum(p.size for p in held.values()) > 4 * _HELD:
                for p in held.values():
                    if p.size:
                        p.merge()
                if sum(p.size for p in held.values()) > 2 * _HELD:
                    yield from (p.rows(k) for k, p in held.items() if p.size)
                    held.clear()
        yield from (p.rows(k) for k, p in held.items() if p.size)

    return run


def _with_hashes(batches):
    """(lang, phrase, h, n) of pairs (lang, phrase, n); hashes are made again for the few that are frequent, not dealt with all."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            own = batch.filter(pa.array(langs == lang))
            texts = own.column("phrase").cast(pa.binary()).to_pylist()
            c = _Chunk(lang, b"\n".join(texts) + b"\n")
            yield pa.RecordBatch.from_arrays([own.column("lang"), own.column("phrase"), pa.array(c.pairs[c.near].view(np.int64)), own.column("n")], ["lang", "phrase", "h", "n"])


def _sift(frequent, bits: int):
    """(block, cells): how often three words of two frequent pairs fall on each cell, up to 255."""

    def run(batches):
        cells = np.zeros(1 << bits, np.uint8)
        for lang, data in _texts(batches):
            c = _Chunk(lang, data)
            grows = c.near & holds(frequent.value, _place(c.pairs))
            at, n = np.unique(c.threes(bits)[grows[:-1] & grows[1:]], return_counts=True)
            cells[at] = np.minimum(cells[at] + n, 255)
        for k in range(0, len(cells), _BLOCK):
            if cells[k : k + _BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK], pa.int32()), pa.array([cells[k : k + _BLOCK].tobytes()], pa.binary())], ["block", "cells"])

    return run


def _add(least: int):
    """(block, bits): a bit for each cell of which all tasks together have counted ``least``, from rows sorted by block."""

    def run(batches):
        block, total = None, None

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= min(least, 255)).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for k, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                own = np.frombuffer(cells, np.uint8).astype(np.int64)
                if k != block:
                    if block is not None:
                        yield packed()
                    block, total = k, np.zeros(len(own), np.int64)
                total += own
        if block is not None:
            yield packed()

    return run


def _threes(rows: DataFrame, pairs, bits: int, least: int):
    """A broadcast of a bit for each cell that three words in sequence may be frequent in, of 4 MB at most."""
    spark = rows.sparkSession
    blocks = rows.mapInArrow(_sift(pairs, bits), "block int, cells binary").repartition(partitions(spark), "block").sortWithinPartitions("block")
    found = blocks.mapInArrow(_add(least), "block int, bits binary").toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for k, x in zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[k * _BLOCK // 8 :][: len(x)] = np.frombuffer(x, np.uint8)
    return spark.sparkContext.broadcast(out)


def _project(pairs, threes, bits: int, hot_words: np.ndarray, hot_pairs: np.ndarray, longest: int):
    """(lang, depth, pointer, n): three words or more from a prefix on, each with a space behind it, that may grow; ``depth`` of them say where it is dealt."""

    def rows(held):
        for (lang, depth), c in held.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array([depth] * len(c), pa.int32()), _strings(list(c)), pa.array(c.values(), pa.int64())], ["lang", "depth", "pointer", "n"])

    def run(batches):
        held: dict[tuple[str, int], Counter] = {}
        for lang, data in _texts(batches):
            c = _Chunk(lang, data)
            grows = c.near & holds(pairs.value, _place(c.pairs))
            cell = c.threes(bits)
            grows = grows[:-1] & grows[1:] & (threes.value[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
            at = np.flatnonzero(grows)
            size, more = np.full(len(at), 3), np.ones(len(at), bool)
            for k in range(1, longest - 2):
                more &= np.append(grows, np.zeros(k, bool))[at + k]
                size += more
            depth = np.where(np.isin(c.h[at], hot_words), np.where(np.isin(c.pairs[at], hot_pairs), longest, 2), 1)
            text, begins = c.spaced()
            starts, ends = begins[at], begins[at + size]
            for d in (1, 2, longest):
                own = depth == d
                if own.any():
                    held.setdefault((lang, d), Counter()).update([text[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            if sum(map(len, held.values())) > _HELD:
                yield from rows(held)
                held.clear()
        yield from rows(held)

    return run


def _grow(least: int):
    """(lang, phrase, n) of the prefixes of three words or more of pointers sorted by (lang, pointer): frequent ones, and of those dealt to several tasks this task's share."""

    def run(batches):
        stack: list[list] = []  # [word, count] from the first word on
        lang, deal, out = None, 1, []

        def close(depth):
            while len(stack) > depth:
                if len(stack) > 2 and (stack[-1][1] >= least or len(stack) < deal):
                    out.append((lang, " ".join([w for w, _ in stack]), stack[-1][1]))
                stack.pop()

        def made():
            rows = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "n"])
            out.clear()
            return rows

        for batch in batches:
            for l, d, p, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "depth", "pointer", "n")), strict=True):
                own = p[:-1].split(" ")
                same = 0
                if l == lang:
                    for w, (x, _) in zip(own, stack, strict=False):
                        if w != x:
                            break
                        same += 1
                close(same)
                lang, deal = l, d
                for x in stack:
                    x[1] += n
                stack += [[w, n] for w in own[same:]]
            yield made()
        close(0)
        yield made()

    return run


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n), (lang, total)): phrases of up to ``longest`` words with ``least`` occurrences, and the number of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(_UND)).alias("lang"), F.col(text_col).cast("binary").alias("t"))
    counted = rows.mapInArrow(_count_words, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    counted = written(counted.where((F.col("n") >= least) | F.col("word").isNull()))
    single = counted.where("word is not null")
    totals = counted.where("word is null").select("lang", F.col("n").alias("total"))
    share = (totals.agg(F.sum("total")).first()[0] or 0) / HOT
    hot = lambda c: np.sort(np.asarray(c.where(F.col("n") > share).select("h").toArrow().column("h"), np.int64).view(np.uint64))  # noqa: E731  fewer than HOT
    pairs = rows.mapInArrow(_count_pairs(_bitmap(single)), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    pairs = written(pairs.where(F.col("n") >= least).mapInArrow(_with_hashes, "lang string, phrase string, h long, n long"))
    two = single.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n").unionByName(pairs.select("lang", "phrase", F.lit(2).alias("words"), "n"))
    if longest < 3:
        return two.where(F.col("words") <= longest), totals
    bits = min(MOST_BITS, max(LEAST_BITS, int(share * HOT / WORDS_A_CELL).bit_length()))
    frequent = _bitmap(pairs)
    threes = _threes(rows, frequent, bits, least)
    pointers = rows.mapInArrow(_project(frequent, threes, bits, hot(single), hot(pairs), longest), "lang string, depth int, pointer string, n long")
    prefix = F.when(F.col("depth") < longest, F.expr("substring_index(pointer, ' ', depth)")).otherwise(F.col("pointer"))
    pointers = pointers.withColumn("prefix", F.xxhash64("lang", prefix))
    pointers = pointers.repartition(partitions(spark), "prefix").sortWithinPartitions("lang", "pointer")
    grown = pointers.select("lang", "depth", "pointer", "n").mapInArrow(_grow(least), "lang string, phrase string, n long")
    grown = grown.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    size = F.size(F.split("phrase", " ", -1))
    phrases = grown.select("lang", "phrase", size.alias("words"), "n").unionByName(two)
    return written(phrases), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` collocations of each language.

    Phrases are words in sequence inside a piece of a text, which ends at a mark
    or a line end; ``a`` is a phrase's occurrences, ``l`` and ``r`` those of the two
    parts of its weakest cut, ``n`` the words of the language, ``score``
    1000 * a * n / (l * r), rounded down, exactly. Phrases inside a longer one that
    occurs as often are left out. Ranks go by score, ``a`` and phrase, so ties
    have one order. A null language is ``und``, null and empty texts have no
    words, repeated rows count again, texts of any length are read as wholes;
    further columns are ignored, no rows give no rows.
    """
    phrases, totals = frequent_phrases(docs, lang_col, text_col, longest, least)
    candidates = phrases.where("words > 1")
    w = F.split("phrase", " ", -1)
    cut = F.col("cut")
    cuts = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "words", "a", "cut", F.array_join(F.slice(w, F.lit(1), cut), " ").alias("left"), F.array_join(F.slice(w, cut + 1, F.col("words") - cut), " ").alias("right"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    whole = lambda c: f"cast({c} as decimal(19, 0))"  # noqa: E731  products of two have 38 digits
    score = F.expr(f"cast((cast(1000 as decimal(4, 0)) * ({whole('a')} * {whole('total')})) div ({whole('l')} * {whole('r')}) as bigint)")
    best = cuts.select("lang", "phrase", "words", "a", F.col("total").alias("n"), F.struct(score.alias("score"), "cut", "l", "r").alias("c")).groupBy("lang", "phrase", "words", "a", "n").agg(F.min("c").alias("c"))
    # a longer phrase as frequent has one of a word more inside that is
    inside = F.array(F.array_join(F.slice(w, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("words") - 1), " "))
    longer = candidates.where("words > 2").select("lang", F.explode(inside).alias("phrase"), F.col("n").alias("a")).distinct()
    best = best.join(longer, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each share first, so that no task orders a whole language
    best = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_prefix_growth_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, '{_UND}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) r(k)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * u.a * t.n // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM u JOIN f x ON x.lang = u.lang AND x.k = u.cut AND x.phrase = array_to_string(u.w[1:u.cut], ' ')
  JOIN f y ON y.lang = u.lang AND y.k = u.k - u.cut AND y.phrase = array_to_string(u.w[u.cut + 1:], ' ') JOIN t ON t.lang = u.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
d AS (SELECT DISTINCT lang, array_to_string(w[i:j], ' ') AS phrase, a FROM c, range(1, {LONGEST + 1}) x(i), range(1, {LONGEST + 1}) y(j) WHERE i < j AND j <= k AND j - i + 1 < k),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
  WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase AND d.a >= b.a))
SELECT * FROM o WHERE rank <= {FIRST}"""
