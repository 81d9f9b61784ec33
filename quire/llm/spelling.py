"""Spelling variants: words that one edit turns into each other, by errata-trie merging.

The words make a trie. At each node the edge with most words below is heavy, the
others are light, and so is the end of a word; a word has at most log2(words)
light edges. Two words one edit apart part at a node, and at least one of them by
a light edge. There the light subtree is merged into the others of the node with
one character skipped or replaced, small to large; terminals that coincide are
the pairs:

- replaced: the light word with the heavy edge's character for its own is a word;
- replaced, both light: the words are equal but for their characters at the node;
- skipped in the light word: the word without its character at the node is a word;
- skipped in the heavy word: the light word with the heavy character before its own is.

No task holds the trie. A node is a table row, known by a polynomial hash of its
prefix and its depth, and heavy edges are counts of rows; a word with an edit has
a hash that follows from sums that its prefixes have. So coinciding terminals are
an equality join of hashes, confirmed on the words. Equal strings have equal
hashes, and any choice of heavy edges is complete, so chance agreement of hashes
costs a comparison but no pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, table, written
from ._text import mix, powers

#: Fixed values of the misspelling that the texts are given: one run in so many loses a character.
DROPPED = 199
SHORTEST, LEAST = 6, 5
#: How many times as frequent as the word its form is.
TIMES = 5
#: Nodes with over a share of one in this many of all rows are joined by broadcast: fewer than so many, of 16 bytes.
TOP = 1 << 15
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_CHUNK = 1 << 20
_HELD = 1 << 18
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _runs(text: str):
    """Lists of a text's runs, a part of the text at a time."""
    at = 0
    while at < len(text):
        end = at + _CHUNK
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def _count(batches):
    """(word, n): the runs of (id, t), misspelt, with those of a batch or more counted."""
    held: Counter[str] = Counter()

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return rows

    for batch in batches:
        for i, t in zip(batch.column("id"), batch.column("t"), strict=True):
            own: Counter[str] = Counter()
            for runs in _runs((t.as_py() or b"").lower().decode("utf-8", "replace")):
                own.update(runs)
            start = zlib.crc32(f"{'' if i.as_py() is None else i}:".encode())
            for run, n in own.items():
                h = zlib.crc32(run.encode(), start)
                if h % DROPPED == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
                if len(run) >= SHORTEST:
                    held[run] += n
            if len(held) > _HELD:
                yield flush()
    if held:
        yield flush()


def _letter(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(1))


def _tries(words: pa.Array):
    """(codes, offsets, sums): the characters of all words, where each begins, and the hash of the prefix before each place of each word.

    ``sums`` has one place more a word than it has characters: its last is the word's own hash.
    """
    texts = words.to_pylist()
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= _CHUNK):
            size += len(texts[b])
            b += 1
        n = np.array([len(t) for t in texts[a:b]])
        codes = np.frombuffer("".join(texts[a:b]).encode("utf-32-le"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum(n)))
        p, q = powers(len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_letter(codes) * p[:-1], out=total[1:])
        ends = np.cumsum(n + 1)
        place = np.arange(ends[-1]) - np.repeat(ends - n - 1, n + 1)  # 0 to n in each word
        start = np.repeat(offsets[:-1], n + 1)
        yield a, b, codes, n, place, (total[start + place] - total[start]) * q[start]
        a = b


def _hashed(batches):
    for batch in batches:
        for a, b, _, n, _, sums in _tries(batch.column("word")):
            own = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([own.column("word"), own.column("n"), pa.array(sums[np.cumsum(n + 1) - 1].view(np.int64))], ["word", "n", "h"])


def _walk(batches):
    """(prefix, depth, edge, h): a row for every edge on the way of each word; the edge of its end is -1."""
    for batch in batches:
        for _, _, codes, n, place, sums in _tries(batch.column("word")):
            last = np.cumsum(n + 1) - 1
            edge = np.full(len(sums), -1, np.int32)
            inside = np.ones(len(sums), bool)
            inside[last] = False
            edge[inside] = codes
            rows = [sums.view(np.int64), place.astype(np.int32), edge, np.repeat(sums[last], n + 1).view(np.int64)]
            for k in range(0, len(sums), _CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + _CHUNK]) for x in rows], ["prefix", "depth", "edge", "h"])


def _errata(batches):
    """(h, key, depth): of each light edge of a word the hashes that it coincides with.

    Depth -1 marks the hash of a whole word to look up, others that of the word
    without its character at that depth, which another light word may have too.
    """
    for batch in batches:
        prefix, h = (np.asarray(batch.column(c)).view(np.uint64) for c in ("prefix", "h"))
        depth, edge, heavy = (np.asarray(batch.column(c)) for c in ("depth", "edge", "heavy"))
        p = powers(int(depth.max(initial=0)) + 1)[0][depth]
        inner = edge >= 0
        more = _letter(heavy) * p
        inserted = prefix + more + (h - prefix) * _BASE
        own = _letter(np.where(inner, edge, 0)) * p
        replaced = (h - own + more)[inner]
        skipped = (prefix + (h - prefix - own) * _INVERSE)[inner]
        wild = (h - own)[inner]
        keys = np.concatenate((inserted, replaced, skipped, wild)).view(np.int64)
        depths = np.concatenate((np.full(len(h) + 2 * len(wild), -1, np.int32), depth[inner]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((h, h[inner], h[inner], h[inner])).view(np.int64)), pa.array(keys), pa.array(depths)], ["h", "key", "depth"])


def _one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes one word of the other, in time linear in their length."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _confirm(batches):
    for batch in batches:
        yield batch.filter(pa.array([_one_edit(a, b) for a, b in zip(batch.column("word").to_pylist(), batch.column("near").to_pylist(), strict=True)], pa.bool_()))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, h): the words of ``LEAST`` occurrences, and their hashes."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("t"))
    n = rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return written(n.mapInArrow(_hashed, "word string, n long, h long"))


def light_edges(vocabulary: DataFrame) -> DataFrame:
    """(prefix, depth, edge, h, heavy): the light edges on the ways of the words (word, n, h), with the heavy edge beside each.

    Nodes near the root have very many rows, but only few nodes have; they are
    broadcast, which leaves the shuffled join without a large key.
    """
    walk = vocabulary.select("word").mapInArrow(_walk, "prefix long, depth int, edge int, h long")
    edges = walk.groupBy("prefix", "depth", "edge").agg(F.count("*").alias("n"))
    nodes = edges.groupBy("prefix", "depth").agg(F.sum("n").alias("n"), F.count("*").alias("edges"), F.max(F.when(F.col("edge") >= 0, F.struct("n", "edge"))).alias("top")).where("edges > 1")
    nodes = written(nodes.select("prefix", "depth", "n", F.col("top.edge").alias("heavy")))
    # n adds up to all rows of the ways at most, so fewer than TOP nodes have more than this
    share = (nodes.agg(F.sum("n")).first()[0] or 0) / TOP
    top = nodes.where(F.col("n") > share).drop("n")
    rest = nodes.where(F.col("n") <= share).drop("n")
    both = walk.join(F.broadcast(top), ["prefix", "depth"]).unionByName(walk.join(rest, ["prefix", "depth"]))
    return both.where("edge <> heavy").select("prefix", "depth", "edge", "h", "heavy")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every word with each word one edit away, both ways."""
    errata = written(light_edges(vocabulary).mapInArrow(_errata, "h long, key long, depth int"))
    hashes = vocabulary.select(F.col("h").alias("key"))
    found = errata.where("depth < 0").join(hashes, "key").select(F.col("h").alias("a"), F.col("key").alias("b"))
    # at most as many words as there are letters are equal but for one letter
    wild = errata.where("depth >= 0")
    other = wild.select("key", "depth", F.col("h").alias("b"))
    met = wild.join(other, ["key", "depth"]).where("h < b").select(F.col("h").alias("a"), "b")
    pairs = found.unionByName(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left = vocabulary.select(F.col("h").alias("a"), F.col("word"), F.col("n"))
    right = vocabulary.select(F.col("h").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = pairs.join(left, "a").join(right, "b").select("word", "n", "near", "near_n")
    pairs = written(pairs.mapInArrow(_confirm, "word string, n long, near string, near_n long").distinct())
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where the forms lead; every round doubles the steps."""
    rows = cut(forms.select("word", F.col("form").alias("root")))
    while not rows.join(rows.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        ahead = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        rows = cut(rows.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return rows


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``.

    Words are the runs of letters of the texts, A-Z in lower case, of which one in
    ``DROPPED``, by a hash of the row's id and the run, loses a character; those
    of at least six characters and five occurrences count. ``form`` is the most
    frequent word one edit away (ties: the first in code-point order) if it has
    at least five times as many occurrences, else null; ``root`` is where forms
    lead. Null and empty texts have no words, a null id counts as the empty
    text; repeated rows count again. Texts and words of any length are read as
    wholes. Further columns are ignored, no rows give no rows.
    """
    vocabulary = words(docs, id_col, text_col)
    near = near_pairs(vocabulary)
    best = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    most = -F.col("best.less")
    best = written(best.select("word", "n_near", F.when(most >= TIMES * F.col("n"), F.struct(F.col("best.near").alias("form"), most.alias("n"))).alias("f")).select("word", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")))
    roots = _roots(best.where("form is not null"))
    out = vocabulary.select("word", "n").join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_errata_trie_spelling(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))
