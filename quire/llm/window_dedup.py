"""Removing passages of 50 words or more that an earlier document has.

A window is 50 consecutive words. Its key is the smallest hash among the
25-word runs in it, so equal windows have equal keys and neighbours mostly
share one. A first pass counts in how many documents each key is, in a
count-min sketch: every partition fills one, and they are merged into a bit
for each cell that says whether two documents or more fell on it. The sketch
never says less than the truth. A second pass groups exactly, by 96 bits of hash
of all 50 words, the windows whose key the sketch estimates to be repeated:
at 10**13 windows a chance collision is expected in fewer than one corpus of a
thousand. A third pass cuts the words.

The exact grouping goes by spans first, the neighbouring windows that share a
key. Where an earlier document has the whole span, all its windows go; only the
first document of each span hands on its windows one by one, for those that
other spans of earlier documents have too.

The merged sketch is broadcast. It has a cell for every eight bytes that Spark
estimates for the texts, but at most 3 x 2**29 bits (201 MB). With very many more
keys than cells it lets more windows through to the exact pass, which is then
slower but no less right.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bit, bitmap, bytes_of, cut, holds, partitions, table, written
from ._text import chunks, mix, sequence_hashes, word_hashes, words

WINDOW, RUN = 50, 25
DEPTH, BLOCK_BITS = 3, 16
#: Cells of a row of the sketch, as a power of 2: for small inputs, and at most.
LEAST_BITS, MOST_BITS = 20, 29
#: Cells that a task holds before it hands them on, and windows of a span at most.
HELD, SPAN = 1 << 21, 1 << 12
SPANS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))


def window_keys(column: pa.Array, window: int = WINDOW, run: int = RUN, second: bool = False):
    """(row, window hashes, second hashes or None, keys) for texts with a window, in order; the j-th window starts at word j."""
    for a, b, data, offsets in chunks(column):
        starts, ends, first = words(data, offsets)
        long = np.flatnonzero(np.diff(first) >= window)
        if not len(long):
            continue
        h = word_hashes(data, starts, ends)
        whole = sequence_hashes(h, window)
        other = sequence_hashes(h, window, 1) if second else None
        m, have, want = sequence_hashes(h, run), 1, window - run + 1
        while 2 * have <= want:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < want:
            m = np.minimum(m[: len(m) - (want - have)], m[want - have :])
        for i in long:
            lo, hi = first[i], first[i + 1] - window + 1
            yield a + int(i), whole[lo:hi], None if other is None else other[lo:hi], m[lo:hi]


def cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(keys ^ seed) >> np.uint64(64 - bits)).astype(np.int64) for seed in _SEEDS[:DEPTH]]


def cell_bits(texts: DataFrame) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (bytes_of(texts, "t") // 8).bit_length()))


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], keys[1:] != keys[:-1]))


class _Cells:
    """For each row of the sketch the cells that one document fell on, and those that more did."""

    def __init__(self, bits: int):
        self.bits, self.waiting, self.held = bits, [], 0
        self.once = [np.zeros(0, np.int64)] * DEPTH
        self.twice = [np.zeros(0, np.int64)] * DEPTH

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(cells(np.unique(keys[_runs(keys)]), self.bits))
        self.held += len(self.waiting[-1][0])
        if self.held > 1 << 18:
            self.merge()

    def merge(self) -> None:
        for r in range(DEPTH):
            own = [np.unique(c[r]) for c in self.waiting]
            x, n = np.unique(np.concatenate([*own, self.once[r]]), return_counts=True)
            self.once[r], self.twice[r] = x, np.union1d(self.twice[r], x[n > 1])
        self.waiting.clear()
        self.held = 0

    def batches(self):
        self.merge()
        low = lambda x: (x & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        for r in range(DEPTH):
            once, twice = self.once[r], self.twice[r]
            blocks = once >> BLOCK_BITS
            at = np.flatnonzero(_runs(blocks)) if len(blocks) else np.zeros(0, np.int64)
            names = blocks[at]
            one = np.split(low(once), at[1:]) if len(at) else []
            ends = np.searchsorted(twice >> BLOCK_BITS, np.stack([names, names + 1]))
            two = low(twice)
            yield pa.RecordBatch.from_arrays(
                [pa.array((names + (r << max(0, self.bits - BLOCK_BITS))).astype(np.int32)), pa.array([x.tobytes() for x in one], pa.binary()), pa.array([two[i:j].tobytes() for i, j in ends.T], pa.binary())],
                ["block", "once", "twice"],
            )


def _merge(batches):
    """Sorted by block: a bit for each cell that two documents or more fell on."""
    block, counts = None, None

    def packed():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["block", "bits"])

    for batch in batches:
        for b, once, twice in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "twice")), strict=True):
            if b != block:
                if block is not None:
                    yield packed()
                block, counts = b, np.zeros(1 << BLOCK_BITS, np.uint8)
            x = np.frombuffer(once, np.uint16)
            counts[x] = np.minimum(counts[x] + 1, 2)
            counts[np.frombuffer(twice, np.uint16)] = 2
    if block is not None:
        yield packed()


def sketch(docs: DataFrame, bits: int) -> bytes:
    """The merged sketch of the texts in ``t``: 3 * 2**bits bits."""

    def fill(batches):
        held = _Cells(bits)
        for batch in batches:
            for _, _, _, keys in window_keys(batch.column("t")):
                held.add(keys)
                if len(held.once[0]) > HELD:  # documents of one task fall into several partial sketches, which add up
                    yield from held.batches()
                    held = _Cells(bits)
        yield from held.batches()

    filled = docs.select("t").mapInArrow(fill, "block int, once binary, twice binary")
    merged = filled.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary")
    out = bytearray(DEPTH << (bits - 3))
    size = 1 << (BLOCK_BITS - 3)
    for r in merged.toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = r.bits
    return bytes(out)


def repeated(sketched: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether the sketch says that each key is in two documents or more."""
    view, change = np.frombuffer(sketched, np.uint8), _runs(keys)
    bits = (len(view) * 8 // DEPTH).bit_length() - 1
    ok = np.ones(int(change.sum()), bool)
    for r, c in enumerate(cells(keys[change], bits)):
        c = c + (r << bits)
        ok &= (view[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return ok[np.cumsum(change) - 1]


def _finish(batches):
    for batch in batches:
        kept, digest, n, removed = [], [], [], []
        gone = batch.column("gone")
        for i, t in enumerate(batch.column("t")):
            w = (t.as_py() or b"").split()
            n.append(len(w))
            if gone[i].is_valid:
                out = np.zeros(len(w) + 1, np.int64)
                spans = gone[i].values
                at, size = (spans.field(k).to_numpy() for k in ("at", "n"))
                np.add.at(out, at, 1)
                np.subtract.at(out, at + size - 1 + WINDOW, 1)
                cover = np.cumsum(out)[: len(w)] > 0
                w = [x for x, c in zip(w, cover.tolist(), strict=True) if not c]
            removed.append(n[-1] - len(w))
            kept.append(b" ".join(w))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of ``docs``.

    ``kept`` is the text left, words joined by single spaces. Null texts count
    as empty and texts of fewer than 50 words lose nothing. Rows with one id are
    one document, whose windows aren't later than each other; each row loses
    the windows of its own text. Rows with a null id are neither earlier nor later
    than any, and lose nothing. Texts of any length are read as wholes, in parts.
    Further columns are ignored, no rows give no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    known = docs.where("id is not null and t is not null")
    shared = docs.sparkSession.sparkContext.broadcast(sketch(known, cell_bits(known)))

    def candidates(batches):
        """The spans of windows to be grouped."""
        for batch in batches:
            ids, tags = (np.asarray(batch.column(c)) for c in ("id", "tag"))
            out, held = [], 0
            for i, whole, other, keys in window_keys(batch.column("t"), second=True):
                ok = repeated(shared.value, keys)
                if not ok.any():
                    continue
                at = np.flatnonzero(_runs(keys))
                j = np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys)))) & SPAN - 1
                at = np.flatnonzero(j == 0)
                size = np.diff(np.append(at, len(keys)))
                ok, rows_ = ok[at], np.repeat(ok[at], size)
                j = j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                s, s2 = np.add.reduceat(mix(whole + j), at)[ok], np.add.reduceat(mix(other + j), at)[ok]
                n = int(ok.sum())
                out.append((np.full(n, ids[i]), np.full(n, tags[i]), at[ok].astype(np.int32), s.view(np.int64), (s2 >> np.uint64(32)).astype(np.uint32).view(np.int32), size[ok], whole[rows_].view(np.int64), (other[rows_] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                held += len(out[-1][6])
                if held > 1 << 17:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    def rows(out):
        *own, size, h, g = (np.concatenate(x) for x in zip(*out, strict=True))
        ends = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h, g)]
        return pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(size.astype(np.int32)), *lists], ["id", "tag", "at", "s", "s2", "n", "h", "g"])

    tagged = known.select("id", F.xxhash64("t").alias("tag"), "t")
    found = written(tagged.mapInArrow(candidates, "id long, tag long, at int, s long, s2 int, n int, h array<long>, g array<int>"))
    # first ids are tables of their own: Spark splits a span or window with very many rows only where the other side isn't an aggregate of the same shuffle
    earliest = lambda of, *by: cut(of.groupBy(*by).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select(*by, "first"))
    spans = earliest(found, "s", "s2")
    covered = found.select("id", "tag", "at", "n", "s", "s2").join(spans, ["s", "s2"]).where("id > first").select("id", "tag", "at", "n")
    own = found.join(spans, ["s", "s2"], "left").where("first is null or id = first")
    own = own.select("id", "tag", "at", F.posexplode(F.arrays_zip("h", "g")).alias("j", "w"))
    own = written(own.select("id", "tag", (F.col("at") + F.col("j")).alias("at"), "w.h", "w.g"))
    later = own.join(earliest(own, "h", "g"), ["h", "g"]).where("id > first").select("id", "tag", "at", F.lit(1).alias("n"))
    gone = covered.unionByName(later).groupBy("id", "tag").agg(F.collect_set(F.struct("at", "n")).alias("gone"))
    gone = cut(gone)
    loses = bitmap(gone.select("id"))

    def hit(batches):
        """Documents that may lose a word; they go on to where their spans are."""
        for batch in batches:
            yield batch.select(["doc_id", "tag", "t"]).filter(pa.array(holds(loses.value, np.asarray(batch.column("bit")))))

    def rest(batches):
        """The others are done where they are."""
        for batch in batches:
            whole = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False) | ~holds(loses.value, np.asarray(batch.column("bit")))
            b = batch.select(["doc_id", "t"]).filter(pa.array(whole))
            yield from _finish([b.append_column("gone", pa.nulls(b.num_rows, SPANS))])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    own = docs.select(F.col("id").alias("doc_id"), F.xxhash64("t").alias("tag"), "t", bit(F.col("id")).alias("bit"))
    moved = own.where("doc_id is not null").mapInArrow(hit, "doc_id long, tag long, t binary").join(gone.withColumnRenamed("id", "doc_id"), ["doc_id", "tag"], "left")
    return own.mapInArrow(rest, schema).unionByName(moved.select("doc_id", "t", "gone").mapInArrow(_finish, schema))


def op10_count_min_windows(spark, sf_dir):
    return dedup_windows(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM w WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM x JOIN f USING (h) WHERE doc_id > first),
k AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM w),
t AS (SELECT k.doc_id, count(*) AS n, count(g.k) AS gone, coalesce(string_agg(x, ' ' ORDER BY k.k) FILTER (g.k IS NULL), '') AS kept FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.k = g.k GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t USING (doc_id)
"""
