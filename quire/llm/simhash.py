"""Near-duplicate documents by SimHash and deletion-variant signatures.

A document's fingerprint has 64 bits; a bit is 1 if it is set in over half the
XXH64 hashes (seed 42) of the document's four-word shingles, repeats included.
Documents with one fingerprint are one class, so that copies cost one row.

Two fingerprints that differ in at most ``radius`` bits, cut into
``radius // 2 + 1`` segments, have a segment that differs in one bit at most (cut
into ``radius + 1`` they would have an equal, but much shorter one). Every segment
is indexed under its one-wildcard variants, one for each of its bits, with that bit
left out: two segments that differ in one bit have the variant without it in
common, equal ones all of theirs. So an equality join on 64 variants finds every
pair, and the full fingerprints confirm it.

The join doesn't make a bucket's pairs. A task takes a bucket's fingerprints,
in blocks of at most ``TILE``, and returns links that join what is within the
radius, as many as a forest has. Buckets of several blocks then compare the
members of different components across blocks, without the pairs inside the
bucket's largest component. No link between components is passed over.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import partitions, table, written
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a bucket that one task holds at a time.
TILE = 4096
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 20
#: Groups of up to this many are compared by shifting whole columns.
SMALL = 9
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(text: bytes, k: int):
    """Arrays of the hashes of a text's k-word shingles, a part of the text at a time."""
    at, held, some = 0, [], False
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        held += text[at:end].lower().split()
        at = end
        n = len(held) - k + 1
        if n > 0:
            some = True
            joined, sizes = b" ".join(held), np.fromiter(map(len, held), np.int64, len(held))
            ends = np.cumsum(sizes + 1) - 1
            spans = zip((ends[:n] - sizes[:n]).tolist(), ends[k - 1 :].tolist(), strict=True)
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
            held = held[n:]
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit number; 0 without words."""
    votes, n = np.zeros(64, np.int64), 0
    for h in _hashes(text, k):
        n += len(h)
        for a in range(0, len(h), 1 << 14):
            votes += np.unpackbits(h[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0]) if n else 0


def _sign(batches):
    for batch in batches:
        prints = [fingerprint(t.as_py() or b"") for t in batch.column("t")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], ["id", "fp"])


def segments(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments, of which one differs in one bit at most; the radius is 2 or more, so that a segment has at most 32 bits."""
    if not 2 <= radius < 64:
        raise ValueError(f"no segments for a radius of {radius}")
    n = radius // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(radius: int = RADIUS):
    """The bucket keys of the column ``fp``: for every bit of a segment its place and the segment without it.

    A key is one number: the bit's place above, the segment's bits, at most 32, below.
    """
    keys = []
    for a, size in segments(radius):
        for b in range(size):
            own = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << size) - 1 - (1 << b)).cast("long"))
            keys.append(own.bitwiseOR(F.lit((a + b) << 32).cast("long")))
    return F.array(*keys)


class _Forest:
    """Joins members to components, and keeps a link for each join."""

    def __init__(self, fp: np.ndarray, comp: np.ndarray, radius: int):
        self.fp, self.comp, self.radius, self.links = fp, np.unique(comp, return_inverse=True)[1], radius, []

    def join(self, i: int, others: np.ndarray) -> None:
        """Links i with one member of each other component among ``others`` that has one within the radius."""
        others = others[self.comp[others] != self.comp[i]]
        near = others[np.bitwise_count(self.fp[others] ^ self.fp[i]) <= self.radius]
        if len(near):
            found, first = np.unique(self.comp[near], return_index=True)
            self.links += [(int(self.fp[i]), int(self.fp[j])) for j in near[first]]
            self.comp[np.isin(self.comp, found)] = self.comp[i]


def _groups(batches, by: list[str], columns: list[str]):
    """(arrays of ``columns``, starts of the groups, with an end) of whole groups of sorted rows."""
    left = None
    for batch in batches:
        now = {c: np.asarray(batch.column(c)) for c in by + columns}
        if left:
            now = {c: np.concatenate((left[c], now[c])) for c in now}
        n = len(now[by[0]])
        if not n:
            continue
        edge = np.zeros(n, bool)
        edge[0] = True
        for c in by:
            edge[1:] |= now[c][1:] != now[c][:-1]
        starts = np.flatnonzero(edge)
        yield now, starts  # the last start is that of a group that may go on
        left = {c: now[c][starts[-1] :] for c in now}
    if left:
        yield left, np.array([0, len(left[by[0]])])


def _table(links) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _within(radius: int):
    """Links inside the groups of rows sorted by (key, block)."""

    def run(batches):
        for rows, starts in _groups(batches, ["key", "block"], ["fp"]):
            sizes = np.diff(starts)
            fp = rows["fp"][: starts[-1]].view(np.uint64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            small, links = sizes[of] <= SMALL, []
            for d in range(1, SMALL):
                at = np.flatnonzero((of[d:] == of[:-d]) & small[d:])
                at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
                links += zip(fp[at].view(np.int64).tolist(), fp[at + d].view(np.int64).tolist(), strict=True)
            for g in np.flatnonzero(sizes > SMALL):
                own = fp[starts[g] : starts[g + 1]]
                f = _Forest(own.view(np.int64), np.arange(len(own)), radius)
                for i in range(len(own) - 1):
                    f.join(i, np.arange(i + 1, len(own)))
                links += f.links
            yield _table(links)

    return run


def _across(radius: int):
    """Links between the rows of the lower and of the higher block of each tile, sorted by (key, low, high)."""

    def run(batches):
        for rows, starts in _groups(batches, ["key", "low", "high"], ["block", "fp", "comp"]):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                f = _Forest(rows["fp"][a:b], rows["comp"][a:b], radius)
                higher = np.flatnonzero(rows["block"][a:b] == rows["high"][a])
                for i in np.flatnonzero(rows["block"][a:b] == rows["low"][a]):
                    f.join(i, higher)
                yield _table(f.links)

    return run


def _deal(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links of the distinct fingerprints ``fp`` that make the components that all pairs within the radius make."""
    members = prints.select("fp", F.explode(variants(radius)).alias("key"))
    large = written(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
    m = members.join(large, "key", "left")
    block = F.coalesce(F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / TILE)), F.lit(0))
    near = written(_deal(m.select("key", block.alias("block"), "fp"), "key", "block").mapInArrow(_within(radius), "a long, b long").distinct())
    if large.isEmpty():
        return near
    comp = components(near).withColumnRenamed("node", "fp")
    m = members.join(large, "key").join(comp, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("comp"))
    sizes = m.groupBy("key", "comp").agg(F.count("*").alias("m"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("comps")).where("comps > 1")
    open_ = written(open_.select("key", F.col("top.comp").alias("main"), F.ceil(F.col("top.m") / TILE).alias("mains"), F.ceil((F.col("m") - F.col("top.m")) / TILE).alias("others")))
    m = m.join(open_, "key")
    inner = F.col("comp") == F.col("main")
    place = F.when(inner, F.pmod(F.xxhash64("fp"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("fp"), F.col("others")))
    start = F.when(inner, F.col("mains")).otherwise(F.lit(0).cast("long"))
    m = m.withColumn("block", place).withColumn("with", F.explode(F.sequence(start, F.col("mains") + F.col("others") - 1)))
    m = m.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "fp", "comp")
    return near.unionByName(_deal(m, "key", "low", "high").mapInArrow(_across(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` has 16 lowercase hexadecimal digits. Texts of fewer than four
    words have the hash of their whole sequence, null texts and texts without a
    word zero, and are linked like any other. Texts of any length are read in
    parts, as wholes. ``component_id`` is the smallest id that links reach, the
    row's own included. Rows with one id are one node, linked by the text of any
    of them; rows with a null id are linked with nothing, and their component is
    null. Repeated rows get equal results, further columns are ignored, and no
    rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    signed = written(rows.mapInArrow(_sign, "id long, fp long"))
    some = signed.where("id is not null")
    classes = written(some.groupBy("fp").agg(F.min("id").alias("rep")))
    # texts of one id link their fingerprints
    several = some.groupBy("id").agg(F.min("fp").alias("b"), F.max("fp").alias("z")).where("b <> z").select("id", "b")
    same = some.join(several, "id").where("fp <> b").select(F.col("fp").alias("a"), "b")
    comp = components(links(classes, radius).unionByName(same)).withColumnRenamed("node", "fp")
    of = written(classes.join(comp, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")))
    least = written(of.groupBy("component").agg(F.min("rep").alias("component_id")))
    of = written(of.join(least, "component").select("fp", "component_id"))
    hex_ = F.lpad(F.lower(F.hex("fp")), 16, "0")
    out = signed.join(of, "fp", "left")
    return out.select(F.col("id").alias("doc_id"), hex_.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_deletion_variant_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
