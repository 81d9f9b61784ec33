"""Near-duplicate documents by circulant MinHash.

A document is its set of distinct 5-word shingles. One permutation shuffles the
shingle universe (2**32 values), the other gives ranks; the k-th coordinate of
a signature is the smallest rank after a circular shift by k, so two
permutations make all 256 coordinates. Bands of 4 of the first 128 coordinates
make buckets (a pair at similarity 0.75 shares none of the 32 with probability
6e-6), and pairs of a bucket are confirmed on their full shingle sets.

A bucket isn't expanded into all its pairs. Documents with one shingle set are
one class, and a bucket holds classes. First each member is compared with the
bucket's hub, the member that shares most with others; what that links forms
components. Buckets that hold more than one component then compare the members
of different components, in tiles of bounded size, outside the largest component
only. A tile first looks at signatures, and only members with a promising
partner bring their texts; signatures that agree in fewer than 140 of 256 places
aren't promising (at similarity 0.75, where 192 agree on average, that is 7.5
standard deviations below: one pair in 10**13). So every pair that shares a bucket
is compared or already joined.

Counts of groups are tables of their own before they are joined, so that Spark
can split a class, bucket or hub with very many rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bit, bitmap, cut, holds, partitions, table
from ._text import mix, shingle_sets
from .components import components

COORDINATES, BANDED, ROWS = 256, 128, 4
AGREE = 140
TILE, TILE_SHINGLES = 256, 1 << 19
#: Members that one task compares with a hub's text before the text is sent again.
GROUP = 64


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row for each set, none of them empty."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), coordinates), np.uint32)
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:]), 1 << 15, "right")) + a)
        x = np.concatenate(sets[a:b])
        x = _permute((x ^ (x >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        at = np.concatenate(([0], np.cumsum(sizes[a : b - 1])))
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):
            np.subtract(x, np.uint32(k), out=y)  # the circular shift
            np.right_shift(y, np.uint32(16), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x85EBCA6B), out=y)
            np.right_shift(y, np.uint32(13), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0xC2B2AE35), out=y)
            np.right_shift(y, np.uint32(16), out=z)
            np.bitwise_xor(y, z, out=y)
            out[a:b, k] = np.minimum.reduceat(y, at)
        a = b
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit bucket keys, which differ from band to band."""
    s = sig.astype(np.uint64).reshape(len(sig), -1, rows)
    h = np.broadcast_to(np.arange(s.shape[1], dtype=np.uint64), s.shape[:2]).copy()
    for r in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return h


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, for sorted arrays of distinct values."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _sign(batches):
    for batch in batches:
        ids, n, h1, h2, sig, keys = batch.column("id"), [], [], [], [], []
        waiting: list[np.ndarray] = []

        def flush():
            full = [s for s in waiting if len(s)]
            m = signatures(full) if full else np.zeros((0, COORDINATES), np.uint32)
            rows = iter(zip(m, bands(m[:, :BANDED]), strict=True)) if full else iter(())
            for s in waiting:
                if len(s):
                    coordinates, k = next(rows)
                    y = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                    h1.append(int(y.sum(dtype=np.uint64).view(np.int64)))
                    h2.append(int(np.bitwise_xor.reduce(mix(y)).view(np.int64)))
                    sig.append((coordinates & np.uint32(255)).astype(np.uint8).tobytes())
                    keys.append(k.view(np.int64))
                else:
                    h1.append(0), h2.append(0), sig.append(b""), keys.append(np.zeros(0, np.int64))
                n.append(len(s))
            waiting.clear()

        held = 0
        for s in shingle_sets(batch.column("t")):
            waiting.append(s)
            held += len(s)
            if held > 1 << 18:
                flush()
                held = 0
        flush()
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
            ["id", "n", "h1", "h2", "sig", "keys"],
        )


def _compare(batches):
    """Sorted by (hub, salt, with the hub first): yields the (a, b) that are similar."""
    hub, own, met = None, [], True
    for batch in batches:
        a, b = [], []
        heads, ids = batch.column("hub").to_pylist(), batch.column("id").to_pylist()
        for head, i, s in zip(heads, ids, shingle_sets(batch.column("t")), strict=True):
            if i == head:
                if met or head != hub:
                    hub, own, met = head, [], False
                own.append(s)
                continue
            met = True
            if head == hub and any(similar(x, s) for x in own):
                a.append(i)
                b.append(head)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id may be among ``ids``: all that are, and few others.

    So most texts that are in no pair needn't be shuffled. A fuller bitmap lets
    more of them through.
    """
    shared = bitmap(ids)

    def run(batches):
        for batch in batches:
            yield batch.select(["id", "t"]).filter(pa.array(holds(shared.value, np.asarray(batch.column("h")))))

    return texts.select("id", "t", bit(F.col("id")).alias("h")).mapInArrow(run, "id long, t binary")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct (a, b) of ``pairs`` whose texts, in (id, t), are similar.

    Pairs are gathered by b in groups of about ``GROUP``, so that each text is
    compared as it streams by and a b in very many pairs goes to many tasks.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    texts = _among(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    n = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).alias("salts")))
    hubs = n.select(F.col("b").alias("id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    members = pairs.join(n, "b").select(F.col("a").alias("id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    rows = texts.join(members.unionByName(hubs), "id")
    rows = rows.repartition(partitions(pairs.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", F.col("id") != F.col("hub"))
    return rows.select("hub", "id", "t").mapInArrow(_compare, "a long, b long").distinct()


class _Tile:
    """Rows of a bucket's two blocks; compares those of the one with those of the other."""

    def __init__(self, at):
        self.at, self.rows = at, []

    def promising(self):
        """(i, js, comp): for each row of the lower block the rows of the higher whose signatures agree enough, the most alike first; ``comp`` are the components."""
        _, low, high, _ = self.at
        ids, n, comp, block = (np.array([r[k] for r in self.rows]) for k in range(4))
        sig = np.frombuffer(b"".join(r[4] for r in self.rows), np.uint8).reshape(len(ids), -1)
        earlier = np.array([r[5] for r in self.rows], np.int64).reshape(len(ids), -1)
        comp = np.unique(comp, return_inverse=True)[1]
        right = np.flatnonzero(block == high)
        for i in np.flatnonzero(block == low):
            ok = (comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= 75 * np.maximum(n[right], n[i]))
            if low == high:
                ok &= ids[right] > ids[i]
            near = right[ok]
            agree = (sig[near] == sig[i]).sum(1)
            # of the buckets that a pair shares only the first compares it; bytes of coordinates may agree where keys don't
            before = (earlier[near] == earlier[i]).any(1)
            order = np.argsort(-agree, kind="stable")
            yield i, near[order[(agree[order] >= AGREE) & ~before[order]]], comp

    def hopeful(self) -> np.ndarray:
        """Whether each row has a promising partner."""
        out = np.zeros(len(self.rows), bool)
        for i, js, _ in self.promising():
            out[js] = True
            out[i] |= len(js) > 0
        return out

    def links(self) -> list[tuple[int, int]]:
        """Similar pairs that join the tile's components, none between rows that others join already."""
        out = []
        for i, js, comp in self.promising():
            for j in js:
                if comp[i] != comp[j] and similar(self.rows[i][6], self.rows[j][6]):
                    out.append((self.rows[i][0], self.rows[j][0]))
                    comp[comp == comp[j]] = comp[i]
        return out


#: What says which tile a row is in, and what a tile needs of a row.
_AT = ["key", "low", "high", "band"]
_OWN = ["id", "n", "comp", "block", "sig", "earlier"]


def _tiles(batches, result, texts: bool):
    """``result`` of each tile of rows sorted by (key, low, high)."""
    tile = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in _AT + _OWN]
        sets = shingle_sets(batch.column("t")) if texts else iter([None] * batch.num_rows)
        for *row, s in zip(*cols, sets, strict=True):
            if tile is None or tile.at != row[:4]:
                if tile:
                    yield result(tile)
                tile = _Tile(row[:4])
            tile.rows.append((*row[4:], s))
    if tile:
        yield result(tile)


def _sieve(batches):
    """The rows that have a promising partner in their tile."""

    def result(tile):
        rows = [tile.at + list(r[:4]) for r, ok in zip(tile.rows, tile.hopeful(), strict=True) if ok]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 3 else pa.int64()) for k in range(8)], _AT + _OWN[:4])

    return _tiles(batches, result, False)


def _link(batches):
    def result(tile):
        links = tile.links()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _tiles(batches, result, True)


def across(members: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between the components of each bucket, from (key, band, id, n, comp), (id, n, sig) and (id, t).

    With the bands' ``keys`` in ``signed``, a pair is compared in the first bucket
    that it shares; without them, in each.
    The members of the largest component meet all others, and the others each
    other, in tiles of two blocks. Blocks are bounded in rows and in shingles.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    live = sizes.groupBy("key").agg(F.max(F.struct("m", "comp", "n")).alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda m, n: F.greatest(F.ceil(m / TILE), F.ceil(n / TILE_SHINGLES))
    live = cut(live.select("key", F.col("top.comp").alias("main"), blocks(F.col("top.m"), F.col("top.n")).alias("mains"), blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("others")))
    m = members.join(live, "key")
    inner = F.col("comp") == F.col("main")
    block = F.when(inner, F.pmod(F.xxhash64("id"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("id"), F.col("others")))
    start = F.when(inner, F.col("mains")).otherwise(F.lit(0).cast("long"))
    m = m.withColumn("block", block).withColumn("with", F.explode(F.sequence(start, F.col("mains") + F.col("others") - 1)))
    m = m.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "band", "id", "n", "comp", "block")
    if "keys" not in signed.columns:
        signed = signed.withColumn("keys", F.array().cast("array<long>"))
    signed = signed.select("id", F.col("n").alias("own_n"), "sig", "keys")

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("earlier", F.slice("keys", F.lit(1), F.col("band"))).drop("keys", "own_n")
        return rows.repartition(partitions(members.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high")

    kinds = "key long, low long, high long, band int, id long, n long, comp long, block long"
    hopeful = cut(dealt(m.join(signed, "id").where("n = own_n")).mapInArrow(_sieve, kinds))
    rows = _among(texts, hopeful.select("id")).join(signed, "id").join(hopeful, "id").where("n = own_n")
    return dealt(rows).mapInArrow(_link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts that are null, empty or without a word have no shingles and are
    linked with nothing; texts of fewer than five words have one, their whole
    sequence. Rows with one id are one node, linked by the text of any of them.
    Rows with a null id are linked with nothing: their component is null and
    they are kept. Texts of any length are compared as wholes; a tile or a hub's
    group has a bound in shingles, beside which it holds one text more at most.
    Further columns are ignored, no rows give no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    signed = cut(docs.mapInArrow(_sign, "id long, n long, h1 long, h2 long, sig binary, keys array<long>"))
    some = signed.where("n > 0 and id is not null")
    classes = cut(some.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("h1", "h2", "n", "rep"))
    of = cut(some.select("id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).where("id <> rep").select("id", "h1", "h2", "n", "rep"))
    # a row for each class and, where rows share an id, for each of its texts
    others = some.join(of.select("id", "h1", "h2", "n").distinct(), ["id", "h1", "h2", "n"], "left_anti")
    reps = cut(others.groupBy("id", "n", "h1", "h2").agg(F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    members = reps.select("id", "n", F.posexplode("keys").alias("band", "key"))
    live = cut(members.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "size"))
    members = cut(members.join(live, "key"))
    # the member that shares most buckets with most others is closest to what they are copies of
    shared = members.groupBy("id").agg(F.sum("size").alias("shared"))
    members = members.join(shared, "id").drop("size")
    hubs = members.groupBy("key").agg(F.max(F.struct("shared", (-F.col("id")).alias("back"), "n")).alias("top")).select("key", (-F.col("top.back")).alias("hub"), F.col("top.n").alias("hub_n"))
    hubs = cut(hubs)
    met = members.join(hubs, "key").where(F.col("id") != F.col("hub"))
    pairs = met.where(100 * F.least("n", "hub_n") >= 75 * F.greatest("n", "hub_n")).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    same = of.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    # rows with one id are one node, whatever their texts
    texts = docs.where("id is not null and t is not null")
    links = cut(confirm(pairs, texts))
    joined = components(links)
    comp = members.drop("shared").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    more = cut(across(comp.select("key", "band", "id", "n", "comp"), reps.select("id", "n", "sig", "keys"), texts))
    every = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(same))
    out = signed.select("id", "n").join(every.withColumnRenamed("node", "id"), "id", "left")
    comp_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.coalesce(comp_id == F.col("id"), F.lit(True)).alias("kept"))


def op6_circulant_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Counts the shingles that every two documents share, which small tables allow.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.doc_id),
c AS (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
