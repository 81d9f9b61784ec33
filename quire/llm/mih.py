"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes of 64 bits: a rotation learned on a bounded sample
(principal axes, then the rotation that brings signs closest to values), and the
signs. A code is split into four substrings, each indexed. Two codes within
Hamming distance r differ by at most r // 4 in some substring, so probing the
four indexes retrieves every code within r; their vectors are reranked by inner
product in double precision, summed in one order whatever the row's place. The
radius is the smallest that holds the wanted share of true neighbours in the
sample. Queries for which all blocks together have fewer than k codes within it
are asked again with a larger one, until each has k.

All rows are indexed, in blocks of bounded size. The largest inner product
becomes the nearest neighbour when every vector gets one more component that
brings all to the same length; codes are made of those.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from ._spark import cut, partitions, table

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
RESULT = "query_id long, rank int, vec_id long, score double"


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))[:, None]])


def learn_rotation(x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (d x 64) of the codes."""
    rng = np.random.RandomState(3)
    centre = x.mean(0)
    c = x - centre
    _, axes = np.linalg.eigh(c.T @ c)
    w = axes[:, ::-1][:, :BITS]
    y = c @ w
    r = np.linalg.qr(rng.randn(w.shape[1], w.shape[1]))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
        r = (u @ v).T
    w = w @ r
    if w.shape[1] < BITS:  # fewer dimensions than bits: random directions for the rest
        w = np.hstack([w, rng.randn(len(w), BITS - w.shape[1])])
    return centre, w


def codes(x: np.ndarray, model) -> np.ndarray:
    """Substrings of the codes: n x 4 of 16 bits."""
    bits = (x - model[0]) @ model[1] > 0
    return np.packbits(bits.reshape(len(x), PARTS, WIDTH), axis=2, bitorder="little").view(np.uint16).reshape(len(x), PARTS)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products with q. Equal rows have equal ones: each row is summed alone, in one order, which a matrix product doesn't promise."""
    return (np.ascontiguousarray(x) * q).sum(1)


class MultiIndex:
    def __init__(self, c: np.ndarray):
        self.c = c
        self.order = [np.argsort(c[:, p], kind="stable") for p in range(PARTS)]
        self.keys, self.start, self.count = [], [], []
        for p in range(PARTS):
            keys, start, count = np.unique(c[self.order[p], p], return_index=True, return_counts=True)
            self.keys.append(keys)
            self.start.append(start)
            self.count.append(count)

    _flips: dict[int, np.ndarray] = {}

    @classmethod
    def flips(cls, r: int) -> np.ndarray:
        if r not in cls._flips:
            cls._flips[r] = np.array([sum(1 << b for b in bits) for n in range(r + 1) for bits in combinations(range(WIDTH), n)], np.uint16)
        return cls._flips[r]

    def probe(self, q: np.ndarray, r: int) -> np.ndarray:
        """Rows whose code is within r of q.

        With r = 4 * s + t, a code within r is within s of q in one of the first
        t + 1 substrings or within s - 1 in one of the others. Few probes are
        looked up one by one, many by passing over the keys in use.
        """
        s, t = divmod(min(r, BITS), PARTS)
        hit = np.zeros(len(self.c), bool)
        for p in range(PARTS):
            near = s if p <= t else s - 1
            if near < 0:
                continue
            keys = self.keys[p]
            if near <= 2 and len(self.flips(near)) < len(keys):
                probes = q[p] ^ self.flips(near)
                at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
                at = at[keys[at] == probes]
            else:
                at = np.flatnonzero(np.bitwise_count(keys ^ q[p]) <= near)
            n = self.count[p][at]
            if len(n):
                begin = np.repeat(self.start[p][at] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                hit[self.order[p][begin + np.arange(n.sum())]] = True
        rows = np.flatnonzero(hit)
        return rows[distance(self.c[rows], q) <= r]


def choose_radius(x: np.ndarray, c: np.ndarray, asked: np.ndarray, k: int, recall: float) -> int:
    """Smallest radius that holds ``recall`` of the k nearest in the sample x with codes c, over at most 256 of its rows as queries with codes ``asked``."""
    n = len(x)
    ask = np.arange(0, n, max(1, n // 256))
    far = []
    for i in ask:
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argsort(-s)[: min(k, n - 1)]
        far.append(distance(c[top], asked[i]))
    far = np.concatenate(far) if far else np.zeros(0, int)
    return int(np.quantile(far, recall, method="higher")) if len(far) else 0


def nearest(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = 8192, recall: float = 0.97, block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k largest inner products found, ties to smaller ids.

    Ids and vectors that are null, vectors that hold null or non-finite
    components and zero vectors take no part. Of rows with one id the smallest
    vector counts, so repeated rows count once; other ids with an equal vector
    are candidates like any. Vectors of fewer components are read as filled up
    with zeros. Further columns are ignored. No rows, or a single one, give no
    rows.
    """
    spark = rows.sparkSession
    v = vectors.clean(rows, id_col, vec_col).where("norm2 > 0")
    n, dim, norm2 = vectors.summary(v)
    if not n:
        return spark.createDataFrame([], RESULT)
    sample = vectors.matrix(v.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("x").toArrow().column("x"), dim)
    high = lifted(sample, norm2)
    model = learn_rotation(high)
    asked = codes(np.hstack([sample, np.zeros((len(sample), 1))]), model)
    radius = choose_radius(sample, codes(high, model), asked, k, recall)

    def probing(radius):
        def build(ids, x):
            index = MultiIndex(codes(lifted(x, norm2), model))

            def find(own, q, least):
                near = index.probe(codes(np.append(q, 0.0)[None, :], model)[0], radius)
                near = near[ids[near] != own]
                found = vectors.Best(k, least)
                found.add(ids[near], inner(x[near], q))
                return found.ids, found.scores

            return find

        return build

    tasks = partitions(spark)
    blocks = {0: -(-n // (block or vectors.block_rows(n, dim, tasks)))}
    data = v.select(F.lit(0).alias("region"), "id", "x")
    asks = v.where(vectors.every_nth(v, every)).select(F.lit(0).alias("region"), "id", "x", F.lit(None).cast("double").alias("least"))
    left, out = asks.count(), None
    while left:
        found = cut(vectors.best(vectors.search(data, asks, probing(radius), k, dim, blocks, vectors.copies(blocks, {0: left}, tasks)), k))
        full = cut(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1)).select("query_id"))
        left = left - full.count() if radius < BITS else 0
        if left:
            found = found.join(full, "query_id", "left_semi")
            asks = cut(asks.join(full, F.col("id") == F.col("query_id"), "left_anti"))
            radius = min(BITS, radius + PARTS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RESULT)


def op2_multi_index_hashing(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))
