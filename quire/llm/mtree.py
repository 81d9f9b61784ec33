"""Exact top-k search by M-tree, best node first.

The largest inner product becomes the nearest neighbour of a metric space when
every vector gets one more component that brings all to the same length. Pages
of the tree hold routing objects with covering radii, or rows; each entry keeps
its distance from the parent's routing object, so that the triangle inequality
can pass it over before its own distance is computed.

The root page is shared: at most 256 routing objects, drawn by a hash of the
id, and the radii of their regions over all rows. A region is kept as blocks of
bounded size, a tree each. A query first searches its own region; the score of
its k-th find then says which of the other regions it need not visit.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from ._spark import cut, partitions, table

PAGE, FANOUT, ROOT = 1024, 16, 256
#: Whole numbers below this are exact as doubles.
EXACT = 2.0**53


class MTree:
    """Rows (n x d) whose squared norms are at most ``norm2``; scores are inner products.

    With ``whole``, components are whole numbers and scores are summed as such:
    exact, as long as they fit 64 bits.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm2: float, page: int = PAGE, fanout: int = FANOUT, whole: bool = False):
        self.ids, self.x, self.norm2, self.page, self.fanout = ids, x, norm2, page, fanout
        self.kind = np.int64 if whole else np.float64
        self.lift = np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))
        self.slack = 1e-9 * (np.sqrt(norm2) + 1)
        self.pages: list[tuple] = []
        self.computed = 0
        rng = np.random.RandomState(5)
        self.root = self._page(np.arange(len(ids)), None, rng) if len(ids) else None

    def _from(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(1) + (self.lift[rows] - self.lift[centre]) ** 2)

    def _page(self, rows: np.ndarray, parent: int | None, rng) -> int:
        to_parent = np.zeros(len(rows)) if parent is None else self._from(rows, parent)
        at = len(self.pages)
        self.pages.append(())
        if len(rows) <= self.page:
            order = np.argsort(to_parent, kind="stable")
            rows = rows[order]
            self.pages[at] = (True, rows, to_parent[order], None, None, self.x[rows].astype(self.kind))
            return at
        routing = rng.choice(rows, self.fanout, replace=False)
        d = np.stack([self._from(rows, c) for c in routing])
        near = d.argmin(0)
        if np.bincount(near, minlength=len(routing)).max() > 0.9 * len(rows):  # many equal rows
            near = np.arange(len(rows)) * len(routing) // len(rows)
        groups = [(c, rows[near == j], float(d[j, near == j].max())) for j, c in enumerate(routing) if (near == j).any()]
        centres = np.array([c for c, _, _ in groups])
        children = [self._page(g, c, rng) for c, g, _ in groups]
        back = np.zeros(len(groups)) if parent is None else self._from(centres, parent)
        self.pages[at] = (False, centres, back, np.array([r for _, _, r in groups]), children, self.x[centres])
        return at

    def search(self, own: int, q: np.ndarray, k: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k largest inner products with q of at least ``least``, without the row whose id is ``own``."""
        found = vectors.Best(k, least, self.kind)
        own_q = q.astype(self.kind)
        if self.root is None:
            return found.ids, found.scores
        base = float(q @ q) + self.norm2
        slack = self.slack + 1e-9 * np.sqrt(float(q @ q))
        # squares lose digits where distances are near 0
        slack += np.sqrt(base * 1e-13)
        reach = lambda: np.sqrt(max(base - 2 * found.least, 0.0)) + slack
        heap = [(0.0, self.root, None)]
        while heap:
            low, at, d_parent = heapq.heappop(heap)
            r = reach()
            if low > r:
                break
            leaf, rows, to_parent, radius, children, x = self.pages[at]
            if leaf:
                a, b = 0, len(rows)
                if d_parent is not None and r < np.inf:
                    a, b = np.searchsorted(to_parent, [d_parent - r, d_parent + r])
                    b = min(len(rows), b + 1)
                if a < b:
                    self.computed += b - a
                    ids = self.ids[rows[a:b]]
                    scores = x[a:b] @ own_q
                    if own is not None:
                        other = ids != own
                        ids, scores = ids[other], scores[other]
                    found.add(ids, scores)
                continue
            near = np.arange(len(rows))
            if d_parent is not None and r < np.inf:
                near = np.flatnonzero(np.abs(d_parent - to_parent) - radius <= r)
            self.computed += len(near)
            d = np.sqrt(np.maximum(base - 2 * (x[near] @ q), 0))
            for j, dj in zip(near.tolist(), d.tolist(), strict=True):
                lower = max(dj - radius[j], 0.0)
                if lower <= r:
                    heapq.heappush(heap, (lower, children[j], dj))
        return found.ids, found.scores


def top_k(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", component=lambda x: F.floor(x * 64).cast("double"), block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k largest inner products with other rows, ties to smaller ids.

    Components pass through ``component`` first. Ids and vectors that are null,
    and vectors that hold null or non-finite components, take no part. Of rows
    with one id the smallest vector counts, so repeated rows count once; other
    ids with an equal vector are candidates like any. Vectors of fewer
    components are read as filled up with zeros. Scores are long: ``component``
    makes whole numbers, whose products are summed in doubles where no sum can
    reach 2**53 and in 64-bit integers otherwise. Further columns are ignored. No
    rows, or a single one, give no rows.
    """
    spark = rows.sparkSession
    v = vectors.clean(rows, id_col, vec_col, component)
    n, dim, norm2 = vectors.summary(v)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tasks = partitions(spark)
    block = block or vectors.block_rows(n, dim, tasks)
    roots = v.orderBy(F.xxhash64("id"), "id").limit(min(ROOT, -(-n // block))).select("x").toArrow()
    centres = vectors.matrix(roots.column("x"), dim)
    lifts = np.sqrt(np.maximum(norm2 - (centres**2).sum(1), 0))

    def distances(x, lift):
        return np.sqrt(np.maximum(((x**2).sum(1) + lift**2)[:, None] + norm2 - 2 * (x @ centres.T + lift[:, None] * lifts), 0))

    def assign(batches):
        for batch in batches:
            x = vectors.matrix(batch.column("x"), dim)
            d = distances(x, np.sqrt(np.maximum(norm2 - (x**2).sum(1), 0)))
            region = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(region.astype(np.int32)), pa.array(d[np.arange(len(x)), region])], ["id", "x", "region", "far"])

    placed = cut(v.select("id", "x").mapInArrow(assign, "id long, x array<double>, region int, far double"))
    asks = vectors.every_nth(placed, every)
    regions = placed.groupBy("region").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count_if(asks).alias("asks")).collect()
    blocks = {r.region: -(-r.n // block) for r in regions}
    radius = {r.region: r.far for r in regions}

    def build(ids, x):
        tree = MTree(ids, x, norm2, whole=norm2 >= EXACT)
        return lambda own, q, least: tree.search(own, q, k, least)

    queries = placed.where(asks).select("region", "id", "x", F.lit(None).cast("long").alias("least"))
    near = cut(vectors.best(vectors.search(placed, queries, build, k, dim, blocks, vectors.copies(blocks, {r.region: r.asks for r in regions}, tasks), "long"), k))
    if len(regions) == 1:
        return near
    reached = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    names = np.array(sorted(radius))
    radii = np.array([radius[r] for r in names])

    def route(batches):
        """The other regions where a query may find a score of at least its k-th."""
        for batch in batches:
            x = vectors.matrix(batch.column("x"), dim)
            least = np.array([-np.inf if s is None else float(s) for s in batch.column("least").to_pylist()])
            d = distances(x, np.zeros(len(x)))[:, names]
            base = (x**2).sum(1) + norm2
            reach = np.sqrt(np.maximum(base - 2 * least, 0)) + 1e-6 * (1 + np.sqrt(base))
            goes = (d - radii <= reach[:, None]) & (names != np.asarray(batch.column("region"))[:, None])
            at, to = np.nonzero(goes)
            rows = pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "x", "least")], ["id", "x", "least"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(names[to].astype(np.int32)), *rows.columns], ["region", "id", "x", "least"])

    routed = cut(queries.drop("least").join(reached, "id", "left").select("region", "id", "x", "least").mapInArrow(route, "region int, id long, x array<double>, least long"))
    asked = {r.region: r.n for r in routed.groupBy("region").agg(F.count("*").alias("n")).collect()}
    far = vectors.search(placed, routed, build, k, dim, blocks, vectors.copies(blocks, asked, tasks), "long")
    return vectors.best(near.select("query_id", "vec_id", "score").unionByName(far), k)


def op1_mtree_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER o::INT AS rank, vec_id, score FROM s
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 20
"""
