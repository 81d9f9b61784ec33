"""What both vector searches share: clean vectors, queries dealt to blocks, and the merge of block results.

A block is some thousands of rows, searched through an index built where the
block lands. Queries stream past it. Blocks are bounded, so no task holds more
than a block and its answers. Rows are shuffled once for each copy of their
block and queries once for each block, so blocks are as large as a task can hold
where there are many, and of few queries each block has few copies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, partitions

#: Components and rows that a block holds at most, and rows below which it isn't worth dealing them out.
COMPONENTS, BLOCK, LEAST = 1 << 22, 1 << 16, 4096
#: Queries that one copy of a block serves at most, and at least where copies only add tasks.
QUERIES, FEW = 1 << 20, 128


def clean(rows: DataFrame, id_col: str, vec_col: str, component=lambda x: x) -> DataFrame:
    """(id, x, norm2): a row for each id, without null ids and vectors that are null or hold null or non-finite components."""
    x = F.transform(F.col(vec_col), lambda v: component(v.cast("double")))
    bad = F.exists(F.col(vec_col), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    rows = rows.groupBy("id").agg(F.min("x").alias("x"))
    return cut(rows.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))


def summary(rows: DataFrame) -> tuple[int, int, float]:
    """Rows, largest dimension, largest squared norm."""
    r = rows.agg(F.count("*"), F.max(F.size("x")), F.max("norm2")).first()
    return r[0], r[1] or 0, r[2] or 0.0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A row for each vector; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values)[offsets[0] : offsets[-1]] if n else np.zeros(0)
    sizes = np.diff(offsets)
    if n and (sizes == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def block_rows(n: int, dim: int, tasks: int) -> int:
    """Rows of a block: two tasks at least share the work on one, and it is of bounded size."""
    return max(1, min(BLOCK, COMPONENTS // max(dim, 1), max(LEAST, -(-2 * n // tasks))))


def copies(blocks: dict[int, int], asked: dict[int, int], tasks: int) -> dict[int, int]:
    """Copies of each region's blocks: so many that about ``2 * tasks`` tasks have queries."""
    live = sum(blocks[r] for r in blocks if asked.get(r))
    return {r: max(1, -(-asked.get(r, 0) // QUERIES), min(-(-asked.get(r, 0) // FEW), -(-2 * tasks // max(live, 1)))) for r in blocks}


def search(data: DataFrame, queries: DataFrame, build: Callable, k: int, dim: int, blocks: dict[int, int], copies: dict[int, int], kind: str = "double") -> DataFrame:
    """(query_id, vec_id, score): the best k of each block for each query, scores of type ``kind``.

    ``data`` has (region, id, x) and ``queries`` (region, id, x, least), where
    region is what the query has to search and ``least`` a score that it has
    reached elsewhere. Regions are split into ``blocks``, and each block is sent
    ``copies`` times, to a part of the queries each. ``build(ids, x)`` returns a
    function of (id, vector, least) that returns ids and scores.
    """
    n = partitions(data.sparkSession)
    number = lambda of: F.create_map(*[F.lit(v) for r, c in of.items() for v in (r, c)])[F.col("region")].cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), number(of) - 1))
    d = data.select("region", F.pmod(F.xxhash64("id"), number(blocks)).cast("int").alias("block"), every(copies).alias("copy"), F.lit(0).alias("kind"), "id", "x", F.lit(None).cast(kind).alias("least"))
    q = queries.select("region", every(blocks).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), number(copies)).cast("int").alias("copy"), F.lit(1).alias("kind"), "id", "x", "least")
    rows = d.unionByName(q).repartition(n, "region", "block", "copy").sortWithinPartitions("region", "block", "copy", "kind")

    types = pa.int64(), pa.int64(), pa.int64() if kind == "long" else pa.float64()

    def run(batches):
        at, ids, xs, find = None, [], [], None
        for batch in batches:
            place = np.stack([np.asarray(batch.column(c)) for c in ("region", "block", "copy", "kind")], 1)
            own = np.asarray(batch.column("id"))
            x = matrix(batch.column("x"), dim)
            least = batch.column("least").to_pylist()
            new = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            out: list[tuple] = []
            for a, b in zip([0, *new], [*new, len(own)], strict=True):
                if a == b:
                    continue
                here = tuple(place[a, :3].tolist())
                if here != at:
                    at, ids, xs, find = here, [], [], None
                if place[a, 3] == 0:
                    ids.append(own[a:b])
                    xs.append(x[a:b].copy())
                    continue
                if not ids:  # a block without rows
                    continue
                if find is None:
                    find = build(np.concatenate(ids), np.concatenate(xs))
                for i in range(a, b):
                    found, scores = find(int(own[i]), x[i], least[i])
                    out.append((np.full(len(found), own[i]), found, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["query_id", "vec_id", "score"])

    return rows.select("region", "block", "copy", "kind", "id", "x", "least").mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to smaller ids."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class Best:
    """The k best (score, id) met so far."""

    def __init__(self, k: int, least: float | None, kind: type = np.float64):
        """``kind`` is what scores are held as."""
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, kind)
        self.least = -np.inf if least is None else least

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = scores >= self.least
        if ok.any():
            ids, scores = np.concatenate([self.ids, ids[ok]]), np.concatenate([self.scores, scores[ok]])
            if len(ids) > self.k:
                order = np.lexsort((ids, -scores))[: self.k]
                ids, scores = ids[order], scores[order]
            self.ids, self.scores = ids, scores
            if len(ids) == self.k:
                self.least = max(self.least, scores.min().item())


def every_nth(rows: DataFrame, n: int) -> Column:
    return F.pmod("id", F.lit(n)) == 0
