"""Packing documents into batches of one padded length.

A dynamic program over the histogram of all lengths chooses the bucket
boundaries with the least padding; inside each bucket documents form batches
of at most ``budget`` padded tokens.

The histogram has a row for every length that occurs, and the driver holds it.
With k different lengths the documents have k * (k - 1) / 2 tokens at least, so
10**13 tokens make fewer than five million rows. For five million and 16 buckets
the program takes half a minute and 600 MB: some arrays of 8 bytes a length, and 4
bytes a length and bucket to find the way back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, table, word_count

#: Rows that one task numbers.
SHARD = 2048
#: Earlier boundaries that are looked at together.
AT_ONCE = 1 << 18


def _lowest(rows: np.ndarray, cost: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each length the first i with the least ``cost[i] - rows[i] * length``.

    It doesn't fall as lengths rise, so those of every second length lie between
    their neighbours': halving the steps, each level looks at every i about once.
    """
    n = len(lengths)
    out = np.empty(n, np.int64)
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        js = np.arange(step - 1, n, 2 * step)
        low = np.where(js >= step, out[np.maximum(js - step, 0)], 0)
        high = np.where(js + step < n, out[np.minimum(js + step, n - 1)], n - 1)
        ends = np.cumsum(high - low + 1)
        a = 0
        while a < len(js):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
            size = high[a:b] - low[a:b] + 1
            first = np.cumsum(size) - size
            i = np.arange(size.sum()) + np.repeat(low[a:b] - first, size)
            values = cost[i] - rows[i] * np.repeat(lengths[js[a:b]], size)
            least = np.flatnonzero(values == np.repeat(np.minimum.reduceat(values, first), size))
            out[js[a:b]] = i[least[np.searchsorted(least, first)]]
            a = b
        step //= 2
    return out


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets, the last the longest length.

    ``lengths`` are ascending and ``counts`` their rows, each at least 1. Minimises
    the sum of bucket bounds over all rows, which is padding plus a constant. With
    R(j) rows up to length j, the cost of the first j lengths in b buckets is the
    least over i of ``cost(i, b - 1) + (R(j) - R(i)) * length(j)``, and the best i
    doesn't fall as j rises, so that a layer of the program takes n log n steps,
    all of them on whole arrays. Whole numbers throughout, so the optimum is exact.
    """
    n = len(lengths)
    if not n:
        return []
    lengths = np.asarray(lengths, np.int64)
    rows = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    cost = np.concatenate(([0], rows[1:] * lengths))
    back: list[np.ndarray] = []
    for _ in range(min(buckets, n) - 1):
        at = _lowest(rows, cost, lengths)
        new = cost[at] + (rows[1:] - rows[at]) * lengths
        better = (at <= np.arange(n)) & (new < cost[1:])  # else one bucket more doesn't help
        back.append(np.where(better, at, -1).astype(np.int32))
        cost[1:] = np.where(better, new, cost[1:])
    out, j = [], n
    for frm in reversed(back):
        if j and frm[j - 1] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(frm[j - 1])
    if j:
        out.append(int(lengths[j - 1]))
    return out[::-1]


def pack(docs: DataFrame, length: Column, buckets: int = 16, budget: int = 65536, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, bucket_len, batch, place) for every row of ``docs``.

    Null lengths count as 0. A document longer than the budget is a batch of
    its own; all other batches of a bucket are full but for the last. Rows with
    equal id and length, null ids among them, are counted and interchangeable.
    Places in a bucket are numbered in shards by a hash of the id, with the shards'
    row counts as offsets. No rows give no batches; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"))
    # a row for at most SHARD equal rows, so that no id is too much for a task
    rows = cut(rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("n")))
    hist = rows.groupBy("n_tokens").agg(F.sum("n").alias("n")).orderBy("n_tokens").toArrow()
    lengths, counts = np.asarray(hist.column("n_tokens")), np.asarray(hist.column("n"))
    bounds = boundaries(lengths, counts, buckets)
    if not bounds:
        return rows.select("doc_id", "n_tokens", F.lit(0).cast("long").alias("bucket_len"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("int").alias("place"))
    held = np.diff(np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.searchsorted(lengths, bounds, "right")))])
    bucket, shard, most = F.lit(None), F.lit(1), F.lit(1)
    for b, h in reversed(list(zip(bounds, held.tolist(), strict=True))):
        fits = F.col("n_tokens") <= b
        bucket, shard, most = F.when(fits, F.lit(b)).otherwise(bucket), F.when(fits, F.lit(max(1, -(-h // SHARD)))).otherwise(shard), F.when(fits, F.lit(max(1, budget // max(b, 1)))).otherwise(most)
    rows = rows.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SHARD))).alias("part"), "n")
    rows = rows.withColumn("n", F.least(F.col("n") - F.col("part") * SHARD, F.lit(SHARD)))
    rows = rows.withColumns({"bucket_len": bucket.cast("long"), "most": most.cast("long"), "shard": F.pmod(F.xxhash64("doc_id", "n_tokens", "part"), shard)})
    counted = rows.groupBy("bucket_len", "shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select("bucket_len", "shard", before.alias("before"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("bucket_len", "shard").orderBy("doc_id", "n_tokens", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("own", own).join(counted, ["bucket_len", "shard"])
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
    place = F.col("before") + F.col("own") + F.col("nth")
    return rows.select("doc_id", "n_tokens", "bucket_len", F.floor(place / F.col("most")).cast("long").alias("batch"), (place % F.col("most")).cast("int").alias("place"))


def op5_length_buckets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pack(docs, word_count(F.col("text")))
