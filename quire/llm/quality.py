"""Quality scores by Bradley-Terry pairwise ranking.

Pairs of a good and a bad document are preferences; weights are learned by
logistic loss on the difference of their features. A document's strength is the
weighted sum of its features; the threshold is the quantile of the labelled
strengths that leaves as many below it as there are bad documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import id_remainder, table
from ._text import chunks, word_hashes, words

_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_MARK_AT = np.full(256, len(_MARKS) + 5, np.int64)
_MARK_AT[_MARKS] = np.arange(len(_MARKS))
for _k, _range in enumerate((range(65, 91), range(48, 58), range(128, 256), (32, 9), (10, 11, 12, 13))):
    _MARK_AT[list(_range)] = len(_MARKS) + _k
_CLASSES = len(_MARKS) + 6
FEATURES = _CLASSES + 5
#: A document counts as bad below this score.
THRESHOLD = 0.3


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: square roots of the shares of byte classes, word shape and repetition. Empty texts are all 0."""
    out = np.zeros((len(column), FEATURES))
    for a, b, data, offsets in chunks(column):
        n = b - a
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        kinds = np.bincount(doc * _CLASSES + _MARK_AT[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
        out[a:b, :_CLASSES] = np.sqrt(kinds / np.maximum(size, 1)[:, None])
        starts, ends, first = words(data, offsets)
        h = word_hashes(data, starts, ends)
        count = np.diff(first)
        same = np.zeros(len(h) + 1, np.int64)
        if len(h):
            again = np.concatenate(([False], h[1:] == h[:-1]))
            again[first[:-1][count > 0]] = False
            np.cumsum(again, out=same[1:])
        repeated = same[first[1:]] - same[first[:-1]]
        for i in range(n):
            x = h[first[i] : first[i + 1]]
            if len(x):
                out[a + i, _CLASSES] = np.sqrt(repeated[i] / len(x))
                # the distinct words of a window of words: independent of length; the last window ends with the text
                whole = x[: len(x) // 256 * 256].reshape(-1, 256) if len(x) >= 256 else x[None, :]
                if len(x) > whole.size:
                    whole = np.concatenate((whole, x[None, -256:]))
                y = np.sort(whole, axis=1)
                distinct = 1 + (y[:, 1:] != y[:, :-1]).sum(1)
                out[a + i, _CLASSES + 1] = 1 - distinct.mean() / whole.shape[1]
                out[a + i, _CLASSES + 2] = np.log1p((size[i] - len(x) + 1) / len(x)) / 4
                out[a + i, _CLASSES + 3] = np.log1p(len(x)) / 16
                out[a + i, _CLASSES + 4] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 30000, ridge: float = 1e-3, steps: int = 25) -> tuple[np.ndarray, float]:
    """Bradley-Terry weights, and the threshold; y holds 0 and 1. Without both labels the weights are 0."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w, -1.0 if len(good) or not len(bad) else 1.0
    rng = np.random.RandomState(11)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = d.T @ p / pairs - ridge * w
        curvature = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(x @ w)
    return w, float((s[len(bad) - 1] + s[len(bad)]) / 2)


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample_rows: int = 12000) -> tuple[np.ndarray, float]:
    """Weights and threshold from at most ``sample_rows`` labelled documents, chosen by a hash of the id."""
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("i"), "i", "y").limit(sample_rows)  # so the broadcast has a bound
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(chosen), "i").select("i", "y", "t")

    def run(batches):
        for batch in batches:
            x = features(batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["i", "y", "x"])

    got = rows.mapInArrow(run, f"i {dict(rows.dtypes)['i']}, y int, x array<double>").groupBy("i", "y").agg(F.min("x").alias("x")).toArrow()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, FEATURES)
    order = np.lexsort(x.T)  # results don't depend on the order of rows
    return fit(x[order], np.array(got.column("y"))[order])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col="doc_id", text_col="text", flag=None, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, or with ``keep`` the rows of ``docs`` with predicted 1.

    ``score`` is a logistic function of the strength that is 0.3 at the
    threshold. Null and empty texts have no features, so all get one score.
    Texts of any length are read as wholes. Repeated rows get equal scores; null
    ids stay null; further columns play no part; no rows give no rows.
    """
    w, t = model
    shift = np.log(THRESHOLD / (1 - THRESHOLD)) - t

    def scores(column):
        return 1 / (1 + np.exp(-np.clip(features(column) @ w + shift, -700, 700)))

    if keep:
        schema, names = docs.schema, docs.columns

        def run(batches):
            for batch in batches:
                at = names.index(text_col)
                yield batch.filter(pa.array(scores(batch.column(at)) >= THRESHOLD))

        return docs.mapInArrow(run, schema)

    def run(batches):
        for batch in batches:
            s = scores(batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (F.lit(False) if flag is None else flag).alias("held_out"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op4_bradley_terry_quality(spark, sf_dir):
    docs, held = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held)
    return score(docs, learn(docs, labels), flag=held)
