"""The corpus pipeline: documents through quality, deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all
but the last return the columns of ``documents``. Between stages rows are
written as Parquet and read again; a stage's folder goes once its successor is
written. Stages keep rows with null ids, texts or sources, take repeated rows as
rows of their own unless they say otherwise, and give no rows for none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.llm import line_dedup, mixing, near_dup, packing, quality
from quire.llm._spark import id_remainder, remove, shared_folder, table, word_count


def quality_stage(spark, docs, sf_dir):
    """Documents that score below the threshold go.

    Null and empty texts have one score, and go or stay alike, as do repeated
    rows. A score equal to the threshold stays. Without labels all stay.
    """
    labels = table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 5) != 0)
    return quality.score(docs, quality.learn(docs, labels), keep=True)


def line_stage(spark, docs, sf_dir):
    """Lines of later copies of repeated runs go, and of repeated passages of fewer lines.

    Every row stays, with its text cut and ``n_chars`` set anew; null texts stay
    null. The first copy is that of the smallest id, a null id before all others;
    rows of one id and one text lose the same lines.
    """
    return line_dedup.dedup_lines(docs, words=line_dedup.PASSAGE)


def near_duplicate_stage(spark, docs, sf_dir):
    """Of each group of near-duplicates the document with the smallest id stays.

    Rows with one id stay or go together; rows without an id, a text or a word stay.
    """
    gone = near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark, docs, sf_dir):
    """Documents appear as often as the mix takes them; those without a word go.

    Rows of one id, source and size share the largest number of copies.
    """
    m = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.max("copies").cast("int").alias("copies"))
    m = m.where("copies > 0").alias("m")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (word_count(F.col("d.text")) == F.col("m.size"))
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    rows = d.join(m, same).select(F.struct(*own).alias("row"), F.explode(F.sequence(F.lit(1), F.col("m.copies"))).alias("nth"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def packing_stage(spark, docs, sf_dir):
    """(doc_id, n_tokens, bucket_len, batch, place) for every document, copies included.

    Null and empty texts have no tokens; equal rows are interchangeable.
    """
    return packing.pack(docs, word_count(F.col("text")))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned scores and MinHash are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for the whole table ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
