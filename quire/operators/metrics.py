"""Metrics of pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_metrics(pages: DataFrame, tables: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """(doc_id, page_num, native_text_ratio, ocr_confidence, words_corrected, tables_detected).

    ``pages`` has (doc_id, page_num, text_density, ocr_confidence, corrections),
    the last two null on native pages. With ``exact`` a native page repeats the
    corrections of the recognised page before it, and a recognised page's ratio
    is 1; without, both are 0 there. A column ``seconds`` becomes ``processing_time``.
    """
    native = F.col("ocr_confidence").isNull()
    if exact:
        before = F.last("corrections", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0))
        corrected, ratio = F.coalesce(before, F.lit(0)), F.when(native, F.col("text_density")).otherwise(1.0)
    else:
        corrected, ratio = F.coalesce("corrections", F.lit(0)), F.when(native, F.col("text_density")).otherwise(0.0)
    out = pages.select("doc_id", "page_num", ratio.alias("native_text_ratio"), "ocr_confidence", corrected.cast("long").alias("words_corrected"), *([F.col("seconds").alias("processing_time")] if "seconds" in pages.columns else []))
    if tables is None:
        return out.withColumn("tables_detected", F.lit(0).cast("long"))
    n = tables.groupBy("doc_id", "page_num").agg(F.count("*").alias("tables_detected"))
    return out.join(n, ["doc_id", "page_num"], "left").withColumn("tables_detected", F.coalesce("tables_detected", F.lit(0)))


def document_metrics(pages: DataFrame) -> DataFrame:
    """Totals of each document; the mean confidence leaves out pages of confidence 0. ``total_time`` adds up what the pages took, if they say it."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        F.count("ocr_confidence").alias("pages_ocr"),
        (F.count("*") - F.count("ocr_confidence")).alias("pages_native"),
        F.avg(F.nullif("ocr_confidence", F.lit(0.0))).alias("avg_ocr_confidence"),
        F.sum("words_corrected").alias("total_words_corrected"),
        F.sum("tables_detected").alias("total_tables"),
        *([F.sum("processing_time").alias("total_time")] if "processing_time" in pages.columns else []),
    )


def metrics_json(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, json) of document metrics with their pages."""
    fields = [c for c in pages.columns if c != "doc_id"]
    p = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("page_metrics"))
    d = documents.join(p, "doc_id")
    return d.select("doc_id", F.to_json(F.struct(*[c for c in d.columns if c != "doc_id"])).alias("json"))
