"""Page rules: density, the need for recognition, repeated headers and footers, page choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_hyphens, strip

PAGE = ["doc_id", "page_num"]


def page_density(spans: DataFrame, pages: DataFrame, threshold: float = 0.01) -> DataFrame:
    """``pages`` with text_density, has_native_text and needs_ocr, from the boxes (x0, y0, x1, y1) of non-blank spans.

    Overlaps count twice; a page without area has density 0.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    inked = spans.where(strip(F.col("text")) != "").groupBy(*PAGE).agg(F.sum(area).alias("ink"))
    out = pages.join(inked, PAGE, "left")
    size = F.col("width") * F.col("height")
    density = F.when(size > 0, F.coalesce("ink", F.lit(0.0)) / F.when(size > 0, size)).otherwise(0.0)
    out = out.withColumn("text_density", density).withColumn("has_native_text", F.col("ink").isNotNull()).drop("ink")
    return out.withColumn("needs_ocr", (F.col("text_density") < threshold) | ~F.col("has_native_text"))


def counted_pages(spans: DataFrame, width: float, height: float) -> DataFrame:
    """(doc_id, page_num, text_density, hyphens) of the pages of one size that have spans: density of the non-blank ones, broken words of all, in one aggregate."""
    area = F.when(strip(F.col("text")) != "", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    p = spans.groupBy(*PAGE).agg(F.sum(area).alias("ink"), F.sum(count_hyphens(F.col("text"))).alias("hyphens"))
    return p.select(*PAGE, (F.coalesce("ink", F.lit(0.0)) / (width * height)).alias("text_density"), "hyphens")


def repeated_texts(spans: DataFrame, pages: DataFrame, share: float = 0.6, least_pages: int = 3) -> DataFrame:
    """(doc_id, kind, text): top and bottom texts that at least ``share`` of a document's pages with text have.

    The bottom counts on pages of more than one span. Documents of fewer than
    ``least_pages`` pages, pages without text included, have none.
    """
    own = spans.where(strip(F.col("text")) != "").select(*PAGE, F.struct("y0", "span_no", strip(F.col("text")).alias("text")).alias("s"))
    ends = own.groupBy(*PAGE).agg(F.min("s").alias("top"), F.max("s").alias("last"), F.count("*").alias("n"))
    kinds = F.array(F.struct(F.lit("header").alias("kind"), F.col("top.text").alias("text")), F.when(F.col("n") > 1, F.struct(F.lit("footer").alias("kind"), F.col("last.text").alias("text"))))
    ends = ends.select("doc_id", F.explode(F.array_compact(kinds)).alias("e")).select("doc_id", "e.*")
    counts = ends.groupBy("doc_id", "kind", "text").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy("doc_id", "kind"))
    counts = counts.withColumn("total", total).where(F.col("c") / F.col("total") >= share)
    enough = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    return counts.join(enough, "doc_id", "left_semi").select("doc_id", "kind", "text")


def strip_repeated(spans: DataFrame, repeated: DataFrame) -> DataFrame:
    """``spans`` without those whose stripped text is a repeated one of their document, wherever it stands."""
    gone = repeated.groupBy("doc_id").agg(F.collect_set("text").alias("_texts"))  # a few texts a document
    keep = spans.join(gone, "doc_id", "left").where(~F.coalesce(F.array_contains("_texts", strip(F.col("text"))), F.lit(False)))
    return keep.select(*spans.columns)


def choose_pages(pages: DataFrame, wanted: list[int] | None) -> DataFrame:
    """The wanted pages that exist; none wanted means all."""
    return pages.where(F.col("page_num").isin(wanted)) if wanted else pages
