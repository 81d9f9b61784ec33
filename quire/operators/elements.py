"""Elements: positions in document order, merging of paragraphs, images among them, the text of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import Sizes, classify_line, classify_span
from ..functions.text import clean_text, normalize_lists, strip


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, from 0 in each document, in order of page and ``order``."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", *order)).cast("long") - 1)


def span_elements(spans: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(doc_id, page_num, pos, type, text, level, section_number, font_size, is_bold) of the non-blank spans, and their y0 where spans have it."""
    own = spans.where(strip(F.col("text")) != "")
    out = own.withColumn("e", classify_span(F.col("text"), F.col("font_size"), F.col("is_bold"), sizes))
    out = with_position(out, "span_no")
    return out.select("doc_id", "page_num", "pos", "e.type", "e.text", "e.level", "e.section_number", "font_size", "is_bold", *[c for c in spans.columns if c == "y0"])


def recognised_elements(pages: DataFrame, line_mode: str = "line") -> DataFrame:
    """(doc_id, page_num, pos, type, text, level) of recognised page texts, cleaned.

    ``line_mode='page'`` reads a page as one line, as recognisers do that join
    words by spaces; ``'line'`` keeps the lines that the text has.
    """
    text = F.regexp_replace("text", r"\s+", " ") if line_mode == "page" else F.col("text")
    lines = pages.select("doc_id", "page_num", F.posexplode(F.split(normalize_lists(clean_text(text)), "\n", -1)).alias("line_no", "line"))
    lines = with_position(lines.where(strip(F.col("line")) != ""), "line_no")
    return lines.withColumn("e", classify_line(F.col("line"))).select("doc_id", "page_num", "pos", "e.type", "e.text", "e.level")


def merge_paragraphs(elements: DataFrame) -> DataFrame:
    """Runs of paragraphs on one page become one, joined by spaces; its other columns are those of the first."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    more = (F.col("type") == "paragraph") & (F.lag("type").over(order) == "paragraph") & (F.lag("page_num").over(order) == F.col("page_num"))
    runs = elements.withColumn("_starts", F.when(more, 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in elements.columns if c not in ("doc_id", "pos", "text")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
    first = [F.min_by(c, "pos").alias(c) for c in rest]
    return runs.groupBy("doc_id", "_run").agg(F.min("pos").alias("pos"), text.alias("text"), *first).select(*elements.columns)


def joined(col: str, by: str, sep: str):
    """Aggregate: the values of ``col`` in order of ``by``, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, col))), lambda s: s[col]), sep)


def place_images(images: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, page_num, y0, image, pos, nth): images (doc_id, page_num, y0, image) with the last element (doc_id, page_num, pos, y0) above them.

    Images and elements of a document are brought together in order of page and
    y0, and an element at an image's height counts as above. ``pos`` is -1 where
    there is none; elements without a y0 are at the top of their page. ``nth`` is
    an image's place among the images of its document.
    """
    own = elements.select("doc_id", "page_num", "y0", "pos", F.lit(None).cast("string").alias("image"))
    rows = own.unionByName(images.select("doc_id", "page_num", "y0", F.lit(None).cast("long").alias("pos"), "image"))
    order = Window.partitionBy("doc_id").orderBy("page_num", F.asc_nulls_first("y0"), F.asc_nulls_first("image"), "pos")
    above = F.last("pos", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.count("image").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("doc_id", "page_num", "y0", "image", F.coalesce(above, F.lit(-1).cast("long")).alias("pos"), nth.alias("nth"))
    return rows.where("image is not null")


def document_text(elements: DataFrame) -> DataFrame:
    """(doc_id, text): all texts in order, before paragraphs are merged."""
    return elements.groupBy("doc_id").agg(joined("text", "pos", " ").alias("text"))
