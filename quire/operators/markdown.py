"""Markdown of elements and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_bullet
from .elements import joined


def element_markdown(kind: Column, text: Column, level: Column, image: Column | None = None) -> Column:
    """Titles and headings get hashes (six at most), list items a dash unless they start with a digit."""
    indent = F.repeat(F.lit("  "), F.coalesce(level, F.lit(1)) - 1)
    item = F.when(text.rlike(r"\A\p{Nd}"), text).otherwise(F.concat(F.lit("- "), strip_bullet(text, digits=False)))
    figure = text if image is None else F.when(image.isNotNull(), F.concat(F.lit("!["), text, F.lit("]("), image, F.lit(")"))).otherwise(text)
    return (
        F.when(kind == "title", F.concat(F.lit("# "), text))
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.coalesce(level, F.lit(2)), F.lit(6))), F.lit(" "), text))
        .when(kind == "list_item", F.concat(indent, item))
        .when(kind == "figure", figure)
        .otherwise(text)
    )


def frontmatter(fields: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """A block of ``key: value`` lines, lists as dashed lines below their key; nothing is quoted."""
    lines = [F.lit("---")] + [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()]
    for k, v in (lists or {}).items():
        lines.append(F.concat(F.lit(f"{k}:"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("\n  - "), x)), "")))
    return F.concat_ws("\n", *lines, F.lit("---"))


def markdown(elements: DataFrame, front: DataFrame | None = None, tables: DataFrame | None = None, page_markers: bool = False) -> DataFrame:
    """(doc_id, markdown) of elements, with (doc_id, front) before them and (doc_id, table_idx, page_num, md) tables at the end.

    ``page_markers`` writes a comment before the first element of every page but
    where it is the page of the element before.
    """
    parts = elements.withColumn("md", element_markdown(F.col("type"), F.col("text"), F.col("level")))
    if page_markers:
        before = F.lag("page_num").over(Window.partitionBy("doc_id").orderBy("pos"))
        mark = F.concat(F.lit("\n<!-- Page "), (F.col("page_num") + 1).cast("string"), F.lit(" -->\n\n"))
        parts = parts.withColumn("mark", F.when(before.eqNullSafe(F.col("page_num")), "").otherwise(mark))
    else:
        parts = parts.withColumn("mark", F.lit(""))
    parts = parts.withColumn("block", F.concat("mark", F.when(F.col("md") != "", F.concat("md", F.lit("\n\n"))).otherwise("")))
    out = parts.groupBy("doc_id").agg(joined("block", "pos", "").alias("markdown"))
    if tables is not None:
        head = F.concat(F.lit("### Table "), (F.col("table_idx") + 1).cast("string"), F.lit(" (Page "), (F.col("page_num") + 1).cast("string"), F.lit(")\n\n"), F.col("md"), F.lit("\n\n"))
        t = tables.withColumn("block", head).groupBy("doc_id").agg(F.concat(F.lit("## Tables\n\n"), joined("block", "table_idx", "")).alias("tables"))
        out = out.join(t, "doc_id", "left").select("doc_id", F.concat("markdown", F.coalesce("tables", F.lit(""))).alias("markdown"))
    if front is not None:
        out = out.join(front, "doc_id", "left").select("doc_id", F.concat(F.coalesce(F.concat("front", F.lit("\n\n")), F.lit("")), "markdown").alias("markdown"))
    return out


def elements_text(elements: DataFrame) -> DataFrame:
    """(doc_id, markdown): the non-empty parts joined by blank lines, without frontmatter."""
    parts = elements.withColumn("md", element_markdown(F.col("type"), F.col("text"), F.col("level"))).where(F.col("md") != "")
    return parts.groupBy("doc_id").agg(joined("md", "pos", "\n\n").alias("markdown"))
