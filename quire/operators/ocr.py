"""Recognised words (text, confidence, bbox) to page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def keep_words(words: Column, least: int = 0) -> Column:
    """The non-blank words of at least that confidence; a null confidence counts as 0."""
    return F.filter(words, lambda w: (strip(w["text"]) != "") & (F.coalesce(w["confidence"], F.lit(0)) >= least))


def confidence(words: Column) -> Column:
    total = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(w["confidence"], F.lit(0)))
    return F.when(F.size(words) > 0, total / F.size(words)).otherwise(0.0)


def page_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: strip(w["text"])), " ")


def recognised_pages(words: DataFrame, least: int = 0) -> DataFrame:
    """(doc_id, page_num, text, ocr_confidence, words) from (doc_id, page_num, words)."""
    kept = words.withColumn("words", keep_words(F.col("words"), least))
    return kept.select("doc_id", "page_num", page_text(F.col("words")).alias("text"), confidence(F.col("words")).alias("ocr_confidence"), "words")
