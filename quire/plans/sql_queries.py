"""Queries written in SQL with the rules as SQL functions."""

from __future__ import annotations

from ..functions.sql import register
from .queries import ORACLES, query, spans


@query(ORACLES["clean_text"])
def sql_clean_text(spark, sf_dir):
    register(spark)
    return spark.sql("SELECT doc_id, page_num, span_no, quire_clean_text(text) AS text, quire_count_hyphens(text) AS joins FROM {spans}", spans=spans(spark, sf_dir))


@query(ORACLES["layout_elements"])
def sql_layout_elements(spark, sf_dir):
    register(spark)
    return spark.sql("""
        WITH classified AS (SELECT doc_id, page_num, span_no, quire_classify_span(text, font_size, is_bold) AS e FROM {spans} WHERE quire_strip(text) <> '')
        SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, span_no) - 1L AS pos, e.type, e.text, e.level, e.section_number FROM classified""", spans=spans(spark, sf_dir))
