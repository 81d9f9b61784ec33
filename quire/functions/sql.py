"""The rules as SQL functions, which the optimiser inlines.

``register(spark)`` makes a temporary SQL function of each rule of ``RULES``, from
the very expression that the Column function builds, so SQL and DataFrames can't
differ, and no rule is a Python function at run time::

    register(spark)
    spark.sql("SELECT quire_clean_text(text) FROM pages WHERE quire_is_list_item(text)")
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import table_markdown, table_records
from . import classify, text

PREFIX = "quire_"
_ELEMENT = "STRUCT<type: STRING, text: STRING, level: INT"
_CELLS = "columns ARRAY<STRING>, cells ARRAY<ARRAY<STRING>>"
#: Parameters, type and rule of each function, by name without the prefix.
RULES: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "clean_text": ("text STRING", "STRING", text.clean_text),
    "join_hyphens": ("text STRING", "STRING", text.join_hyphens),
    "count_hyphens": ("text STRING", "BIGINT", text.count_hyphens),
    "fix_spacing": ("text STRING", "STRING", text.fix_spacing),
    "normalize_whitespace": ("text STRING", "STRING", text.normalize_whitespace),
    "fix_confusions": ("text STRING", "STRING", text.fix_confusions),
    "normalize_lists": ("text STRING", "STRING", text.normalize_lists),
    "preserve_sections": ("text STRING", "STRING", text.preserve_sections),
    "merge_lines": ("lines ARRAY<STRING>", "STRING", text.merge_lines),
    "strip": ("text STRING", "STRING", text.strip),
    "strip_bullet": ("text STRING", "STRING", text.strip_bullet),
    "is_upper": ("text STRING", "BOOLEAN", text.is_upper),
    "is_list_item": ("text STRING", "BOOLEAN", classify.is_list_item),
    "section_number": ("text STRING", "STRING", classify.section_number),
    "classify_span": ("text STRING, size DOUBLE, bold BOOLEAN", _ELEMENT + ", section_number: STRING>", classify.classify_span),
    "classify_line": ("text STRING", _ELEMENT + ">", classify.classify_line),
    "clean_filename": ("name STRING", "STRING", text.clean_filename),
    "path_stem": ("path STRING", "STRING", text.path_stem),
    "language_code": ("code STRING", "STRING", text.language_code),
    "language_list": ("codes ARRAY<STRING>", "STRING", text.language_list),
    "table_markdown": (_CELLS, "STRING", table_markdown),
    "table_records": (_CELLS, "STRING", table_records),
}

_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
_OPERATOR = re.compile(r"(?<![\w`!<>=+\-*/%])([!<>=+\-*/%]+|and|or|not)\(")


def expression(rule: Callable[..., Column], parameters: str) -> str:
    """The SQL text of a rule over its parameters; operators, which Columns call as functions, are quoted names."""
    names = [p.split()[0] for p in re.split(r", (?=\w+ [A-Z])", parameters)]
    shown = rule(*[F.col(n) for n in names])._jc.node().sql()
    parts = _LITERAL.split(shown)
    return "".join(p if k % 2 else _OPERATOR.sub(r"`\1`(", p) for k, p in enumerate(parts))


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Creates or replaces the session's functions; returns their names."""
    for name, (parameters, kind, rule) in RULES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {expression(rule, parameters)}")
    return [prefix + name for name in RULES]
