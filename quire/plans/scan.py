"""A damaged scan made of plain documents, so that every rule has work to do.

Lines become spans, a line of more than 240 characters several, eight a page,
with bullets, numbers, section numbers, upper case, broken words, bad spacing,
sizes and weights by position, and a header and footer on each page. Nothing of
a text is left out. One SQL tail serves Spark and the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST = 240
SPARK_HEAD = rf"""WITH lines AS (SELECT doc_id, lang, source, p AS line_no, l AS line FROM {{documents}} LATERAL VIEW posexplode(
  flatten(transform(split(text, '\n'), x -> transform(sequence(0, greatest(0, (length(x) - 1) div {WIDEST})), k -> substr(x, cast(k * {WIDEST} + 1 AS INT), {WIDEST}))))) t AS p, l)"""
DUCK_HEAD = f"""WITH cut AS (SELECT doc_id, lang, source,
  flatten(list_transform(string_split(text, chr(10)), lambda x: list_transform(range(0, greatest(0, (length(x) - 1) // {WIDEST}) + 1), lambda k: substr(x, k * {WIDEST} + 1, {WIDEST})))) AS c FROM documents),
lines AS (SELECT doc_id, lang, source, CAST(unnest(range(len(c))) AS INT) AS line_no, unnest(c) AS line FROM cut)"""
_TAIL = """
, body AS (
  SELECT doc_id, source, CAST(FLOOR(line_no / 8.0) AS INT) AS page_num, CAST(line_no % 8 + 1 AS INT) AS span_no,
    CASE (doc_id + line_no) % 12
      WHEN 0 THEN concat('• ', line) WHEN 1 THEN concat('1) ', line)
      WHEN 2 THEN concat('2.3 ', line) WHEN 3 THEN concat('- ', line)
      WHEN 4 THEN concat('a) ', line)
      WHEN 5 THEN CASE WHEN lang = 'en' THEN upper(line) ELSE line END
      WHEN 6 THEN replace(replace(line, 'on', concat('o-', chr(10), ' n')), ', ', ' ,')
      WHEN 7 THEN concat(replace(line, ' ', '  '), ' 1l 2O l O')
      ELSE line END AS text,
    CASE WHEN line_no = 0 THEN 18.0e0 WHEN line_no % 11 = 3 THEN 14.5e0 WHEN line_no % 11 = 5 THEN 12.0e0 ELSE 10.0e0 END AS font_size,
    (line_no % 17 = 9) AS is_bold
  FROM lines)
{marked}, spans AS (SELECT doc_id, page_num, span_no, text, CAST(font_size AS DOUBLE) AS font_size, is_bold, CAST(y0 AS DOUBLE) AS y0,
  CAST(40 AS DOUBLE) AS x0, CAST(40 + 5 * length(text) AS DOUBLE) AS x1, CAST(y0 + font_size AS DOUBLE) AS y1 FROM marked)
"""
#: Headers and footers for the oracle, each from the lines that begin a page.
_DUCK_MARKED = """, pg AS (SELECT doc_id, source, CAST(FLOOR(line_no / 8.0) AS INT) AS page_num FROM lines WHERE line_no % 8 = 0)
, marked AS (
  SELECT doc_id, page_num, span_no, text, font_size, is_bold, 40.0e0 + 20.0e0 * span_no AS y0 FROM body
  UNION ALL SELECT doc_id, page_num, 0, CASE WHEN doc_id % 4 = 3 THEN concat('Header ', source, ' ', CAST(page_num AS VARCHAR(9))) ELSE concat('Header ', source) END, 9.0e0, false, 20.0e0 FROM pg
  UNION ALL SELECT doc_id, page_num, 99, CASE WHEN page_num % 3 = 2 THEN concat('Footer ', CAST(page_num AS VARCHAR(9))) ELSE 'Footer' END, 9.0e0, false, 780.0e0 FROM pg)
"""
#: The same in one pass over the lines, each of which is its own span and, where it begins a page, the page's header and footer too.
_SPARK_MARKED = """
, marked AS (
  SELECT doc_id, page_num, m.span_no, m.text, m.font_size, m.is_bold, m.y0 FROM (
    SELECT doc_id, page_num, explode(filter(array(
      named_struct('span_no', span_no, 'text', text, 'font_size', font_size, 'is_bold', is_bold, 'y0', 40.0e0 + 20.0e0 * span_no),
      CASE WHEN span_no = 1 THEN named_struct('span_no', 0, 'text', CASE WHEN doc_id % 4 = 3 THEN concat('Header ', source, ' ', CAST(page_num AS VARCHAR(9))) ELSE concat('Header ', source) END, 'font_size', 9.0e0, 'is_bold', false, 'y0', 20.0e0) END,
      CASE WHEN span_no = 1 THEN named_struct('span_no', 99, 'text', CASE WHEN page_num % 3 = 2 THEN concat('Footer ', CAST(page_num AS VARCHAR(9))) ELSE 'Footer' END, 'font_size', 9.0e0, 'is_bold', false, 'y0', 780.0e0) END), x -> x IS NOT NULL)) AS m FROM body))
"""
TAIL = _TAIL.replace("{marked}", _DUCK_MARKED)
#: Characters whose upper case Spark writes as several, and those of them that have a single one; DuckDB's ``upper`` maps one to one.
_SEVERAL = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)
_SINGLE = {c: "ẞ" if c == "ß" else c.title() for c in _SEVERAL if c == "ß" or len(c.title()) == 1}
_SPARK_UPPER = f"""CASE WHEN length(upper(line)) > length(line) THEN array_join(transform(split(line, ''), c -> CASE WHEN length(upper(c)) > 1 THEN translate(c, '{"".join(_SINGLE)}', '{"".join(_SINGLE.values())}') ELSE upper(c) END), '') ELSE upper(line) END"""
_SPARK_TAIL = _TAIL.replace("{marked}", _SPARK_MARKED).replace("upper(line)", _SPARK_UPPER)
WIDTH, HEIGHT = 595.0, 842.0


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, page_num, span_no, text, font_size, is_bold, x0, y0, x1, y1)."""
    return documents.sparkSession.sql(SPARK_HEAD + _SPARK_TAIL + "SELECT * FROM spans", documents=documents.select("doc_id", "lang", "source", "text"))


def pages(spans_: DataFrame) -> DataFrame:
    """(doc_id, page_num, width, height): every page has one header."""
    return spans_.where("span_no = 0").select("doc_id", "page_num").withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})
