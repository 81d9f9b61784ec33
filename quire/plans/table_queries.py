"""Queries that find tables on printed reports, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import table_finder, tables
from . import reports
from .queries import query

_PAGE, _TABLE = "doc_id, page_num", "doc_id, page_num, tab"

#: CTEs from spans to the grid g of tables without lines.
_TEXT_GRID = f"""
, r0 AS (SELECT *, max(y1) OVER (PARTITION BY {_PAGE} ORDER BY y0, x0, span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM spans)
, r1 AS (SELECT *, sum(CASE WHEN below IS NULL OR y0 + 0.3 * (y1 - y0) >= below THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE} ORDER BY y0, x0, span_no) AS line FROM r0)
, c0 AS (SELECT *, max(x1) OVER (PARTITION BY {_PAGE}, line ORDER BY x0, span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r1)
, c1 AS (SELECT *, sum(CASE WHEN before IS NULL OR x0 - before >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE}, line ORDER BY x0, span_no) AS cell FROM c0)
, cl AS (SELECT {_PAGE}, line, cell, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c1 GROUP BY {_PAGE}, line, cell)
, l0 AS (SELECT {_PAGE}, line, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM cl GROUP BY {_PAGE}, line)
, l1 AS (SELECT *, coalesce(lag(n) OVER w > 1 AND y0 - lag(y1) OVER w <= 3 * (y1 - y0), false) AS goes_on FROM l0 WINDOW w AS (PARTITION BY {_PAGE} ORDER BY line))
, l2 AS (SELECT *, sum(CASE WHEN n > 1 AND NOT goes_on THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE} ORDER BY line) AS tab FROM l1)
, l3 AS (SELECT *, row_number() OVER (PARTITION BY {_TABLE} ORDER BY line) - 1 AS nth, count(*) OVER (PARTITION BY {_TABLE}) AS lines FROM l2 WHERE n > 1)
, runs AS (SELECT * FROM l3 WHERE lines > 1)
, inn AS (SELECT cl.*, tab, lines FROM cl JOIN runs USING ({_PAGE}, line))
, e0 AS (SELECT {_TABLE}, floor(lines * 0.15) AS few, x0 AS x, 1 AS step FROM inn UNION ALL SELECT {_TABLE}, floor(lines * 0.15), x1, -1 FROM inn)
, e1 AS (SELECT *, sum(step) OVER (PARTITION BY {_TABLE} ORDER BY x, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cover FROM e0)
, e2 AS (SELECT *, lag(x) OVER (PARTITION BY {_TABLE} ORDER BY x, step) AS before FROM e1 WHERE (step = 1 AND cover = few + 1) OR (step = -1 AND cover = few))
, k0 AS (SELECT {_TABLE}, x, row_number() OVER (PARTITION BY {_TABLE} ORDER BY x) - 1 AS col FROM e2 WHERE step = 1 AND (before IS NULL OR x - before >= 6))
, k1 AS (SELECT {_TABLE}, min(x0) AS lft, max(x1) AS rgt FROM inn GROUP BY {_TABLE})
, k2 AS (SELECT {_TABLE}, col, CASE WHEN col = 0 THEN least(x, lft) ELSE x END AS x0, coalesce(lead(x) OVER (PARTITION BY {_TABLE} ORDER BY col), greatest(rgt, x)) AS x1, count(*) OVER (PARTITION BY {_TABLE}) AS cols FROM k0 JOIN k1 USING ({_TABLE}))
, k3 AS (SELECT {_TABLE}, nth AS rw, y0, coalesce(lead(y0) OVER (PARTITION BY {_TABLE} ORDER BY nth), y1) AS y1 FROM runs)
, g AS (SELECT {_TABLE}, rw, col, k2.x0, k3.y0, k2.x1, k3.y1, rw AS to_row, col AS to_col, k2.x0 AS bx0, k3.y0 AS by0, k2.x1 AS bx1, k3.y1 AS by1 FROM k3 JOIN k2 USING ({_TABLE}) WHERE cols > 1)
"""
#: CTEs from segments to the grid g of tables with drawn lines.
_LINE_GRID = f"""
, s0 AS (SELECT {_PAGE}, abs(x1 - x0) <= 1.5 AS up, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, x0, y0, x1, y1 FROM segments WHERE least(abs(x1 - x0), abs(y1 - y0)) <= 1.5 AND greatest(abs(x1 - x0), abs(y1 - y0)) > 0)
, s1 AS (SELECT {_PAGE}, up, CASE WHEN up THEN mx ELSE my END AS at_, CASE WHEN up THEN least(y0, y1) ELSE least(x0, x1) END AS low, CASE WHEN up THEN greatest(y0, y1) ELSE greatest(x0, x1) END AS high FROM s0)
, s2 AS (SELECT *, CASE WHEN coalesce(at_ - lag(at_) OVER (PARTITION BY {_PAGE}, up ORDER BY at_, low, high) > 1.5, true) THEN at_ END AS fresh FROM s1)
, s3 AS (SELECT {_PAGE}, up, last_value(fresh IGNORE NULLS) OVER (PARTITION BY {_PAGE}, up ORDER BY at_, low, high ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_, low, high FROM s2)
, s4 AS (SELECT *, max(high) OVER (PARTITION BY {_PAGE}, up, at_ ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s3)
, s5 AS (SELECT *, sum(CASE WHEN coalesce(low > before + 1.5, true) THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE}, up, at_ ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS piece FROM s4)
, s6 AS (SELECT {_PAGE}, up, at_, min(low) AS low, max(high) AS high FROM s5 GROUP BY {_PAGE}, up, at_, piece HAVING max(high) - min(low) >= 8)
, ln AS (SELECT *, row_number() OVER (PARTITION BY {_PAGE} ORDER BY up, at_, low, high) AS id FROM s6)
, cr AS (SELECT a.doc_id, a.page_num, a.id AS a, b.id AS b FROM ln a JOIN ln b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND NOT a.up AND b.up
    AND b.at_ BETWEEN a.low - 1.5 AND a.high + 1.5 AND a.at_ BETWEEN b.low - 1.5 AND b.high + 1.5)
, ed AS (SELECT * FROM cr UNION SELECT {_PAGE}, b, a FROM cr)
, re(doc_id, page_num, id, m) AS (SELECT DISTINCT {_PAGE}, a, a FROM ed UNION SELECT ed.doc_id, ed.page_num, ed.b, re.m FROM re JOIN ed ON ed.doc_id = re.doc_id AND ed.page_num = re.page_num AND ed.a = re.id)
, tl AS (SELECT {_PAGE}, tab, up, at_, low, high FROM (SELECT {_PAGE}, id, min(m) AS tab FROM re GROUP BY {_PAGE}, id) q JOIN ln USING ({_PAGE}, id))
, ax AS (SELECT {_TABLE}, up, at_, lead(at_) OVER (PARTITION BY {_TABLE}, up ORDER BY at_) AS nxt, row_number() OVER (PARTITION BY {_TABLE}, up ORDER BY at_) - 1 AS nth, count(*) OVER (PARTITION BY {_TABLE}, up) AS n FROM (SELECT DISTINCT {_TABLE}, up, at_ FROM tl) q)
, at0 AS (SELECT x.doc_id, x.page_num, x.tab, y.nth AS rw, x.nth AS col, x.at_ AS x0, x.nxt AS x1, y.at_ AS y0, y.nxt AS y1 FROM ax x JOIN ax y ON x.doc_id = y.doc_id AND x.page_num = y.page_num AND x.tab = y.tab AND x.up AND NOT y.up
    AND x.nxt IS NOT NULL AND y.nxt IS NOT NULL AND x.n + y.n > 4)
, at1 AS (SELECT *, EXISTS (SELECT 1 FROM tl WHERE tl.doc_id = at0.doc_id AND tl.page_num = at0.page_num AND tl.tab = at0.tab AND tl.up AND tl.at_ = at0.x0 AND (at0.y0 + at0.y1) / 2 BETWEEN tl.low - 1.5 AND tl.high + 1.5) AS lft,
    EXISTS (SELECT 1 FROM tl WHERE tl.doc_id = at0.doc_id AND tl.page_num = at0.page_num AND tl.tab = at0.tab AND NOT tl.up AND tl.at_ = at0.y0 AND (at0.x0 + at0.x1) / 2 BETWEEN tl.low - 1.5 AND tl.high + 1.5) AS top FROM at0)
, at2 AS (SELECT *, coalesce(max(CASE WHEN lft THEN col END) OVER (PARTITION BY {_TABLE}, rw ORDER BY col), 0) AS to_col, coalesce(max(CASE WHEN top THEN rw END) OVER (PARTITION BY {_TABLE}, col ORDER BY rw), 0) AS to_row FROM at1)
, g AS (SELECT {_TABLE}, rw, col, x0, y0, x1, y1, to_row, to_col, min(x0) OVER w AS bx0, min(y0) OVER w AS by0, max(x1) OVER w AS bx1, max(y1) OVER w AS by1 FROM at2 WINDOW w AS (PARTITION BY {_TABLE}, to_row, to_col))
"""
#: CTEs from the grid g and spans to the tables f, with cells as one string and as lists.
_FILLED = f"""
, pl AS (SELECT g.doc_id, g.page_num, g.tab, to_row, to_col, span_no, text, s.x0, s.y0, (s.x1 - s.x0) * (s.y1 - s.y0) AS area,
    greatest(0, least(s.x1, bx1) - greatest(s.x0, bx0)) * greatest(0, least(s.y1, by1) - greatest(s.y0, by0)) AS covered
  FROM spans s JOIN g ON g.doc_id = s.doc_id AND g.page_num = s.page_num AND least((s.x0 + s.x1) / 2, s.x0 + 2) >= g.x0 AND least((s.x0 + s.x1) / 2, s.x0 + 2) < g.x1 AND (s.y0 + s.y1) / 2 >= g.y0 AND (s.y0 + s.y1) / 2 < g.y1)
, tx AS (SELECT {_TABLE}, to_row AS rw, to_col AS col, string_agg(text, ' ' ORDER BY y0, x0, span_no) AS text FROM pl GROUP BY {_TABLE}, to_row, to_col)
, cf AS (SELECT {_TABLE}, CASE WHEN sum(area) > 0 THEN sum(covered) / sum(area) ELSE 1 END AS confidence FROM pl GROUP BY {_TABLE})
, rw AS (SELECT {_TABLE}, rw, list(text ORDER BY col) AS r, min(g.y0) AS y0, min(g.x0) AS x0 FROM g LEFT JOIN tx USING ({_TABLE}, rw, col) GROUP BY {_TABLE}, rw)
, f AS (SELECT {_TABLE}, list(r ORDER BY rw) AS cells, min(y0) AS y0, min(x0) AS x0 FROM rw GROUP BY {_TABLE})
, found AS (SELECT {_PAGE}, (row_number() OVER (PARTITION BY {_PAGE} ORDER BY f.y0, f.x0, tab) - 1)::INT AS table_idx, cells, confidence FROM f JOIN cf USING ({_TABLE}))
"""
_CELLS = "array_to_string(list_transform(cells, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '~')), chr(31))), chr(30))"


def _joined(found: DataFrame) -> DataFrame:
    rows = F.transform("cells", lambda r: F.array_join(r, "\x1f", "~"))
    return found.withColumns({"cells": F.array_join(rows, "\x1e"), "confidence": F.round("confidence", 9)})


_UNRULED = reports.sql("spans") + _TEXT_GRID + _FILLED
_RULED = reports.sql("spans", "segments").replace("WITH ", "WITH RECURSIVE ", 1) + _LINE_GRID + _FILLED


@query(_UNRULED + f"SELECT {_PAGE}, table_idx, {_CELLS} AS cells, round(confidence, 9)::DOUBLE AS confidence, 'unruled' AS method FROM found")
def unruled_tables(spark, sf_dir):
    return _joined(table_finder.unruled_tables(reports.spans(spark, sf_dir)))


@query(_RULED + f"SELECT {_PAGE}, table_idx, {_CELLS} AS cells, round(confidence, 9)::DOUBLE AS confidence, 'ruled' AS method FROM found")
def ruled_tables(spark, sf_dir):
    return _joined(table_finder.ruled_tables(reports.spans(spark, sf_dir), reports.segments(spark, sf_dir), partitions=reports.partitions(spark, sf_dir)))


#: Lines are drawn for every third customer only; the others' tables are found by gaps.
@query(_RULED.replace("FROM segments WHERE", "FROM segments WHERE doc_id % 3 = 0 AND") + f", ruled AS (SELECT * FROM found), unruled AS ({_UNRULED} SELECT * FROM found)" + f"""
SELECT {_PAGE}, table_idx, {_CELLS} AS cells, round(confidence, 9)::DOUBLE AS confidence, method FROM (
  SELECT *, 'ruled' AS method FROM ruled UNION ALL SELECT *, 'unruled' FROM unruled u WHERE NOT EXISTS (SELECT 1 FROM ruled r WHERE r.doc_id = u.doc_id AND r.page_num = u.page_num)) q""")
def table_fallback(spark, sf_dir):
    return _joined(table_finder.find_tables(reports.spans(spark, sf_dir), reports.segments(spark, sf_dir).where("doc_id % 3 = 0"), partitions=reports.partitions(spark, sf_dir)))


@query(_UNRULED + """
, kept AS (SELECT *, len(list_filter(cells[1], lambda c: c IS NOT NULL)) > len(cells[1]) * 0.5 AS p FROM found WHERE confidence >= 0.985)
, used AS (SELECT *, list_filter(range(1, len(cells[1]) + 1), lambda j: len(list_filter(cells, lambda r: r[j] IS NOT NULL)) > 0) AS u FROM kept)
SELECT doc_id, page_num, table_idx, array_to_string(CASE WHEN p THEN list_transform(u, lambda j: coalesce(cells[1][j], '')) ELSE list_transform(u, lambda j: (j - 1)::VARCHAR) END, chr(31)) AS columns,
  array_to_string(list_transform(CASE WHEN p THEN cells[2:] ELSE cells END, lambda r: array_to_string(list_transform(u, lambda j: coalesce(r[j], '')), chr(31))), chr(30)) AS cells FROM used""")
def measured_tables(spark, sf_dir):
    t = tables.clean_tables(table_finder.unruled_tables(reports.spans(spark, sf_dir)), 0.985)
    return t.select("doc_id", "page_num", "table_idx", F.array_join("columns", "\x1f").alias("columns"), F.array_join(F.transform("cells", lambda r: F.array_join(r, "\x1f")), "\x1e").alias("cells"))
