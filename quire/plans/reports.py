"""Printed reports made of the orders, so that finding tables has something to find.

A customer's orders are rows of five columns, 30 a page, with a paragraph after
every twelve, empty cells, a right-aligned column, and now and then a remark across
two columns. The same tables have drawn lines, in pieces, without a border inside
the remark. One SQL text numbers the orders for Spark and the oracle; Spark then makes
all texts or lines of an order at once, in place of a pass for each kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Orders of a task, about; an order is some seven spans or segments.
ORDERS = 1 << 16

_ROWS = """
WITH numbered AS (
  SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority, o_orderdate AS day,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM {orders})
, listed AS (
  SELECT *, CAST(FLOOR(n / 30.0) AS INT) AS page_num, n % 30 AS nth, 60.0e0 + 14 * (n % 30 + FLOOR((n % 30) / 12.0)) AS y,
    row_number() OVER (PARTITION BY doc_id, CAST(FLOOR(n / 30.0) AS INT), CAST(FLOOR((n % 30) / 12.0) AS INT) ORDER BY n DESC) = 1 AS ends FROM numbered)
"""
_SPANS = """
, texts AS (
  SELECT doc_id, page_num, nth * 6 AS span_no, CAST(k AS VARCHAR(20)) AS text, 40.0e0 AS x, y, 0 AS right_ FROM listed
  UNION ALL SELECT doc_id, page_num, nth * 6 + 1, status, 110.0e0, y, 0 FROM listed WHERE k % 5 <> 0
  UNION ALL SELECT doc_id, page_num, nth * 6 + 2, CAST(CAST(FLOOR(price) AS BIGINT) AS VARCHAR(20)), 190.0e0, y, 1 FROM listed
  UNION ALL SELECT doc_id, page_num, nth * 6 + 3, CASE WHEN k % 11 = 4 THEN 'see the notes on the order' ELSE priority END, 220.0e0, y, 0 FROM listed WHERE k % 7 <> 3
  UNION ALL SELECT doc_id, page_num, nth * 6 + 4, CAST(CAST(day AS DATE) AS VARCHAR(10)), 320.0e0, y, 0 FROM listed WHERE k % 11 <> 4
  UNION ALL SELECT doc_id, page_num, nth * 6 + 5, concat('Orders up to number ', CAST(k AS VARCHAR(20)), ' are above, and further ones follow.'), 40.0e0, y + 14, 0 FROM listed WHERE nth % 12 = 11
  UNION ALL SELECT doc_id, page_num, -1, concat('Customer ', CAST(doc_id AS VARCHAR(20))), 40.0e0, 20.0e0, 0 FROM listed WHERE nth = 0)
, spans AS (
  SELECT doc_id, page_num, CAST(span_no AS INT) AS span_no, text, CAST(x - right_ * 5 * length(text) AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0,
    CAST(x + (1 - right_) * 5 * length(text) AS DOUBLE) AS x1, CAST(y + 10 AS DOUBLE) AS y1 FROM texts)
"""
_SEGMENTS = """
, borders AS (SELECT 36.0e0 AS x UNION ALL SELECT 100.0e0 UNION ALL SELECT 140.0e0 UNION ALL SELECT 205.0e0 UNION ALL SELECT 310.0e0 UNION ALL SELECT 376.0e0)
, segments AS (
  SELECT doc_id, page_num, 36.0e0 AS x0, y - 2 AS y0, 376.0e0 AS x1, y - 2 AS y1 FROM listed
  UNION ALL SELECT doc_id, page_num, 36.0e0, y + 12, 376.0e0, y + 12 FROM listed WHERE ends
  UNION ALL SELECT doc_id, page_num, x, y - 2, x + 0.25e0, y + 12 FROM listed CROSS JOIN borders WHERE NOT (k % 11 = 4 AND x = 310.0e0))
"""


def sql(*tables: str) -> str:
    """CTEs up to the given ones, for DuckDB."""
    return _ROWS.format(orders="orders") + "".join({"spans": _SPANS, "segments": _SEGMENTS}[t] for t in tables)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")


def partitions(spark: SparkSession, sf_dir: str) -> int:
    """So that a task has about so many orders, however many there are; counting them reads the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-_orders(spark, sf_dir).count() // ORDERS))


def _dealt(spark: SparkSession, sf_dir: str, rows) -> DataFrame:
    """What ``rows`` makes of a listed order, an array of structs or nulls, dealt by page; orders are numbered once for all."""
    n = partitions(spark, sf_dir)
    listed = spark.sql(_ROWS + "SELECT * FROM listed", orders=_orders(spark, sf_dir).repartition(n, "o_custkey"))
    made = listed.select("doc_id", "page_num", F.explode(rows).alias("r")).where("r IS NOT NULL").select("doc_id", "page_num", "r.*")
    return made.repartition(n, "doc_id", "page_num")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_num, span_no, text, x0, y0, x1, y1): the rows of ``_SPANS``, all of an order's at once."""
    long = lambda c: c.cast("long").cast("string")
    k, nth, y = F.col("k"), F.col("nth").cast("int"), F.col("y")
    above = F.concat(F.lit("Orders up to number "), long(k), F.lit(" are above, and further ones follow."))
    texts = (  # condition, number in the order, text, x, y, whether that is the right end
        (None, nth * 6, long(k), 40.0, y, False),
        (k % 5 != 0, nth * 6 + 1, F.col("status"), 110.0, y, False),
        (None, nth * 6 + 2, long(F.floor("price")), 190.0, y, True),
        (k % 7 != 3, nth * 6 + 3, F.when(k % 11 == 4, "see the notes on the order").otherwise(F.col("priority")), 220.0, y, False),
        (k % 11 != 4, nth * 6 + 4, F.col("day").cast("date").cast("string"), 320.0, y, False),
        (nth % 12 == 11, nth * 6 + 5, above, 40.0, y + 14, False),
        (nth == 0, F.lit(-1), F.concat(F.lit("Customer "), long(F.col("doc_id"))), 40.0, F.lit(20.0), False),
    )

    def span(condition, span_no, text, x, at, right):
        wide, x = 5 * F.length(text), F.lit(x)
        s = F.struct(span_no.alias("span_no"), text.alias("text"), (x - wide if right else x).alias("x0"), at.alias("y0"), (x if right else x + wide).alias("x1"), (at + 10).alias("y1"))
        return s if condition is None else F.when(condition, s)

    return _dealt(spark, sf_dir, F.array(*[span(*t) for t in texts]))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_num, x0, y0, x1, y1): the rows of ``_SEGMENTS``, all of an order's at once."""
    y = F.col("y")
    line = lambda x0, y0, x1, y1: F.struct(F.lit(x0).alias("x0"), y0.alias("y0"), F.lit(x1).alias("x1"), y1.alias("y1"))
    borders = {x: line(x, y - 2, x + 0.25, y + 12) for x in (36.0, 100.0, 140.0, 205.0, 310.0, 376.0)}
    borders[310.0] = F.when(F.col("k") % 11 != 4, borders[310.0])
    return _dealt(spark, sf_dir, F.array(line(36.0, y - 2, 376.0, y - 2), F.when(F.col("ends"), line(36.0, y + 12, 376.0, y + 12)), *borders.values()))
