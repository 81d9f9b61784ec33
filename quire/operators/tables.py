"""Tables: cleaning, Markdown, records, confidence and the choice between finders.

A table is (doc_id, page_num, table_idx, cells array<array<string>>, confidence,
method), with ``columns`` once it is clean; ragged widths are why cells are arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def clean_tables(tables: DataFrame, least: float = 0.5, blank_is_null: bool = False) -> DataFrame:
    """Tables of at least that confidence, clean.

    All-null rows and columns go; the first of several rows becomes the header if
    over half of it is filled, else columns are numbered; cells are stripped,
    nulls empty. In steps, so that each is made once: the places of filled cells
    first, whose distinct ones are the columns that stay.
    """
    t = tables.where(F.col("confidence") >= least)
    cells = F.col("cells")
    if blank_is_null:
        cells = F.transform(cells, lambda r: F.transform(r, lambda c: F.when(strip(c) != "", c)))
    t = t.withColumn("_rows", F.filter(cells, lambda r: F.exists(r, lambda c: c.isNotNull())))
    places = F.flatten(F.transform("_rows", lambda r: F.filter(F.transform(r, lambda c, j: F.when(c.isNotNull(), j)), lambda j: j.isNotNull())))
    t = t.withColumn("_used", F.array_sort(F.array_distinct(places)))
    head = F.transform("_used", lambda j: F.get(F.get("_rows", F.lit(0)), j))
    promote = (F.size("_rows") > 1) & (F.size(F.filter(head, lambda c: c.isNotNull())) > F.size("_used") * 0.5)
    t = t.withColumn("_promote", promote)
    body = F.when(F.col("_promote"), F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))).otherwise(F.col("_rows"))
    columns = F.when(F.col("_promote"), F.transform(head, lambda c: F.coalesce(c, F.lit("")))).otherwise(F.transform("_used", lambda j: j.cast("string")))
    t = t.withColumn("columns", columns)
    t = t.withColumn("cells", F.transform(body, lambda r: F.transform("_used", lambda j: F.coalesce(strip(F.get(r, j)), F.lit("")))))
    return t.drop("_rows", "_used", "_promote")


def table_markdown(columns: Column, cells: Column) -> Column:
    """A pipe table without padding or index; empty if it has no rows."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(columns, lambda c: F.lit("---")), "|"), F.lit("|"))
    return F.when(F.size(cells) > 0, F.concat_ws("\n", row(columns), rule, F.array_join(F.transform(cells, row), "\n"))).otherwise("")


def table_records(columns: Column, cells: Column) -> Column:
    """JSON records; of columns with one name the last counts."""
    last = F.filter(F.sequence(F.lit(0), F.size(columns) - 1), lambda j: ~F.array_contains(F.slice(columns, j + 2, F.size(columns)), F.get(columns, j)))
    one = lambda r: F.map_from_arrays(F.transform(last, lambda j: F.get(columns, j)), F.transform(last, lambda j: F.get(r, j)))
    return F.when(F.size(columns) > 0, F.to_json(F.transform(cells, one))).otherwise("[]")


def first_found(ruled: DataFrame, fallback: DataFrame) -> DataFrame:
    """The tables of the first finder, and those of the second on pages where the first has none, whatever their confidence."""
    both = ruled.withColumn("_turn", F.lit(0)).unionByName(fallback.withColumn("_turn", F.lit(1)))
    first = F.min("_turn").over(Window.partitionBy("doc_id", "page_num"))
    return both.withColumn("_first", first).where("_turn = _first").drop("_turn", "_first")
