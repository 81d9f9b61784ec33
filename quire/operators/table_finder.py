"""Finding tables on pages: by drawn lines, or by the gaps between texts.

Input are spans (doc_id, page_num, span_no, text, x0, y0, x1, y1) and segments
(doc_id, page_num, x0, y0, x1, y1), from the top left corner of a page. Either way
a table becomes a grid of rectangles; texts are placed in it by a containment
join, which also measures the confidence, the share of the texts' area that lies
inside their cells.

Everything is windows, sweeps and one join by page, so spans that are dealt by page
move no more; the only Python joins the crossing lines of pages to grids, by Arrow
batch. A grid is a row for each of a table's: (doc_id, page_num, table, rows, cols,
top, left, row, y0, y1, cells).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import first_found

PAGE = ["doc_id", "page_num"]
TABLE = [*PAGE, "table"]
SHAPE = ["rows", "cols", "top", "left"]
#: Points between texts of different cells; lines that are this close are one.
GAP, CLOSE = 6.0, 1.5
#: Shortest drawn line that counts.
SHORTEST = 8.0
#: Width of the stripes, in points, by which crossing lines meet, and height of the blocks of rows that texts meet.
TILE, BLOCK = 64.0, 128.0
#: Pairs of lines that are looked at at once.
PAIRS = 1 << 20
#: Share of a table's rows that may write across a border between columns.
ACROSS = 0.15
#: Heights of a row that may be between two rows of a table.
APART = 3.0


#: What ``functions.text.strip`` takes off, as characters.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _bare(text: Column) -> Column:
    """Stripped without a regular expression, of which there would be several a span."""
    return F.btrim(text, F.lit(SPACES))


def _running(order: Window, last: int = 0):
    return order.rowsBetween(Window.unboundedPreceding, last)


def text_rows(spans: DataFrame) -> DataFrame:
    """Non-blank spans with ``row``: texts that overlap in y by over 30 % of their height are on one row."""
    own = spans.where(_bare(F.col("text")) != "").select(*PAGE, "span_no", _bare(F.col("text")).alias("text"), "x0", "y0", "x1", "y1")
    down = Window.partitionBy(*PAGE).orderBy("y0", "x0", "span_no")
    below = F.max("y1").over(_running(down, -1))
    starts = F.when(below.isNull() | (F.col("y0") + 0.3 * (F.col("y1") - F.col("y0")) >= below), 1).otherwise(0)
    return own.withColumn("_starts", starts).withColumn("row", F.sum("_starts").over(_running(down))).drop("_starts")


def row_cells(rows: DataFrame, gap: float = GAP) -> DataFrame:
    """(doc_id, page_num, row, cell, x0, x1, y0, y1): the texts of a row that are closer than ``gap`` are one cell."""
    across = Window.partitionBy(*PAGE, "row").orderBy("x0", "span_no")
    before = F.max("x1").over(_running(across, -1))
    cells = rows.withColumn("_starts", F.when(before.isNull() | (F.col("x0") - before >= gap), 1).otherwise(0)).withColumn("cell", F.sum("_starts").over(_running(across)))
    return cells.groupBy(*PAGE, "row", "cell").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])


def table_runs(cells: DataFrame, apart: float = APART) -> DataFrame:
    """(doc_id, page_num, table, row, y0, y1, ends, rows): runs of two or more neighbouring rows of two or more cells; ``ends`` are a row's cells as (x0, x1)."""
    rows = cells.groupBy(*PAGE, "row").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.collect_list(F.struct("x0", "x1")).alias("ends")).withColumn("n", F.size("ends"))
    down = Window.partitionBy(*PAGE).orderBy("row")
    near = (F.lag("n").over(down) > 1) & (F.col("y0") - F.lag("y1").over(down) <= apart * (F.col("y1") - F.col("y0")))
    rows = rows.withColumn("_starts", F.when((F.col("n") > 1) & ~F.coalesce(near, F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("table", F.sum("_starts").over(_running(down))).where("n > 1")
    return rows.withColumn("rows", F.count("*").over(Window.partitionBy(*TABLE)).cast("int")).where("rows > 1").select(*TABLE, "row", "y0", "y1", "ends", "rows")


def column_starts(ends: Column, rows: Column, gap: float = GAP, across: float = ACROSS) -> Column:
    """Where the columns of a table begin, from its cells' (x0, x1).

    A sweep over the cells' ends counts how many cover a place; columns are the
    stretches that more than ``across`` of the rows cover, and gaps narrower than
    ``gap`` are none. The array that the sweep carries has a place a column only.
    """
    few = F.floor(rows * across)
    step = lambda x, n: F.transform(ends, lambda c: F.struct(c[x].alias("x"), F.lit(n).alias("step")))

    def sweep(at, e):
        cover = at["cover"] + e["step"]
        begins, stops = (e["step"] == 1) & (cover == few + 1), (e["step"] == -1) & (cover == few)
        starts = begins & (at["before"].isNull() | (e["x"] - at["before"] >= gap))
        return F.struct(cover.alias("cover"), F.when(begins | stops, e["x"]).otherwise(at["before"]).alias("before"), F.when(starts, F.concat(at["xs"], F.array(e["x"]))).otherwise(at["xs"]).alias("xs"))

    none = F.struct(F.lit(0).alias("cover"), F.lit(None).cast("double").alias("before"), F.array().cast("array<double>").alias("xs"))
    return F.aggregate(F.sort_array(F.concat(step("x0", 1), step("x1", -1))), none, sweep, lambda at: at["xs"])


def text_grid(spans: DataFrame, gap: float = GAP, across: float = ACROSS, apart: float = APART) -> DataFrame:
    """The grid of tables without lines: a run's rows by its columns, two at least."""
    runs = table_runs(row_cells(text_rows(spans), gap), apart)
    lists = F.sort_array(F.collect_list(F.struct("row", "y0", "y1"))).alias("lines"), F.flatten(F.collect_list("ends")).alias("ends")
    t = runs.groupBy(*TABLE, "rows").agg(*lists).withColumn("xs", column_starts(F.col("ends"), F.col("rows"), gap, across)).where(F.size("xs") > 1)
    first, last = F.get("xs", F.lit(0)), F.get("xs", F.size("xs") - 1)
    left = F.least(first, F.array_min(F.transform("ends", lambda c: c["x0"])))
    right = F.greatest(last, F.array_max(F.transform("ends", lambda c: c["x1"])))
    inner = F.slice("xs", F.lit(2), F.size("xs") - 1)
    t = t.select(*TABLE, "rows", F.size("xs").alias("cols"), F.get("lines", F.lit(0))["y0"].alias("top"), left.alias("left"), F.concat(F.array(left), inner, F.array(right)).alias("xs"), "lines")
    t = t.select(*TABLE, *SHAPE, "xs", "lines", F.posexplode("lines").alias("row", "line"))
    t = t.select(*TABLE, *SHAPE, "xs", "row", F.col("line")["y0"].alias("y0"), F.coalesce(F.get("lines", F.col("row") + 1)["y0"], F.col("line")["y1"]).alias("y1"))
    x = lambda j: F.get("xs", j)
    cell = lambda j: F.struct(x(j).alias("x0"), x(j + 1).alias("x1"), F.col("row").alias("to_row"), j.alias("to_col"), x(j).alias("in_x0"), F.col("y0").alias("in_y0"), x(j + 1).alias("in_x1"), F.col("y1").alias("in_y1"))
    return t.select(*TABLE, *SHAPE, "row", "y0", "y1", F.transform(F.sequence(F.lit(0), F.col("cols") - 1), cell).alias("cells"))


def drawn_lines(segments: DataFrame, close: float = CLOSE, shortest: float = SHORTEST) -> DataFrame:
    """(doc_id, page_num, upright, at, low, high): upright and level lines, of pieces that touch.

    Segments of about one place are put on the first of them, and those that
    overlap or nearly touch there are one line.
    """
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    s = segments.select(*PAGE, (dx <= close).alias("upright"), dx.alias("dx"), dy.alias("dy"), "x0", "y0", "x1", "y1").where(F.least("dx", "dy") <= close).where(F.greatest("dx", "dy") > 0)
    pick = lambda a, b: F.when(F.col("upright"), a).otherwise(b)
    s = s.select(*PAGE, "upright", pick((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2).alias("at"), pick(F.least("y0", "y1"), F.least("x0", "x1")).alias("low"), pick(F.greatest("y0", "y1"), F.greatest("x0", "x1")).alias("high"))
    kind = Window.partitionBy(*PAGE, "upright").orderBy("at", "low", "high")
    apart = F.col("at") - F.lag("at").over(kind) > close
    s = s.withColumn("_new", F.when(F.coalesce(apart, F.lit(True)), F.col("at"))).withColumn("at", F.last("_new", ignorenulls=True).over(_running(kind)))
    along = Window.partitionBy(*PAGE, "upright", "at").orderBy("low", "high")
    broken = F.col("low") > F.max("high").over(_running(along, -1)) + close
    s = s.withColumn("_starts", F.when(F.coalesce(broken, F.lit(True)), 1).otherwise(0)).withColumn("_piece", F.sum("_starts").over(_running(along)))
    return s.groupBy(*PAGE, "upright", "at", "_piece").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_piece").where(F.col("high") - F.col("low") >= shortest)


def _buckets(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def crossings(lines: DataFrame, close: float = CLOSE, tile: float = TILE) -> DataFrame:
    """(doc_id, page_num, level, upright): the crossing lines as (at, low, high), met in stripes of the page."""
    line = F.struct("at", "low", "high")
    level = lines.where("not upright").select(*PAGE, line.alias("level"), F.explode(_buckets(F.col("low") - close, F.col("high") + close, tile)).alias("stripe"))
    up = lines.where("upright").select(*PAGE, line.alias("up"), F.floor(F.col("at") / tile).alias("stripe"))
    met = level.join(up, [*PAGE, "stripe"])
    reach = lambda a, b: (F.col(f"{a}.at") >= F.col(f"{b}.low") - close) & (F.col(f"{a}.at") <= F.col(f"{b}.high") + close)
    return met.where(reach("up", "level") & reach("level", "up")).select(*PAGE, "level", F.col("up").alias("upright"))


def _crossed(levels: pa.Array, ups: pa.Array, close: float) -> pa.Array:
    """The grids of pages, in order of their first level line, from the pages' lines as sorted lists of (at, low, high)."""
    (lp, lx), (up, ux) = ((np.repeat(np.arange(len(a)), a.value_lengths()), a.flatten()) for a in (levels, ups))
    (la, ll, lh), (ua, ul, uh) = ([v.field(k).to_numpy() for k in range(3)] for v in (lx, ux))
    n, places = len(lp), up + 1j * ua  # complex numbers are ordered by page, then place
    first, past = np.searchsorted(places, lp + 1j * (ll - close), "left"), np.searchsorted(places, lp + 1j * (lh + close), "right")
    top, met = np.arange(n + len(up)), np.zeros(n + len(up), bool)
    total = np.concatenate([[0], np.cumsum(past - first)])
    for began in np.unique(np.searchsorted(total, np.arange(0, total[-1], PAIRS))):  # so many pairs at once, or one level line's
        ended = max(began + 1, np.searchsorted(total, total[began] + PAIRS))
        many = (past - first)[began:ended]
        i = np.repeat(np.arange(began, began + len(many)), many)
        j = np.repeat(first[began:ended] - total[began : began + len(many)], many) + np.arange(total[began], total[began] + len(i))
        reach = (la[i] >= ul[j] - close) & (la[i] <= uh[j] + close)
        i, j = i[reach], j[reach] + n
        met[i] = met[j] = True
        while len(i):
            a, b = np.minimum(top[i], top[j]), np.maximum(top[i], top[j])
            np.minimum.at(top, b, a)
            while (top[top] != top).any():
                top = top[top]
            apart = top[i] != top[j]
            i, j = i[apart], j[apart]
    tables = np.unique(top[met])

    def lists(begin, end, lines):
        own = np.flatnonzero(met[begin:end])
        own = own[np.argsort(top[begin:end][own], kind="stable")]
        ends = np.searchsorted(top[begin:end][own], tables, "right")
        return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype("int32"), lines.take(pa.array(own)))

    grids = pa.StructArray.from_arrays([lists(0, n, lx), lists(n, len(top), ux)], names=["levels", "ups"])
    return pa.ListArray.from_arrays(np.searchsorted(lp[tables], np.arange(len(levels) + 1)).astype("int32"), grids)


def crossed(levels: Column, ups: Column, close: float = CLOSE) -> Column:
    """A page's grids of crossing lines, as (levels, ups), in order of their first level line; both lists are sorted (at, low, high)."""
    lines = "array<struct<at:double,low:double,high:double>>"
    return F.arrow_udf(lambda a, b: _crossed(a, b, close), f"array<struct<levels:{lines},ups:{lines}>>")(levels, ups)


def line_grid(segments: DataFrame, close: float = CLOSE, shortest: float = SHORTEST, partitions: int | None = None) -> DataFrame:
    """The grid of tables with drawn lines: connected grids of crossing lines.

    A cell without a drawn left or upper border is part of the one beside or above.
    Tables are dealt by page, to ``partitions`` tasks, before they are cells.
    """
    own = F.struct("at", "low", "high")
    kind = lambda up: F.sort_array(F.collect_list(F.when(F.col("upright") == up, own)))
    pages = drawn_lines(segments, close, shortest).groupBy(*PAGE).agg(kind(False).alias("levels"), kind(True).alias("ups")).where((F.size("levels") > 1) & (F.size("ups") > 1))
    t = pages.select(*PAGE, F.posexplode(crossed(F.col("levels"), F.col("ups"), close)).alias("table", "grid")).select(*TABLE, "grid.levels", "grid.ups")
    t = t.repartition(partitions, *PAGE) if partitions else t.repartition(*PAGE)
    t = t.withColumns({"xs": F.array_distinct(F.transform("ups", lambda v: v["at"])), "ys": F.array_distinct(F.transform("levels", lambda v: v["at"]))})
    t = t.where((F.size("xs") > 1) & (F.size("ys") > 1) & (F.size("xs") + F.size("ys") > 4))
    t = t.withColumns({"rows": F.size("ys") - 1, "cols": F.size("xs") - 1, "top": F.get("ys", F.lit(0)), "left": F.get("xs", F.lit(0))})
    # a row has the lines that lie on its upper border and those that pass its middle, so that its cells are made of few
    t = t.select("*", F.posexplode(F.slice("ys", F.lit(1), F.col("rows"))).alias("row", "y0")).withColumn("y1", F.get("ys", F.col("row") + 1))
    over = lambda v, at: (v["low"] - close <= at) & (v["high"] + close >= at)
    above = F.filter("levels", lambda v: v["at"] == F.col("y0"))
    beside = F.transform(F.filter("ups", lambda v: over(v, (F.col("y0") + F.col("y1")) / 2)), lambda v: v["at"])
    t = t.select(*TABLE, *SHAPE, "xs", "row", "y0", "y1", above.alias("above"), beside.alias("beside"))
    t = t.select("*", F.posexplode(F.slice("xs", F.lit(1), F.col("cols"))).alias("col", "x0")).withColumn("x1", F.get("xs", F.col("col") + 1))
    closed = F.array_contains("beside", F.col("x0")).alias("closed"), F.exists("above", lambda v: over(v, (F.col("x0") + F.col("x1")) / 2)).alias("covered")
    t = t.select(*TABLE, *SHAPE, "row", "col", "x0", "y0", "x1", "y1", *closed)
    beside, below = Window.partitionBy(*TABLE, "row").orderBy("col"), Window.partitionBy(*TABLE, "col").orderBy("row")
    t = t.withColumn("to_col", F.coalesce(F.last(F.when(F.col("closed"), F.col("col")), ignorenulls=True).over(_running(beside)), F.lit(0)))
    t = t.withColumn("to_row", F.coalesce(F.last(F.when(F.col("covered"), F.col("row")), ignorenulls=True).over(_running(below)), F.lit(0)))
    whole = Window.partitionBy(*TABLE, "to_row", "to_col")
    box = [F.min(c).over(whole).alias(f"in_{c}") for c in ("x0", "y0")] + [F.max(c).over(whole).alias(f"in_{c}") for c in ("x1", "y1")]
    t = t.select(*TABLE, *SHAPE, "row", "y0", "y1", "x0", "x1", "to_row", "to_col", *box)
    cells = F.sort_array(F.collect_list(F.struct("x0", "x1", "to_row", "to_col", "in_x0", "in_y0", "in_x1", "in_y1")))
    return t.groupBy(*TABLE, *SHAPE, "row", "y0", "y1").agg(cells.alias("cells"))


def placed(grid: DataFrame, spans: DataFrame, tile: float = BLOCK) -> DataFrame:
    """The spans inside a grid's cells, with (table, to_row, to_col) and ``covered``, how much of their area is in that cell.

    A span is in the cell with the point at the middle of its height and two
    points from its left end. A page's spans meet blocks of a table's rows, ``tile``
    points high, and are then looked up among the rows and cells of a block.
    """
    x = lambda k: F.get(F.col("cells"), k)
    blocks = grid.groupBy(*TABLE, *SHAPE, F.floor(F.col("y0") / tile).alias("_block")).agg(
        F.min(x(F.lit(0))["x0"]).alias("c_x0"), F.max(x(F.size("cells") - 1)["x1"]).alias("c_x1"), F.min("y0").alias("c_y0"), F.max("y1").alias("c_y1"),
        F.collect_list(F.struct("y0", "y1", "cells")).alias("lines"),
    ).drop("_block")
    at_x, at_y = F.least((F.col("x0") + F.col("x1")) / 2, F.col("x0") + 2), (F.col("y0") + F.col("y1")) / 2
    s = spans.where(_bare(F.col("text")) != "").select(*PAGE, "span_no", _bare(F.col("text")).alias("text"), "x0", "y0", "x1", "y1", at_x.alias("ax"), at_y.alias("ay"))
    met = s.join(blocks, PAGE).where("ax >= c_x0 and ax < c_x1 and ay >= c_y0 and ay < c_y1")
    met = met.select(*TABLE, *SHAPE, "span_no", "text", "x0", "y0", "x1", "y1", "ax", "ay", F.explode("lines").alias("line")).where("ay >= line.y0 and ay < line.y1")
    met = met.select("*", F.explode("line.cells").alias("cell")).where("ax >= cell.x0 and ax < cell.x1")
    side = lambda k: F.greatest(F.lit(0.0), F.least(f"{k}1", f"cell.in_{k}1") - F.greatest(f"{k}0", f"cell.in_{k}0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return met.select(*TABLE, *SHAPE, "cell.to_row", "cell.to_col", "span_no", "text", "x0", "y0", area.alias("area"), (side("x") * side("y")).alias("covered"))


def tables_of(grid: DataFrame, spans: DataFrame, method: str) -> DataFrame:
    """(doc_id, page_num, table_idx, cells, confidence, method): a grid's tables with their texts, null where a cell has none, in order from the top.

    Texts of a cell are joined by spaces in order of (y0, x0). ``confidence`` is
    the share of the texts' area inside their cells; tables without text are none.
    """
    sums = F.sum("area").alias("area"), F.sum("covered").alias("covered")
    texts = F.sort_array(F.collect_list(F.struct("y0", "x0", "span_no", "text", "to_col")))
    rows = placed(grid, spans).groupBy(*TABLE, *SHAPE, "to_row").agg(texts.alias("texts"), *sums)
    cell = lambda j: F.filter("texts", lambda s: s["to_col"] == j)
    line = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), cell)
    line = F.transform(line, lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda s: s["text"]), " ")))
    t = rows.withColumn("line", line).groupBy(*TABLE, *SHAPE).agg(F.map_from_entries(F.collect_list(F.struct("to_row", "line"))).alias("lines"), *sums)
    empty = F.array_repeat(F.lit(None).cast("string"), F.col("cols"))
    t = t.withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.coalesce(F.try_element_at("lines", i), empty)))
    idx = F.row_number().over(Window.partitionBy(*PAGE).orderBy("top", "left", "table")) - 1
    share = F.when(F.col("area") > 0, F.col("covered") / F.when(F.col("area") > 0, F.col("area"))).otherwise(1.0)
    return t.select(*PAGE, idx.cast("int").alias("table_idx"), "cells", share.alias("confidence"), F.lit(method).alias("method"))


def unruled_tables(spans: DataFrame, **options) -> DataFrame:
    """Tables found by the gaps between texts; pages without any have no row."""
    return tables_of(text_grid(spans, **options), spans, "unruled")


def ruled_tables(spans: DataFrame, segments: DataFrame, **options) -> DataFrame:
    """Tables found by their drawn lines; pages without lines have no row."""
    return tables_of(line_grid(segments, **options), spans, "ruled")


def find_tables(spans: DataFrame, segments: DataFrame, method: str = "auto", partitions: int | None = None) -> DataFrame:
    """Tables by ``'ruled'``, ``'unruled'``, or with ``'auto'`` by lines and, on pages where those show none, by gaps."""
    if method == "ruled":
        return ruled_tables(spans, segments, partitions=partitions)
    if method == "unruled":
        return unruled_tables(spans)
    if method != "auto":
        raise ValueError(f"no such method: {method}")
    return first_found(ruled_tables(spans, segments, partitions=partitions), unruled_tables(spans))
