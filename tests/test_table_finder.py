"""Tables by gaps and by lines: grids, merged cells, ragged rows, pages without any."""

import math

import pytest

from quire.operators import table_finder as tf

SPANS = "doc_id long, page_num int, span_no int, text string, x0 double, y0 double, x1 double, y1 double"
SEGMENTS = "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double"


def spans(spark, rows):
    """(doc, page, text, x, y[, x1]): five points a character, ten high."""
    return spark.createDataFrame([(d, p, k, t, float(x), float(y), float(end[0] if end else x + 5 * len(t)), float(y + 10)) for k, (d, p, t, x, y, *end) in enumerate(rows)], SPANS)


def box(doc, page, xs, ys, without=()):
    """Segments of a grid, a piece for each side of each cell; ``without`` are (x, y) of upright pieces left out."""
    out = [(doc, page, float(a), float(y), float(b), float(y)) for y in ys for a, b in zip(xs, xs[1:])]
    return out + [(doc, page, float(x), float(a), float(x), float(b)) for x in xs for a, b in zip(ys, ys[1:]) if (x, a) not in without]


def found(tables):
    return {(r.doc_id, r.page_num, r.table_idx): (r.cells, round(r.confidence, 6)) for r in tables.collect()}


def test_gaps_make_columns(spark):
    rows = [(1, 0, t, x, 14 * k) for k, line in enumerate([("Name", "Age", "Town"), ("Ann", "7", "Oslo"), ("Bertram", "", "Rome"), ("Cy", "12", "")]) for t, x in zip(line, (10, 60, 100))]
    assert found(tf.unruled_tables(spans(spark, rows))) == {(1, 0, 0): ([["Name", "Age", "Town"], ["Ann", "7", "Oslo"], ["Bertram", None, "Rome"], ["Cy", "12", None]], 1.0)}


def test_words_of_a_cell_stay_together(spark):
    rows = [(1, 0, "two", 10, 0), (1, 0, "words", 28, 1), (1, 0, "right", 90, 0), (1, 0, "one", 10, 14), (1, 0, "side", 90, 14)]
    assert found(tf.unruled_tables(spans(spark, rows))) == {(1, 0, 0): ([["two words", "right"], ["one", "side"]], 1.0)}


def test_text_apart_ends_a_table(spark):
    table = lambda page, y: [(1, page, t, x, y + 14 * k) for k in range(2) for t, x in ((f"a{y}", 10), ("b", 80))]
    prose = [(1, 0, "A paragraph across the whole page that is text.", 10, 28)]
    got = found(tf.unruled_tables(spans(spark, table(0, 0) + prose + table(0, 42) + table(0, 200) + table(1, 0) + [(1, 2, "only text", 10, 0), (1, 3, "one", 10, 0), (1, 3, "row", 90, 0)])))
    assert {k: c[0][0] for k, (c, _) in got.items()} == {(1, 0, 0): "a0", (1, 0, 1): "a42", (1, 0, 2): "a200", (1, 1, 0): "a0"}


def test_remarks_across_columns_lower_the_confidence(spark):
    rows = [(1, 0, f"{c}{k}", x, 14 * k) for k in range(8) for c, x in (("a", 10), ("b", 60), ("c", 110)) if k != 3] + [(1, 0, "a remark across two columns", 10, 42), (1, 0, "c3", 160, 42)]
    (cells, confidence), = found(tf.unruled_tables(spans(spark, rows))).values()
    assert cells[0][:3] == ["a0", "b0", "c0"] and cells[3][0] == "a remark across two columns" and 0.5 < confidence < 0.9


def test_lines_make_cells(spark):
    s = spans(spark, [(1, 0, "a", 12, 12), (1, 0, "b", 62, 12), (1, 0, "c", 12, 32), (1, 0, "d1", 62, 26), (1, 0, "d2", 62, 33), (1, 0, "outside", 200, 12)])
    g = spark.createDataFrame(box(1, 0, (10, 60, 110), (10, 25, 45)), SEGMENTS)
    assert found(tf.ruled_tables(s, g)) == {(1, 0, 0): ([["a", "b"], ["c", "d1 d2"]], 1.0)}


def test_cells_without_a_border_are_one(spark):
    s = spans(spark, [(1, 0, "a title for both", 12, 12), (1, 0, "c", 12, 32), (1, 0, "d", 62, 32)])
    g = spark.createDataFrame(box(1, 0, (10, 60, 110), (10, 25, 45), without={(60, 10)}), SEGMENTS)
    assert found(tf.ruled_tables(s, g)) == {(1, 0, 0): ([["a title for both", None], ["c", "d"]], 1.0)}
    # the border drawn, the title leaves its cell
    g = spark.createDataFrame(box(1, 0, (10, 60, 110), (10, 25, 45)), SEGMENTS)
    (_, confidence), = found(tf.ruled_tables(s, g)).values()
    area = 80 * 10 + 2 * 5 * 10
    assert confidence == round((48 * 10 + 2 * 5 * 10) / area, 6)


def test_grids_beside_and_inside_each_other(spark):
    """Grids that don't cross are tables of their own; a frame alone and lines that meet nothing are none."""
    segments = box(1, 0, (10, 60, 110), (10, 25, 45)) + box(1, 0, (150, 200, 250), (10, 25, 45)) + box(1, 0, (300, 400), (10, 45)) + box(2, 1, (10, 60, 110), (10, 25, 45)) + [(1, 0, 10.0, 300.0, 200.0, 300.0), (1, 0, 0.0, 0.0, 90.0, 90.0)]
    s = spans(spark, [(1, 0, "left", 12, 12), (1, 0, "right", 152, 12), (1, 0, "framed", 310, 12), (2, 1, "other", 62, 30)])
    got = found(tf.ruled_tables(s, spark.createDataFrame(segments, SEGMENTS)))
    assert {k: [t for r in c for t in r if t] for k, (c, _) in got.items()} == {(1, 0, 0): ["left"], (1, 0, 1): ["right"], (2, 1, 0): ["other"]}


def test_broken_and_doubled_lines(spark):
    """Pieces that nearly touch are one line, and so are lines drawn as thin boxes."""
    thin = [(1, 0, float(x), 10.0, x + 0.5, 45.0) for x in (10, 60, 110)] + [(1, 0, 10.0, y, 59.0, y) for y in (10.0, 25.0, 45.0)] + [(1, 0, 60.0, y + 0.5, 110.0, y + 0.5) for y in (10.0, 25.0, 45.0)]
    s = spans(spark, [(1, 0, "a", 12, 12), (1, 0, "d", 62, 30)])
    assert found(tf.ruled_tables(s, spark.createDataFrame(thin, SEGMENTS))) == {(1, 0, 0): ([["a", None], [None, "d"]], 1.0)}


@pytest.mark.parametrize("tile", [7.0, 64.0, 5000.0])
def test_placing_does_not_depend_on_tiles(spark, monkeypatch, tile):
    """Every text is in the one cell that a plain search finds."""
    xs, ys = (10.0, 33.0, 64.0, 128.0, 190.5), (5.0, 64.0, 70.0, 200.0)
    rows = [(1, 0, f"t{i}.{j}", 3 + 13.7 * i, 2 + 17.3 * j) for i in range(15) for j in range(12)]
    s = spans(spark, rows)
    grid = tf.line_grid(spark.createDataFrame(box(1, 0, xs, ys), SEGMENTS))
    got = {r.text: (r.to_row, r.to_col) for r in tf.placed(grid, s, tile).collect()}
    want = {}
    for _, _, t, x, y in rows:
        ax, ay = min(x + 2.5 * len(t), x + 2), y + 5
        where = [(r, c) for c in range(4) for r in range(3) if xs[c] <= ax < xs[c + 1] and ys[r] <= ay < ys[r + 1]]
        if where:
            want[t] = where[0]
    assert got == want and len(want) > 50


def test_crossings_do_not_depend_on_stripes(spark):
    lines = tf.drawn_lines(spark.createDataFrame(box(1, 0, tuple(range(0, 400, 37)), tuple(range(0, 300, 23))), SEGMENTS))
    assert tf.crossings(lines, tile=11.0).count() == tf.crossings(lines, tile=1000.0).count() == math.ceil(400 / 37) * math.ceil(300 / 23)


def test_auto_takes_lines_first(spark):
    s = spans(spark, [(d, 0, t, x, 12 + 14 * k) for d in (1, 2) for k in range(3) for t, x in (("a", 12), ("b", 62))])
    g = spark.createDataFrame(box(1, 0, (10, 60, 110), (10, 25, 55)), SEGMENTS)
    got = {r.doc_id: (r.method, len(r.cells)) for r in tf.find_tables(s, g).collect()}
    assert got == {1: ("ruled", 2), 2: ("unruled", 3)}
    assert {r.doc_id for r in tf.find_tables(s, g, "unruled").collect()} == {1, 2} and {r.doc_id for r in tf.find_tables(s, g, "ruled").collect()} == {1}
    with pytest.raises(ValueError):
        tf.find_tables(s, g, "odd")


def test_pages_without_anything(spark):
    none, lines = spans(spark, [(1, 0, " ", 0, 0)]), spark.createDataFrame([], SEGMENTS)
    assert tf.unruled_tables(none).count() == 0 and tf.unruled_tables(none.limit(0)).count() == 0 and tf.ruled_tables(none, lines).count() == 0
    assert tf.ruled_tables(none, spark.createDataFrame(box(1, 0, (10, 60, 110), (10, 25, 45)), SEGMENTS)).count() == 0  # a grid without text


def test_grids_of_pages_are_those_of_a_plain_search(monkeypatch):
    """Whatever the number of pairs looked at at once, and with lines that meet nothing or only in a chain."""
    pa, random = pytest.importorskip("pyarrow"), __import__("random").Random(5)
    close = 1.5
    line = lambda: (float(random.randrange(60)), *(lambda a: (float(a), float(a + random.randrange(3, 25))))(random.randrange(60)))
    pages = [[sorted({line() for _ in range(random.randrange(12))}) for _ in range(2)] for _ in range(60)]
    pages[7] = [[(float(10 * k), 10.0 * k, 10.0 * k + 10) for k in range(40)], [(float(10 * k), 10.0 * k - 10, 10.0 * k) for k in range(1, 40)]]
    want = []
    for levels, ups in pages:
        left, own = [(0, v) for v in levels] + [(1, v) for v in ups], []
        meet = lambda a, b: a[0] != b[0] and all(p[0] >= q[1] - close and p[0] <= q[2] + close for p, q in ((a[1], b[1]), (b[1], a[1])))
        while left:
            group, new = [], [left.pop(0)]
            while new:
                group.append(new.pop())
                new += [x for x in left if meet(group[-1], x)]
                left = [x for x in left if x not in new]
            if len(group) > 1:
                own.append({"levels": sorted(v for k, v in group if not k), "ups": sorted(v for k, v in group if k)})
        want.append(own)
    kind = pa.list_(pa.struct([(k, pa.float64()) for k in ("at", "low", "high")]))
    sides = [pa.array([[dict(zip(("at", "low", "high"), v)) for v in p[k]] for p in pages], kind) for k in range(2)]
    for pairs in (1, 7, 1 << 20):
        monkeypatch.setattr(tf, "PAIRS", pairs)
        got = tf._crossed(*sides, close).to_pylist()
        assert [[{k: [tuple(v.values()) for v in vs] for k, vs in g.items()} for g in p] for p in got] == want
    assert sum(map(len, want)) > 50 and tf._crossed(*(s[:0] for s in sides), close).to_pylist() == []


def test_texts_are_stripped_alike(spark):
    from quire.functions.text import strip

    odd = [c + "a" + c + "b" + c for c in map(chr, [*range(1, 0x300), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF])] + [" \t　\n", "", " ​ "]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert not df.where(strip(df.t) != tf._bare(df.t)).collect()
