"""Plans: what goes by document is shuffled once, and only what is needed is read."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import deck, pages, scripts
from quire.plans import queries, scan
from quire.sources import files
from tests.conftest import SF


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.split("Initial Plan")[0])


def elements(spark):
    return spark.createDataFrame([(1, 0, 0, "title", "T", 1)], "doc_id long, page_num int, pos long, type string, text string, level int")


def test_decks_shuffle_by_document_once(spark):
    for rows in (deck.deck_slides(elements(spark)), deck.text_deck_slides(elements(spark)), scripts.markdown_slides(elements(spark).select("doc_id", "text"))):
        assert len(exchanges(rows)) == 1


def test_markdown_decks_make_their_documents_once(spark):
    """Covers go along with the lines, which are stripped once, in the generator."""
    d = spark.createDataFrame([(1, "# Some title\n- an item"), (1, "x"), (2, None)], "doc_id long, text string")
    deck_ = scripts.markdown_deck(d.repartition(3), "B", F.concat(F.lit("Doc "), F.col("text")))
    plan = deck_._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
    lines = scripts.markdown_slides(d)._jdf.queryExecution().optimizedPlan()
    assert all(x.count("regexp_replace") < 16 for x in lines.toString().split("\n"))
    got = sorted((r.doc_id, r.slides, (r.deck or "None").count("Some title")) for r in deck_.collect())
    assert got == [(1, 1, 1), (1, 1, 2), (2, 0, 0)]


def test_headers_shuffle_by_document_once(spark):
    d = spark.createDataFrame([(1, 0, 0, "x", 1.0)], "doc_id long, page_num int, span_no int, text string, y0 double").repartition("doc_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exchanges(pages.strip_repeated(d, pages.repeated_texts(d, d.select("doc_id", "page_num").distinct())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found and all(re.fullmatch(r"doc_id#\d+L, \d+", x) for x in found)


def test_scans_read_needed_columns_only(spark):
    plan = queries.QUERIES["clean_text"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert "n_chars" not in read and "text" in read


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    plan = files.pdf_listing(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert "rangepartitioning" not in files.pdf_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_merging_lines_is_one_expression(spark):
    plan = queries.QUERIES["merge_lines"](spark, SF).select(F.length("text"))._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "Exchange" not in plan


def scans(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return len(re.findall("FileScan parquet", plan))


def test_the_scan_is_read_once_for_each_use(spark):
    """Body, headers and footers come from one pass over the lines, density and broken words from one aggregate."""
    for name, most in (("clean_text", 1), ("layout_elements", 1), ("page_metrics", 1), ("document_metrics", 1), ("metrics_json", 2), ("deck_slides", 1)):
        assert scans(queries.QUERIES[name](spark, SF)) <= most, name


def test_upper_case_of_the_scan_is_that_of_sql(spark):
    """Characters with several in upper case, among others."""
    duckdb = pytest.importorskip("duckdb")
    line = "Straße ŉ ᾀ ᾲ ﬁ ΰ ÿ é 😀 ﬃß"
    docs = spark.createDataFrame([(5, "en", "a", line), (17, "en", "a", "plain"), (29, "de", "a", line)], "doc_id long, lang string, source string, text string")
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, source VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [tuple(r) for r in docs.collect()])
        want = con.execute(scan.DUCK_HEAD + scan.TAIL + "SELECT doc_id, span_no, text FROM spans").fetchall()
    assert sorted(map(tuple, scan.spans(docs).select("doc_id", "span_no", "text").collect())) == sorted(want)


def test_clean_tables_need_no_shuffle(spark):
    plan = queries.QUERIES["table_clean"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_pages_of_tables_are_dealt_by_page(spark):
    """No step of finding tables gathers more than a page's rows by one key."""
    from quire.operators import table_finder
    from quire.plans import reports

    sf = SF.replace("0.001", "0.01")
    for df in (table_finder.unruled_tables(reports.spans(spark, sf)), table_finder.ruled_tables(reports.spans(spark, sf), reports.segments(spark, sf))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "SinglePartition" not in plan
        own = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.split("Initial Plan")[0]) if "custkey" not in x and "_w0" not in x]  # the report's own numbering apart
        assert own and all("doc_id" in x and "page_num" in x for x in own), own


def test_tasks_of_tables_grow_in_number_not_in_size(spark, monkeypatch):
    """Orders, spans and tables are dealt to as many tasks as there are so many orders, and move no more after that; no page is a call of Python."""
    from quire.operators import table_finder
    from quire.plans import reports

    sf = SF.replace("0.001", "0.01")
    monkeypatch.setattr(reports, "ORDERS", 1000)
    n = reports.partitions(spark, sf)
    assert n == -(-spark.read.parquet(f"{sf}/orders.parquet").count() // 1000) > 4
    spans, segments = reports.spans(spark, sf), reports.segments(spark, sf)
    for df, most in ((table_finder.unruled_tables(spans), 4), (table_finder.ruled_tables(spans, segments, partitions=n), 5)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        own = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert 0 < len(own) <= most and all(int(x.split(", ")[-1]) == n for x in own), own
        assert "InPandas" not in plan
