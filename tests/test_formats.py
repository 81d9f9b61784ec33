"""The data sources: page ranges and pushed conditions, and files that are there as wholes or not at all."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan

from quire.operators import table_finder
from quire.plans import pipeline
from quire.sources import files, formats, pdf
from tests.pdfs import pdf as make


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("pdfs")
    for name, n in (("a.pdf", 23), ("b.PDF", 1), ("c.pdf", 4)):
        (top / name).write_bytes(make([[(50, 700 - 14 * j, 10, "F1", f"{name} page {k} line {j} has words " * 3) for j in range(3)] for k in range(n)], {"Title": name}))
    (top / "broken.pdf").write_bytes(b"junk" * 2000)
    (top / "other.txt").write_bytes(b"x")
    return str(top)


def rows(df):
    return sorted(df.drop("seconds").collect(), key=str)


@pytest.mark.parametrize("split", [500, 3000, 1 << 20])
def test_pages_by_range_are_those_of_whole_files(spark, folder, split):
    got = formats.pdf_pages(spark, folder, split_bytes=split)
    assert rows(got) == rows(pdf.decode_pages(files.pdf_files(spark, folder)))
    sizes = [os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.lower().endswith(".pdf")]
    assert got.rdd.getNumPartitions() == sum(-(-s // split) for s in sizes)
    chosen = formats.pdf_pages(spark, folder, "1,3-4,30", split_bytes=split)
    assert rows(chosen) == rows(pdf.decode_pages(files.pdf_files(spark, folder), [0, 2, 3, 29]))


def test_conditions_on_pages_are_pushed(spark, folder):
    some = formats.pdf_pages(spark, folder, split_bytes=2000).where("page_num > 2 and page_num in (1, 3, 20) and width > 0")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "page_num#" in plan and not re.search(r"page_num#\d+ (>|IN|=)", plan) and re.search(r"width#\d+ > 0", plan)  # the scan does what isn't in a filter
    assert sorted((r.path[-5:], r.page_num) for r in some.collect()) == [("a.pdf", 3), ("a.pdf", 20), ("c.pdf", 3)]


def test_pages_that_are_left_out_are_not_decoded(spark, folder, monkeypatch):
    seen = []
    content = pdf.page_content
    monkeypatch.setattr(pdf, "page_content", lambda p, page: seen.append(1) or content(p, page))
    reader = formats.PdfReader(StructType.fromDDL(pdf.SCHEMA), folder, split=1000)
    other = IsNotNull(("page_num",))
    assert list(reader.pushFilters([GreaterThan(("page_num",), 5), LessThan(("page_num",), 9), other, EqualTo(("path",), "x")])) == [other, EqualTo(("path",), "x")]
    got = [n for part in reader.partitions() for batch in reader.read(part) for n in batch.column("page_num").to_pylist()]
    assert got == [6, 7, 8] and len(seen) == 3
    assert list(formats.PdfReader(StructType.fromDDL(pdf.SCHEMA), folder).pushFilters([In(("page_num",), (1,))])) == []


def test_paths(spark, folder, tmp_path):
    with pytest.raises(Exception, match="no such path"):
        formats.pdf_pages(spark, f"{folder}/none").count()
    with pytest.raises(Exception, match="not a PDF"):
        formats.pdf_pages(spark, f"{folder}/other.txt").count()
    assert formats.pdf_pages(spark, str(tmp_path)).count() == 0 and formats.pdf_pages(spark, f"{folder}/c.pdf").count() == 4


def test_pipeline_over_page_ranges(spark, folder):
    text = lambda r: sorted(tuple(x) for x in r.elements.select("doc_id", "page_num", "pos", "text").collect())
    assert text(pipeline.process_path(spark, folder, split_bytes=1000)) == text(pipeline.process_path(spark, folder))


def listed(at):
    """Files by name; a staging folder that tasks were still writing to has none."""
    return {n: open(f"{at}/{n}", "rb").read() for n in os.listdir(at) if not n.startswith("_staging-")} if os.path.isdir(at) else {}


def test_files_are_written(spark, tmp_path):
    at = f"{tmp_path}/out"
    d = spark.range(40).select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("name"), F.concat(F.lit("text "), F.col("id").cast("string")).cast("binary").alias("content"))
    formats.write_files(d.repartition(7), at)
    assert listed(at) == {f"{i}.md": b"text %d" % i for i in range(40)}
    formats.write_files(d.limit(1).withColumn("content", F.lit(None).cast("binary")), at)  # replaces by name; null is empty
    assert listed(at)["0.md"] == b"" and len(listed(at)) == 40


@pytest.mark.parametrize("end", ["raise", "exit"])
def test_a_failed_or_killed_task_leaves_nothing(spark, tmp_path, end):
    def dies(batches):
        for batch in batches:
            if 17 in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(["first"]), pa.array([b"written before"])], ["name", "content"])
                if end == "exit":
                    os._exit(3)
                raise RuntimeError("dies")
            yield pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in batch.column("id").to_pylist()]), pa.array([b"x"] * batch.num_rows)], ["name", "content"])

    at = f"{tmp_path}/out"
    with pytest.raises(Exception):
        formats.write_files(spark.range(0, 20, 1, 5).mapInArrow(dies, "name string, content binary"), at)
    assert listed(at) == {}


def test_only_finished_attempts_count(tmp_path):
    """An attempt that stops halfway, and the one that takes its place."""
    writer = formats.FilesWriter(str(tmp_path))
    batch = lambda *names: pa.RecordBatch.from_arrays([pa.array(names), pa.array([n.encode() for n in names])], ["name", "content"])

    def stops():
        yield batch("a", "b")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writer.write(stops())
    done = writer.write(iter([batch("a", "b"), batch("c")]))
    assert set(os.listdir(tmp_path)) == {f"_staging-{writer.job}"}  # nothing has its name yet
    writer.commit([done, None])
    assert listed(tmp_path) == {n: n.encode() for n in "abc"}
    for names, words in ((("x", "x"), "two files"), (("../x",), "not a file name")):
        again = formats.FilesWriter(str(tmp_path))
        with pytest.raises(ValueError, match=words):
            again.commit([again.write(iter([batch(*names)]))])
        again.abort([])
        assert listed(tmp_path) == {n: n.encode() for n in "abc"}


def test_drawn_lines_make_tables(spark, tmp_path):
    """Lines, boxes and thin fills of a page's content, in a turned-up coordinate system, become its tables."""
    draw = lambda ops: b"\n".join([b"q 2 0 0 2 0 0 cm", *ops, b"Q"])
    lines = [b"%d 300 m %d 360 l S" % (x, x) for x in (25, 75, 125)] + [b"25 360 100 -60 re s", b"25 330 100 0.5 re f", b"0 0 500 500 re f", b"10 10 m 20 20 30 30 40 40 c S", b"1 1 m 9 9 l n"]
    text = [[(60, 690, 10, "F1", "a"), (160, 690, 10, "F1", "b"), (60, 620, 10, "F1", "c")]]
    raw = make(text)
    page = pdf.Pdf(raw)
    own = list(page.pages())[0]
    content = page.bytes(page.get(own["Contents"])) + b"\n" + draw(lines)
    plain = pdf.Pdf.bytes
    pdf.Pdf.bytes = lambda self, s: content if s.raw == page.get(own["Contents"]).raw else plain(self, s)
    try:
        (row,) = pdf.decode("p", raw)
    finally:
        pdf.Pdf.bytes = plain
    assert len(row["segments"]) == 3 + 4 + 4 and row["seconds"] > 0
    d = spark.createDataFrame([(row["path"], 0, row["spans"], row["segments"], None)], f"path string, page_num int, spans array<{pdf.SPAN}>, segments array<{pdf.SEGMENT}>, error string")
    (t,) = table_finder.find_tables(pdf.spans(d), pdf.segments(d)).collect()
    assert (t.method, t.cells, round(t.confidence, 6)) == ("ruled", [["a", "b"], ["c", None]], 1.0)
