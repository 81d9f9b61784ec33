"""Spark data sources: pages of PDF files by page range, and folders of exported files.

``register(spark)`` makes them known by name:

- ``spark.read.format("quire_pdf").load(path)`` has a row for each page. A file of
  more than ``splitBytes`` is several partitions, each with its share of the
  pages, so that one large file isn't one task. Conditions on ``page_num`` are
  pushed into the scan: pages that they leave out aren't decoded.
- ``df.write.format("quire_files").mode("append").save(folder)`` writes a file for
  each (name, content). Tasks write to a staging folder; only what finished tasks
  have written is moved to its final name, when all have finished. So a retried,
  speculative or killed task leaves no part of a file, and neither does a job
  that fails: it leaves nothing.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import parse_pages
from . import files, pdf

#: Bytes of a file that one task decodes by default.
SPLIT = 32 << 20
#: Pages of one Arrow batch.
BATCH = 64
_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


@dataclass
class _Part(InputPartition):
    """The ``nth`` of ``of`` shares of a file's wanted pages."""

    path: str
    name: str
    nth: int
    of: int


def _pdf_files(path: str) -> list[tuple[str, str, int]]:
    """(path, name as Spark has it, bytes) of one PDF file or of those right in a folder, in order."""
    store, at = files.store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no such path: {path}")
    if info.type == fs.FileType.File and not at.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF file: {path}")
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
    found = sorted((f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".pdf")), key=lambda f: f.path)
    head = path.rstrip("/") if "://" in path else None
    whole = lambda f: f"file:{f.path}" if head is None else head if info.type == fs.FileType.File else f"{head}/{f.base_name}"
    return [(whole(f) if head else f.path, whole(f), f.size) for f in found]


class PdfReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, pages: str | None = None, split: int = SPLIT):
        self.schema, self.path, self.split = to_arrow_schema(schema), path, split
        self.wanted = parse_pages(pages) if pages else None
        self.pushed: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("page_num",):
                self.pushed.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[_Part]:
        parts = []
        for path, name, size in _pdf_files(self.path):
            n = max(1, -(-size // self.split))
            parts += [_Part(path, name, k, n) for k in range(n)]
        return parts or [_Part("", "", 0, 0)]

    def keeps(self, page: int) -> bool:
        return all(_TESTS[kind](page, value) for kind, value in self.pushed)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.of:
            return
        store, at = files.store(part.path)
        with store.open_input_file(at) as f:
            data = f.read()
        held: list[dict] = []
        for row in pdf.decode_rows(part.name, data, self.wanted, (part.nth, part.of), self.keeps if self.pushed else None):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, self.schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, self.schema)


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_pdf"

    def schema(self) -> str:
        return pdf.SCHEMA

    def reader(self, schema: StructType) -> PdfReader:
        return PdfReader(schema, self.options["path"], self.options.get("pages"), int(self.options.get("splitBytes", SPLIT)))


@dataclass
class _Written(WriterCommitMessage):
    """(where a file is, its name) of what a task has written."""

    files: list[tuple[str, str]] = field(default_factory=list)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        store, top = files.store(self.folder)
        return store, top.rstrip("/"), f"{top.rstrip('/')}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, _, staging = self._staging()
        own, done = f"{staging}/{uuid.uuid4().hex}", _Written()  # a folder for each attempt
        store.create_dir(own, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or os.path.basename(name) != name:
                    raise ValueError(f"not a file name: {name!r}")
                at = f"{own}/{len(done.files)}"
                with store.open_output_stream(at) as out:
                    out.write(content or b"")
                done.files.append((at, name))
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        store, top, staging = self._staging()
        made = [x for m in messages if m for x in m.files]
        twice = [name for name, n in Counter(name for _, name in made).items() if n > 1]
        if twice:
            store.delete_dir(staging)
            raise ValueError(f"two files would be written as {twice[0]}")
        store.create_dir(top, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: store.move(x[0], f"{top}/{x[1]}"), made))
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)

    def abort(self, messages: list[_Written | None]) -> None:
        store, _, staging = self._staging()
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class ExportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are added or replaced by name: use mode append")
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the formats known, and lets conditions be pushed into them."""
    for source in (PdfPages, ExportFiles):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def pdf_pages(spark: SparkSession, path: str, pages: str | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """The decoded pages of the PDF files at ``path``, read by page range."""
    register(spark)
    reader = spark.read.format("quire_pdf").option("splitBytes", split_bytes)
    return (reader.option("pages", pages) if pages else reader).load(path if "://" in path else os.path.abspath(path))


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes (name, content) to a folder; all of them, or after a failure none."""
    register(rows.sparkSession)
    rows.select("name", "content").write.format("quire_files").mode("append").save(folder)
