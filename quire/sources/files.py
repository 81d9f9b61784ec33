"""Listing and reading input files."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of one PDF file or of those right in a folder.

    A missing path and a single file of another kind are errors. Contents aren't
    put in order, which would shuffle every byte; ``pdf_listing`` is.
    """
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise ValueError(f"no such path: {path}")
    if fs.getFileStatus(p).isFile() and not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF file: {path}")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "false").load(path)


def pdf_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of the same files in order of path; no content is read."""
    return pdf_files(spark, path).drop("content").orderBy("path")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): Markdown files as wholes, by path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def html_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, span_no, text, font_size, is_bold) of web pages (page_id, html): headings and blocks as spans."""
    body = F.regexp_replace("html", r"(?is)<(script|style|nav|head|footer)\b.*?</\1>|<!--.*?-->", " ")
    marked = F.regexp_replace(body, r"(?i)<(h[1-6])\b[^>]*>", "\n\x01$1\x02")
    marked = F.regexp_replace(marked, r"(?i)<(p|li|div|br|tr|table|ul|ol|article|section|/h[1-6]|/p|/li|/div)\b[^>]*>", "\n")
    plain = F.regexp_replace(marked, r"<[^>]*>", "")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(char))
    lines = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(plain, "\n")).alias("span_no", "line"))
    size = F.when(F.col("line").startswith("\x01h1"), 18.0).when(F.col("line").startswith("\x01h2"), 14.5).when(F.col("line").startswith("\x01h"), 12.5).otherwise(10.0)
    text = F.trim(F.regexp_replace("line", "\x01h[1-6]\x02", ""))
    return lines.select("doc_id", F.lit(0).alias("page_num"), "span_no", text.alias("text"), size.alias("font_size"), F.lit(False).alias("is_bold")).where("text <> ''")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def ensure_folder(path: str) -> str:
    """Makes a folder and those above it where they don't exist; returns the path."""
    system, at = store(path)
    system.create_dir(at, recursive=True)
    return path


def copy_file(source: str, target: str) -> None:
    """Copies one file, also between stores, and makes the target's folder; a missing source is an error."""
    (from_, a), (to, b) = store(source), store(target)
    if from_.get_file_info(a).type != fs.FileType.File:
        raise FileNotFoundError(source)
    to.create_dir(os.path.dirname(b), recursive=True)
    with from_.open_input_stream(a) as data, to.open_output_stream(b) as out:
        while chunk := data.read(1 << 20):
            out.write(chunk)


@dataclass(frozen=True)
class Brand:
    """Brand of a deck; only the name is required. The colours are fixed values."""

    name: str
    logo: str | None = None
    primary: str = "#0F172A"
    secondary: str = "#22C55E"
    accent: str = "#06B6D4"
    footer: str | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str, logo: str | None = None) -> "Brand":
        text = spark.read.text(path, wholetext=True).first().value
        known = {k: v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__}
        return cls(**known | ({"logo": logo} if logo else {}))

    def column(self):
        return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in asdict(self).items()])
