"""From files to elements, exports and metrics; every stage is a DataFrame."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.classify import Sizes
from ..functions.text import count_hyphens, output_name, parse_pages, path_stem
from ..log import NAME
from ..operators import deck, docx, elements, imaging, language, markdown, metrics, ocr, pages, table_finder
from ..operators import tables as table_rules
from ..sources import files, formats, pdf, raster
from ..sources.files import Brand

log = logging.getLogger(NAME)

#: Takes (path, content, pages), a row a file with the pages to draw, and the resolution; returns ``raster.RENDERED``.
Renderer = Callable[[DataFrame, float], DataFrame]
#: Takes (path, page_num, width, height, pixels, languages, dpi), a prepared gray picture a page, with languages as a recogniser's
#: codes joined by plus signs; returns (path, page_num, words array<struct<text,confidence,bbox>>).
Recogniser = Callable[[DataFrame], DataFrame]
#: Takes (path, content, pages), a row a file; returns (doc_id, page_num, table_idx, cells, confidence, method).
TableFinder = Callable[[DataFrame], DataFrame]
#: Columns that a recogniser and a table finder have to return.
WORDS, TABLES = ("path", "page_num", "words"), ("doc_id", "page_num", "table_idx", "cells", "confidence", "method")


class MissingBackend(RuntimeError):
    """Work was asked for that no back-end here can do."""


@dataclass(frozen=True)
class Options:
    languages: tuple[str, ...] = ("spa", "eng")
    export: tuple[str, ...] = ("md",)
    pages: str | None = None
    min_confidence: int = 0
    min_table_confidence: float = 0.5
    dpi: int = 300
    denoise: bool = True
    contrast: bool = True
    binarise: bool = True
    deskew: bool = True
    line_mode: str = "line"
    exact_metrics: bool = True
    page_markers: bool = False
    frontmatter: bool = True
    sizes: Sizes = field(default_factory=Sizes)
    brand: Brand = Brand("Brand")
    renderer: Renderer = raster.render_pages
    recogniser: Recogniser | None = None
    #: How tables are found: auto (by lines, else by gaps), ruled, unruled, or None.
    tables: str | None = "auto"
    #: Whether embedded images become files, and slides of the JSON deck.
    images: bool = False
    #: Further finders, for pages where those before have found none.
    table_finders: tuple[TableFinder, ...] = ()

    def wanted(self) -> list[int] | None:
        return parse_pages(self.pages) if self.pages else None


@dataclass
class Result:
    pages: DataFrame
    elements: DataFrame
    merged: DataFrame
    tables: DataFrame | None
    languages: DataFrame
    page_metrics: DataFrame
    document_metrics: DataFrame
    errors: DataFrame
    options: Options
    decoded: DataFrame
    source: DataFrame
    #: What Spark has counted while decoding, once that has run: pages, errors and seconds in tasks.
    observed: Observation | None = None

    def release(self) -> None:
        """Drops the decoded pages from the cache; further results are decoded anew."""
        self.decoded.unpersist()

    def exports(self) -> dict[str, DataFrame]:
        """(path, name, content) of each wanted kind; unknown kinds are left out."""
        o = self.options
        t = self.tables.withColumn("md", table_rules.table_markdown(F.col("columns"), F.col("cells"))) if self.tables is not None else None
        titles = deck.deck_titles(self.merged)
        info = self.merged.groupBy("doc_id").agg(F.countDistinct("page_num").cast("int").alias("pages")).join(self.languages, "doc_id").withColumn("source", F.col("doc_id"))
        out = {}
        if "md" in o.export:
            front = info.join(titles, "doc_id").select("doc_id", markdown.frontmatter({"title": F.col("title"), "source": F.col("source")}, {"languages": F.col("languages")}).alias("front")) if o.frontmatter else None
            out["md"] = markdown.markdown(self.merged, front, t, o.page_markers).withColumnRenamed("markdown", "content")
        if "json" in o.export:
            placed = None
            if o.images:
                own = self.decoded.where("error is null").select(F.col("path").alias("doc_id"), "page_num", F.explode("images").alias("i"))
                placed = elements.place_images(own.select("doc_id", "page_num", "i.y0", _image_name(F.col("doc_id"), F.col("i")).alias("image")), self.merged)
            slides = deck.deck_slides(self.merged, t, o.brand.logo, placed)
            out["json"] = deck.deck_json(slides, info.select("doc_id", "source", "pages", "languages"), o.brand.column()).withColumnRenamed("json", "content")
        if "docx" in o.export:
            out["docx"] = docx.docx(self.merged, self.tables)
        out["metrics"] = metrics.metrics_json(self.document_metrics, self.page_metrics).withColumnRenamed("json", "content")
        for k in {"json", "metrics"} & out.keys():
            out[k] = out[k].withColumn("content", indented("content"))
        files_ = {k: d.select(F.col("doc_id").alias("path"), output_name(F.col("doc_id"), k).alias("name"), F.col("content").cast("binary").alias("content")) for k, d in out.items()}
        if o.images:  # their bytes aren't kept in the cache, so they are decoded again
            i = pdf.decode_pages(self.source, o.wanted()).where("error is null").select("path", "page_num", F.explode("images").alias("i"))
            files_["images"] = i.select("path", _image_name(F.col("path"), F.col("i")).alias("name"), "i.content")
        return files_


def _image_name(path: Column, image: Column) -> Column:
    """The file name of an image of the column ``page_num``."""
    return F.concat(path_stem(path), F.format_string(".p%d-%d.", F.col("page_num") + 1, image["img_idx"] + 1), image["ext"])


@F.pandas_udf(StringType())
def indented(texts: pd.Series) -> pd.Series:
    """JSON texts indented by two spaces."""
    return texts.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False), na_action="ignore")


def _by_file(pages_: DataFrame, source: DataFrame) -> DataFrame:
    """(path, content, pages): a row a file, so that no file is copied for each of its pages."""
    wanted = pages_.groupBy("path").agg(F.sort_array(F.collect_set("page_num")).alias("pages"))
    return wanted.join(source.select("path", "content"), "path").select("path", "content", "pages")


def _checked(rows: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    if missing := [c for c in columns if c not in rows.columns]:
        raise MissingBackend(f"the {what} returns no {', '.join(missing)}")
    return rows


def process(source: DataFrame, options: Options = Options(), decoded: DataFrame | None = None) -> Result:
    """Elements, metrics and exports of (path, content) PDF files, whose pages may be ``decoded`` already.

    Pages are decoded once, and only their text is kept. Pages of little native
    text are drawn, prepared and recognised: a recogniser that is needed but
    missing is an error, and files or pages that can't be read or drawn are rows
    of ``errors``; none passes as an empty document.
    """
    observed = Observation()
    # the mark keeps Spark from taking an earlier run's cache for this one, which may see other files
    decoded = pdf.decode_pages(source, options.wanted()) if decoded is None else decoded
    boxes = F.transform("images", lambda i: i.dropFields("content")) if options.images else F.lit(None)
    decoded = decoded.withColumn("images", boxes).withColumn("run", F.lit(uuid.uuid4().hex)).observe(observed, F.count("page_num").alias("pages"), F.count("error").alias("errors"), F.sum("seconds").alias("seconds")).persist()
    p = decoded.where("error is null").select(F.col("path").alias("doc_id"), "page_num", "width", "height", "seconds")
    spans = pdf.spans(decoded).repartition("doc_id")  # once; what follows goes by document
    dense = pages.page_density(spans, p)
    repeated = pages.repeated_texts(spans, p)
    native = dense.where(~F.col("needs_ocr")).select("doc_id", "page_num")
    kept = pages.strip_repeated(spans, repeated).join(native, pages.PAGE, "left_semi")
    found = elements.span_elements(kept, options.sizes).select("doc_id", "page_num", "pos", "type", "text", "level", "y0")
    scanned = dense.where("needs_ocr").select("doc_id", "page_num")
    errors = decoded.where("error is not null").select("path", "page_num", "error")
    if options.recogniser is None:
        if not scanned.isEmpty():
            raise MissingBackend("pages without native text need a recogniser")
        read = dense.limit(0).select("doc_id", "page_num", F.lit(0.0).alias("ocr_confidence"), F.lit(0).cast("long").alias("corrections"))
    else:
        drawn = options.renderer(_by_file(scanned.withColumnRenamed("doc_id", "path"), source), options.dpi)
        errors = errors.unionByName(drawn.where("pixels is null").select("path", "page_num", F.coalesce("error", F.lit("no picture")).alias("error")))
        pictures = imaging.prepare_pages(drawn, options.denoise, options.contrast, options.binarise, options.deskew)
        pictures = pictures.withColumns({"languages": F.lit("+".join(options.languages)), "dpi": F.lit(options.dpi)})
        words = _checked(options.recogniser(pictures), WORDS, "recogniser").select(F.col("path").alias("doc_id"), "page_num", "words")
        texts = ocr.recognised_pages(words, options.min_confidence)
        found = found.unionByName(elements.recognised_elements(texts, options.line_mode), allowMissingColumns=True)
        read = texts.select("doc_id", "page_num", "ocr_confidence", count_hyphens(F.col("text")).alias("corrections"))
    found = elements.with_position(found.withColumnRenamed("pos", "_own"), "_own").drop("_own").select("doc_id", "page_num", "pos", "type", "text", "level", "y0")
    tables = table_finder.find_tables(spans, pdf.segments(decoded), options.tables) if options.tables else None
    for finder in options.table_finders:
        own = _checked(finder(_by_file(decoded.where("error is null"), source)), TABLES, "table finder")
        tables = own if tables is None else table_rules.first_found(tables, own)
    if tables is not None:
        tables = table_rules.clean_tables(tables, options.min_table_confidence)
    full = dense.select("doc_id", "page_num", "text_density", "seconds").join(read, pages.PAGE, "left")
    by_page = metrics.page_metrics(full, tables, options.exact_metrics)
    langs = language.with_languages(elements.document_text(found)).select("doc_id", "languages")
    return Result(dense, found, elements.merge_paragraphs(found), tables, langs, by_page, metrics.document_metrics(by_page), errors, options, decoded, source, observed)


def process_path(spark: SparkSession, path: str, options: Options = Options(), split_bytes: int | None = None) -> Result:
    """``process`` of the files at ``path``; with ``split_bytes`` files of more bytes are decoded by several tasks, which needs a store that Arrow reads too."""
    decoded = formats.pdf_pages(spark, path, options.pages, split_bytes) if split_bytes else None
    return process(files.pdf_files(spark, path).select("path", "content"), options, decoded)


def write_exports(result: Result, folder: str) -> dict[str, float]:
    """One file for each document and kind, named after its source, written where the rows are; returns seconds by kind, and as ``decode`` those that tasks spent on decoding.

    ``folder`` is a path or URI that all executors share. A kind's files appear
    when all of them are written, or not at all. Documents of one name from
    different folders would overwrite each other, so they are an error.
    """
    docs = result.elements.select(F.col("doc_id").alias("path")).distinct()
    twice = docs.groupBy(output_name(F.col("path"), "md").alias("name")).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two documents would be written as {twice[0].name}")
    where, seconds = files.ensure_folder(folder if "://" in folder else os.path.abspath(folder)), {}
    for kind, rows in result.exports().items():
        began = time.perf_counter()
        formats.write_files(rows, where)
        seconds[kind] = time.perf_counter() - began
    seconds["decode"] = result.observed.get["seconds"] or 0.0
    log.info("wrote %s to %s", ", ".join(f"{k} in {v:.1f} s" for k, v in seconds.items()), folder)
    return seconds
