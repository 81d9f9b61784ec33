"""The command line: ``python -m quire extract --input FILE_OR_FOLDER --out FOLDER``.

Options that only concern a local run elsewhere (``--keep-layout``, ``--merge``,
``--workers``) are taken and have no effect: Spark deals out the work. A
recogniser and further table finders are functions, named as module:function.
"""

from __future__ import annotations

import argparse
import sys
from importlib import import_module

from pyspark.sql import SparkSession

from . import __version__, log
from .functions.text import LANGUAGE_CODES
from .plans.pipeline import MissingBackend, Options, process_path, write_exports
from .sources.files import Brand


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Structured documents from PDF files, on Spark.")
    p.add_argument("--version", action="version", version=f"quire {__version__}")
    x = p.add_subparsers(dest="command", required=True).add_parser("extract", help="read PDF files and write what is in them")
    x.add_argument("--input", required=True, help="a PDF file, or a folder of them")
    x.add_argument("--out", required=True, help="folder for the results, shared by all executors")
    x.add_argument("--lang", default="spa,eng", help="languages for the recogniser, apart by commas or plus signs")
    x.add_argument("--export", default="md", help="kinds of files: md, json, docx, apart by commas")
    x.add_argument("--gamma", action="store_true", help="write the JSON deck too")
    x.add_argument("--brand", help="JSON file with the deck's brand")
    x.add_argument("--logo", help="logo of the deck, before that of the brand")
    x.add_argument("--dpi", type=int, default=300)
    for name, text in (("deskew", "turn pages upright"), ("denoise", "smooth pages"), ("binarize", "make pages black and white")):
        x.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=True, help=text)
    x.add_argument("--min-conf", type=int, default=0, help="least confidence of a recognised word, 0 to 100")
    x.add_argument("--pages", help="pages from 1 on, such as 1,3-5")
    x.add_argument("--tables", choices=("auto", "ruled", "unruled", "none"), default="auto", help="how tables are found")
    x.add_argument("--images", action="store_true", help="write embedded images, and slides for them")
    x.add_argument("--split-mb", type=float, help="files of more megabytes are decoded by several tasks")
    x.add_argument("--recogniser", help="module:function that recognises pages without native text")
    x.add_argument("--log-level", default="INFO", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
    x.add_argument("--log-file")
    x.add_argument("--keep-layout", action="store_true", help="no effect")
    x.add_argument("--merge", action="store_true", help="no effect")
    x.add_argument("--workers", type=int, help="no effect")
    return p


def options(spark: SparkSession, a: argparse.Namespace) -> Options:
    """The options that the arguments name; a name that isn't known is an error."""
    export = [k for k in a.export.lower().split(",") if k]
    if unknown := set(export) - {"md", "json", "docx"}:
        raise ValueError(f"no such export: {', '.join(sorted(unknown))}")
    if a.gamma and "json" not in export:
        export.append("json")
    recogniser = None
    if a.recogniser:
        module, _, name = a.recogniser.partition(":")
        recogniser = getattr(import_module(module), name)
    languages = tuple(LANGUAGE_CODES.get(x, x) for x in a.lang.replace("+", ",").split(",") if x)
    brand = Brand.read(spark, a.brand, a.logo) if a.brand else Brand("Brand", logo=a.logo)
    return Options(
        languages=languages, export=tuple(export), pages=a.pages, min_confidence=a.min_conf, dpi=a.dpi, denoise=a.denoise, deskew=a.deskew, binarise=a.binarize,
        brand=brand, recogniser=recogniser, tables=None if a.tables == "none" else a.tables, images=a.images,
    )


def main(arguments: list[str] | None = None) -> int:
    """0 if every file and page was read, else 1; what could be read is written either way."""
    a = parser().parse_args(arguments)
    messages = log.configure(a.log_level, file=a.log_file)
    spark = SparkSession.builder.appName("quire extract").getOrCreate()
    try:
        result = process_path(spark, a.input, options(spark, a), int(a.split_mb * (1 << 20)) if a.split_mb else None)
        errors = result.errors.collect()
        write_exports(result, a.out)
        result.release()
    except (ValueError, MissingBackend) as e:
        messages.error("%s", e)
        return 2
    for e in errors:
        messages.error("%s%s: %s", e.path, "" if e.page_num is None else f" page {e.page_num + 1}", e.error)
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
