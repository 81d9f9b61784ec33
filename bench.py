"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the input and the cores. Each query is written to Spark's no-op sink: once to
warm up and then BENCH_RUNS times (default 3), of which the median counts.
``decoded_pages_per_sec`` is for PDF files made of the documents beforehand.
``further`` are queries of later rounds, timed alike and not part of the total.
"""

import json
import os
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from quire.plans import paper
from quire.plans.catalog import QUERIES
from quire.sources import pdf

HEADLINE = (
    "clean_text", "normalize_lists", "ocr_line_elements", "layout_elements", "page_density", "repeated_header_footer", "strip_headers", "merged_paragraphs",
    "markdown_document", "deck_title_subtitle", "deck_slides", "deck_text_slides", "section_grouped_deck", "page_metrics", "document_metrics", "language_id", "table_clean",
)
FURTHER = ("unruled_tables", "ruled_tables", "table_fallback", "measured_tables", "language_learned", "deck_images", "markdown_deck", "sql_clean_text")


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, more = {}, {}
    for name in HEADLINE + FURTHER:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        (took if name in HEADLINE else more)[name] = round(median(times[1:]), 3)
    with tempfile.TemporaryDirectory() as top:
        paper.pdfs(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(int(cpus) * 4, "doc_id")).write.parquet(f"{top}/pdfs")
        files = spark.read.parquet(f"{top}/pdfs")
        n, times = pdf.decode_pages(files).select("page_num").count(), []
        for _ in range(runs):
            began = time.perf_counter()
            pdf.spans(pdf.decode_pages(files)).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "further": more, "documents": docs, "decoded_pages": n, "decoded_pages_per_sec": round(n / median(times)), "documents_per_sec_each_query": {k: round(docs / max(v, 1e-3)) for k, v in took.items()}}))


if __name__ == "__main__":
    main()
