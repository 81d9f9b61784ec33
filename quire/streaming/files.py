"""The document pipeline over a folder that fills up.

A file is a complete document, so every batch of new files is processed like a
batch of its own and no state crosses batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Options, process

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", per_batch).load(folder)


def process_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options = Options(), **trigger) -> StreamingQuery:
    """Appends the merged elements of new files to the Parquet folders ``out``/batch=n, and their errors beside them."""

    def each(batch: DataFrame, n: int) -> None:
        r = process(batch.select("path", "content"), options)
        r.merged.write.mode("overwrite").parquet(f"{out}/elements/batch={n}")
        r.errors.write.mode("overwrite").parquet(f"{out}/errors/batch={n}")
        r.release()

    return watch(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
