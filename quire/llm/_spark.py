"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables.

    The folder is what ``spark.checkpoint.dir`` names. Where that is unset, a
    temporary folder is used in single-JVM mode; on a cluster it is an error,
    since a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quire-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a checkpoint in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_tables: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    """Removes the written tables; if Spark's JVM has gone before, they are left to whoever keeps the shared folder."""
    for spark, path in _tables:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the connection has gone, in whatever way it says so
            break
    _tables.clear()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a checkpoint for large tables, since it is columnar and compressed.

    Results read such tables lazily, so they go when the driver's program ends.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_sweep)
    _tables.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Size of a bitmap of ids, whatever the input.
FILTER_BITS = 1 << 26


def bit(id_: Column) -> Column:
    """The place of an id in a bitmap."""
    return F.pmod(F.xxhash64(id_), F.lit(FILTER_BITS))


def bitmap(ids: DataFrame):
    """A broadcast of 8 MB that ``holds`` looks up: every id of ``ids`` is in it, and few others as long as it isn't full."""
    h = bit(F.col("id"))
    words = ids.groupBy(F.shiftright(h, 6).cast("int").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[np.asarray(words.column("at"))] = np.asarray(words.column("bits"))
    return ids.sparkSession.sparkContext.broadcast(bits)


def holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63) & 1).astype(bool)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is in."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bytes_of(df: DataFrame, column: str) -> int:
    """About the bytes of ``df``: Spark's estimate, or where it has none the sum over ``column``."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n
