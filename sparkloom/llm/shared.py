"""Tables and folders that the driver and every executor can see.

Intermediate results are written as Parquet below ``spark.checkpoint.dir`` and read again, so a
lost executor never takes them along and no plan keeps a long lineage.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.lineage import shared_dir

#: The white space of all word contracts: bytes 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Size of the batches that go to Python.
BATCH_BYTES = "4m"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "snappy", level: int = 3) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table read again and its path. ``level`` is that of zstd."""
    path = new_path(df.sparkSession, name)
    bound_batches(df.sparkSession)
    df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bound_batches(spark: SparkSession) -> None:
    """Let plans hand rows to Python in batches of about ``BATCH_BYTES``, as a worker and its executor hold a few
    of them; a session that sets a size of its own keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in ("67108864b", "64mb", "64m"):
        spark.conf.set(key, BATCH_BYTES)


def release_memory() -> None:
    """Give what a Python worker has freed back to the system; workers are used again and wait beside the JVM."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError, TypeError):  # only glibc keeps it and has this call
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving freed memory back when a task ends."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return released


def drop_paths(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle width the session asks for; whoever sizes the cluster sets it with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(text: Column) -> Column:
    """UTF-8 size of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: the places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rows_where(docs: DataFrame, make: Callable[[], Callable[[pa.Array], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose whole text passes, with all columns as they are and no shuffle.

    ``make`` runs once in each task and returns the test of an array of texts."""
    place = docs.columns.index("text")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(place)), pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
