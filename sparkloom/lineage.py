"""Cut the lineage of iterative plans through the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where none is named (tests), a fresh local one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loom-"))
        named = context.getCheckpointDir()
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    named = named.rstrip("/")
    return "file://" + named[5:] if named.startswith("file:/") and not named.startswith("file://") else named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: for large tables, as a checkpoint is not compressed."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    free_shuffles(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.is_stored = True
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more; it does so when the driver
    collects garbage, which a small heap may not need for long."""
    gc.collect()
    spark._jvm.System.gc()


def laid_out(edges: DataFrame, key: str = "src", of: DataFrame | None = None, then: Callable[[DataFrame], DataFrame] = lambda placed: placed) -> DataFrame:
    """``edges`` dealt and sorted by ``key`` and kept on the executors, so that joins on ``key`` move the
    other side only. Columns ``of`` a stored table are not written once more, and what ``then``
    makes of the edges in place is kept with them. They are made from the shared folder again where an executor is lost; the caller
    unpersists them."""
    width = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = edges if getattr(of, "is_stored", False) else stored(edges, "edges")
    return then(placed.repartition(width, key).sortWithinPartitions(key)).persist(StorageLevel.MEMORY_AND_DISK)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed now and read back from the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
