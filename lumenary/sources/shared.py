"""Folders that the driver and all executors see, and checkpoints written there."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The session's shared folder, that of spark.checkpoint.dir; one of our own only on a local master, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(folder, "own", None)
        if base is None:
            base = folder.own = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, base, True)
    return base


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def checkpoint(df: DataFrame, batch: int | None = None) -> DataFrame:
    """`df`, computed, written in the shared folder and cut off from its lineage; workers get `batch` rows at a time at most."""
    path, spark = fresh(df.sparkSession, "table"), df.sparkSession
    before = spark.conf.get(_BATCH)
    if batch and not 0 < int(before) <= batch:
        spark.conf.set(_BATCH, str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the tables that `checkpoint` wrote for these; nothing may read them again. Others are left alone."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """`rows` with a column `place`: 1, 2, and so on in the order of `by`.

    Ranges of rows are sorted apart; each range knows how many rows stand in those before it.
    """
    dealt = checkpoint(rows.repartitionByRange(*by).withColumn("range_", F.spark_partition_id()))
    starts, total = [], 0
    for r in dealt.groupBy("range_").count().orderBy("range_").collect():  # a row for each range
        starts.append((r["range_"], total))
        total += r["count"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "range_ int, start_ long"))
    place = F.col("start_") + F.row_number().over(W.partitionBy("range_").orderBy(*by))
    return dealt.join(starts, "range_").withColumn("place", place).drop("range_", "start_")
