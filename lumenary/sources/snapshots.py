"""States of a table, published one after the other: a folder for each, and a small file that names the current one.

A state is written whole before the file names it, so a reader sees the old one or the new one, and never half of one,
nor none. A state that readers may have planned with stays until the next is published, if its publisher asks for that.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT = "_CURRENT"


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str) -> str | None:
    files, at = _files(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    """The file appears whole: it is written under another name first."""
    files, at = _files(spark, path)
    _, first = _files(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(first)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    # Renamed over the file there, in one step: a crash or a reader in between finds the one or the other.
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    over = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), context._jsc.hadoopConfiguration()).rename(first, at, over)


def about(spark: SparkSession, folder: str) -> dict | None:
    """What is known of the current state; None if there is none, or its file can't be read."""
    try:
        return json.loads(_read(spark, f"{folder}/{CURRENT}") or "null")
    except ValueError:
        return None


def publish(rows: DataFrame, folder: str, keep: bool = False, **facts) -> int:
    """Write a new state, name it current with its facts, and delete those before, with `keep` all but the last of them.

    Returns its number of rows.
    """
    spark = rows.sparkSession
    before = (about(spark, folder) or {}).get("state") if keep else None
    name = f"state-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    count = spark.read.schema(rows.schema).parquet(f"{folder}/{name}").count()
    _write(spark, f"{folder}/{CURRENT}", json.dumps({"state": name, "before": before, "count": count, "schema": rows.schema.json()} | facts))
    sweep(spark, folder)
    return count


def sweep(spark: SparkSession, folder: str) -> int:
    """Delete the states that are neither current nor the one before it; how many there were."""
    known, gone = about(spark, folder) or {}, 0
    files, at = _files(spark, folder)
    for status in files.listStatus(at) if files.exists(at) else []:
        name = status.getPath().getName()
        if name.startswith("state-") and name not in (known.get("state"), known.get("before")):
            files.delete(status.getPath(), True)
            gone += 1
    return gone


def withdraw(spark: SparkSession, folder: str) -> None:
    """No state is current any more."""
    files, at = _files(spark, f"{folder}/{CURRENT}")
    files.delete(at, False)
    sweep(spark, folder)


def current(spark: SparkSession, folder: str, **facts) -> DataFrame | None:
    """The current state; None if there is none, or one of other facts than those asked for."""
    from pyspark.sql.types import StructType

    known = about(spark, folder)
    if known is None or any(known.get(k) != v for k, v in facts.items()):
        return None
    return spark.read.schema(StructType.fromJson(json.loads(known["schema"]))).parquet(f"{folder}/{known['state']}")


def build_vectors(vectors: DataFrame, folder: str, model: str, dim: int) -> int:
    """Publish the vectors (photo_id, embedding, model) of one model as the index; withdraw it if there are none."""
    rows = vectors.where(F.col("model") == model).select("photo_id", F.col("embedding").cast("array<float>").alias("embedding"))
    if rows.isEmpty():
        withdraw(vectors.sparkSession, folder)
        return 0
    return publish(rows.repartitionByRange("photo_id").sortWithinPartitions("photo_id"), folder, model=model, dim=dim)


def load_vectors(spark: SparkSession, folder: str, model: str, dim: int) -> DataFrame | None:
    """The index, if it is this model's and of this dimension; an index of another model is none."""
    return current(spark, folder, model=model, dim=dim)
