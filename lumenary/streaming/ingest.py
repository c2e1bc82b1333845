"""Incremental ingest: files arrive as a stream, each new content hash becomes one photo with pending jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenary.sources.shared import fresh

STAGES = ("thumbs", "embed", "faces", "caption")


def new_photos(files: DataFrame) -> DataFrame:
    """The first row of each content hash that the stream has seen.

    The state store keeps every hash for ever, 32 bytes and an entry's overhead each: a file may come back after years,
    so there is no time after which one can be forgotten. With RocksDB as the state store they lie on disk.
    """
    return files.dropDuplicates(["blake3"])


def start(files: DataFrame, target: str, state: str) -> StreamingQuery:
    """Ingests what is there and stops. Started again with the same folders, it takes only what came since.

    Each batch overwrites its own folder, so one that is repeated after a crash leaves the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return new_photos(files).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict[str, int]:
    """How far the query has come."""
    seen = list(query.recentProgress)
    return {"batches": len(seen), "rows": sum(p["numInputRows"] for p in seen)}


def enqueue(photos: DataFrame) -> DataFrame:
    """A pending job of every stage for each photo."""
    return photos.select("blake3", F.explode(F.array(*(F.lit(s) for s in STAGES))).alias("stage")).withColumn("state", F.lit("pending"))


def ingested_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of all distinct documents, ingested as a stream of files."""
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders and patterns, but no single file: this pattern fits the one path only.
    files = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{sf_dir}/[d]ocuments.parquet").select(F.md5("text").alias("blake3"), F.col("n_chars").alias("bytes"))
    target = fresh(spark, "photos")
    query = start(files, target, fresh(spark, "ingest"))
    query.awaitTermination()
    photos = spark.read.schema("blake3 string, bytes long").option("recursiveFileLookup", True).parquet(target)
    return enqueue(photos)


JOBS_SQL = "select blake3, stage, 'pending' as state from (select distinct md5(text) as blake3 from documents) d cross join (select unnest(['thumbs', 'embed', 'faces', 'caption']) as stage) s"
