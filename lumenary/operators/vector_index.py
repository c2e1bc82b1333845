"""A kept vector index: one byte a component, scanned by matrix products, and exact scores where bounds leave a doubt.

A vector is kept as whole numbers of -127 to 127, a scale and the length of what this leaves out; so its product with a
query is known to within that length times the query's. A search reads the codes once. Each task drops what its own k-th
best lower bound beats, the k-th best of all tasks drops more, and exact vectors are joined for the rest: the best k are
proven, whatever the vectors are like. A version is a folder and a row of `state`, which is written last.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenary.sources.shared import checkpoint

#: Vectors in a row of the table of codes.
PACK = 4096
CODES = "ids array<long>, codes binary, scales array<double>, errors array<double>"
EXACT = "id long, embedding array<float>"
STATE = "version int, name string, model string, dim int, n long"


def _coded(dim: int):
    """Batches of (id, embedding) to rows of CODES."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                x = part.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                scale = np.abs(x).max(1) / 127
                codes = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                error = np.sqrt(np.square(x - codes * scale[:, None]).sum(1)) * (1 + 1e-9)
                ids = part.column(0).to_pylist()
                yield pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([codes.tobytes()]), pa.array([scale.tolist()]), pa.array([error.tolist()])], names=["ids", "codes", "scales", "errors"])

    return run


def build(vectors: DataFrame, folder: str, model: str, dim: int) -> int:
    """Index the vectors (id, embedding) of one model, and return their number.

    Null vectors, those of another length and those with null or non-finite components are left out.
    """
    spark, name = vectors.sparkSession, f"version-{uuid.uuid4().hex}"
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where((F.size("embedding") == dim) & ~odd)
    rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/{name}/exact")
    exact = spark.read.schema(EXACT).parquet(f"{folder}/{name}/exact")
    exact.mapInArrow(_coded(dim), CODES).write.parquet(f"{folder}/{name}/codes")
    n, before = exact.count(), state(spark, folder)
    spark.createDataFrame([(before["version"] + 1 if before else 0, name, model, dim, n)], STATE).coalesce(1).write.mode("append").parquet(f"{folder}/state")
    return n


def state(spark: SparkSession, folder: str):
    """The row of the newest version (version, name, model, dim, n); None if there is none."""
    try:
        return spark.read.schema(STATE).parquet(f"{folder}/state").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _bounded(query: np.ndarray, k: int, slack: float):
    """Rows of CODES to (id, low, high), bounds of each product; without those that the task's own k-th best low beats."""

    def run(batches):
        import pyarrow as pa

        q, length, best = query.astype(np.float32), float(np.linalg.norm(query)), np.full(k, -np.inf)
        for batch in batches:
            for row in range(batch.num_rows):
                scale, error = (batch.column(c)[row].values.to_numpy() for c in ("scales", "errors"))
                codes = np.frombuffer(batch.column("codes")[row].as_py(), np.int8).reshape(len(scale), -1).astype(np.float32)
                off = length * (error + scale * 127 * len(q) ** 1.5 * 2**-22) + slack  # and what single precision loses
                near = scale * (codes @ q)
                low, high = near - off, near + off
                best = np.sort(np.concatenate([best, low]))[-k:]
                some = np.flatnonzero(high >= best[0])
                yield pa.record_batch([batch.column("ids")[row].values.take(pa.array(some)), pa.array(low[some]), pa.array(high[some])], names=["id", "low", "high"])

    return run


def top(spark: SparkSession, folder: str, query: list[float], limit: int, least: float, share: float) -> DataFrame:
    """(id, score to six digits) of the `limit` most similar vectors, cut off below `least` and below `share` of the best; ties to the smaller id.

    As `search.vector_top` gives them. A query of another length than the index finds nothing.
    """
    now, q = state(spark, folder), np.array(query, np.float64)
    if now is None or len(q) != now["dim"] or limit < 1:
        return spark.createDataFrame([], "id long, score double")
    codes = spark.read.schema(CODES).parquet(f"{folder}/{now['name']}/codes")
    some = checkpoint(codes.mapInArrow(_bounded(q, limit, 1e-6), "id long, low double, high double"))
    lows = [r["low"] for r in some.orderBy(F.desc("low")).select("low").limit(limit).collect()]
    some = some.where(F.col("high") >= (lows[-1] if len(lows) == limit else float("-inf"))).select("id")
    exact = spark.read.schema(EXACT).parquet(f"{folder}/{now['name']}/exact").join(some, "id")
    dot = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.array(*(F.lit(float(x)) for x in q)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = exact.select("id", F.round(dot, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    best = best.withColumn("best", F.max("score").over(W.partitionBy()))  # over `limit` rows
    return best.where(F.col("score") >= F.greatest(F.lit(least), F.col("best") * share)).select("id", "score")
