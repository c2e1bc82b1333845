"""The nearest of many named vectors for each row, by cosine: rows are routed to the groups that can hold them, once.

Named vectors are grouped around pivots, a bounded sample of them. A row knows its angle to each pivot; with a group's
radius that bounds how near and how far the group's vectors can be. It goes to the groups whose nearest possible vector
is no farther than the row's `most` nearest are at worst. Groups are cut into blocks of BLOCK vectors, and the rows of a
block into shares, so a task multiplies bounded matrices, however many rows or named vectors there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenary.sources.shared import checkpoint

PIVOTS, BLOCK, ROWS = 256, 2048, 8192
#: Angles count as so much larger or smaller than they are: similarities are rounded to six digits.
SLACK = 2e-3


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _grouped(pivots):
    """(person_id, centroid) to its nearest pivot and the angle; one without a direction is as far off as can be."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                a = _angles(x, pivots.value)
                away = np.where(np.square(x).sum(1) > 0.5, a.min(1), np.pi)
                yield pa.record_batch([*batch.columns, pa.array(a.argmin(1).astype(np.int64)), pa.array(away)], names=["person_id", "centroid", "pivot", "angle"])

    return run


def _routed(shared, most: int):
    """(key, v) once for each block that may hold one of the row's `most` nearest."""

    def run(batches):
        import pyarrow as pa

        pivots, number, radius, first, shards = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            a = _angles(x, pivots)
            worst = a + radius
            order = worst.argsort(1)
            enough = (np.cumsum(number[order], axis=1) >= most).argmax(1)
            bound = np.where(number.sum() >= most, np.take_along_axis(worst, order, 1)[np.arange(len(x)), enough], np.inf)
            bound[np.square(x).sum(1) < 0.5] = np.inf  # no direction: equally far from all
            rows, groups = np.nonzero(a - radius <= bound[:, None] + SLACK)
            n = shards[groups]
            block = np.repeat(first[groups] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows = pa.array(np.repeat(rows, n))
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(block)], names=["key", "v", "block"])

    return run


def _best(most: int):
    def run(rows, named):
        import pyarrow as pa

        keys, ids, sims = [], [], []
        if rows.num_rows and named.num_rows:
            key, person = rows.column("key").to_numpy(), named.column("person_id").to_numpy()
            order = person.argsort()  # of equally near ones the smaller id comes first
            x, c, person = _matrix(rows.column("v")), _matrix(named.column("centroid"))[order], person[order]
            for k in range(0, len(x), 512):
                sim = np.round(x[k : k + 512] @ c.T, 6)
                top = (-sim).argsort(1, kind="stable")[:, :most] if most > 1 else sim.argmax(1)[:, None]
                keys.append(np.repeat(key[k : k + 512], top.shape[1]))
                ids.append(person[top].ravel())
                sims.append(np.take_along_axis(sim, top, 1).ravel())
        return pa.table({"key": np.concatenate(keys) if keys else np.zeros(0, np.int64), "person_id": np.concatenate(ids) if ids else np.zeros(0, np.int64), "sim": np.concatenate(sims) if sims else np.zeros(0)})

    return run


def nearest(rows: DataFrame, named: DataFrame, most: int) -> DataFrame:
    """(key, person_id, sim, r): for `rows` (key long, v: of length 1) the `most` nearest of `named` (person_id long, centroid: of length 1).

    Similarities have six digits; ties go to the smaller id. Vectors of length 0 are allowed on both sides. No named
    vectors give no rows.
    """
    kind = "person_id long, centroid array<double>"
    named = checkpoint(named.selectExpr("cast(person_id as long) as person_id", "cast(centroid as array<double>) as centroid"))
    total = named.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "key long, person_id long, sim double, r int")
    context = rows.sparkSession.sparkContext
    sample = named.orderBy(F.xxhash64("person_id"), "person_id").limit(max(1, min(PIVOTS, total // 64))).collect()
    pivots = np.array([r["centroid"] for r in sample])
    grouped = checkpoint(named.mapInArrow(_grouped(context.broadcast(pivots)), kind + ", pivot long, angle double"))
    held = {r["pivot"]: r for r in grouped.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    used = sorted(held)
    number = np.array([held[p]["n"] for p in used])
    shards = -(-number // BLOCK)
    first = np.cumsum(shards) - shards
    facts = context.broadcast((pivots[used], number, np.array([held[p]["radius"] for p in used]), first, shards))
    routed = checkpoint(rows.selectExpr("cast(key as long) as key", "cast(v as array<double>) as v").mapInArrow(_routed(facts, most), "key long, v array<double>, block long"))
    shares = routed.groupBy("block").agg(F.ceil(F.count("*") / ROWS).alias("shares"))
    places = rows.sparkSession.createDataFrame([(p, int(f), int(s)) for p, f, s in zip(used, first, shards)], "pivot long, first long, shards long")
    blocks = grouped.join(F.broadcast(places), "pivot").select((F.col("first") + F.pmod(F.xxhash64("person_id"), F.col("shards"))).alias("block"), "person_id", "centroid")  # PIVOTS rows
    blocks = blocks.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "person_id", "centroid").toDF("b", "s", "person_id", "centroid")
    asked = routed.join(shares, "block").select("key", "v", "block", F.pmod(F.xxhash64("key"), F.col("shares")).alias("share")).toDF("key", "v", "block", "share")
    found = asked.groupBy("block", "share").cogroup(blocks.groupBy("b", "s")).applyInArrow(_best(most), "key long, person_id long, sim double")
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("sim"), "person_id")))  # some rows for each block
    return ranked.where(F.col("r") <= most)
