"""Connected components of an edge table: local forests, and alternating star contraction between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Edges that one task contracts at a time (16 bytes each).
ROWS = 500_000


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of 0 to n - 1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # hook the roots, then shorten all paths
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def _forest(batches):
    """The edges of a partition, as stars around the smallest node of each of their components."""
    import pyarrow as pa

    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = _labels(place[: len(u)], place[len(u) :], len(nodes))
    other = np.flatnonzero(label != np.arange(len(nodes)))
    for k in range(0, len(other), 100_000):
        at = other[k : k + 100_000]
        yield pa.record_batch([pa.array(nodes[at]), pa.array(nodes[label[at]])], names=["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, rows: int = ROWS) -> DataFrame:
    """`edges` (u, v long) to one row (node, component) for each node; component is the smallest node reachable.

    Edges are dealt to tasks of `rows` each (by chance, so no node is a key), and each task turns its own into stars.
    Where there is more than one task, large-star and small-star steps alternate between them until one task can hold
    what is left, or nothing changes; the number of rounds grows with the logarithm of the longest path. Loops and
    repeated edges are harmless; rows with null are ignored. The result is a table in the shared folder.
    """
    e = T.checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    last = None
    while True:
        now = _mark(e)
        tasks = max(1, -(-now[0] // rows))
        if tasks > 1 and now == last:  # stars already
            break
        stars = e.repartition(tasks).mapInArrow(T.trimmed(_forest), "u long, v long")
        if tasks == 1:
            e, old = T.checkpoint(stars), e
            T.release(old)
            break
        last = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e, old = T.checkpoint(small), e
        T.release(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
