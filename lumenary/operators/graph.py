"""Connected components of a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.sources.shared import checkpoint, release

#: Edges that one task contracts.
EDGES = 1_000_000


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 and edges a-b: the smallest node that each is connected with."""
    up = np.arange(n)
    while True:
        before = up.copy()
        low = np.minimum(up[a], up[b])
        for end in (a, b):
            np.minimum.at(up, before[end], low)
            np.minimum.at(up, end, low)
        while (up != up[up]).any():
            up = up[up]
        if (up == before).all():
            return up


def stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: each node but the smallest of its component, and that smallest."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    up = smallest(at[: len(x)], at[len(x) :], len(nodes))
    other = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[other], nodes[up[other]]


def _contracted(batches):
    """The edges of a task as stars."""
    import pyarrow as pa

    parts = [(b.column("x").to_numpy(), b.column("y").to_numpy()) for b in batches if b.num_rows]
    if parts:
        x, y = stars(*(np.concatenate(z) for z in zip(*parts)))
        yield pa.record_batch([pa.array(x), pa.array(y)], names=["x", "y"])


def connected(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """`edges` (x, y) to (id, label) of every node: label is the smallest node that it is connected with.

    Each task turns `most` of the edges into stars. If what is left fits into one task, that task has the answer; else
    labels pass along what is left, and along labels, until none changes.
    """
    kept = checkpoint(edges.where("x <> y").select("x", "y"))
    total = kept.count()
    trees = checkpoint(kept.repartition(max(1, -(-total // most))).mapInArrow(_contracted, "x long, y long"))
    release(kept)
    if total > most and trees.count() <= most:
        trees, kept = checkpoint(trees.repartition(1).mapInArrow(_contracted, "x long, y long")), trees
        release(kept)
        total = 0
    if total <= most:
        return trees.select(F.col("x").alias("id"), F.col("y").alias("label")).unionByName(trees.select(F.col("y").alias("id"), F.col("y").alias("label")).distinct())
    both = trees.unionByName(trees.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = last = checkpoint(both.select(F.col("x").alias("id"), F.col("x").alias("label")).distinct())
    while True:
        near = both.join(labels, both.y == labels.id).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.x).select("id", F.least("label", "near").alias("new"), "label")
        jump = step.select(F.col("id").alias("at"), F.col("new").alias("jump"))
        step = checkpoint(step.join(jump, step.new == jump["at"]).select("id", F.least("jump", "new").alias("new"), "label"))
        release(last)
        labels, last = step.select("id", F.col("new").alias("label")), step
        if step.where("new <> label").isEmpty():
            return labels
