"""Similar vectors and near hashes: groups around pivots, pairs of blocks that can meet, hashes by blocks of bits."""

from __future__ import annotations

from itertools import combinations
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.sources.shared import checkpoint

#: Rows that one task holds of either side of a comparison, about.
BLOCK = 4096
#: Pivots are taken from a bounded sample; they only group rows, and bound how near two groups can come.
PIVOTS = 256
#: Bytes of the vectors of a block of either side, where blocks are compared with each other, at most; products held at a time.
TILE_BYTES, PRODUCTS = 32 << 20, 1 << 22
#: Hashes of a block, about, where all are compared with all; a task holds two blocks.
TILE = 1 << 16
#: How many hashes are compared in the time in which a join makes a row, about.
DEAR = 100


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class Cells:
    """Unit vectors (id, v) grouped by their nearest pivot, as a table with columns pivot and angle; what is known of each group.

    Pivots are a bounded sample. Two groups whose pivots are farther apart than both radii and an angle can hold no pair
    of vectors within that angle, by the triangle inequality.
    """

    def __init__(self, vectors: DataFrame, block: int):
        v = F.col("embedding").cast("array<double>")
        norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
        rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.transform(v, lambda x: x / norm).alias("v"))
        total = rows.count()
        sample = rows.withColumn("by", F.xxhash64("id")).orderBy("by").limit(max(1, min(PIVOTS, total // block))).collect() if total else []
        self.pivots = np.array([r["v"] for r in sample])
        self.block, self.spark = block, vectors.sparkSession
        shared = self.spark.sparkContext.broadcast(self.pivots)

        def near(batches):
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    x = _matrix(pa.chunked_array([batch.column("v")])) @ shared.value.T
                    yield pa.record_batch([*batch.columns, pa.array(x.argmax(1).astype(np.int64)), pa.array(np.arccos(np.clip(x.max(1), -1, 1)))], names=["id", "v", "pivot", "angle"])

        self.rows = checkpoint(rows.mapInArrow(near, "id long, v array<double>, pivot long, angle double"))
        known = self.rows.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
        self.held = {r["pivot"]: r["n"] for r in known}
        self.radius = {r["pivot"]: r["radius"] for r in known}
        self.between = np.arccos(np.clip(self.pivots @ self.pivots.T, -1, 1)) if total else np.zeros((0, 0))

    def blocked(self, rows: DataFrame, held: dict[int, int] | None = None) -> DataFrame:
        """`rows` (id, pivot) with the block of each: a share of its group of `block` rows, about."""
        places = self._places(self.held if held is None else held, None)
        return rows.join(F.broadcast(places), "pivot").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("shards"))).drop("first", "shards")

    def paired(self, rows: DataFrame, angle: float, held: dict[int, int] | None = None) -> DataFrame:
        """`rows` (id, pivot), each once for every pair of blocks (lo, hi) in which it may meet another within the angle.

        Blocks grow with the rows, up to TILE_BYTES, so that each row is sent to a few: a large group has blocks of its own,
        small ones next to each other share one. A row works out which ones it can meet; what is broadcast is a table of the
        pivots and of which blocks hold a group near each.
        """
        places = self._places(self.held if held is None else held, angle)
        met = F.array_distinct(F.flatten(F.transform("near", lambda x: F.sequence(x["first"], x["first"] + x["shards"] - 1))))
        rows = rows.join(F.broadcast(places), "pivot").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("shards")))  # PIVOTS rows
        return rows.withColumn("other", F.explode(met)).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("first", "shards", "near", "other")

    def _chain(self, some: list[int]) -> list[int]:
        """Pivots in an order in which each is followed by the nearest of those left."""
        left, out = set(some), []
        while left:
            out.append(min(left, key=lambda p: (self.between[out[-1], p] if out else 0, p)))
            left.remove(out[-1])
        return out

    def _places(self, held: dict[int, int], angle: float | None) -> DataFrame:
        if angle is None:
            shards = {p: -(-n // self.block) for p, n in sorted(held.items())}
            first = dict(zip(shards, np.cumsum([0, *shards.values()]).tolist()))
        else:
            total, cores = sum(held.values()), self.spark.sparkContext.defaultParallelism
            most = max(self.block, min(TILE_BYTES // (8 * max(1, self.pivots.shape[-1])), -(-total // isqrt(4 * cores))))
            shards, first, at, full = {}, {}, 0, most
            for p in self._chain(list(held)):
                shards[p] = max(1, -(-held[p] // most))
                if shards[p] > 1 or full + held[p] > most:
                    first[p], at, full = at, at + shards[p], held[p] if shards[p] == 1 else most
                else:
                    first[p], full = at - 1, full + held[p]
        near = {p: [(first[q], shards[q]) for q in shards if angle is not None and self.between[p, q] - self.radius[p] - self.radius[q] <= angle + 1e-9] for p in shards}
        kind = "pivot long, first long, shards long" + (", near array<struct<first: long, shards: long>>" if angle is not None else "")
        return self.spark.createDataFrame([(p, first[p], shards[p], near[p])[: 3 + (angle is not None)] for p in shards], kind)


def least_cosine(least: float) -> float:
    """The smallest number that is `least` or more, to six digits: comparing with it needs no rounding."""
    low, high = least - 1e-6, least + 1e-6
    while low < (middle := (low + high) / 2) < high:
        low, high = (low, middle) if np.round(middle, 6) >= least else (middle, high)
    return high


def near_rows(x: np.ndarray, y: np.ndarray, least: float):
    """(k, hit): for some rows of x, from k on, whether their cosine with each row of y is `least`; PRODUCTS at a time."""
    step = max(16, PRODUCTS // max(1, len(y)))
    for k in range(0, len(x), step):
        yield k, x[k : k + step] @ y.T >= least


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(x, y) of all pairs of vectors (vec_id, embedding) whose cosine, to six digits, is `least` or more; both ways.

    Blocks of groups that may hold a pair are multiplied with each other.
    """
    cells, enough = Cells(vectors, BLOCK), least_cosine(least)

    def compare(rows):
        import pyarrow as pa

        ids, block, v = rows.column("id").to_numpy(), rows.column("block").to_numpy(), _matrix(rows.column("v"))
        a, b = block == rows.column("lo")[0].as_py(), block == rows.column("hi")[0].as_py()
        xs, ys, i, j, left, right = [], [], ids[a], ids[b], v[a], v[b]
        for k, hit in near_rows(left, right, enough):
            at, to = np.nonzero(hit)
            xs.append(i[k + at])
            ys.append(j[to])
        x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (xs, ys))
        some = x != y
        return pa.table({"x": x[some], "y": y[some]})

    eps = float(np.arccos(np.clip(least - 1e-6, -1, 1)))
    one = cells.paired(cells.rows.drop("angle"), eps).groupBy("lo", "hi").applyInArrow(compare, "x long, y long")
    return checkpoint(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())


def near_hashes(rows: DataFrame, most: int) -> DataFrame:
    """(a, b, distance) of all pairs of rows (id, h), a < b, whose 64-bit hashes differ in `most` bits at least at most.

    Up to 11 bits: in one of four blocks of 16 bits such hashes differ by a quarter of that at most, so one side is
    entered under all values so near to its own. Beyond, each block gets a threshold of its own, see `_wide_pairs`. Where
    so many rows share values that these ways compare a good part of all pairs, all are compared, see `_tiled_pairs`.
    """
    one = checkpoint(rows.select(F.col("id").cast("long").alias("id"), F.col("h").cast("long").alias("h")).where("id is not null and h is not null"))
    total = one.count()
    if total <= BLOCK:
        return _tiled_pairs(one, most, total)
    cut = F.array(*(F.struct(F.lit(i).alias("i"), _part("h", i).alias("v")) for i in range(4)))
    wide = one.select("id", "h", F.inline(cut))
    held = wide.groupBy("i", "v").agg(F.count("*").alias("n")).toArrow()  # 4 x 2**16 rows at most
    counts = np.zeros((4, 1 << 16))
    counts[held.column("i").to_numpy(), held.column("v").to_numpy()] = held.column("n").to_numpy()
    if most // 4 > 2:
        return _wide_pairs(one, wide, counts, most, total)
    if _meetings(counts)[:, : most // 4 + 1].sum() * DEAR > total * total:
        return _tiled_pairs(one, most, total)
    masks = [sum(1 << k for k in c) for d in range(most // 4 + 1) for c in combinations(range(16), d)]
    a = wide.select(F.col("id").alias("a"), F.col("h").alias("ha"), "i", F.col("v").alias("own"), F.explode(F.lit(masks)).alias("mask"))
    a = a.select("a", "ha", "i", F.col("own").bitwiseXOR(F.col("mask")).alias("v"))
    b = wide.select(F.col("id").alias("b"), F.col("h").alias("hb"), "i", "v")
    return _met(a.join(b.hint("merge"), ["i", "v"]), most, [most // 4] * 4)


def _met(both: DataFrame, most: int, allowed: list[int]) -> DataFrame:
    """Of rows (a, ha, b, hb, i) that met in block i: the near pairs, each in the first block in which it meets."""
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.coalesce(*(F.when(F.bit_count(F.shiftrightunsigned(differ, 16 * i).bitwiseAND(F.lit(0xFFFF))) <= t, F.lit(i)) for i, t in enumerate(allowed) if t >= 0))
    distance = F.bit_count(differ)
    return both.where((F.col("a") < F.col("b")) & (distance <= most) & (first == F.col("i"))).select("a", "b", distance.alias("distance"))


def _meetings(counts: np.ndarray) -> np.ndarray:
    """For each block of 16 bits, how many pairs of rows differ in 0 to 16 of them (block x 17), by how often values occur."""
    x = counts.copy()
    for k in range(16):  # Walsh-Hadamard: its square is that of the counts by which bits differ
        x = x.reshape(len(counts), -1, 2, 1 << k)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
    x = x.reshape(len(counts), -1) ** 2
    for k in range(16):
        x = x.reshape(len(counts), -1, 2, 1 << k)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
    bits = np.bitwise_count(np.arange(1 << 16))
    return np.array([np.bincount(bits, row, 17) for row in x.reshape(len(counts), -1) / (1 << 16)])


def _part(h: str, i) -> Column:
    return F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int")


def thresholds(costs: np.ndarray, most: int) -> list[int]:
    """For blocks whose pairs at each distance number `costs` (block x 17): the cheapest thresholds that lose no pair.

    If hashes differed in each block by more than its threshold, they would differ by the sum of (threshold + 1) at least;
    so these sum up to most + 1. A threshold of -1 leaves a block out.
    """
    best = {0: (0.0, [])}
    for row in costs:
        total = np.concatenate([[0.0], np.cumsum(row)])
        step = {}
        for used, (cost, chosen) in best.items():
            for t in range(18):
                key = min(used + t, most + 1)
                if key not in step or cost + total[t] < step[key][0]:
                    step[key] = (cost + total[t], [*chosen, t - 1])
        best = step
    return best[most + 1][1]


def _compared(most: int):
    """Tiles of rows (id, h, left: whether of the left block, both: whether left and right are one block, tile) to near pairs."""

    def run(batches):
        import pyarrow as pa

        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table)
        ids, h, left, both, tile = (table.column(c).to_numpy() for c in ("id", "h", "left", "both", "tile"))
        h, found, size = h.view(np.uint64), [], 0

        def out():
            return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b", "distance"])

        for t in np.unique(tile):
            x = np.flatnonzero((tile == t) & left)
            y = x if both[x[:1]].all() else np.flatnonzero((tile == t) & ~left)
            for k in range(0, len(x), 64):
                for m in range(0, len(y), 8192):
                    i, j = x[k : k + 64], y[m : m + 8192]
                    d = np.bitwise_count(h[i, None] ^ h[j])
                    at = np.flatnonzero(d <= most)
                    if not len(at):
                        continue
                    a, b = ids[i[at // len(j)]], ids[j[at % len(j)]]
                    some = a < b if x is y else a != b
                    found.append((np.minimum(a, b)[some], np.maximum(a, b)[some], d.ravel()[at][some].astype(np.int32)))
                    size += len(found[-1][0])
                    if size > 100_000:
                        yield out()
                        found, size = [], 0
        if found:
            yield out()

    return run


def _tiled_pairs(one: DataFrame, most: int, total: int) -> DataFrame:
    """Pairs by comparing all rows, block with block: a task holds two blocks of TILE rows, about, and writes what it finds.

    Rows are sent once for each block, so a table of fewer than TILE rows is cut only to give each core some tiles.
    """
    cores = one.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-total // TILE), min(-(-total // BLOCK), isqrt(4 * cores)))
    rows = one.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.lit(list(range(blocks)))))
    rows = rows.select("id", "h", (F.col("block") <= F.col("other")).alias("left"), (F.col("block") == F.col("other")).alias("both"), F.expr("cast(greatest(block, other) * (greatest(block, other) + 1) div 2 as int) + least(block, other)").alias("tile"))
    return rows.repartitionById(blocks * (blocks + 1) // 2, "tile").mapInArrow(_compared(most), "a long, b long, distance int")


def _wide_pairs(one: DataFrame, wide: DataFrame, counts: np.ndarray, most: int, total: int) -> DataFrame:
    """Pairs by blocks of 16 bits with thresholds allotted by how often values occur.

    A block has 2**16 values at most, so all values and their counts are known to every task. They tell how many pairs of
    rows each threshold would compare; the cheapest allotment is taken. Rows meet by pairs of near values, each pair of
    rows in the first block that it is near in.
    """
    spark = one.sparkSession
    sums = _meetings(counts)
    allowed = thresholds(sums, most)
    if sum(row[: t + 1].sum() for row, t in zip(sums, allowed)) * DEAR > total * total:
        return _tiled_pairs(one, most, total)
    shared = spark.sparkContext.broadcast([np.flatnonzero(c).astype(np.uint16) for c in counts])
    shares = max(1, max(np.count_nonzero(c) for c in counts) // 512)
    chunks = spark.range(0, 4 * shares, 1, min(4 * shares, 512))  # each a block and a share of its values

    def near_values(batches):
        import pyarrow as pa

        for batch in batches:
            for c in batch.column(0).to_pylist():
                v, t = shared.value[c // shares], allowed[c // shares]
                for k in range(c % shares, len(v) if t >= 0 else 0, 64 * shares):
                    some = v[k : k + 64 * shares : shares]
                    at, to = np.nonzero(np.bitwise_count(some[:, None] ^ v) <= t)
                    yield pa.record_batch([pa.array(np.full(len(at), c // shares, np.int32)), pa.array(some[at].astype(np.int32)), pa.array(v[to].astype(np.int32))], names=["i", "v", "u"])

    pairs = chunks.mapInArrow(near_values, "i int, v int, u int")
    a = wide.select(F.col("id").alias("a"), F.col("h").alias("ha"), "i", "v")
    b = wide.select(F.col("id").alias("b"), F.col("h").alias("hb"), "i", F.col("v").alias("u"))
    return _met(a.join(pairs.hint("merge"), ["i", "v"]).join(b.hint("merge"), ["i", "u"]), most, allowed)  # far more pairs than Spark guesses


def sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, h) of the fixture: a bit for each positive component of a vector."""
    h = F.expr("aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), h.alias("h"))


def hamming_pairs(spark: SparkSession, sf_dir: str, most: int = 18) -> DataFrame:
    return near_hashes(sign_hashes(spark, sf_dir), most)
