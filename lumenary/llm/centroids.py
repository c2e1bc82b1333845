"""Centroid clustering of vectors of whole numbers, exact, by ball trees.

Each task builds metric trees over stretches of CHUNK of its vectors, once; they are written as a table, a row a tree. A
ball knows its centre, radius, number, componentwise sum and sum of squares. In a round the balls of a tree go down
level by level with the centroids that can still own one of their vectors: a centroid farther from the centre than the
nearest by more than two radii can't. A ball with one centroid left goes to it whole, by its sums; a leaf with several
is compared vector by vector, in whole numbers that doubles hold exactly. A task returns a row for each centroid, so a
round moves (tasks x centroids) rows however many vectors there are, and the driver sees only the centroids.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

K, DIM, ROUNDS, SEED, SCALE = 40, 64, 5, 2, 256
CHUNK = 8192
LEAF = 32
#: Largest magnitude of a component: products and squared distances of 64 of them are exact in doubles.
MOST = 1 << 22
TREE = "ids array<long>, data binary, first array<int>, size array<int>, child array<int>, radius array<double>, sums binary, squares array<long>"


def _split(x: np.ndarray, centre: np.ndarray):
    """Which vectors of a ball go right: those nearer to the second of two far vectors; None if all are equal."""
    far = x[np.argmax(np.square(x - centre).sum(1))]
    other = x[np.argmax(np.square(x - far).sum(1))]
    along = x @ (other - far)
    right = along > (along.min() + along.max()) / 2
    return right if right.any() and not right.all() else None


def tree(x: np.ndarray) -> dict:
    """The balls over whole-number vectors, children after their parents and side by side; `order` puts each ball's vectors in a row."""
    order = np.arange(len(x))
    first, size, child, radius, sums, squares = [0], [len(x)], [-1], [], [], []
    at = 0
    while at < len(first):
        rows = order[first[at] : first[at] + size[at]]
        part = x[rows]
        total = part.sum(0)
        centre = total / len(rows)
        sums.append(total)
        squares.append(int(np.square(part).sum()))
        radius.append(float(np.sqrt(np.square(part - centre).sum(1).max())))
        right = _split(part.astype(np.float64), centre) if len(rows) > LEAF and radius[at] > 0 else None
        if right is not None:
            order[first[at] : first[at] + size[at]] = np.concatenate([rows[~right], rows[right]])
            left = int(size[at] - right.sum())
            child[at] = len(first)
            first += [first[at], first[at] + left]
            size += [left, size[at] - left]
            child += [-1, -1]
        at += 1
    return {"order": order, "first": np.array(first), "size": np.array(size), "child": np.array(child), "radius": np.array(radius), "sums": np.array(sums), "squares": np.array(squares)}


def _grow(dim: int, scale: int):
    """Batches of (vec_id, embedding) to rows of TREE."""

    def planted(ids, x):
        import pyarrow as pa

        t = tree(x)
        kinds = {"first": pa.int32(), "size": pa.int32(), "child": pa.int32(), "radius": pa.float64(), "squares": pa.int64()}
        lists = {n: pa.array([t[n]], pa.list_(k)) for n, k in kinds.items()}
        columns = {"ids": pa.array([ids.take(pa.array(t["order"])).to_pylist()], pa.list_(pa.int64())), "data": pa.array([x[t["order"]].astype(np.int32).tobytes()]), "sums": pa.array([t["sums"].astype(np.int64).tobytes()])} | lists
        names = [f.split()[0] for f in TREE.split(", ")]
        return pa.record_batch([columns[n] for n in names], names=names)

    def run(batches):
        import pyarrow as pa

        ids, parts, held = [], [], 0
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().astype(np.float64)
            x = np.floor(values * scale)
            if len(x) and np.abs(x).max() > MOST:
                raise ValueError(f"a component times {scale} is beyond {MOST}: squared distances would not be exact")
            x = x.astype(np.int64).reshape(-1, dim)
            at = 0
            while at < len(x):
                n = min(CHUNK - held, len(x) - at)
                ids.append(batch.column(0).slice(at, n))
                parts.append(x[at : at + n])
                at, held = at + n, held + n
                if held == CHUNK:
                    yield planted(pa.concat_arrays(ids), np.concatenate(parts))
                    ids, parts, held = [], [], 0
        if held:
            yield planted(pa.concat_arrays(ids), np.concatenate(parts))

    return T.trimmed(run)


def filtered(t: dict, centroids: np.ndarray):
    """Which centroid owns what: (balls, their centroids), then (vectors, their centroids, squared distances) of the other leaves."""
    size, first, child, radius = t["size"], t["first"], t["child"], t["radius"]
    centre, c = t["sums"] / size[:, None], centroids.astype(np.float64)
    norms = np.square(c).sum(1)
    balls, owners, leaves, masks = [], [], [], []
    front, may = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    while len(front):
        d = np.sqrt(np.stack([np.square(centre[front] - y).sum(1) for y in c], axis=1))
        d[~may] = np.inf
        near, r = d.min(1), radius[front]
        may = d <= (near + 2 * r + 1e-9 * (near + r) + 1e-6)[:, None]  # rounding never takes a centroid away
        sure = may.sum(1) == 1
        balls.append(front[sure])
        owners.append(d[sure].argmin(1))
        end = ~sure & (child[front] < 0)
        leaves.append(front[end])
        masks.append(may[end])
        down = ~sure & ~end
        front, may = np.concatenate([child[front[down]], child[front[down]] + 1]), np.concatenate([may[down], may[down]])
    leaves, masks = np.concatenate(leaves), np.concatenate(masks)
    counts = size[leaves]
    rows = np.repeat(first[leaves] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    x = t["data"][rows].astype(np.float64)
    d = np.square(x).sum(1)[:, None] - 2 * (x @ c.T) + norms
    d[~np.repeat(masks, counts, axis=0)] = np.inf
    own = d.argmin(1) if len(d) else np.zeros(0, np.int64)  # the first of equals
    return np.concatenate(balls), np.concatenate(owners), rows, own, d[np.arange(len(d)), own].astype(np.int64)


def _read(batch, row: int, dim: int) -> dict:
    get = lambda name, kind: np.array(batch.column(name)[row].values.to_numpy(), kind)
    t = {n: get(n, np.int64) for n in ("first", "size", "child", "squares")} | {"radius": get("radius", np.float64)}
    t["data"] = np.frombuffer(batch.column("data")[row].as_py(), np.int32).reshape(-1, dim)
    t["sums"] = np.frombuffer(batch.column("sums")[row].as_py(), np.int64).reshape(-1, dim)
    return t


def _totals(shared):
    """A task's trees to a row for each centroid: number, sum of squares and componentwise sums of what it owns."""

    def run(batches):
        import decimal

        import pyarrow as pa

        c = shared.value
        k, dim = c.shape
        count, sums, squares = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), [0] * k
        for batch in batches:
            for row in range(batch.num_rows):
                t = _read(batch, row, dim)
                balls, owners, rows, own, _ = filtered(t, c)
                np.add.at(count, owners, t["size"][balls])
                np.add.at(sums, owners, t["sums"][balls])
                for j, s in zip(owners.tolist(), t["squares"][balls].tolist()):
                    squares[j] += s
                x = t["data"][rows].astype(np.int64)
                count += np.bincount(own, minlength=k)
                np.add.at(sums, own, x)
                for j in np.unique(own).tolist():
                    squares[j] += int(np.square(x[own == j]).sum())
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array([decimal.Decimal(squares[j]) for j in used], pa.decimal128(38, 0)), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "squares", "sums"])

    return T.trimmed(run)


def _owned(shared):
    """Trees to a row for each vector: id, cluster, squared distance."""

    def run(batches):
        import pyarrow as pa

        c = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                t = _read(batch, row, c.shape[1])
                balls, owners, rows, own, d = filtered(t, c)
                cluster, distance = np.zeros(len(t["data"]), np.int32), np.zeros(len(t["data"]), np.int64)
                cluster[rows], distance[rows] = own, d
                for b, j in zip(balls.tolist(), owners.tolist()):
                    span = slice(t["first"][b], t["first"][b] + t["size"][b])
                    cluster[span] = j
                    distance[span] = np.square(t["data"][span].astype(np.int64) - c[j]).sum(1)
                yield pa.record_batch([batch.column("ids")[row].values, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return T.trimmed(run)


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, embedding) of the vectors of `dim` components, none of them null, NaN or infinite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size("embedding") == dim) & F.coalesce(~odd, F.lit(False)))


def starts(rows: DataFrame, k: int, seed: int, dim: int, scale: int) -> np.ndarray:
    """The vectors of the k smallest sha256 of `seed:vec_id`, in that order; repeated ids by their components; null ids are none."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.where("vec_id is not null").orderBy(order, "embedding").limit(k).collect()
    return np.floor(np.array([r["embedding"] for r in found], np.float64).reshape(len(found), dim) * scale).astype(np.int64)


def totals(trees: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(cluster, number, sum of squares, sums) of each centroid that owns a vector: a row for each at most."""
    shared = trees.sparkSession.sparkContext.broadcast(centroids)
    parts = trees.drop("ids").mapInArrow(_totals(shared), "cluster int, n long, squares decimal(38,0), sums array<long>")
    each = [F.sum(F.col("sums")[i]) for i in range(centroids.shape[1])]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("squares").cast("decimal(38,0)").alias("squares"), F.array(*each).alias("sums")).collect()
    shared.destroy()
    return [(r["cluster"], r["n"], int(r["squares"]), np.array(r["sums"], np.int64)) for r in rows]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector (vec_id, embedding) of `vectors`.

    Vectors become floor(scale * x). Centroids start as those of the k smallest hashes of `seed` and id, or as all if
    there are fewer; after `rounds` rounds of assignment and floor of the means each vector is assigned once more.
    Equally near centroids: the smaller number. Null or empty vectors, those of another length and those with null or
    non-finite components give no row; vectors with a null id do, and are never a start; repeated rows each count and
    each get a row; a table without usable vectors with an id gives an empty one; other columns are ignored, whatever their names. A component of
    over 2**22 after scaling is an error, as its distances would not be exact. Many equal vectors are one ball.
    """
    spark, rows = vectors.sparkSession, usable(vectors, dim)
    c = starts(rows, k, seed, dim, scale)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = T.checkpoint(rows.mapInArrow(_grow(dim, scale), TREE))
    for _ in range(rounds):
        for j, n, _, sums in totals(trees, c):
            c[j] = sums // n
    known = []
    for j, n, squares, sums in totals(trees, c):
        own = [int(x) for x in c[j]]
        inertia = squares - 2 * sum(a * int(b) for a, b in zip(own, sums)) + n * sum(a * a for a in own)
        known.append((j, inertia, hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()))
    known = [(*r, sum(x[1] for x in known)) for r in known]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, centroid_sha256 string, inertia long")
    owned = trees.mapInArrow(_owned(spark.sparkContext.broadcast(c)), "vec_id long, cluster int, distance long")
    return owned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster(T.table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    def near(t: int) -> str:
        dot = "list_inner_product"
        return f"a{t} as materialized (select rid, min(cast({dot}(v, v) - 2 * {dot}(v, c) + {dot}(c, c) as bigint) * 64 + j) as m from kept, c{t} group by rid)"

    def moved(t: int) -> str:
        return f"""p{t} as (select m % 64 as j, unnest(v) as x, unnest(range({DIM})) as i from kept join a{t} using (rid)),
f{t} as (select j, i, floor(sum(x) / count(*)) as x from p{t} group by j, i),
g{t} as (select j, list(x order by i) as c from f{t} group by j),
c{t + 1} as materialized (select c{t}.j, coalesce(g{t}.c, c{t}.c) as c from c{t} left join g{t} using (j))"""

    steps = ",\n".join(f"{near(t)},\n{moved(t)}" for t in range(ROUNDS))
    return f"""
with kept as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as v
  from embeddings where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: isfinite(x))) = {DIM}),
c0 as materialized (
  select row_number() over (order by sha256('{SEED}:' || vec_id), v) - 1 as j, v as c from kept
  where vec_id is not null order by 1 limit {K}),
{steps},
{near(ROUNDS)},
d as (select vec_id, m % 64 as j, m // 64 as distance from kept join a{ROUNDS} using (rid))
select vec_id, cast(j as int) as cluster, distance, cast(sum(distance) over (partition by j) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(c, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
from d join c{ROUNDS} using (j)
"""


SQL = _sql()
