"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample. Every vector goes to the list of its nearest centroid, and boundary vectors,
to which other centroids are nearly as near, to those lists too. The centroids, a bounded number, are linked into a graph
that each worker holds and walks best-first. A query probes the lists whose centroids are within a ratio of the nearest
one's distance, and further ones, nearest first, until they hold enough different vectors (or all of them). The ratio is
measured on the sample: vectors without clusters ask for more lists than those with.

A list that has grown beyond SPLIT rows, as in tables of millions, is cut into lists of LIST_ROWS by centroids of its
own, fitted where its rows are; a query that probes it probes those of them that the same ratio selects. So lists stay
small, and the work of a query doesn't grow with the table.

Largest inner product becomes smallest distance by one more component that brings all vectors to one length; queries
have 0 there. Equal vectors are indexed once, with their smallest ids: no more of them can be among the k nearest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _text as T

#: Vectors that centroids are fitted on, at most; every vector is indexed.
SAMPLE = 20_000
#: Vectors of a list, about; the number of lists that the graph holds is bounded by MOST_LISTS and by a tenth of the sample.
LIST_ROWS = 250
MOST_LISTS = 2000
#: A list of more rows is cut into lists of its own, with so many sampled rows for each of their centroids.
SPLIT = 2000
SPLIT_SAMPLE = 40
#: A vector also goes to lists whose centroids are at most so much farther (squared) than its nearest; to REPLICAS at most.
BOUNDARY = 1.06
REPLICAS = 3
#: A query probes the lists whose centroids are at most so much farther than its nearest, or farther ones where the data
#: ask for it: so many of ASKED sampled vectors' true neighbours in the sample have to lie in lists that they probe.
PROBE = 1.33
RECALL = 0.97
ASKED = 200
#: Where these lists hold fewer different vectors than so many times k + 1, further lists are probed, nearest first.
FLOOR = 10
#: Rows that one task compares at a time: several lists together, or a shard of a crowded one.
GROUP_ROWS = 8_192
DEGREE = 24


def _fit(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Centroids by k-means whose steps charge crowded clusters, so that lists come out balanced."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    charge = np.zeros(lists, np.float32)
    for _ in range(8):
        d = (c * c).sum(1) - 2 * x @ c.T
        own = (d + charge).argmin(1)
        n = np.bincount(own, minlength=lists)
        spread = float(np.maximum(d.min(1) + (x * x).sum(1), 0).mean()) or 1.0
        charge = (charge + 0.1 * spread * (n * lists / len(x) - 1)).clip(0, 0.3 * spread).astype(np.float32)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def _graph(c: np.ndarray) -> np.ndarray:
    """For each centroid its nearest ones, and a few at random so that the walk leaves any neighbourhood."""
    rng = np.random.default_rng(1)
    n = len(c)
    near = min(DEGREE, n - 1)
    d = (c * c).sum(1)[None] - 2 * c @ c.T
    np.fill_diagonal(d, np.inf)
    links = np.argpartition(d, near - 1, axis=1)[:, :near] if near else np.zeros((n, 0), int)
    return np.concatenate([links, rng.integers(0, n, (n, 6))], axis=1)


#: Queries that walk the graph together.
TOGETHER = 256


def _walk(q: np.ndarray, c: np.ndarray, links: np.ndarray, ratio: float) -> np.ndarray:
    """Best-first search of the graph for several queries at once: their squared distances to the centroids reached, else inf.

    Each query expands its nearest centroids not yet expanded, from fixed entry points, until the nearest of them is
    farther than `ratio` times the nearest reached; every step works on all queries that still go on.
    """
    n, m = len(c), len(q)
    dist = np.full((m, n), np.inf, np.float32)
    open_ = np.zeros((m, n), bool)

    def reach(rows, nodes):
        dist[rows, nodes] = np.square(c[nodes] - q[rows]).sum(1)
        open_[rows, nodes] = True

    start = np.linspace(0, n - 1, min(n, 16)).astype(int)
    reach(np.repeat(np.arange(m), len(start)), np.tile(start, m))
    go = np.arange(m)
    while len(go):
        waiting = np.where(open_[go], dist[go], np.inf)
        few = min(4, n)
        best = np.argpartition(waiting, few - 1, axis=1)[:, :few] if few < n else np.tile(np.arange(n), (len(go), 1))
        at = np.take_along_axis(waiting, best, 1)
        least = at.min(1)
        # At least some are expanded, so that the walk gets away from poor entry points.
        on = np.isfinite(least) & ((least <= ratio * dist[go].min(1)) | (np.isfinite(dist[go]).sum(1) <= 4 * DEGREE))
        go, best, at = go[on], best[on], at[on]
        rows, nodes = np.repeat(go, best.shape[1])[np.isfinite(at).ravel()], best[np.isfinite(at)]
        open_[rows, nodes] = False
        new = np.zeros((m, n), bool)
        new[rows[:, None], links[nodes]] = True
        reach(*np.nonzero(new & ~np.isfinite(dist)))
    return dist


def _chosen(dist: np.ndarray, ratio: float, most: int) -> np.ndarray:
    """The places within `ratio` of the nearest, nearest first, `most` of them."""
    found = np.flatnonzero(dist <= dist.min() * ratio)
    return found[np.argsort(dist[found], kind="stable")][:most]


def _widen(found: np.ndarray, q: np.ndarray, c: np.ndarray, firsts: np.ndarray, least: int) -> np.ndarray:
    """`found` and the nearest other lists, until they hold `least` different vectors or all.

    `firsts` counts each vector in the list of its nearest centroid alone, so that none counts twice.
    """
    if firsts[found].sum() >= least:
        return found
    order = np.argsort(np.square(c - q).sum(1), kind="stable")
    order = np.concatenate([found, order[~np.isin(order, found)]])
    return order[: int(np.searchsorted(np.cumsum(firsts[order]), min(least, firsts.sum()))) + 1]


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def _needed(x: np.ndarray, c: np.ndarray, longest: float, k: int) -> float:
    """The ratio at which RECALL of the pairs of a sampled vector and one of its k largest inner products in the sample meet in a list.

    Neighbours in a sample are farther off than those in the table, so this errs towards more lists.
    """
    m, k = min(len(x), ASKED), min(k, len(x) - 1)
    if k < 1 or len(c) < 2:
        return 1.0
    scores = x[:m] @ x.T
    scores[np.arange(m), np.arange(m)] = -np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    size = np.square(x).sum(1)
    lift = lambda v, tail: np.column_stack([v, tail]).astype(np.float32)
    asked = _apart(lift(x[:m] * np.sqrt(longest / size[:m])[:, None], np.zeros(m)), c)
    asked /= np.maximum(asked.min(1), 1e-12)[:, None]
    found = near.ravel()
    held = _apart(lift(x[found], np.sqrt(np.maximum(longest - size[found], 0))), c)
    own = np.argsort(held, axis=1)[:, :REPLICAS]
    there = np.take_along_axis(held, own, 1) <= held.min(1)[:, None] * BOUNDARY
    ratio = np.where(there, np.take_along_axis(np.repeat(asked, k, axis=0), own, 1), np.inf).min(1)
    return float(np.quantile(ratio, RECALL))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: not null, no component null or not finite, not all zero, the usual length."""
    v = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    good = good.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    usual = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("v") == (usual["n"] if usual else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, probe: float | None = None) -> DataFrame:
    """For each row of `vectors` (vec_id, embedding) whose id is divisible by `every`, the k nearest other rows found.

    Returns query_id, rank (from 1), vec_id, score: the inner product of the original vectors in double precision,
    largest first, ties to the smaller vec_id; all candidates if there are fewer than k. Rows whose vector is null, zero,
    of another length than most or holds null or non-finite components take no part. Of rows with one vec_id and one
    vector one counts; an empty table gives an empty result; other columns are ignored, whatever their names. `probe` is the
    ratio of distances up to which lists are probed: by default PROBE, or what the sample shows to be needed, if that is more.
    """
    spark = vectors.sparkSession
    # Equal vectors are known by 128 bits of their hashes, so that vectors aren't sorted and travel once.
    rows = usable(vectors).withColumns({"a": F.xxhash64("v"), "b": F.xxhash64("v", F.lit(7))})
    # One row for each different vector, with its k + 1 smallest ids: a query among them takes k others at most.
    part = W.partitionBy("a", "b", F.pmod(F.xxhash64("vec_id"), F.lit(32))).orderBy("vec_id")
    smallest = rows.select("a", "b", "vec_id").distinct().withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    ids = smallest.groupBy("a", "b").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids")).withColumn("vec_id", F.element_at("ids", 1))
    each = ["vec_id", "a", "b"]
    same = rows.groupBy(*each).agg(F.first("v").alias("v")).join(ids, each).withColumnRenamed("vec_id", "vid")
    same = T.checkpoint(same)
    n, longest = same.agg(F.count("*"), F.max(F.expr("aggregate(v, 0d, (a, x) -> a + x * x)"))).first()
    kind = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], kind)
    lists = max(1, min(MOST_LISTS, n // LIST_ROWS, SAMPLE // 10))
    by = F.xxhash64("vid")
    few = same.where(F.pmod(by, F.lit(1 << 20)) < int(1.2 * SAMPLE / n * (1 << 20)) + 1).select("v", by.alias("by")).orderBy("by").limit(SAMPLE).toPandas()
    x = np.stack(few["v"].to_numpy()).astype(np.float64)
    lists = min(lists, len(x))
    lift = np.sqrt(np.maximum(longest - np.square(x).sum(1), 0))
    c = _fit(np.column_stack([x, lift]).astype(np.float32), lists)
    if probe is None:
        probe = max(PROBE, _needed(x, c, float(longest), k))
    index = spark.sparkContext.broadcast((c, _graph(c), float(longest)))

    def lifted(v: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with one more component; queries, whose direction alone decides, are of the length of all others."""
        longest = index.value[2]
        size = np.square(v).sum(1)
        if query:
            return np.column_stack([v * np.sqrt(longest / size)[:, None], np.zeros(len(v))]).astype(np.float32)
        return np.column_stack([v, np.sqrt(np.maximum(longest - size, 0))]).astype(np.float32)

    @F.pandas_udf("array<int>")
    def lists_of(v: pd.Series) -> pd.Series:
        c, links, _ = index.value
        out = []
        for k in range(0, len(v), TOGETHER):
            q = lifted(np.stack(v.iloc[k : k + TOGETHER].to_numpy()).astype(np.float64), False)
            out += [_chosen(dist, BOUNDARY, REPLICAS).astype(np.int32) for dist in _walk(q, c, links, BOUNDARY)]
        return pd.Series(out)

    stored = same.select("vid", "v", F.posexplode(lists_of("v")).alias("place", "list"))
    stored = T.checkpoint(stored)
    # Lists in groups of GROUP_ROWS about; MOST_LISTS rows at most.
    plan, group, held, large = [], 0, 0, []
    firsts = np.zeros(lists, np.int64)
    for r in stored.groupBy("list").agg(F.count("*").alias("n"), F.count_if(F.col("place") == 0).alias("firsts")).orderBy("list").collect():
        firsts[r["list"]] = r["firsts"]
        if r["n"] > SPLIT:
            large.append((r["list"], min(-(-r["n"] // LIST_ROWS), MOST_LISTS), -(-r["n"] // GROUP_ROWS), r["n"]))
            continue
        if held and held + r["n"] > GROUP_ROWS:
            group, held = group + 1, 0
        plan.append((r["list"], group))
        held += r["n"]
    # The group of each list; a list that will be cut stands for itself, and one without rows for nothing.
    groups = np.full(lists, lists, np.int64)
    for name, *rest in plan:
        groups[name] = rest[0]
    for name, *_ in large:
        groups[name] = -1 - name
    counts = spark.sparkContext.broadcast((firsts, groups))
    plan = F.broadcast(spark.createDataFrame(plan, "list int, group long"))
    block = stored.join(plan, "list").select(F.col("list").cast("long").alias("list"), "group", "vid", "v")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy(*each).agg(F.first("v").alias("v")).withColumnRenamed("vec_id", "query_id")
    asked = T.checkpoint(asked.join(same.select("a", "b", F.col("vid").alias("own")), ["a", "b"]).select("query_id", "v", "own"))
    distinct = asked.groupBy("own").agg(F.first("v").alias("v"))

    def probing(parts):
        """A row for each query and group that it probes, with the lists; a row for each list alone would be most of all pairs where no clusters are."""
        c, links, _ = index.value
        firsts, groups = counts.value
        for pdf in parts:
            for at in range(0, len(pdf), TOGETHER):
                some, out = pdf.iloc[at : at + TOGETHER], []
                q = lifted(np.stack(some["v"].to_numpy()).astype(np.float64), True)
                for own, v, x, dist in zip(some["own"], some["v"], q, _walk(q, c, links, probe)):
                    found = _widen(_chosen(dist, probe, MOST_LISTS), x, c, firsts, FLOOR * (k + 1))
                    found = found[groups[found] < len(groups)]
                    found = found[np.argsort(groups[found], kind="stable")]
                    names, starts = np.unique(groups[found], return_index=True)
                    for name, held in zip(names.tolist(), np.split(found.astype(np.int64), starts[1:])):
                        out.append((own, v, name, held, float(np.square(c[held] - x).sum(1).min())))
                yield pd.DataFrame(out, columns=["own", "v", "group", "lists", "far"]).astype({"own": "int64", "group": "int64", "far": "float32"})

    probes = distinct.select("own", "v").mapInPandas(probing, "own long, v array<double>, group long, lists array<long>, far float")
    if large:
        cells = F.broadcast(spark.createDataFrame(large, "list int, parts int, shards int, n long"))
        probes = T.checkpoint(probes)
        cut = probes.where("group < 0").select("own", "v", F.element_at("lists", 1).cast("int").alias("list"))
        more, into = _split(stored.join(cells, "list"), cut.join(cells, "list"), lifted, probe, FLOOR * (k + 1))
        block = block.unionByName(more)
        small = probes.where("group >= 0").withColumn("held", F.lit(0).cast("long"))
        every_probe = small.unionByName(into.withColumn("lists", F.array("list")).drop("list"))
        # Of the parts of all lists those that the ratio selects, and the nearest until they hold enough.
        near = W.partitionBy("own")
        before = F.sum("held").over(near.orderBy("far", F.element_at("lists", 1)).rowsBetween(W.unboundedPreceding, -1))
        probes = every_probe.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("least", F.min("far").over(near)).where((F.col("far") <= F.col("least") * probe) | (F.col("before") < FLOOR * (k + 1)) | (F.col("held") == 0))
        probes = probes.groupBy("group", "own").agg(F.first("v").alias("v"), F.flatten(F.collect_list("lists")).alias("lists"))
    probes = probes.select("group", "own", "v", "lists").toDF("q_group", "own", "q", "lists")

    def compare(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        """The best of one group for each query that probes it: k + 1 different vectors, as its own may be among them."""
        out = {"own": [], "vid": [], "score": []}
        if len(queries) and len(block):
            block = block.sort_values("list")
            b, ids = np.stack(block["v"].to_numpy()), block["vid"].to_numpy()
            names, starts = np.unique(block["list"].to_numpy(), return_index=True)
            ends = np.append(starts[1:], len(ids))
            for s in range(0, len(queries), 128):
                part = queries.iloc[s : s + 128]
                q = np.stack(part["q"].to_numpy())
                scores = np.full((len(part), len(ids)), -np.inf)
                probed = [set(x) for x in part["lists"]]
                for name, lo, hi in zip(names, starts, ends):
                    some = [i for i, x in enumerate(probed) if name in x]
                    if some:
                        scores[some, lo:hi] = q[some] @ b[lo:hi].T
                for own, x, row in zip(part["own"], q, scores):
                    least = -np.inf if len(row) <= REPLICAS * (k + 1) else np.partition(row, -(REPLICAS * (k + 1)))[-(REPLICAS * (k + 1))]  # a vector may be in several lists
                    at = np.flatnonzero((row >= least) & np.isfinite(row))
                    at = at[np.lexsort((ids[at], -row[at]))]
                    at = at[np.sort(np.unique(ids[at], return_index=True)[1])][: k + 1]
                    out["own"] += [own] * len(at)
                    out["vid"] += ids[at].tolist()
                    out["score"] += (np.cumsum(b[at] * x, axis=1)[:, -1]).tolist()  # added up in order
        return pd.DataFrame(out).astype({"own": "int64", "vid": "int64", "score": "float64"})

    found = probes.groupBy("q_group").cogroup(block.groupBy("group")).applyInPandas(compare, "own long, vid long, score double")
    found = found.groupBy("own", "vid").agg(F.max("score").alias("score"))
    best = found.withColumn("r", F.row_number().over(W.partitionBy("own").orderBy(F.desc("score"), "vid"))).where(F.col("r") <= k + 1).select("own", "vid", "score")
    # Back to rows: every id of the vectors found but the query's own.
    exact = best.join(same.select("vid", "ids"), "vid").select("own", "ids", "score")
    # The k + 1 first rows of a query vector serve all rows that ask with it.
    answer = exact.select("own", "score", F.explode("ids").alias("vec_id"))
    answer = answer.withColumn("r", F.row_number().over(W.partitionBy("own").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    answer = answer.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("all"))
    out = asked.select("query_id", "own").join(answer, "own")
    others = F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _split(stored: DataFrame, probes: DataFrame, lifted, probe: float, least: int) -> tuple[DataFrame, DataFrame]:
    """Large lists cut into lists of their own, and the parts that queries probe.

    `stored` (vid, v, list, ...) and `probes` (own, v, list) come with the cell's parts, shards and n. Returns the rows
    (list, group, vid, v), and (own, v, list, group, far, held) with the rows that a part holds.
    """
    keys = ["list", "shard"]
    per = max(1, GROUP_ROWS // LIST_ROWS)
    hashed = F.pmod(F.xxhash64("vid", F.lit(5)), F.lit(1 << 20))
    sample = stored.where(hashed < F.ceil(F.col("parts") * SPLIT_SAMPLE / F.col("n") * (1 << 20))).select("list", "parts", "v")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = lifted(np.stack(pdf["v"].to_numpy()).astype(np.float64), False)
        c = _fit(x, min(int(pdf["parts"].iloc[0]), len(x)))
        return pd.DataFrame({"list": key[0], "part": np.arange(len(c)), "c": list(c)})

    parts = T.checkpoint(sample.groupBy("list").applyInPandas(fit, "list int, part int, c array<float>"))

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64(by), F.col("shards")).cast("int"))

    def each(shards: DataFrame) -> DataFrame:
        """The centroids of each list for each of its shards."""
        out = parts.join(F.broadcast(shards), "list").select("list", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), "part", "c")
        return out.toDF("p_list", "p_shard", "part", "c")

    def assign(key: tuple, rows: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = {"list": [], "group": [], "vid": [], "v": []}
        if len(rows):
            c, names = np.stack(cs["c"].to_numpy()), cs["part"].to_numpy().astype(np.int64)
            for k in range(0, len(rows), 4096):
                some = rows.iloc[k : k + 4096]
                d = _apart(lifted(np.stack(some["v"].to_numpy()).astype(np.float64), False), c)
                near = d <= d.min(1)[:, None] * BOUNDARY
                order = np.argsort(np.where(near, d, np.inf), axis=1)[:, :2]
                i, j = np.nonzero(np.take_along_axis(near, order, 1))
                part = names[order[i, j]]
                cell = (int(key[0]) + 1) << 24
                out["list"] += (cell + part).tolist()
                out["group"] += (cell + part // per).tolist()
                out["vid"] += some["vid"].to_numpy()[i].tolist()
                out["v"] += some["v"].to_numpy()[i].tolist()
        return pd.DataFrame(out).astype({"list": "int64", "group": "int64", "vid": "int64"})

    sizes = stored.select("list", "shards", "n").distinct()
    more = T.checkpoint(dealt(stored.select("list", "shards", "vid", "v"), "vid").groupBy(*keys).cogroup(each(sizes.select("list", "shards")).groupBy("p_list", "p_shard")).applyInPandas(assign, "list long, group long, vid long, v array<double>"))
    held = more.groupBy("list").agg(F.count("*").alias("held"))
    known = T.checkpoint(parts.withColumn("name", ((F.col("list").cast("long") + 1) * (1 << 24) + F.col("part"))).join(held.withColumnRenamed("list", "name"), "name").select("list", "name", "part", "c", "held"))

    def choose(key: tuple, rows: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = {"own": [], "v": [], "list": [], "group": [], "far": [], "held": []}
        if len(rows) and len(cs):
            c, names, part, n = np.stack(cs["c"].to_numpy()), cs["name"].to_numpy(), cs["part"].to_numpy().astype(np.int64), cs["held"].to_numpy()
            for k in range(0, len(rows), 1024):
                some = rows.iloc[k : k + 1024]
                d = _apart(lifted(np.stack(some["v"].to_numpy()).astype(np.float64), True), c)
                for own, v, x in zip(some["own"], some["v"], d):
                    order = np.argsort(x, kind="stable")
                    keep = order[(x[order] <= x[order[0]] * probe) | (np.cumsum(n[order]) - n[order] < least)]
                    out["own"] += [own] * len(keep)
                    out["v"] += [v] * len(keep)
                    out["list"] += names[keep].tolist()
                    out["group"] += (((int(key[0]) + 1) << 24) + part[keep] // per).tolist()
                    out["far"] += x[keep].tolist()
                    out["held"] += n[keep].tolist()
        return pd.DataFrame(out).astype({"own": "int64", "list": "int64", "group": "int64", "far": "float32", "held": "int64"})

    asks = probes.groupBy("list").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("ask_shards"))
    asks = T.checkpoint(asks)
    side = known.join(F.broadcast(asks), "list").select("list", F.explode(F.expr("sequence(0, ask_shards - 1)")).alias("shard"), "name", "part", "c", "held").toDF("p_list", "p_shard", "name", "part", "c", "held")
    asking = probes.join(F.broadcast(asks), "list").withColumn("shard", F.pmod(F.xxhash64("own"), F.col("ask_shards")).cast("int")).select("list", "shard", "own", "v")
    into = asking.groupBy(*keys).cogroup(side.groupBy("p_list", "p_shard")).applyInPandas(choose, "own long, v array<double>, list long, group long, far float, held long")
    return more, into


def op3_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(T.table(spark, sf_dir, "embeddings"))
