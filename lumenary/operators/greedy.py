"""Greedy choices in a fixed order: near-duplicate groups and face records to drop.

Going through rows in order, each row looks at the first row kept so far among its neighbours. Without one it is kept;
with one it is dropped, unless the two disagree. Rows that no chain of neighbours joins don't matter to each other: a task
takes whole components and goes through them in order. A component too large for a task is cut into ranges of the order;
each range is decided as far as what is known of earlier ones allows, so there are as many rounds as ranges, at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenary.operators import filters, paths, people
from lumenary.operators.cluster import hamming_pairs, near_hashes
from lumenary.operators.graph import connected
from lumenary.sources.shared import checkpoint, release

SAME_BOX = 0.5
#: Edges that a task takes, about.
EDGES = 500_000


def _resolved(batches):
    """A task's rows (id, earlier, known, agrees, p0, p1, ...; earlier is null for a row to be decided) to (id, kept).

    `known` says whether an earlier row of another task is kept, as far as that is known. Rows are decided in order of
    their places, as far as they can be; those that nothing comes after have no place and come last.
    """
    import pyarrow as pa

    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    asked = table.column("earlier").is_null().to_numpy()
    ids = table.column("id").to_numpy()
    own = np.unique(ids[asked])
    edges = table.filter(pa.array(~asked))
    later, earlier = edges.column("id").to_numpy(), edges.column("earlier").to_numpy()
    places = [edges.column(c).to_numpy() for c in edges.column_names if c.startswith("p")]
    # an order of the rows: by where they stand as earlier ones, then all others
    order = np.lexsort(places[::-1])
    first, at = np.unique(earlier[order], return_index=True)
    inside = np.isin(first, own)
    turn = np.concatenate([first[inside][np.argsort(at[inside], kind="stable")], np.setdiff1d(own, first)])
    by_row = np.lexsort([*places[::-1], later])
    start = np.searchsorted(later[by_row], turn, "left").tolist()
    stop = np.searchsorted(later[by_row], turn, "right").tolist()
    earlier, agrees = earlier[by_row].tolist(), edges.column("agrees").to_numpy(zero_copy_only=False)[by_row].tolist()
    known = edges.column("known").to_pylist()
    kept = {e: known[k] for e, k in zip(edges.column("earlier").to_pylist(), range(len(known)))} | dict.fromkeys(own.tolist())
    for row, a, b in zip(turn.tolist(), start, stop):
        say = True
        for k in range(a, b):
            state = kept[earlier[k]]
            if state is None:
                say = None
                break
            if state:
                say = not agrees[k]
                break
        kept[row] = say
    yield pa.record_batch([pa.array(turn), pa.array([kept[r] for r in turn.tolist()], pa.bool_())], names=["id", "kept"])


def first_fit(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(id, kept) of all rows in `edges` (later, earlier, place of the earlier one in the order, agrees).

    `most` is how many edges a task takes, about; components of more are cut.
    """
    place = F.struct("place") if not isinstance(edges.schema["place"].dataType, StructType) else F.col("place")
    parts = [f.name for f in edges.select(place.alias("p")).schema["p"].dataType.fields]
    places = [place[f].cast("long").alias(f"p{i}") for i, f in enumerate(parts)]
    e = checkpoint(edges.select(F.col("later").alias("id"), "earlier", "agrees", *places))
    names = [f"p{i}" for i in range(len(parts))]
    labels = connected(e.select(F.col("id").alias("x"), F.col("earlier").alias("y")))
    sized = labels.join(e.groupBy("id").agg(F.count("*").alias("n")), "id", "left")
    sizes = sized.groupBy("label").agg(F.sum(F.coalesce("n", F.lit(0))).alias("edges"))
    rows = checkpoint(labels.join(sizes, "label"))
    tasks = max(1, -(-e.count() // most))

    def solved(edges, asked, key, tasks):
        wide = edges.select("id", "earlier", "known", "agrees", *names, key)
        wide = wide.unionByName(asked.select("id", key), allowMissingColumns=True)
        return wide.repartition(tasks, key).drop(key).mapInArrow(_resolved, "id long, kept boolean")

    unknown = F.lit(None).cast("boolean").alias("known")
    small = rows.where(F.col("edges") <= most)
    found = solved(e.join(small, "id").select(*e.columns, "label", unknown), small, "label", tasks)
    large = rows.where(F.col("edges") > most)
    if large.isEmpty():
        return checkpoint(found)
    # places of rows of large components, of those that have one; ranges of the order hold `most` edges or fewer
    long = e.join(large.select("id"), "id", "left_semi")
    count = max(2, -(-long.count() // most))
    spots = long.groupBy("earlier").agg(*(F.min(p).alias(p) for p in names))
    ranged = checkpoint(spots.repartitionByRange(count, *names).withColumn("range_", F.spark_partition_id()).select(F.col("earlier").alias("id"), "range_"))
    state = checkpoint(large.select("id").join(ranged, "id", "left").select("id", F.coalesce("range_", F.lit(count) + F.pmod(F.xxhash64("id"), F.lit(count))).alias("range_"), F.lit(None).cast("boolean").alias("kept")))
    while not state.where("kept is null").isEmpty():
        open_ = state.where("kept is null")
        asked = long.join(open_.select("id", "range_"), "id").join(state.select(F.col("id").alias("earlier"), F.col("kept").alias("known")), "earlier")
        new = solved(asked, open_, "range_", 2 * count).where("kept is not null").select("id", F.col("kept").alias("said"))
        before, state = state, checkpoint(state.join(new, "id", "left").select("id", "range_", F.coalesce("kept", "said").alias("kept")))
        release(before)
    return checkpoint(found.unionByName(state.select("id", "kept")))


def near_duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(seed, member): seeds in order of id that no earlier seed covers, each with all rows near it, itself included."""
    fit = first_fit(pairs.select(F.col("b").alias("later"), F.col("a").alias("earlier"), F.col("a").alias("place"), F.lit(True).alias("agrees")))
    seeds = fit.where("kept").select(F.col("id").alias("seed"))
    both = pairs.select(F.col("a").alias("seed"), F.col("b").alias("member")).union(pairs.select("b", "a"))
    return both.join(seeds, "seed", "left_semi").union(seeds.select("seed", F.col("seed").alias("member")))


def duplicate_faces(faces: DataFrame, least: float = SAME_BOX) -> DataFrame:
    """Ids of faces that are a second record of one on the same photo: decided records come first, then smaller ids.

    Boxes count as shares of their image where its size is known. Two decided records that are of different people, or
    of which one is rejected, disagree, and both stay.
    """
    decided = F.expr("coalesce(confirmed, 0) = 1 or coalesce(rejected, 0) = 1")
    rows = people.boxes(faces).select("id", "photo_id", "person_id", F.coalesce("rejected", F.lit(0)).alias("rejected"), decided.alias("decided"), *"xywh")
    a, b = (rows.select("photo_id", *(F.col(c).alias(f"{t}_{c}") for c in rows.columns if c != "photo_id")) for t in "ab")
    both = a.join(b, "photo_id").where("struct(not a_decided, a_id) < struct(not b_decided, b_id)")
    near = both.where(people.iou("a", "b") >= least)
    agrees = F.expr("not (b_decided and (a_rejected <> b_rejected or coalesce(a_person_id <> b_person_id, false)))")
    fit = first_fit(near.select(F.col("b_id").alias("later"), F.col("a_id").alias("earlier"), F.expr("struct(not a_decided, a_id)").alias("place"), agrees.alias("agrees")))
    return fit.where("not kept").select("id")


def near_duplicates(lib, hashes: DataFrame, most: int = 6, format_pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """Groups (seed, member) of photos whose hashes (id, h) are near, and the seeds of those left out.

    Groups that are one picture in several formats are left out unless asked for; their members count as seen all the same.
    """
    groups = near_duplicate_groups(near_hashes(hashes, most))
    if format_pairs:
        return groups, groups.select("seed").limit(0)
    names = lib.photo.select(F.col("id").alias("member"), "blake3").join(filters.first_file(lib), "blake3").select("member", "filename")
    pairs = paths.format_groups(groups.join(names, "member"), "seed").select("seed")
    return groups.join(pairs, "seed", "left_anti"), pairs


def fixture_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(hamming_pairs(spark, sf_dir))
