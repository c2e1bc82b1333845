"""Faces and people: centroids, anchoring, suggestions, clustering again, and each decision about a face, a group or a person.

A decision returns the new state of the tables that it changes. Names are the same whatever the case of A-Z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.operators import density
from lumenary.operators.nearest import nearest
from lumenary.sources.shared import checkpoint, numbered

METHODS = ("face_vectors", "person_centroids", "assign_known", "suggest_people", "next_cluster", "cluster_unassigned", "recluster", "person_for_name", "name_cluster", "name_face", "merge_clusters", "ignore_cluster", "ignore_face", "restore_ignored", "detach_face", "assign_face", "merge_people", "rename_person", "delete_person", "decided_boxes", "redetected")

STATE = ("id", "photo_id", "person_id", "cluster_id", "confirmed", "rejected", "ignored_as")


def face_vectors(lib, faces: DataFrame | None = None) -> DataFrame:
    """Faces with their vectors, in double precision, of length 1."""
    faces = lib.face if faces is None else faces
    v = lib.embeddings.select((F.col("vec_id") + 1).alias("id"), F.col("embedding").cast("array<double>").alias("raw"))
    return faces.join(v, "id").withColumn("v", unit(F.col("raw")))


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _centroids(rows: DataFrame, key: str) -> DataFrame:
    """(key, centroid): the mean of the raw vectors, of length 1; added up before anything is shuffled."""
    first = rows.select(F.size("raw").alias("n")).first()
    mean = F.array(*(F.avg(F.col("raw")[i]) for i in range(first["n"] if first else 0))).cast("array<double>")
    return rows.groupBy(key).agg(mean.alias("mean")).select(key, unit(F.col("mean")).alias("centroid"))


def person_centroids(lib) -> DataFrame:
    """Of each person's confirmed faces that aren't rejected."""
    return _centroids(face_vectors(lib, lib.face.where("confirmed = 1 and rejected = 0 and person_id is not null")), "person_id")


def _nearest_people(rows: DataFrame, people: DataFrame, key: str, most: int) -> DataFrame:
    """For rows (key, v) the `most` nearest people (person_id, centroid): (key, person_id, sim, r); ties to the smaller id."""
    return nearest(rows.withColumnRenamed(key, "key"), people, most).withColumnRenamed("key", key)


def assign_known(lib, least: float = 0.58) -> DataFrame:
    """(face_id, person_id, sim): the nearest person of each unnamed face that isn't rejected, if near enough."""
    rows = face_vectors(lib, lib.face.where("person_id is null and rejected = 0")).select(F.col("id").alias("face_id"), "v")
    return _nearest_people(rows, person_centroids(lib), "face_id", 1).where(F.col("sim") >= least).select("face_id", "person_id", "sim")


def suggest_people(lib, clusters: DataFrame | None = None, top: int = 2, least: float = 0.35) -> DataFrame:
    """(cluster_id, person_id, name, score, r): who each group (of `clusters`, cluster_id) might be, by centroids, best first."""
    faces = lib.face.where("rejected = 0 and cluster_id is not null")
    faces = faces if clusters is None else faces.join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    groups = _centroids(face_vectors(lib, faces), "cluster_id").withColumnRenamed("centroid", "v")
    named = lib.person.where("name is not null and name <> ''").select(F.col("id").alias("person_id"), "name")
    people = person_centroids(lib).join(named, "person_id", "left_semi")
    found = _nearest_people(groups, people, "cluster_id", top).where(F.col("sim") >= least).join(named, "person_id")
    return found.select("cluster_id", "person_id", "name", F.round("sim", 3).alias("score"), "r")


def next_cluster(lib, faces: DataFrame | None = None) -> DataFrame:
    """One row: the first id that no group has had, 1 if there is none."""
    return (lib.face if faces is None else faces).agg((F.coalesce(F.max("cluster_id"), F.lit(0)) + 1).cast("long").alias("next_id"))


def cluster_unassigned(lib, faces: DataFrame, least: float = 0.58, min_rows: int = 3) -> DataFrame:
    """(id, cluster_id): groups of the unnamed faces that aren't rejected, numbered from the next free id in order of their labels.

    No group if there are fewer such faces than a group needs. Faces that are in none are left out.
    """
    rows = checkpoint(face_vectors(lib, faces.where("person_id is null and rejected = 0")).select(F.col("id").alias("vec_id"), F.col("raw").alias("embedding")))
    if rows.limit(min_rows).count() < min_rows:
        return faces.select("id", F.lit(None).cast("long").alias("cluster_id")).limit(0)
    labels = density.dbscan(rows, least, min_rows)
    numbers = numbered(labels.select("label").distinct(), "label")
    base = next_cluster(lib, faces)
    return labels.join(numbers, "label").crossJoin(F.broadcast(base)).select("id", (F.col("next_id") + F.col("place") - 1).alias("cluster_id"))  # one row


def recluster(lib, least: float = 0.58, min_rows: int = 3, known: float | None = None) -> DataFrame:
    """The faces after clustering again: proposals are dropped, faces near a known person go to them unconfirmed, the rest is grouped."""
    kept = lib.face.withColumn("cluster_id", F.when(F.col("person_id").isNotNull(), F.col("cluster_id")))
    anchored = assign_known(lib.with_tables(face=kept), least if known is None else known).select(F.col("face_id").alias("id"), F.col("person_id").alias("known"))
    kept = kept.join(checkpoint(anchored), "id", "left").withColumn("confirmed", F.when(F.col("known").isNotNull(), 0).otherwise(F.col("confirmed"))).withColumn("person_id", F.coalesce("person_id", "known")).drop("known")
    groups = cluster_unassigned(lib, kept, least, min_rows).withColumnRenamed("cluster_id", "grouped")
    return kept.join(groups, "id", "left").withColumn("cluster_id", F.coalesce("grouped", "cluster_id")).drop("grouped")


def _change(faces: DataFrame, where: Column, **values) -> DataFrame:
    """Faces with new values where a condition holds."""
    old = dict(faces.dtypes)
    return faces.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v).cast(old[c])).otherwise(F.col(c)) for c, v in values.items()})


def _same(a: Column, name: str) -> Column:
    return F.translate(a, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == name.translate({c: c + 32 for c in range(65, 91)})


def person_for_name(lib, name: str) -> tuple[DataFrame, int, bool]:
    """The people with this one among them, their id, and whether they are new."""
    there = lib.person.where(_same(F.col("name"), name)).agg(F.min("id")).first()[0]
    if there is not None:
        return lib.person, there, False
    new = (lib.person.agg(F.max("id")).first()[0] or 0) + 1
    row = lib.spark.createDataFrame([(new, name)], "id long, name string")
    return lib.person.unionByName(row, allowMissingColumns=True), new, True


def _cover(people: DataFrame, faces: DataFrame, person: int, is_new: bool) -> DataFrame:
    """People with a cover for a new one: their best face."""
    if "cover_face_id" not in people.columns:
        people = people.withColumn("cover_face_id", F.lit(None).cast("long"))
    if not is_new:
        return people
    best = faces.where(F.col("person_id") == person).agg(F.max_by("id", F.struct("det_score", -F.col("id"))).alias("best"))
    return people.crossJoin(F.broadcast(best)).withColumn("cover_face_id", F.when(F.col("id") == person, F.col("best")).otherwise(F.col("cover_face_id"))).drop("best")  # one row


def name_cluster(lib, cluster_id: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Faces and people after all faces of a group, rejected ones too, are said to be this person's."""
    people, person, is_new = person_for_name(lib, name)
    faces = _change(lib.face, F.col("cluster_id") == cluster_id, person_id=person, confirmed=1, cluster_id=None)
    return faces, _cover(people, faces, person, is_new)


def name_face(lib, face_id: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The same for one face, which is no longer ignored then."""
    if lib.face.where(F.col("id") == face_id).isEmpty():
        raise KeyError(f"no face {face_id}")
    people, person, is_new = person_for_name(lib, name)
    faces = _change(lib.face, F.col("id") == face_id, person_id=person, confirmed=1, cluster_id=None, rejected=0, ignored_as=None)
    return faces, _cover(people, faces, person, is_new)


def merge_clusters(lib, clusters: list[int], name: str | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Faces after groups become one, the one of the smallest id; with a name it is named at once (faces and people)."""
    if len(set(clusters)) < 2:
        raise ValueError("two groups at least are needed")
    faces = _change(lib.face, F.col("cluster_id").isin(sorted(set(clusters))), cluster_id=min(clusters))
    return faces if name is None else name_cluster(lib.with_tables(face=faces), min(clusters), name)


def ignore_cluster(lib, cluster_id: int) -> DataFrame:
    """Faces of a group are rejected, and remember the group."""
    if lib.face.where(F.col("cluster_id") == cluster_id).isEmpty():
        raise KeyError(f"no group {cluster_id}")
    return _change(lib.face, F.col("cluster_id") == cluster_id, rejected=1, ignored_as=cluster_id, cluster_id=None)


def ignore_face(lib, face_id: int) -> DataFrame:
    """A face is rejected, for itself: it remembers no group."""
    return _change(lib.face, F.col("id") == face_id, rejected=1, person_id=None, cluster_id=None, confirmed=0)


def restore_ignored(lib, cluster_id: int) -> DataFrame:
    """The faces that were ignored as a group are that group again."""
    return _change(lib.face, (F.col("rejected") == 1) & (F.col("ignored_as") == cluster_id), rejected=0, cluster_id=F.col("ignored_as"), ignored_as=None)


def detach_face(lib, face_id: int) -> DataFrame:
    return _change(lib.face, F.col("id") == face_id, person_id=None, cluster_id=None, confirmed=0)


def assign_face(lib, face_id: int, person_id: int) -> DataFrame:
    """A face is said to be a known person's; whether it is rejected stays."""
    return _change(lib.face, F.col("id") == face_id, person_id=person_id, cluster_id=None, confirmed=1)


def merge_people(lib, person_id: int, into: int) -> tuple[DataFrame, DataFrame]:
    """Faces and people after one person's faces are another's, and the first is gone."""
    if person_id == into:
        raise ValueError("a person can't be merged with themselves")
    return _change(lib.face, F.col("person_id") == person_id, person_id=into), lib.person.where(F.col("id") != person_id)


def rename_person(lib, person_id: int, name: str) -> DataFrame:
    """People with a new name; an error names whom to merge with, if another has it."""
    other = lib.person.where(_same(F.col("name"), name) & (F.col("id") != person_id)).agg(F.min("id")).first()[0]
    if other is not None:
        raise ValueError(f"{name!r} is person {other}; merge into them")
    return lib.person.withColumn("name", F.when(F.col("id") == person_id, name).otherwise(F.col("name")))


def delete_person(lib, person_id: int) -> tuple[DataFrame, DataFrame]:
    """Faces and people without this one; their faces are nobody's, and in no group."""
    return _change(lib.face, F.col("person_id") == person_id, person_id=None, confirmed=0), lib.person.where(F.col("id") != person_id)


def boxes(faces: DataFrame) -> DataFrame:
    """Faces with x, y, w, h: shares of their picture where its size is known, else pixels."""
    known = F.expr("coalesce(src_w, 0) > 0 and coalesce(src_h, 0) > 0")
    return faces.withColumns({c: F.when(known, F.col(f"bbox_{c}") / F.col(f"src_{s}")).otherwise(F.col(f"bbox_{c}").cast("double")) for c, s in zip("xywh", "whwh")})


def iou(a: str, b: str) -> Column:
    """How much of two boxes together both cover; columns are a_x, a_y, ... and b_x, ..."""
    x = "greatest(0d, least({a}_x + {a}_w, {b}_x + {b}_w) - greatest({a}_x, {b}_x))".format(a=a, b=b)
    shared = f"({x} * {x.replace('_x', '_y').replace('_w', '_h')})"
    every = f"({a}_w * {a}_h + {b}_w * {b}_h - {shared})"
    return F.expr(f"case when {every} > 0 then {shared} / {every} else 0d end")


def decided_boxes(lib) -> DataFrame:
    """(id, photo_id, x, y, w, h) of the faces that were decided about: named or ignored."""
    return boxes(lib.face.where("confirmed = 1 or rejected = 1")).select("id", "photo_id", "x", "y", "w", "h")


def redetected(lib, found: DataFrame, model: str = "m", least: float = 0.5) -> DataFrame:
    """Faces after a detector ran again on some photos: decided faces stay, its own undecided ones go, and of `found`
    (photo_id, bbox_x, ..., src_h, det_score) those come that cover no decided one. New ids follow the last."""
    faces = lib.face if "model" in lib.face.columns else lib.face.withColumn("model", F.lit(model))
    again = found.select("photo_id").distinct()
    gone = faces.where((F.col("model") == model) & (F.col("confirmed") == 0) & (F.col("rejected") == 0)).join(again, "photo_id", "left_semi")
    stay = faces.join(gone.select("id"), "id", "left_anti")
    a = boxes(found.withColumn("key", F.xxhash64(*found.columns))).select("key", "photo_id", *(F.col(c).alias(f"a_{c}") for c in "xywh"))
    b = decided_boxes(lib).select("photo_id", *(F.col(c).alias(f"b_{c}") for c in "xywh"))
    known = a.join(b, "photo_id").where(iou("a", "b") >= least).select("key").distinct()
    new = found.withColumn("key", F.xxhash64(*found.columns)).join(known, "key", "left_anti").drop("key")
    last = faces.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    rows = numbered(new, "photo_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h").crossJoin(F.broadcast(last))  # one row
    zero = F.lit(0)
    rows = rows.select((F.col("last") + F.col("place")).alias("id"), "photo_id", *(F.col(f"bbox_{c}") for c in "xywh"), "src_w", "src_h", "det_score", zero.alias("confirmed"), zero.alias("rejected"), F.lit(model).alias("model"))
    return stay.unionByName(rows, allowMissingColumns=True)
