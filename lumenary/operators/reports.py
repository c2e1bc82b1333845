"""Counts, duplicates, groups and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenary.operators import filters

METHODS = ("roots_and_volumes", "exact_duplicates", "wasted_bytes", "tag_counts", "people_counts", "people_counts_all", "naming_queue", "cluster_faces", "ignored_groups", "root_stats", "stats", "timeline", "match_sources", "group_bytes", "fts_document", "job_stats", "job_grid")


def roots_and_volumes(lib) -> DataFrame:
    volumes = lib.volume.select(F.col("id").alias("volume_id"), F.col("label").alias("volume"), "online")
    return lib.root.join(F.broadcast(volumes), "volume_id").orderBy("volume", "rel_path").select("id", F.col("volume").alias("label"), "rel_path", "online")


def _copies(lib) -> DataFrame:
    files = lib.file.groupBy("blake3").agg(F.count("*").alias("n")).where("n > 1")
    return lib.photo.select("id", "blake3", "bytes").join(files, "blake3").withColumn("extra", F.coalesce("bytes", F.lit(0)) * (F.col("n") - 1))


def exact_duplicates(lib, limit: int | None = 200, between: str = ": ") -> DataFrame:
    """Photos with several files, missing ones included, most wasteful first: (id, bytes, n, paths, a line each)."""
    copies = _copies(lib).orderBy(F.desc("extra"), "id")
    copies = copies if limit is None else copies.limit(limit)
    volumes = lib.volume.select(F.col("id").alias("volume_id"), "label")
    roots = F.broadcast(lib.root.select(F.col("id").alias("root_id"), "volume_id").join(F.broadcast(volumes), "volume_id"))
    lines = lib.file.join(copies.select("blake3"), "blake3", "left_semi").join(roots, "root_id").groupBy("blake3").agg(F.array_join(F.array_sort(F.collect_list(F.concat("label", F.lit(between), "rel_path"))), "\n").alias("paths"))
    return copies.join(lines, "blake3").select("id", "bytes", "n", "paths")


def wasted_bytes(lib, limit: int | None = 200) -> DataFrame:
    """The bytes that copies take, of the photos that exact_duplicates returns."""
    copies = _copies(lib).orderBy(F.desc("extra"), "id")
    return (copies if limit is None else copies.limit(limit)).agg(F.sum("extra").cast("long").alias("wasted"))


def tag_counts(lib) -> DataFrame:
    """How often each tag was given; twice to a photo by two sources counts twice."""
    return lib.photo_tag.groupBy("name").agg(F.count("*").alias("n"))


def _best(column: str = "id") -> Column:
    return F.max_by(column, F.struct("det_score", -F.col("id")))


def people_counts(lib) -> DataFrame:
    """(id, name, n, cover): faces that aren't rejected, and the best face of all; people without faces count 0."""
    faces = lib.face.where("person_id is not null").groupBy("person_id").agg(F.count_if(F.col("rejected") == 0).alias("n"), _best().alias("cover"))
    return lib.person.join(faces, lib.person.id == faces.person_id, "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "cover")


def people_counts_all(lib) -> DataFrame:
    """The same with rejected faces."""
    faces = lib.face.groupBy("person_id").agg(F.count("*").alias("n"))
    return lib.person.join(faces, lib.person.id == faces.person_id, "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _top_faces(faces: DataFrame, group: str, most: int) -> DataFrame:
    """The best faces of each group, from the best of each task's share, so that a large group isn't sorted whole."""
    order = F.struct((-F.col("det_score")).alias("a"), F.col("id").alias("b"))
    part = W.partitionBy(group, F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(order)
    some = faces.withColumn("r", F.row_number().over(part)).where(F.col("r") <= most)
    return some.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("r") <= most)


def naming_queue(lib, groups: int = 60, most: int = 12) -> DataFrame:
    """The largest groups of unnamed faces, and the best faces of each: (cluster_id, n, face_id, r)."""
    sizes = lib.face.where("cluster_id is not null and person_id is null and rejected = 0").groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(groups)
    return _top_faces(lib.face.join(F.broadcast(sizes), "cluster_id"), "cluster_id", most).select("cluster_id", "n", F.col("id").alias("face_id"), "r")


def cluster_faces(lib, cluster_id: int, limit: int = 200) -> DataFrame:
    """The faces of a group, best first, with the photo of each; no row if there is no such group."""
    faces = lib.face.where(F.col("cluster_id") == cluster_id).orderBy(F.desc("det_score"), "id").limit(limit).select("id", "photo_id", "det_score")
    photos = lib.photo.select(F.col("id").alias("photo_id"), "blake3", "taken_at").join(filters.first_file(lib), "blake3", "left")
    return faces.join(photos, "photo_id").join(filters.winner(lib), "photo_id", "left").select("id", "photo_id", "det_score", "taken_at", "caption", "filename")


def ignored_groups(lib, groups: int = 60, most: int = 6) -> DataFrame:
    """(cluster_id, n, face_id, r, loose): groups that were ignored, with their best faces, and how many ignored faces have none."""
    ignored = lib.face.where("rejected = 1")
    loose = ignored.agg(F.count_if(F.col("ignored_as").isNull()).alias("loose"))
    sizes = ignored.where("ignored_as is not null").groupBy("ignored_as").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ignored_as").limit(groups)
    top = _top_faces(ignored.join(F.broadcast(sizes), "ignored_as"), "ignored_as", most)
    return top.crossJoin(F.broadcast(loose)).select(F.col("ignored_as").alias("cluster_id"), "n", F.col("id").alias("face_id"), "r", "loose")  # one row


def root_stats(lib) -> DataFrame:
    files = lib.file.groupBy("root_id").agg(F.count_distinct("blake3").alias("photos"), F.count_if(F.col("state") == "missing").alias("missing"))
    return lib.root.join(files, lib.root.id == files.root_id, "left").select("id", F.coalesce("photos", F.lit(0)).cast("long").alias("photos"), F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))


def stats(lib) -> DataFrame:
    """One row: how many photos, files, faces, people, tags, captioned and embedded photos."""
    parts = [(lib.photo, F.count("*"), "photos"), (lib.file, F.count("*"), "files"), (lib.face, F.count("*"), "faces"), (lib.person, F.count("*"), "people"), (lib.photo_tag, F.count_distinct("name"), "tags"), (lib.annotation, F.count_distinct("photo_id"), "captioned"), (lib.embeddings, F.count("*"), "embedded")]
    out = None
    for table, count, name in parts:
        one = table.agg(count.alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def timeline(lib, photos: DataFrame, by: str = "month", searched: bool = False, oldest_first: bool = False) -> DataFrame:
    """Groups of ranked photos (id, taken_at, rel_path, rank) by day, month, year, folder or none: (key, n, place).

    Groups of a search, and folders, stand in the order of their first photo (of equal ranks in that of their keys); else
    in that of time. Photos without a time are one group, 0000, and files without a folder another, an empty one.
    """
    forms = {"day": "yyyyMMdd", "month": "yyyyMM", "year": "yyyy"}
    if by == "folder":
        key = F.regexp_extract(F.coalesce(F.translate("rel_path", "\\", "/"), F.lit("")), "^(.*)/", 1)
    elif by == "none":
        key = F.lit("")
    else:
        key = F.when(F.coalesce("taken_at", F.lit(0)) == 0, "0000").otherwise(F.date_format(F.timestamp_seconds("taken_at"), forms[by]))
    groups = photos.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    order = ["first", "key"] if searched or by in ("folder", "none") else ["key"] if oldest_first else [F.desc("key")]
    return groups.withColumn("place", F.row_number().over(W.orderBy(*order))).select("key", "n", "place")  # a row for each group


def match_sources(lib, hits: DataFrame) -> DataFrame:
    """How many of the hits (sources, parted by commas) each engine found."""
    return hits.select(F.explode(F.split("sources", ",")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def group_bytes(lib, groups: DataFrame) -> DataFrame:
    """The bytes of the photos of each group (seed, member)."""
    return groups.join(lib.photo.select(F.col("id").alias("member"), "bytes"), "member").groupBy("seed").agg(F.count("*").alias("n"), F.sum(F.coalesce("bytes", F.lit(0))).cast("long").alias("bytes"))


def _joined(rows: DataFrame, key: str, column: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(column)), " ").alias(column))


def fts_document(lib) -> DataFrame:
    """The text of each photo, by column: caption and scene, tags (of two sources twice), read text, distinct people, names and folders of four files, place."""
    tags = _joined(lib.photo_tag.withColumnRenamed("name", "tags"), "photo_id", "tags")
    people = lib.face.join(lib.person.select(F.col("id").alias("person_id"), F.col("name").alias("people")), "person_id").select("photo_id", "people").distinct()
    folder = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    first = lib.file.select("blake3", "id", "filename", F.when(folder == "", ".").otherwise(folder).alias("folder"))
    nth = F.row_number().over(W.partitionBy("blake3").orderBy("id", "filename", "folder"))  # the first four are kept before rows are shuffled
    first = first.withColumn("nth", nth).where("nth <= 4").groupBy("blake3").agg(F.array_sort(F.collect_list(F.struct("id", "filename", "folder"))).alias("f"))
    first = first.select("blake3", F.array_join("f.filename", " ").alias("filename"), F.array_join("f.folder", " ").alias("folder"))
    about = filters.winner(lib).select("photo_id", F.concat_ws(" ", "caption", "scene").alias("caption"), F.col("ocr_text").alias("ocr"))
    out = lib.photo.select(F.col("id").alias("photo_id"), "blake3", F.col("place_name").alias("place")).join(first, "blake3", "left")
    for part in (about, tags, _joined(people, "photo_id", "people")):
        out = out.join(part, "photo_id", "left")
    return out.select(F.col("photo_id").alias("id"), "caption", "tags", "ocr", "people", "filename", "folder", "place")


def job_stats(lib) -> DataFrame:
    return lib.job.groupBy("stage", "state").agg(F.count("*").alias("n"))


def job_grid(lib, states: tuple[str, ...] = ("pending", "running", "done", "failed")) -> DataFrame:
    """A row for each stage, a column for each state."""
    return lib.job.groupBy("stage").agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))


def bench(rows: DataFrame, seconds: str, tokens: str) -> DataFrame:
    """Median and mean seconds a photo, tokens a second, median tokens, and days for 500,000 photos."""
    return rows.agg(F.median(seconds).alias("median"), F.avg(seconds).alias("mean"), (F.sum(tokens) / F.sum(seconds)).alias("tokens_per_second"), F.median(tokens).alias("median_tokens"), (F.median(seconds) * 500_000 / 86400).alias("days"))
