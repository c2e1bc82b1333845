"""Which photos: structured conditions, browsing, the map, and what a page shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("like_names", "of_person", "of_tag", "of_camera", "of_place", "of_folder", "of_filename", "of_dates", "of_favorites", "with_faces", "visible", "matching", "browse", "map_points", "page_columns", "photo_detail", "first_file", "winner")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(column: str | Column) -> Column:
    """A-Z as a-z; other letters stay."""
    return F.translate(column, UPPER, LOWER)


def fold(value: str) -> str:
    return value.translate(str.maketrans(UPPER, LOWER))


def like(column: str | Column, value: str) -> Column:
    """Whether the column holds the value, whatever the case of A-Z; % and _ in the value stay wildcards, a backslash is itself."""
    return folded(column).like("%" + fold(value).replace("\\", "\\\\") + "%")


def like_names(lib, value: str) -> DataFrame:
    """Files whose name fits (id, filename)."""
    return lib.file.where(like("filename", value)).select("id", "filename")


def _photos(lib, photos):
    return lib.photo if photos is None else photos


def _with_file(lib, photos, files: DataFrame) -> DataFrame:
    return _photos(lib, photos).join(files.select("blake3"), "blake3", "left_semi")


def of_person(lib, name: str, photos: DataFrame | None = None) -> DataFrame:
    """Photos with a face of a person whose name fits; rejected and unconfirmed faces count."""
    named = lib.person.where(like("name", name)).select(F.col("id").alias("person_id"))
    faces = lib.face.join(named, "person_id", "left_semi").select(F.col("photo_id").alias("id"))
    return _photos(lib, photos).join(faces, "id", "left_semi")


def of_tag(lib, tag: str, photos: DataFrame | None = None) -> DataFrame:
    tagged = lib.photo_tag.where(folded("name") == fold(tag)).select(F.col("photo_id").alias("id"))
    return _photos(lib, photos).join(tagged, "id", "left_semi")


def of_camera(lib, value: str, photos: DataFrame | None = None) -> DataFrame:
    return _photos(lib, photos).where(like("camera_model", value) | like("camera_make", value))


def of_place(lib, value: str, photos: DataFrame | None = None) -> DataFrame:
    return _photos(lib, photos).where(like("place_name", value))


def of_folder(lib, value: str, photos: DataFrame | None = None) -> DataFrame:
    """Photos with a file, in whatever state, whose path fits."""
    return _with_file(lib, photos, lib.file.where(like("rel_path", value)))


def of_filename(lib, value: str, photos: DataFrame | None = None) -> DataFrame:
    return _with_file(lib, photos, lib.file.where(like("filename", value)))


def of_dates(lib, since: int | None = None, until: int | None = None, photos: DataFrame | None = None) -> DataFrame:
    """Both ends included; an end that is None or 0 is open. Photos without a time only fit where both are."""
    out = _photos(lib, photos)
    out = out.where(F.col("taken_at") >= since) if since else out
    return out.where(F.col("taken_at") <= until) if until else out


def of_favorites(lib, photos: DataFrame | None = None) -> DataFrame:
    return _photos(lib, photos).where("favorite = 1")


def with_faces(lib, there: bool = True, photos: DataFrame | None = None) -> DataFrame:
    return _photos(lib, photos).join(lib.face.select(F.col("photo_id").alias("id")), "id", "left_semi" if there else "left_anti")


def visible(lib, photos: DataFrame | None = None) -> DataFrame:
    """Photos that aren't hidden and have a file that isn't missing; an offline one will do."""
    return _with_file(lib, _photos(lib, photos).where("hidden = 0"), lib.file.where("state <> 'missing'"))


def matching(lib, request) -> DataFrame:
    """The visible photos that meet all conditions of a `plans.request.Request`."""
    out = visible(lib)
    for field, narrow in (("person", of_person), ("tag", of_tag), ("camera", of_camera), ("place", of_place), ("folder", of_folder), ("filename", of_filename)):
        for value in request.only.get(field, ()):
            out = narrow(lib, value, out)
    out = of_dates(lib, *request.span, out)
    if request.favorite:
        out = of_favorites(lib, out)
    return out if request.faces is None else with_faces(lib, request.faces, out)


def first_file(lib) -> DataFrame:
    """One file of each photo, that of the smallest id: (blake3, filename, rel_path)."""
    return lib.file.groupBy("blake3").agg(F.min_by(F.struct("filename", "rel_path"), "id").alias("f")).select("blake3", "f.*")


def winner(lib) -> DataFrame:
    """The annotation of each photo that counts: by hand before a model's, then the newest, then the last caption by name."""
    order = F.struct((F.col("model") == "manual").alias("by_hand"), "created_at", "caption")
    best = lib.annotation.groupBy("photo_id").agg(F.max_by(F.struct("caption", "scene", "ocr_text"), order).alias("a"))
    return best.select("photo_id", "a.*")


def browse(lib, sort: str = "newest", limit: int = 80, offset: int = 0) -> DataFrame:
    """A page of photos that aren't hidden, missing ones included: newest, oldest, added or name; any other sort is newest."""
    photos = lib.photo.where("hidden = 0").join(first_file(lib), "blake3", "left")
    order = {"oldest": F.asc_nulls_first("taken_at"), "added": F.desc("created_at"), "name": F.asc_nulls_first("filename")}
    key = order.get(sort, F.desc_nulls_last("taken_at"))
    return photos.orderBy(key, "id").offset(offset).limit(min(limit, 500)).select("id", "taken_at", "created_at", "filename")


def map_points(lib, limit: int = 5000) -> DataFrame:
    """Photos with a position, newest first, with their newest caption; one by hand has no precedence here."""
    newest = lib.annotation.groupBy("photo_id").agg(F.max_by("caption", F.struct("created_at", "caption")).alias("caption"))
    points = lib.photo.where("gps_lat is not null and hidden = 0").orderBy(F.desc_nulls_last("taken_at"), "id").limit(limit)
    return points.join(newest, points.id == newest.photo_id, "left").select("id", "gps_lat", "gps_lon", "caption")


def page_columns(lib, ids: DataFrame) -> DataFrame:
    """What a page shows of the photos of `ids` (id): bytes, and a file's path."""
    return lib.photo.join(F.broadcast(ids.select("id").limit(500)), "id", "left_semi").join(first_file(lib), "blake3", "left").select("id", "bytes", "rel_path")


def photo_detail(lib, ids: DataFrame | None = None) -> DataFrame:
    """All about each photo, or those of `ids` (id): caption, tags (by hand before others, then by name), faces that aren't rejected with their people, files by drive.

    The lists are what is asked for; of a content of very many files ask for the photos of interest only.
    """
    if ids is not None:
        photos = lib.photo.join(ids.select("id"), "id", "left_semi")
        of = lambda table: table.join(ids.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
        lib = lib.with_tables(photo=photos, photo_tag=of(lib.photo_tag), face=of(lib.face), annotation=of(lib.annotation), file=lib.file.join(photos.select("blake3"), "blake3", "left_semi"))
    tags = lib.photo_tag.withColumn("o", F.when(F.col("source") == "manual", 0).otherwise(1)).groupBy("photo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "name", "source"))), lambda t: F.concat(t["source"], F.lit(":"), t["name"])), ",").alias("tags"))
    people = lib.person.select(F.col("id").alias("person_id"), "name")
    faces = lib.face.where("rejected = 0").join(people, "person_id", "left")
    faces = faces.groupBy("photo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda f: F.concat(f["id"].cast("string"), F.lit(":"), F.coalesce(f["name"], F.lit("?")))), ",").alias("faces"))
    root = lib.root.select(F.col("id").alias("root_id"), "volume_id").join(F.broadcast(lib.volume.select(F.col("id").alias("volume_id"), "label")), "volume_id")
    files = lib.file.join(F.broadcast(root), "root_id").groupBy("blake3").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "label", "rel_path"))), lambda f: F.concat(f["label"], F.lit(":"), f["rel_path"])), ",").alias("files"))
    about = winner(lib).select(F.col("photo_id").alias("id"), "caption")
    out = lib.photo.select("id", "blake3", "camera_model").join(about, "id", "left").join(files, "blake3", "left")
    for part in (tags, faces):
        out = out.join(part.withColumnRenamed("photo_id", "id"), "id", "left")
    return out.select("id", "camera_model", "caption", "tags", "faces", "files")


