"""Changes of state: scans, files, jobs, tags, annotations, and what goes when files go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.operators import filters
from lumenary.sources.shared import checkpoint, numbered, release

METHODS = ("scan", "mark_missing", "set_offline", "ingest", "orphans", "prune", "remove_root", "removal_counts", "enqueue", "claim", "finish", "unclaim", "requeue_stale", "retry_failed", "reset_stage", "set_tags", "edit_annotation", "revert_annotation", "set_favorite", "import_keywords", "export_ids", "export_counts")
STAGES = ("thumbs", "embed", "faces", "caption")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """`old` with the rows of `new`: of rows with equal keys the columns `update` (all of the new one's) are replaced.

    Of several rows of `new` with the same keys the one that comes last in order of its columns counts.
    """
    update = [c for c in (new.columns if update is None else update) if c not in keys]
    rest = [c for c in new.columns if c not in keys]
    n = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("last")).select(*keys, *(F.col(f"last.{c}").alias(f"new_{c}") for c in rest)) if rest else new.select(*keys).distinct()
    n = n.withColumn("new_there", F.lit(True))
    out = old.withColumn("old_there", F.lit(True)).join(n, keys, "full_outer")

    def value(c):
        if c not in new.columns:
            return F.col(c)
        fresh = F.col("old_there").isNull() | (F.col("new_there") if c in update else F.lit(False))
        return F.when(F.coalesce(fresh, F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return out.select(*(F.col(c) if c in keys else value(c) for c in old.columns))


def upsert_partitions(table: str, new: DataFrame, keys: list[str], by: str) -> int:
    """Upsert `new` into a Parquet table that is partitioned by `by`, one of the keys; returns how many partitions were rewritten.

    Only the partitions that `new` has rows for are read and rewritten; files of others stay as they are. A new version of
    a partition is written before the old one goes.
    """
    spark = new.sparkSession
    touched = new.select(by).distinct()
    old = spark.read.parquet(table).join(F.broadcast(touched), by, "left_semi")  # a row for each partition
    rows = checkpoint(upsert(old, new.select(*old.columns), keys))
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(table)
    release(rows)
    return touched.count()


def globs(column: str | Column) -> Column:
    """The patterns that a column holds as a JSON array of strings; none for null, an empty text, or what is no such array."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose keys it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def scan(lib, found: DataFrame, root_id: int, force: bool = False) -> DataFrame:
    """Each file of a root against what a walk found (rel_path, mtime, size): (rel_path, status new, changed, unchanged or missing).

    A file is unchanged if its whole seconds of mtime and its size are; with `force` none is.
    """
    old = lib.file.where(F.col("root_id") == root_id).select("rel_path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.lit(True).alias("known"))
    both = found.select("rel_path", F.col("mtime").cast("long").alias("mtime"), "size", F.lit(True).alias("there")).join(old, "rel_path", "full_outer")
    same = (F.col("mtime") == F.col("m")) & (F.col("size") == F.col("s")) & F.lit(not force)
    return both.select("rel_path", F.when(F.col("there").isNull(), "missing").when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("status"))


def mark_missing(lib, root_id: int, started: int) -> DataFrame:
    """Files after a whole scan of a root that began at `started`: present ones that it hasn't seen are missing; offline ones stay."""
    gone = (F.col("root_id") == root_id) & (F.col("state") == "present") & (F.col("seen_at") < started)
    return lib.file.withColumn("state", F.when(gone, "missing").otherwise(F.col("state")))


def set_offline(lib, root_id: int, offline: bool = True) -> DataFrame:
    """Files after a root's drive went, or came back: present and offline ones change, missing ones don't."""
    here = (F.col("root_id") == root_id) & F.col("state").isin("present", "offline")
    return lib.file.withColumn("state", F.when(here, "offline" if offline else "present").otherwise(F.col("state")))


def ingest(lib, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, photos and jobs after files (root_id, rel_path, filename, mtime, size, blake3) are taken in.

    A known hash is linked only; a new one is one photo with a pending job of each stage, however many files have it.
    A file that was known by root and path is updated, and present again.
    """
    found = found.dropDuplicates(["root_id", "rel_path"])
    last = lib.file.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    fresh = found.join(lib.file.select("root_id", "rel_path"), ["root_id", "rel_path"], "left_anti")
    places = numbered(fresh.select("root_id", "rel_path"), "root_id", "rel_path").crossJoin(F.broadcast(last))  # one row
    rows = found.withColumn("state", F.lit("present")).join(places.select("root_id", "rel_path", (F.col("last") + F.col("place")).alias("id")), ["root_id", "rel_path"], "left")
    files = upsert(lib.file, rows, ["root_id", "rel_path"], [c for c in rows.columns if c != "id"])
    new = found.groupBy("blake3").agg(F.min("size").alias("bytes")).join(lib.photo.select("blake3"), "blake3", "left_anti")
    top = lib.photo.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = numbered(new, "blake3").crossJoin(F.broadcast(top)).select((F.col("last") + F.col("place")).alias("id"), "blake3", "bytes")
    photos = lib.photo.unionByName(new, allowMissingColumns=True)
    return files, photos, enqueue(lib, new)


def orphans(lib, drop_missing: bool = True, files: DataFrame | None = None) -> DataFrame:
    """Photos without a file, or with missing ones only, unless those count."""
    files = lib.file if files is None else files
    return lib.photo.join((files.where("state <> 'missing'") if drop_missing else files).select("blake3"), "blake3", "left_anti")


def prune(lib, drop_missing: bool = True) -> dict[str, DataFrame]:
    """Every table without the orphans and what hangs on them; files that are missing go too, if they don't count."""
    gone = orphans(lib, drop_missing).select(F.col("id").alias("photo_id"), "blake3")
    out = {"photo": lib.photo.join(gone, "blake3", "left_anti")}
    out["file"] = (lib.file.where("state <> 'missing'") if drop_missing else lib.file).join(gone, "blake3", "left_anti")
    for name in ("annotation", "photo_tag", "face", "job"):
        out[name] = getattr(lib, name).join(gone, "photo_id", "left_anti")
    return out


def remove_root(lib, root_id: int) -> DataFrame:
    """The photos that go with a root: those of no other root's file that isn't missing."""
    return orphans(lib, files=lib.file.where(F.col("root_id") != root_id))


def removal_counts(lib, root_id: int) -> DataFrame:
    """One row: how many files and photos go with a root."""
    return lib.file.where(F.col("root_id") == root_id).agg(F.count("*").alias("files")).crossJoin(remove_root(lib, root_id).agg(F.count("*").alias("photos")))  # one row each


def enqueue(lib, photos: DataFrame, stages: tuple[str, ...] = STAGES, priority: int = 100, reset: bool = False) -> DataFrame:
    """Jobs with a pending one of each stage for each photo (id); with `reset`, those there are start over with this priority."""
    last = lib.job.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = photos.select(F.col("id").alias("photo_id"), F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    fresh = numbered(new.join(lib.job.select("photo_id", "stage"), ["photo_id", "stage"], "left_anti"), "photo_id", "stage")
    rows = fresh.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("place")).alias("id"), "photo_id", "stage", F.lit("pending").alias("state"), F.lit(priority).cast("long").alias("priority"), F.lit(0).cast("long").alias("attempts"))  # one row
    old = lib.job
    if reset:
        again = old.join(new.withColumn("again", F.lit(True)), ["photo_id", "stage"], "left")
        hit = F.coalesce("again", F.lit(False))
        old = again.withColumns({"state": F.when(hit, "pending").otherwise(F.col("state")), "attempts": F.when(hit, 0).otherwise(F.col("attempts")), "priority": F.when(hit, priority).otherwise(F.col("priority"))})
        if "error" in old.columns:
            old = old.withColumn("error", F.when(~hit, F.col("error")))
    return old.select(*lib.job.columns).unionByName(rows, allowMissingColumns=True)


def claim(lib, stage: str, limit: int) -> DataFrame:
    """The pending jobs of a stage that a worker takes, by priority, then id: running, one attempt more."""
    jobs = lib.job.where((F.col("stage") == stage) & (F.col("state") == "pending")).orderBy("priority", "id").limit(limit)
    return jobs.withColumns({"state": F.lit("running"), "attempts": F.col("attempts") + 1})


def finish(lib, results: DataFrame) -> DataFrame:
    """Jobs after some ended (id, state done, failed or pending, error); errors keep 500 letters."""
    ended = results.select("id", F.col("state").alias("to"), F.substring("error", 1, 500).alias("why"))
    out = lib.job.join(ended, "id", "left")
    error = F.col("error") if "error" in lib.job.columns else F.lit(None).cast("string")
    return out.select(*(c for c in lib.job.columns if c not in ("state", "error")), F.coalesce("to", "state").alias("state"), F.when(F.col("to").isNotNull(), F.col("why")).otherwise(error).alias("error"))


def unclaim(lib, ids: DataFrame) -> DataFrame:
    """Jobs after some (id) that were taken are put back: pending, without the attempt."""
    back = F.coalesce("back", F.lit(False))
    out = lib.job.join(ids.select("id", F.lit(True).alias("back")), "id", "left")
    return out.withColumns({"state": F.when(back, "pending").otherwise(F.col("state")), "attempts": F.when(back, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts"))}).select(*lib.job.columns)


def requeue_stale(lib, most: int = 5) -> DataFrame:
    """Jobs after a crash: running ones of fewer attempts than that are pending again."""
    return lib.job.withColumn("state", F.when((F.col("state") == "running") & (F.col("attempts") < most), "pending").otherwise(F.col("state")))


def retry_failed(lib, stage: str | None = None) -> DataFrame:
    """Failed jobs, of one stage or all, are pending again without attempts or error."""
    if stage is not None and stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; there are {', '.join(STAGES)}")
    again = (F.col("state") == "failed") & (F.lit(True) if stage is None else F.col("stage") == stage)
    out = lib.job.withColumns({"state": F.when(again, "pending").otherwise(F.col("state")), "attempts": F.when(again, 0).otherwise(F.col("attempts"))})
    return out.withColumn("error", F.when(~again, F.col("error"))) if "error" in out.columns else out


def reset_stage(lib, stage: str, rebuild: bool = False) -> dict[str, DataFrame]:
    """Tables after a stage starts over for every photo, also those that had no job of it.

    With `rebuild`, what it made goes: of faces those that nobody decided about, of embed all vectors; captions are
    replaced one by one as they come, and thumbnails are no table.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; there are {', '.join(STAGES)}")
    out = {"job": enqueue(lib, lib.photo.select("id"), (stage,), reset=True)}
    if rebuild and stage == "faces":
        out["face"] = lib.face.where("confirmed = 1 or rejected = 1")
    if rebuild and stage == "embed":
        out["embeddings"] = lib.embeddings.limit(0)
    return out


def normal_tag(tag: Column) -> Column:
    return F.lower(F.regexp_replace(tag, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def set_tags(lib, tags: DataFrame, source: str) -> DataFrame:
    """Tags after this source's of some photos (photo_id, names array) are replaced; other sources' stay. Blank ones are dropped."""
    old = lib.photo_tag.join(tags.select("photo_id", F.lit(source).alias("source")), ["photo_id", "source"], "left_anti")
    new = tags.select("photo_id", F.explode("names").alias("name")).withColumn("name", normal_tag(F.col("name"))).where("name <> ''").distinct()
    return old.unionByName(new.withColumn("source", F.lit(source)))


def edit_annotation(lib, edits: DataFrame, now: int) -> DataFrame:
    """Annotations after edits by hand (photo_id, caption, scene, ocr_text): a null field keeps what counted so far, or is empty."""
    current = filters.winner(lib).select("photo_id", *(F.col(c).alias(f"old_{c}") for c in ("caption", "scene", "ocr_text")))
    rows = edits.join(current, "photo_id", "left").select("photo_id", *(F.coalesce(F.col(c), F.col(f"old_{c}"), F.lit("")).alias(c) for c in ("caption", "scene", "ocr_text")), F.lit("manual").alias("model"), F.lit(now).cast("long").alias("created_at"))
    return upsert(lib.annotation, rows, ["photo_id", "model"])


def revert_annotation(lib, photos: DataFrame) -> DataFrame:
    """Annotations without those by hand of some photos (photo_id)."""
    return lib.annotation.join(photos.select("photo_id", F.lit("manual").alias("model")), ["photo_id", "model"], "left_anti")


def set_favorite(lib, ids: DataFrame, on: bool = True) -> DataFrame:
    hit = lib.photo.join(ids.select("id", F.lit(True).alias("hit")), "id", "left")
    return hit.withColumn("favorite", F.when(F.col("hit"), int(on)).otherwise(F.col("favorite"))).select(*lib.photo.columns)


def import_keywords(lib, sidecars: DataFrame) -> DataFrame:
    """Tags after sidecars (photo_id, tags array) were read: their keywords, parted at , ; or |, join those given by hand."""
    read = sidecars.select("photo_id", F.explode("tags").alias("raw")).select("photo_id", F.explode(F.split("raw", "[,;|]")).alias("name")).withColumn("name", normal_tag(F.col("name"))).where("name <> ''")
    hand = lib.photo_tag.where("source = 'manual'").select("photo_id", "name")
    return lib.photo_tag.where("source <> 'manual'").unionByName(hand.unionByName(read).distinct().withColumn("source", F.lit("manual")))


def export_ids(lib, root_id: int | None = None, limit: int | None = None) -> DataFrame:
    """The photos whose sidecars are written: with a present file, of one root or any, by id."""
    files = lib.file.where("state = 'present'")
    files = files if root_id is None else files.where(F.col("root_id") == root_id)
    out = lib.photo.join(files.select("blake3"), "blake3", "left_semi").select("id").orderBy("id")
    return out.limit(limit) if limit else out


def export_counts(lib, readable: DataFrame, there: DataFrame, packets: DataFrame, root_id: int | None = None, overwrite: bool = False) -> DataFrame:
    """One row: of the photos to export, how many are offline (not `readable`, id), skipped (their sidecar is `there`, id) and written (they have a packet, id)."""
    ids = export_ids(lib, root_id)
    for name, rows in (("readable", readable), ("there", there), ("packet", packets)):
        ids = ids.join(rows.select("id", F.lit(True).alias(name)).distinct(), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    skipped = F.col("readable") & F.col("there") & F.lit(not overwrite)
    return ids.agg(F.count("*").alias("total"), F.count_if(~F.col("readable")).alias("offline"), F.count_if(skipped).alias("skipped"), F.count_if(F.col("readable") & ~skipped & F.col("packet")).alias("written"))
