"""The registered library queries: operators of `Library` with parameters, over the fixture of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.functions import imaging, lenient_json, providers
from lumenary.library import Library
from lumenary.operators import changes, cluster, density, greedy, paths, people, reports, search, text_index, vector_index
from lumenary.plans import oracles, request, runner
from lumenary.sources import picture_fixture, shared, sidecar, snapshots
from lumenary.streaming import ingest, scans

STATE = people.STATE


def _library(make):
    return lambda spark, sf_dir: make(Library.of_driver_tables(spark, sf_dir))


def _ids(photos: DataFrame, *more: str) -> DataFrame:
    return photos.select("id", *more)


def _faces(table: DataFrame) -> DataFrame:
    return table.select(*STATE)


def _made(lib, expression: str, name: str) -> DataFrame:
    """A column made of the ids of files."""
    return lib.file.select("id", F.expr(expression).alias(name))


def _listing(lib) -> DataFrame:
    """Files as a walk of a drive would list them, some of them in folders that are left out."""
    odd = "case id % 7 when 0 then '.cache/' when 1 then 'a/node_modules/b/' when 2 then 'keep/skip/' else '' end"
    return lib.file.selectExpr("id", f"concat('/mnt/p/', {odd}, rel_path, case when id % 11 = 0 then '.txt' else '' end) as path")


def _mounts(lib) -> DataFrame:
    """The fixture's mounts: drives at /mnt/, one within another, known by serial, uuid, marker or path."""
    return lib.spark.createDataFrame([("/", None, "u-root", None, "system"), ("/mnt/a", "s-1", "u-1", None, "A"), ("/mnt/a/b", None, None, "m-2", "B"), ("/mnt/c", None, None, None, "C")], "mountpoint string, serial string, uuid string, marker string, label string")


def _nations(lib) -> DataFrame:
    """A mount for each nation, and for some another one in it, as many as the table has."""
    top = lib.root.selectExpr("concat('/mnt/', rel_path) as mountpoint", "concat('s-', id) as serial", "label")
    deep = lib.root.where("id % 3 = 0").selectExpr("concat('/mnt/', rel_path, '/en', if(id % 2 = 0, '/', '')) as mountpoint", "concat('d-', id) as serial", "concat(label, ' en') as label")
    return top.unionByName(deep).withColumns({"uuid": F.lit(None).cast("string"), "marker": F.lit(None).cast("string")})


def _detected(lib) -> DataFrame:
    """What a detector finds again: each third face, some of them moved."""
    box = {c: (F.col(f"bbox_{c}") + (F.when(F.col("id") % 2 == 0, 400).otherwise(3) if c == "x" else 0)).alias(f"bbox_{c}") for c in "xywh"}
    return lib.face.where("id % 3 = 0").select("photo_id", *box.values(), "src_w", "src_h", "det_score")


def _reranked(lib) -> DataFrame:
    """Photos in an order that isn't that of time."""
    rows = lib.photo.where("hidden = 0").join(lib.file.groupBy("blake3").agg(F.min_by("rel_path", "id").alias("rel_path")), "blake3")
    return rows.select("id", "taken_at", "rel_path", (F.pmod(F.col("id") * 7919, F.lit(100003))).alias("rank"))


def _vector_index(lib) -> DataFrame:
    """What is read back of an index after a build for one model, and a second one that replaces it."""
    folder = shared.fresh(lib.spark, "index")
    rows = lib.embeddings.select(F.col("vec_id").alias("photo_id"), "embedding", F.when(F.col("vec_id") % 4 == 0, "old").otherwise("m64").alias("model"))
    snapshots.build_vectors(rows, folder, "old", 64)
    snapshots.build_vectors(rows, folder, "m64", 64)
    assert snapshots.load_vectors(lib.spark, folder, "old", 64) is None
    return snapshots.load_vectors(lib.spark, folder, "m64", 64).select("photo_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _text_index(lib, docs: DataFrame | None = None) -> text_index.Index:
    return text_index.build(lib.fts_document() if docs is None else docs, shared.fresh(lib.spark, "text"))


def _updated_index(lib) -> text_index.Index:
    """An index over an older state of the photos, brought up to date: two thirds had other captions, some are new, some have gone."""
    docs = lib.fts_document()
    older = docs.where("id % 5 <> 1").withColumn("caption", F.when(F.col("id") % 3 == 0, F.col("caption")).otherwise(F.concat(F.lit("by whom "), "place", F.lit(" whatever by"))))
    index = _text_index(lib, older)
    text_index.update(lib.spark, index.folder, docs.where("id % 3 = 1 and id % 7 <> 0"), docs.where("id % 7 = 0").select("id"))
    return text_index.update(lib.spark, index.folder, docs.where("(id % 3 = 2 or id % 5 = 1) and id % 7 <> 0"))


def _vector_codes(lib) -> str:
    folder = shared.fresh(lib.spark, "codes")
    vector_index.build(lib.embeddings.select(F.col("vec_id").alias("id"), "embedding"), folder, "m64", 64)
    return folder


def _query(lib) -> list[float]:
    row = lib.embeddings.where("vec_id = 0").first()
    return row["embedding"] if row else []


def _indexed_search(lib) -> DataFrame:
    lib = lib.with_indexes(_text_index(lib).folder, _vector_codes(lib))
    return lib.search(request.Request(text="by wh", only={"place": ["nation_1"]}), 25, query=_query(lib)).select("id", "score", "sources", "rank")


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("id", F.round("score", 6).alias("score"))


def _stage_run(lib) -> DataFrame:
    """Job states after the caption stage ran over all photos: texts of fewer than five words fail, offline photos stay pending."""
    texts = lib.documents.select(F.col("doc_id").alias("photo_id"), F.col("text").alias("payload"))
    lib = lib.with_tables(job=lib.photo.select(F.col("id"), F.col("id").alias("photo_id"), F.lit("caption").alias("stage"), F.lit("pending").alias("state"), F.lit(100).cast("long").alias("priority"), F.lit(0).cast("long").alias("attempts")))
    work = runner.provider_work(lib, runner.offline_payloads(lib, texts), "caption", "first_words")
    out, _ = runner.batches(lib, "caption", 100_000, 1 << 40, work)
    return out.job.select("id", "state", "attempts")


def _upserted_roots(lib) -> DataFrame:
    """Roots added again: label and enabled change, the globs that were there stay; a new path is a new root."""
    old = lib.root.select("volume_id", "rel_path", "label", F.lit(0).alias("enabled"), F.concat(F.lit('["'), "rel_path", F.lit('*"]')).alias("globs"))
    new = old.where("volume_id % 2 = 0").select("volume_id", F.when(F.length("label") % 2 == 0, F.concat("rel_path", F.lit("/sub"))).otherwise(F.col("rel_path")).alias("rel_path"), F.lit("again").alias("label"), F.lit(1).alias("enabled"), F.lit("[]").alias("globs"))
    out = changes.upsert(old, new, ["volume_id", "rel_path"], ["label", "enabled"])
    return out.withColumn("globs", F.array_join(changes.globs("globs"), ","))


def _upserted_partitions(lib) -> DataFrame:
    """The files as a table with a folder for each root, after files of a few roots changed and came."""
    table = shared.fresh(lib.spark, "files")
    files = lib.file.select("rel_path", "size", "state", "root_id")
    files.repartition("root_id").write.partitionBy("root_id").parquet(table)
    some = files.where("root_id % 6 = 1 and size % 2 = 0")
    new = some.withColumn("size", F.col("size") + 1).unionByName(some.withColumn("rel_path", F.concat(F.lit("x/"), "rel_path")))
    changes.upsert_partitions(table, new.withColumn("state", F.lit("present")), ["root_id", "rel_path"], "root_id")
    return lib.spark.read.parquet(table).select("rel_path", "size", "state", F.col("root_id").cast("long").alias("root_id"))


MAKES = {
    # Browsing and structured filters
    "browse_newest": lambda lib: _ids(lib.browse("newest", 50), "taken_at"),
    "browse_oldest": lambda lib: _ids(lib.browse("oldest", 50, 20), "taken_at"),
    "browse_added": lambda lib: _ids(lib.browse("added", 50, 10), "created_at"),
    "browse_name": lambda lib: _ids(lib.browse("name", 50), "filename"),
    "filter_person": lambda lib: _ids(lib.matching(request.Request(only={"person": ["asia"]}))),
    "filter_tag": lambda lib: _ids(lib.matching(request.Request(only={"tag": ["fr", "src3"]}))),
    "filter_camera": lambda lib: _ids(lib.matching(request.Request(only={"camera": ["econ"]})), "camera_model"),
    "filter_folder_filename": lambda lib: _ids(lib.matching(request.Request(only={"folder": ["en/src1"], "filename": [".jpg"]}))),
    "filter_place": lambda lib: _ids(lib.matching(request.Request(only={"place": ["nation_1"]})), "place_name"),
    "filter_favorite": lambda lib: _ids(lib.matching(request.Request(favorite=True))),
    "filter_dates_inclusive": lambda lib: _ids(lib.matching(request.Request(span=(1704499200, 1708387200))), "taken_at"),
    "filter_has_faces": lambda lib: _ids(lib.matching(request.Request(faces=True))),
    "filter_no_faces": lambda lib: _ids(lib.matching(request.Request(faces=False))),
    "visible_photos": lambda lib: _ids(lib.visible()),
    "like_wildcards": lambda lib: lib.like_names("img_1_4."),
    "map_points": lambda lib: lib.map_points(),
    "page_columns": lambda lib: lib.page_columns(lib.photo.orderBy("id").limit(40)),
    "photo_detail": lambda lib: lib.photo_detail(),
    "root_volume": lambda lib: lib.roots_and_volumes(),
    "readable_path": lambda lib: lib.readable_paths(lib.file.where("id % 19 <> 0").select("root_id", "rel_path")),
    # Annotations, text documents, reports
    "winner_annotation": lambda lib: lib.winner().select("photo_id", "caption", "scene"),
    "fts_document": lambda lib: lib.fts_document(),
    "exact_duplicates": lambda lib: lib.exact_duplicates(),
    "wasted_bytes": lambda lib: lib.wasted_bytes(),
    "tag_counts": lambda lib: lib.tag_counts(),
    "people_counts": lambda lib: lib.people_counts(),
    "people_counts_cli": lambda lib: lib.people_counts_all(),
    "naming_queue": lambda lib: lib.naming_queue(),
    "cluster_faces": lambda lib: lib.cluster_faces(5, 30),
    "ignored_groups": lambda lib: lib.ignored_groups(3),
    "root_stats": lambda lib: lib.root_stats(),
    "lib_stats": lambda lib: lib.stats(),
    "timeline_groups": lambda lib: lib.timeline(_reranked(lib), "day"),
    "timeline_searched": lambda lib: lib.timeline(_reranked(lib), "month", searched=True),
    "timeline_folders": lambda lib: lib.timeline(_reranked(lib), "folder"),
    "match_sources": lambda lib: lib.match_sources(search.rrf_fusion(lib)),
    "near_group_bytes": lambda lib: lib.group_bytes(greedy.near_duplicate_groups(cluster.near_hashes(lib.embeddings.select(F.col("vec_id").alias("id"), F.expr("aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)").alias("h")), 18))),
    "captioner_bench": lambda lib: reports.bench(lib.events.select(F.col("value").alias("s"), (F.col("user_id") % 400).alias("t")), "s", "t").select(*(F.round(c, 6).alias(c) for c in ("median", "mean", "tokens_per_second", "median_tokens", "days"))),
    "human_bytes": lambda lib: lib.file.select("id", paths.human_bytes(F.col("size") * F.pow(F.lit(40), F.col("id") % 6).cast("long") * (F.col("id") % 8)).alias("size")),
    "parent_folders": lambda lib: lib.file.select("id", paths.parent_folder(F.when(F.col("id") % 5 == 0, F.col("filename")).otherwise(F.col("rel_path"))).alias("folder")),
    "thumb_paths": lambda lib: lib.photo.select("id", paths.thumb_path(F.col("blake3"), "grid").alias("path")),
    # Ingest, jobs and changes
    "filename_dates": lambda lib: _made(lib, "concat('IMG_20', lpad(cast(id % 30 as string), 2, '0'), lpad(cast(id % 14 as string), 2, '0'), lpad(cast(id % 33 as string), 2, '0'), '_101010.jpg')", "name").select("id", "name", F.date_format(imaging.name_date(F.col("name"), F.lit(2030)), "yyyy-MM-dd").alias("day")),
    "gps_degrees": lambda lib: lib.file.select("id", imaging.degrees(1 + F.col("id") % 90, (F.col("id") % 60).cast("double"), (F.col("id") % 37).cast("double"), F.when(F.col("id") % 2 == 0, "S").otherwise("N")).alias("degrees")),
    "picture_meta": picture_fixture.read_back,
    "walk_pictures": lambda lib: paths.pictures(_listing(lib), "/mnt/p", ["*/skip/*"]).select("id", "rel_path"),
    "scan_cdc": lambda lib: lib.scan(lib.file.where("root_id = 4 and id % 7 <> 0").select("rel_path", (F.col("mtime") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("mtime"), "size").unionByName(lib.file.where("root_id = 5").select(F.concat(F.lit("new/"), "rel_path").alias("rel_path"), "mtime", "size")), 4),
    "scan_forced": lambda lib: lib.scan(lib.file.where("root_id = 4").select("rel_path", "mtime", "size"), 4, force=True),
    "stream_scans": scans.three_scans,
    "mark_missing": lambda lib: lib.with_tables(file=lib.file.withColumn("seen_at", F.lit(1000) + F.col("id") % 10)).mark_missing(4, 1004).select("id", "state"),
    "root_offline": lambda lib: lib.set_offline(3).select("id", "state"),
    "root_online": lambda lib: lib.set_offline(3, False).select("id", "state"),
    "ingest_files": lambda lib: lib.ingest(_arrivals(lib))[0].select("root_id", "rel_path", "blake3", "state"),
    "ingest_photos": lambda lib: lib.ingest(_arrivals(lib))[1].select("blake3", "bytes"),
    "mounted_on": lambda lib: paths.mounted_on(lib.file.selectExpr("id", "concat(case id % 4 when 0 then '/mnt/a/' when 1 then '/mnt/a/b/' when 2 then '/mnt/ab/' else '/mnt/c/' end, rel_path) as path"), _mounts(lib)).select("id", "volume", "label", "rel_path"),
    "current_mountpoints": lambda lib: paths.current_mountpoints(lib.spark.createDataFrame([("s-1",), ("mark-m-2",), ("path-/mnt/c",), ("u-gone",)], "uuid string"), _mounts(lib)),
    "library_state": lambda lib: paths.library_state(lib.file.selectExpr("concat('/p/', split(rel_path, '/')[0]) as path").distinct().unionByName(lib.file.selectExpr("concat('/p/', regexp_extract(rel_path, '^(.*)/', 1)) as path").distinct()).unionByName(lib.spark.createDataFrame([("/p",), ("/q",)], "path string")), lib.spark.createDataFrame([("/p/en",), ("/p/fr/src1",)], "path string")),
    "browse_folder": lambda lib: paths.browse_folder(lib.file.selectExpr("concat('/p/', rel_path) as path"), "/p/en", lib.spark.createDataFrame([("/p/en/src1",), ("/p/fr",)], "path string")),
    "mounted_deep": lambda lib: paths.mounted_on(lib.file.join(lib.root.select(F.col("id").alias("root_id"), F.col("rel_path").alias("top")), "root_id").select("id", F.concat(F.lit("/mnt/"), "top", F.lit("/"), "rel_path").alias("path")), _nations(lib)).select("id", "volume", "label", "rel_path"),
    "mountpoints_now": lambda lib: paths.current_mountpoints(lib.root.select(F.concat(F.when(F.col("id") % 5 == 0, "gone-").otherwise("s-"), F.col("id").cast("string")).alias("uuid")), _nations(lib)),
    "library_state_deep": lambda lib: paths.library_state(lib.file.selectExpr("id", "concat('/p/', regexp_extract(rel_path, '^(.*)/', 1)) as path"), lib.file.where("id % 40 = 7").selectExpr("concat('/p/', if(id % 80 = 7, split(rel_path, '/')[0], rel_path)) as path")),
    "like_accents": lambda lib: lib.with_tables(file=lib.file.withColumn("filename", F.concat(F.when(F.col("id") % 3 == 0, "École_").when(F.col("id") % 3 == 1, "école_").otherwise("ECOLE_"), "filename"))).like_names("École_img"),
    "photo_detail_some": lambda lib: lib.photo_detail(lib.photo.where("id % 50 = 3").select("id")),
    "upsert_partitioned": _upserted_partitions,
    "upsert_repeated": lambda lib: changes.upsert(lib.root.select("volume_id", "rel_path", "label"), lib.root.where("id % 2 = 0").select("volume_id", "rel_path", F.explode(F.array(F.lit("b"), "label", F.lit("a"))).alias("label")), ["volume_id", "rel_path"]),
    "prune_orphans": lambda lib: _ids(lib.orphans()),
    "prune_tags": lambda lib: lib.prune()["photo_tag"],
    "remove_root": lambda lib: _ids(lib.remove_root(4)),
    "removal_counts": lambda lib: lib.removal_counts(4),
    "job_stats": lambda lib: lib.job_stats(),
    "job_grid": lambda lib: lib.job_grid(),
    "job_claim": lambda lib: lib.claim("embed", 16).select("id", "stage", "state", "attempts"),
    "job_finish": lambda lib: lib.finish(lib.job.where("state = 'running'").select("id", F.when(F.col("id") % 2 == 0, "done").otherwise("failed").alias("state"), F.when(F.col("id") % 2 == 1, F.repeat(F.lit("no "), 300)).alias("error"))).select("id", "state", F.length("error").alias("letters")),
    "job_requeue": lambda lib: lib.requeue_stale().select("id", "state"),
    "job_unclaim": lambda lib: lib.unclaim(lib.job.where("state = 'running'").select("id")).select("id", "state", "attempts"),
    "job_retry_failed": lambda lib: lib.retry_failed("faces").select("id", "state", "attempts"),
    "job_enqueue_all": lambda lib: lib.enqueue(lib.photo.select("id")).select("photo_id", "stage", "state", "attempts"),
    "job_reset_stage": lambda lib: lib.reset_stage("faces")["job"].select("photo_id", "stage", "state", "attempts"),
    "reset_discards": lambda lib: lib.reset_stage("faces", rebuild=True)["face"].select("id"),
    "stage_run": _stage_run,
    "set_tags_replace": lambda lib: lib.set_tags(lib.photo.where("id % 10 = 0").select(F.col("id").alias("photo_id"), F.array(F.lit(" Replaced "), F.lit("replaced"), F.lit(" ")).alias("names")), "ai").select("photo_id", "name", "source"),
    "upsert_files": lambda lib: changes.upsert(lib.file.select("root_id", "rel_path", "size", "state"), lib.file.where("id % 3 = 0").select("root_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("x/"), "rel_path")).otherwise(F.col("rel_path")).alias("rel_path"), (F.col("size") + 1).alias("size"), F.lit("present").alias("state")), ["root_id", "rel_path"]),
    "upsert_roots": _upserted_roots,
    "favorite_toggle": lambda lib: lib.set_favorite(lib.photo.where("id % 3 = 0").select("id")).select("id", "favorite"),
    "manual_edit": lambda lib: lib.edit_annotation(lib.photo.where("id % 4 = 0").select(F.col("id").alias("photo_id"), F.when(F.col("id") % 8 == 0, "by hand").alias("caption"), F.lit(None).cast("string").alias("scene"), F.lit("").alias("ocr_text")), 1800000000).where("model = 'manual'").select("photo_id", "caption", "scene", "ocr_text", "created_at"),
    "manual_revert": lambda lib: lib.with_tables(annotation=lib.revert_annotation(lib.photo.select(F.col("id").alias("photo_id")))).winner().select("photo_id", "caption"),
    "keyword_import": lambda lib: lib.import_keywords(lib.photo.where("id % 5 = 0").select(F.col("id").alias("photo_id"), F.array(F.lit("Holiday; Kerala |beach"), F.lit(" ,FR,")).alias("tags"))).where("source = 'manual'").groupBy("photo_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("tags")),
    "sidecar_paths": lambda lib: lib.with_tables(volume=lib.volume.withColumn("label", F.concat("label", F.lit(" #1/"), F.col("id").cast("string")))).sidecar_targets(),
    "sidecar_paths_beside": lambda lib: lib.sidecar_targets("beside"),
    "sidecar_export_ids": lambda lib: lib.export_ids(limit=300),
    "sidecar_export_counts": lambda lib: lib.export_counts(lib.readable_paths(lib.file.select("root_id", "rel_path")), lib.photo.where("id % 6 = 0"), lib.photo.where("id % 5 <> 0"), 7),
    "sidecar_collect": lambda lib: sidecar.collected(lib).select("id", "caption", F.array_join("tags", ",").alias("tags"), F.array_join("regions.name", ",").alias("people"), "rating"),
    "region_normalise": lambda lib: lib.face.where("src_w is not null and rejected = 0").select("id", *(F.round(c, 9).alias(n) for c, n in zip(sidecar.centred(), "xywh"))),
    # Near duplicates, boxes, faces
    "format_pairs": lambda lib: paths.format_groups(lib.file.select((F.col("id") - F.col("id") % 2).alias("shot"), F.when(F.col("id") % 9 == 0, ".nef").otherwise(F.col("filename")).alias("filename")), "shot"),
    "iou_pairs": lambda lib: _iou_pairs(lib),
    "face_crops": lambda lib: lib.crops(300, 900),
    "decided_boxes": lambda lib: lib.decided_boxes().select("id", *(F.round(c, 6).alias(c) for c in "xywh")),
    "decided_face_merge": lambda lib: lib.redetected(_detected(lib)).select("photo_id", "bbox_x", "bbox_y", "bbox_w", "confirmed", "rejected"),
    "duplicate_faces": lambda lib: greedy.duplicate_faces(lib.face),
    "person_centroids": lambda lib: lib.person_centroids().select("person_id", F.posexplode("centroid").alias("pos", "x")).select("person_id", "pos", F.round("x", 6).alias("x")),
    "assign_known": lambda lib: lib.assign_known(0.2),
    "suggest_people": lambda lib: lib.suggest_people(least=0.0).select("cluster_id", "person_id", "name", "score", "r"),
    "max_cluster": lambda lib: lib.next_cluster(),
    "recluster": lambda lib: lib.recluster(0.35, 3, 0.2).select("id", "person_id", "cluster_id", "confirmed"),
    "recluster_too_few": lambda lib: lib.recluster(0.35, 1 << 30).select("id", "cluster_id"),
    "person_for_name": lambda lib: lib.person_for_name("asia")[0].unionByName(lib.person_for_name("New One")[0]).distinct(),
    "name_cluster": lambda lib: _faces(lib.name_cluster(5, "Someone New")[0]),
    "name_cluster_cover": lambda lib: lib.name_cluster(5, "Someone New")[1],
    "name_face": lambda lib: _faces(lib.name_face(30, "asia")[0]),
    "merge_clusters": lambda lib: _faces(lib.merge_clusters([7, 6, 8])),
    "merge_and_name": lambda lib: _faces(lib.merge_clusters([7, 6], "europe")[0]),
    "ignore_cluster": lambda lib: _faces(lib.ignore_cluster(8)),
    "ignore_face": lambda lib: _faces(lib.ignore_face(5)),
    "restore_ignored": lambda lib: _faces(lib.restore_ignored(4)),
    "detach_face": lambda lib: _faces(lib.detach_face(1)),
    "assign_face": lambda lib: _faces(lib.assign_face(5, 2)),
    "merge_people": lambda lib: _faces(lib.merge_people(3, 1)[0]),
    "rename_person": lambda lib: lib.rename_person(2, "Ann"),
    "delete_person": lambda lib: _faces(lib.delete_person(4)[0]),
    # Full text, vectors, search
    "vector_topk_cutoff": lambda lib: search.vector_top(lib.embeddings, lib.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")), 200, 0.07, 0.2).select(F.col("id").alias("vec_id"), "score"),
    "vector_index": _vector_index,
    "fts_prefix_and": lambda lib: _prefix_and(lib),
    "fts_bm25": lambda lib: search.bm25(lib.documents, search.WORDS),
    "vector_topk_codes": lambda lib: vector_index.top(lib.spark, _vector_codes(lib), _query(lib), 200, 0.07, 0.2).select(F.col("id").alias("vec_id"), "score"),
    "search_indexed": _indexed_search,
    "fts_weighted_stemmed": lambda lib: _rounded(text_index.search(_text_index(lib), "by wh")),
    "fts_incremental": lambda lib: _rounded(text_index.search(_updated_index(lib), "by wh")),
    "fts_top": lambda lib: text_index.top(_text_index(lib), "by wh", 50),
    "fts_phrase": lambda lib: _rounded(text_index.search(_text_index(lib), "img_2 en")),
    "hybrid_search": search.hybrid_search,
    "rrf_fusion": search.rrf_fusion,
    "search_filter_only": lambda lib: lib.search(request.Request(only={"tag": ["fr"]}), 25).select("id", "score", "sources", "rank"),
    "search_fallback": lambda lib: lib.search(request.Request(text="zzqqzz", only={"place": ["nation_1"]}), 25).select("id", "score", "sources", "rank"),
    "search_no_match": lambda lib: lib.search(request.Request(text="zzqqzz"), 25, vectors=lib.embeddings.select(F.col("vec_id").alias("id"), F.lit(0.0).alias("score")).where("id < 0")).agg(F.count("*").alias("n")),
    "search_paging": lambda lib: lib.page(search.hybrid_search(lib), 10, 5).select("id", "rank", "score", "sources", "filename", "total", "capped"),
    "typed_search": lambda lib: _ids(lib.matching(request.understand("tag:fr photos from: 'nation_1' camera:a last year", request.NOW))),
    "sidecar_round_trip": sidecar.round_trip,
}


def _arrivals(lib) -> DataFrame:
    """Files that arrive: known contents at new places, known files changed, new contents, one of them twice."""
    some = lib.file.where("id % 4 = 0").select("root_id", "id", "rel_path", "filename", "mtime", F.lit(77).cast("long").alias("size"), "blake3")
    place = F.when(F.col("id") % 3 == 0, F.concat(F.lit("moved/"), "rel_path")).otherwise(F.col("rel_path"))
    content = F.when(F.col("id") % 8 == 0, F.md5((F.col("id") - F.col("id") % 16).cast("string"))).otherwise(F.col("blake3"))
    return some.select("root_id", place.alias("rel_path"), "filename", (F.col("mtime") + 1).alias("mtime"), "size", content.alias("blake3"))


def _iou_pairs(lib) -> DataFrame:
    rows = lib.face.select("id", "photo_id", *(F.col(f"bbox_{c}").cast("double").alias(c) for c in "xywh"))
    a, b = (rows.select("photo_id", *(F.col(c).alias(f"{t}_{c}") for c in ("id", *"xywh"))) for t in "ab")
    both = a.join(b, "photo_id").where("a_id < b_id").withColumn("iou", people.iou("a", "b"))
    return both.where("iou >= 0.5").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round("iou", 6).alias("iou"))


def _prefix_and(lib) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return lib.documents.select("doc_id", words.alias("ws")).where(F.array_contains("ws", "by") & F.exists("ws", lambda w: w.startswith("wh"))).select("doc_id")


#: Plans that read the driver's tables themselves.
PLANS = {
    "dbscan_labels": density.dbscan_labels,
    "hamming_pairs": cluster.hamming_pairs,
    "hamming_pairs_near": lambda spark, sf_dir: cluster.near_hashes(_close_hashes(spark, sf_dir), 6),
    "near_duplicate_groups": greedy.fixture_groups,
    "searches_understood": request.searches_understood,
    "searches_of_all_kinds": request.searches_of_all_kinds,
    "annotation_damage": lenient_json.annotation_damage,
    "annotation_salvage": lenient_json.annotation_salvage,
    "filename_dates_all": imaging.name_dates,
    "phash_pictures": imaging.phash_of_products,
    "caption_stage": providers.caption_stage,
    "face_stage": providers.face_stage,
    "image_stage": providers.image_stage,
    "stream_ingest_jobs": ingest.ingested_jobs,
}


def _close_hashes(spark, sf_dir: str) -> DataFrame:
    """Hashes of which some differ in few bits: those of ten rows, with bits turned by their ids."""
    h = cluster.sign_hashes(spark, sf_dir).withColumn("g", F.col("id") % 10)
    base = h.where("id < 10").select("g", F.col("h").alias("base"))
    turned = F.expr("shiftleft(1L, cast(id % 61 as int)) ^ shiftleft(1L, cast(id % 47 as int)) ^ shiftleft(id % 16, 13)")
    return h.join(base, "g").select("id", F.col("base").bitwiseXOR(turned).alias("h"))


QUERIES = {n: _library(make) for n, make in MAKES.items()} | PLANS
ORACLES = {n: sql for n, sql in oracles.SQL.items() if n in QUERIES}

