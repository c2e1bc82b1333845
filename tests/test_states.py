"""Decisions, jobs, settings, snapshots, files and plug-ins: known cases and refusals."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary.functions import providers
from lumenary.library import Library
from lumenary.operators import cluster, graph, paths, nearest, people, reports
from lumenary.plans import request, runner
from lumenary.sources import settings, sidecar, snapshots

FACE = "id long, photo_id long, bbox_x long, bbox_y long, bbox_w long, bbox_h long, src_w int, src_h int, det_score double, person_id long, cluster_id long, confirmed int, rejected int, ignored_as long, model string"


def faces(spark, *rows):
    made = [(i, i, 100 * i, 0, 50, 50, 1000, 1000, 0.5 + i / 100, *x, "m") for i, x in enumerate(rows, 1)]
    return spark.createDataFrame(made, FACE)


@pytest.fixture(scope="module")
def small(spark):
    table = faces(spark, (None, 7, 0, 0, None), (None, 7, 0, 1, None), (None, 9, 0, 0, None), (1, None, 1, 0, None), (None, None, 0, 1, 7))
    vectors = spark.createDataFrame([(i, [1.0, 0.1 * i] if i < 3 else [0.0, 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    return Library(spark, {"face": table, "person": spark.createDataFrame([(1, "Ann")], "id long, name string"), "embeddings": vectors})


def state(table):
    return {r["id"]: (r["person_id"], r["cluster_id"], r["confirmed"], r["rejected"], r["ignored_as"]) for r in table.collect()}


def test_decisions(small):
    table, known = small.name_cluster(7, "ANN")
    assert state(table)[1] == state(table)[2][:3] + (0, None) == (1, None, 1, 0, None) and state(table)[2][3] == 1 and known.count() == 1
    table, known = small.name_face(5, "Bob")
    assert state(table)[5] == (2, None, 1, 0, None) and {(r["id"], r["name"], r["cover_face_id"]) for r in known.collect()} == {(1, "Ann", None), (2, "Bob", 5)}
    assert state(small.ignore_cluster(9))[3] == (None, None, 0, 1, 9)
    assert state(small.restore_ignored(7))[5] == (None, 7, 0, 0, None) and state(small.restore_ignored(7))[2][3] == 1
    assert state(small.ignore_face(4))[4] == (None, None, 0, 1, None)
    assert {state(small.merge_clusters([9, 7]))[i][1] for i in (1, 2, 3)} == {7}
    for wrong in (lambda: small.merge_clusters([7, 7]), lambda: small.merge_people(1, 1), lambda: small.with_tables(person=small.person.union(small.spark.createDataFrame([(2, "Bob")], small.person.schema))).rename_person(2, "aNN")):
        with pytest.raises(ValueError):
            wrong()
    for gone in (lambda: small.ignore_cluster(99), lambda: small.name_face(99, "x")):
        with pytest.raises(KeyError):
            gone()
    assert small.rename_person(1, "ann").first()["name"] == "ann"
    table, known = small.delete_person(1)
    assert state(table)[4] == (None, None, 0, 0, None) and known.isEmpty()


def test_nearest_person_in_blocks_and_close_scores(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 4))
    v[1] = v[0] * 2 + 1e-9
    rows = spark.createDataFrame([(i, [float(y) for y in x / np.linalg.norm(x)]) for i, x in enumerate(rng.normal(size=(20, 4)))], "face_id long, v array<double>")
    known = spark.createDataFrame([(i, [float(y) for y in x / np.linalg.norm(x)]) for i, x in enumerate(v)], "person_id long, centroid array<double>")
    want = {r["face_id"]: max(range(40), key=lambda i: (round(float(np.dot(r["v"], v[i] / np.linalg.norm(v[i]))), 6), -i)) for r in rows.collect()}
    for most in (5000, 7):
        monkeypatch.setattr(nearest, "BLOCK", most)
        assert {r["face_id"]: r["person_id"] for r in people._nearest_people(rows, known, "face_id", 1).collect()} == want


def test_jobs_end_when_nothing_is_new(spark):
    jobs = spark.createDataFrame([(i, i, "caption", "pending", 100 - i % 3, 0) for i in range(1, 13)], "id long, photo_id long, stage string, state string, priority long, attempts long")
    texts = spark.createDataFrame([(i, None if i % 4 == 0 else "few words" if i % 5 == 0 else "one two three four five") for i in range(1, 13)], "photo_id long, payload string")
    lib = Library(spark, {"job": jobs})
    out, counts = runner.batches(lib, "caption", 5, 1000, runner.provider_work(lib, texts, "caption", "first_words"))
    got = {r["id"]: (r["state"], r["attempts"]) for r in out.job.collect()}
    assert got == {i: ("pending" if i % 4 == 0 else "failed" if i % 5 == 0 else "done", 1) for i in range(1, 13)}
    assert counts["skipped"] == 3 and counts["failed"] == 2 and counts["done"] == 7
    again = out.with_tables(job=out.retry_failed("caption"))
    assert {(r["state"], r["attempts"]) for r in again.job.where("id in (5, 10)").collect()} == {("pending", 0)}
    with pytest.raises(ValueError):
        lib.retry_failed("nothing")
    with pytest.raises(ValueError):
        lib.reset_stage("nothing")


def test_jobs_behind_offline_ones_are_run(spark):
    jobs = spark.createDataFrame([(i, i, "caption", "pending", 1, 0) for i in range(1, 21)], "id long, photo_id long, stage string, state string, priority long, attempts long")
    texts = spark.createDataFrame([(i, None if i <= 7 else "one two three four five") for i in range(1, 21)], "photo_id long, payload string")
    for limit, ended in ((1000, 13), (4, 4)):
        out, counts = runner.batches(Library(spark, {"job": jobs}), "caption", 5, limit, runner.provider_work(None, texts, "caption", "first_words"))
        got = {r["id"]: (r["state"], r["attempts"]) for r in out.job.collect()}
        assert got == {i: ("pending", 1) if i <= 7 else ("done", 1) if i <= 7 + ended else ("pending", 0) for i in range(1, 21)}
        assert counts == {"done": ended, "failed": 0, "skipped": 7}


def test_runner(spark):
    done = []
    work = {s: (lambda lib, s=s: (done.append(s) or lib, {"n": 1})) for s in runner.ORDER}
    run = runner.Runner(work)
    assert run.plan(["caption", "faces"]) == ["faces", "caption", "cluster"]
    lib = Library(spark, {"job": spark.createDataFrame([(1, 1, "embed", "running", 1, 2), (2, 2, "embed", "running", 1, 9)], "id long, photo_id long, stage string, state string, priority long, attempts long")})
    out = run.run(lib, ["embed", "thumbs"])
    assert done == ["thumbs", "embed"] and {r["id"]: r["state"] for r in out.job.collect()} == {1: "pending", 2: "running"}
    assert not run.cancel() and run.state["results"] == {"thumbs": {"n": 1}, "embed": {"n": 1}}

    def stop(lib):
        run.cancel()
        with pytest.raises(runner.Busy):
            run.run(lib)
        return lib, {}

    run.work["thumbs"] = stop
    done.clear()
    run.run(lib)
    assert run.state["cancelled"] and not done and not run.state["running"]
    for wrong in ([], ["sing"]):
        with pytest.raises(ValueError):
            run.plan(wrong)


def test_settings(tmp_path):
    path = str(tmp_path / "settings.toml")
    assert settings.load(path) == settings.Settings()
    with open(path, "w") as f:
        f.write('[server]\nscan_workers = 3\n[embed]\nmin_score = 1\n[later]\nx = [1, 2]\n')
    assert settings.load(path).scan_workers == 3 and settings.load(path).embed.min_score == 1.0
    changed = settings.save(path, {"faces": {"min_cluster_size": 5}, "sidecar": {"location": "beside"}})
    assert changed.faces.min_cluster_size == 5 and settings.load(path) == changed and settings._table(path)["later"] == {"x": [1, 2]}
    before = open(path).read()
    for wrong in ({"sidecar": {"location": "moon"}}, {"auto_process": ["sing"]}, {"embed": {"dim": "many"}}):
        with pytest.raises(ValueError):
            settings.save(path, wrong)
    assert open(path).read() == before


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = spark.createDataFrame([(3, [0.5, 1.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], "photo_id long, embedding array<double>, model string")
    assert snapshots.load_vectors(spark, folder, "a", 2) is None
    assert snapshots.build_vectors(rows, folder, "a", 2) == 2 and snapshots.load_vectors(spark, folder, "a", 3) is None
    old = snapshots.load_vectors(spark, folder, "a", 2)
    assert sorted(r["photo_id"] for r in old.collect()) == [1, 3]
    assert snapshots.build_vectors(rows, folder, "b", 2) == 1 and snapshots.load_vectors(spark, folder, "a", 2) is None
    assert [r["photo_id"] for r in snapshots.load_vectors(spark, folder, "b", 2).collect()] == [2]
    assert len([n for n in os.listdir(folder) if n.startswith("state-")]) == 1
    assert snapshots.build_vectors(rows, folder, "c", 2) == 0 and snapshots.load_vectors(spark, folder, "b", 2) is None
    with open(f"{folder}/_CURRENT", "w") as f:
        f.write("{broken")
    for crc in tmp_path.rglob(".*crc"):
        crc.unlink()
    assert snapshots.about(spark, folder) is None


def test_readers_of_the_state_before_can_end(spark, tmp_path):
    folder = str(tmp_path / "states")
    states = [spark.range(n) for n in (1, 2, 3)]
    snapshots.publish(states[0], folder, keep=True)
    first = snapshots.current(spark, folder)
    assert snapshots.publish(states[1], folder, keep=True) == 2 and first.count() == 1
    second = snapshots.current(spark, folder)
    assert snapshots.publish(states[2], folder, keep=True) == 3 and second.count() == 2
    assert len([n for n in os.listdir(folder) if n.startswith("state-")]) == 2
    assert [n for n in os.listdir(folder) if n.startswith("_CURRENT")] == ["_CURRENT"]
    assert snapshots.publish(states[0], folder) == 1 and len([n for n in os.listdir(folder) if n.startswith("state-")]) == 1


def test_files(spark, tmp_path):
    names = ["a.JPG", "b.txt", "x/c.nef", ".h/d.jpg", "x/node_modules/y/e.png", "skip/f.jpg", "Thumbs.db"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    found = paths.walk(spark, str(tmp_path), ["*/skip"])
    got = {r["rel_path"]: r["hash"] for r in found.select("rel_path", paths.content_hash(F.col("content")).alias("hash")).collect()}
    from hashlib import sha256

    assert got == {n: sha256(n.encode()).hexdigest() for n in ("a.JPG", "x/c.nef")}
    listing = spark.createDataFrame([(f"/photos/{n}",) for n in names] + [(None,)], "path string")
    assert sorted(r[0] for r in paths.pictures(listing, "/photos", ["*/photos"]).select("rel_path").collect()) == ["a.JPG", "skip/f.jpg", "x/c.nef"]
    assert [r[0] for r in paths.pictures(listing, "/photos", recursive=False).select("rel_path").collect()] == ["a.JPG"]


def test_sidecars_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/s/{n}.xmp", t) for n, t in (("a", "one"), ("b", None), ("c", "three"))], "path string, packet string")
    assert {os.path.basename(r["path"]): r["state"] for r in sidecar.save(rows).collect()} == {"a.xmp": "written", "b.xmp": "empty", "c.xmp": "written"}
    assert {r["state"] for r in sidecar.save(rows, overwrite=False).collect()} == {"skipped", "empty"}
    assert sorted(os.listdir(tmp_path / "s")) == ["a.xmp", "c.xmp"] and (tmp_path / "s" / "c.xmp").read_text() == "three"


def test_sidecar_paths_keep_blanks(spark):
    df = spark.createDataFrame([("My Disk-1_é/\\:", "a/b.jpg"), ("  ", "c.jpg"), (None, "d.jpg")], "drive string, path string")
    got = [r[0] for r in df.select(paths.in_app_folder("/app/", F.col("drive"), F.col("path"))).collect()]
    assert got == ["/app/My Disk-1_é___/a/b.jpg.xmp", "/app/drive/c.jpg.xmp", "/app/unknown/d.jpg.xmp"]


def test_formats(spark):
    groups = {1: (["DSC_1.NEF", "dsc_1.JPG"], True), 2: (["a.jpg", "a.jpg"], False), 3: (["a.jpg", "a.png"], False), 4: (["a.heic", "a.jpg", "a.png"], True), 5: (["a.nef"], False), 6: ([".nef", ".jpg"], False), 7: (["a.cr2", "b.jpg"], False), 8: (["noext", "noext.nef"], False)}
    df = spark.createDataFrame([(g, n) for g, (names, _) in groups.items() for n in names], "g long, filename string")
    assert {r["g"] for r in paths.format_groups(df, "g").collect()} == {g for g, (_, want) in groups.items() if want}
    sizes = {0: "-", 1: "1 B", 1023: "1023 B", 1024: "1.0 KB", 16640: "16.2 KB", 1572864: "1.5 MB", 5 * 1024**4: "5120.0 GB"}
    got = spark.createDataFrame([(n,) for n in sizes] + [(None,)], "n long").select("n", paths.human_bytes(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == sizes | {None: "-"}


def test_near_hashes_and_components(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(25)]
    h = [(i, (x := base[i % 25]) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9)))) for i in range(200)]
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in h], "id long, h long")
    for most in (0, 3, 6, 11, 18):
        want = {(i, j, d) for i, x in h for j, y in h if i < j and (d := (x ^ y).bit_count()) <= most}
        assert {tuple(r) for r in cluster.near_hashes(df, most).collect()} == want
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    low = {}

    def root(i):
        while low.setdefault(i, i) != i:
            i = low[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            low[y] = x
    for most in (1_000_000, 7):
        got = {tuple(r) for r in graph.connected(spark.createDataFrame(edges, "x long, y long"), most).collect()}
        assert got == {(i, root(i)) for i in low}


def test_similar_pairs_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 20)
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(12, 6)), 25, axis=0) + rng.normal(size=(300, 6)) * 0.2
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = np.round(u @ u.T, 6) >= 0.97
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i != j}
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in cluster.similar_pairs(df, 0.97).collect()} == want
    assert cluster.similar_pairs(df.where("vec_id < 0"), 0.97).count() == 0


def test_search_chooses_its_engines(spark):
    lib = Library.of_driver_tables(spark, "/root/testdata/sf0.001")
    none = lib.embeddings.select(F.col("vec_id").alias("id"), F.lit(0.5).alias("score")).limit(0)
    words = request.Request(text="zzqqzz")
    assert {r["sources"] for r in lib.search(words, 5).collect()} == {"filter"}
    assert lib.search(words, 5, vectors=none).isEmpty()
    some = lib.embeddings.select((F.col("vec_id") * 3).alias("id"), (1 / (1 + F.col("vec_id"))).alias("score"))
    assert {r["sources"] for r in lib.search(words, 5, vectors=some).collect()} == {"vec"}
    hits = lib.search(request.Request(), 300)
    page = lib.page(hits, 7, 3, most=100).collect()
    assert [r["rank"] for r in sorted(page, key=lambda r: r["rank"])] == list(range(4, 11)) and page[0]["total"] == 100 and page[0]["capped"]


def test_plugin_files(tmp_path):
    good, bad = tmp_path / "good.py", tmp_path / "bad.py"
    good.write_text("from lumenary.functions import providers\n\n\n@providers.register('text', 'loose')\nclass Loose(providers.TextEmbedder):\n    def run(self, batch):\n        return [[1.0] for _ in batch]\n")
    bad.write_text("raise RuntimeError('no')\n")
    with pytest.warns(UserWarning, match="bad.py"):
        providers.load_file(str(bad))
    with pytest.warns(UserWarning, match="nowhere.py"):
        providers.load_file(str(tmp_path / "nowhere.py"))
    assert providers.text_provider(settings.Embed(provider="loose", plugins=[str(good)])).__name__ == "Loose"
    assert providers.text_provider(settings.Embed(provider="loose", text_provider="hashed")) is providers.HashedWords
    with pytest.raises(ValueError):
        providers.provider("sound", "x")


def test_bench_report(spark):
    got = reports.bench(spark.createDataFrame([(1.0, 10), (2.0, 30), (6.0, 50)], "s double, t long"), "s", "t").first()
    assert (got["median"], got["mean"], got["tokens_per_second"], got["median_tokens"]) == (2.0, 3.0, 10.0, 30.0) and math.isclose(got["days"], 2 * 500000 / 86400)


def test_numbers_in_order(spark):
    from lumenary.sources.shared import numbered

    rng = random.Random(6)
    rows = [(rng.randrange(400), i) for i in range(1000)]
    got = {(r["a"], r["b"]): r["place"] for r in numbered(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {r: k for k, r in enumerate(sorted(rows), 1)}
    assert numbered(spark.createDataFrame([], "a long"), "a").count() == 0


def test_timeline_of_equal_ranks_stands_by_key(spark):
    rows = [(i, 86400 * 31 * (i * 37 % 40 + 1), f"f{i * 37 % 40:02}/a.jpg", 7) for i in range(40)]
    photos = spark.createDataFrame(rows, "id long, taken_at long, rel_path string, rank long").repartition(4, "id")
    for by, searched in (("folder", False), ("month", True)):
        got = reports.timeline(None, photos, by, searched).orderBy("place").collect()
        assert [r.key for r in got] == sorted(r.key for r in got) and [r.place for r in got] == list(range(1, len(got) + 1))
