"""Functions and plans that SQL doesn't express, against brute force and known cases."""

import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary.functions import imaging, lenient_json, providers, stem
from lumenary.library import Library
from lumenary.operators import fulltext, greedy
from lumenary.plans import catalogue, request
from lumenary.sources import sidecar
from lumenary.streaming import ingest

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 7, 10, 12, 0, tzinfo=timezone.utc)


def _at(*when):
    return int(datetime(*when, tzinfo=timezone.utc).timestamp())


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "generalizations": "gener", "oscillators": "oscil", "adoption": "adopt", "controll": "control", "rate": "rate", "at": "at"}
    assert {w: stem.stem(w) for w in want} == want
    assert stem.words("Événement IMG_1234 running") == ["even", "img", "1234", "run"]
    assert stem.words(None) == []


@pytest.mark.parametrize(
    "typed, span",
    [
        ("today", (_at(2024, 7, 10), _at(2024, 7, 10, 12))),
        ("yesterday", (_at(2024, 7, 9), _at(2024, 7, 10))),
        ("last week", (_at(2024, 7, 3, 12), _at(2024, 7, 10, 12))),
        ("past 2 days", (_at(2024, 7, 8, 12), _at(2024, 7, 10, 12))),
        ("last summer", (_at(2023, 6, 1), _at(2023, 8, 31, 23, 59, 59))),
        ("winter 2023", (_at(2023, 12, 1), _at(2024, 2, 29, 23, 59, 59))),
        ("March 2022", (_at(2022, 3, 1), _at(2022, 3, 31, 23, 59, 59))),
        ("2021", (_at(2021, 1, 1), _at(2021, 12, 31, 23, 59, 59))),
        ("december", (_at(2023, 12, 1), _at(2023, 12, 31, 23, 59, 59))),
        ("july", (_at(2024, 7, 1), _at(2024, 7, 31, 23, 59, 59))),
        ("dogs", (None, None)),
    ],
)
def test_spans(typed, span):
    got = request.understand(typed, NOW)
    assert got.span == span
    assert got.text == ("dogs" if typed == "dogs" else "")


def test_fields():
    got = request.understand("""show me person:"Ann Lee" person:bob tag:Beach in:'New York' type:jpg favourites of dogs camera:x camera:y""", NOW)
    assert got == request.Request("dogs", {"person": ["Ann Lee", "bob"], "tag": ["beach"], "place": ["New York"], "camera": ["y"]}, (None, None), True)
    assert request.understand("", NOW).text == ""


def test_requests(spark):
    lib = Library.of_driver_tables(spark, SF)
    everything = request.Request(only={"person": ["o'x"], "tag": ["a'b\\"], "camera": ["c"], "place": ["p"], "folder": ["f"], "filename": ["n"]}, span=(1, 2), favorite=True, faces=False)
    assert lib.matching(everything).count() == 0
    assert lib.matching(request.Request()).count() > 0
    empty = request.understood(spark.createDataFrame([(None,)], "q string"), "q", NOW).first()["request"]
    assert empty["text"] == "" and empty["date_from"] is None


def test_lenient_json(spark):
    cases = {
        '{"caption": " a ", "tags": [" X ", ""], "people_count": 2}': ("a", ["x"], 2),
        '{"caption": "a", "ocr_text": "cut off he': ("a", [], 0),
        '{"caption": "a", "tags": ["x", "y"': ("a", ["x", "y"], 0),
        '{"caption": "a\\u20", "tags": []}': ("a20", [], 0),
        "no JSON at all {": None,
    }
    df = lenient_json.annotated(spark.createDataFrame([(k, k) for k in cases], "t string, a string"), "a")
    got = {r["t"]: r["a"] and (r["a"]["caption"], r["a"]["tags"], r["a"]["people_count"]) for r in df.collect()}
    assert got == cases
    assert lenient_json.annotated(spark.sql("select cast(null as string) as t"), "t").first()[0] is None


def test_perceptual_hash(spark):
    rng = np.random.default_rng(1)
    pictures = [rng.random((32, 32)) * 255 for _ in range(3)]

    def plain(p):
        k = np.arange(32)
        low = [sum(p[r, c] * np.cos(np.pi * (2 * r + 1) * u / 64) * np.cos(np.pi * (2 * c + 1) * v / 64) for r in k for c in k) * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) for u in range(8) for v in range(8)]
        h = int("".join("1" if x > np.median(low[1:]) else "0" for x in low), 2)
        return h - (1 << 64) if h >> 63 else h

    rows = [(i, p.ravel().tolist()) for i, p in enumerate(pictures)] + [(3, None), (4, [1.0])]
    got = dict(imaging.perceptual_hashes(spark.createDataFrame(rows, "id long, grey array<double>")).collect())
    assert got == {i: plain(p) for i, p in enumerate(pictures)} | {3: None, 4: None}


def test_name_dates(spark):
    cases = {"IMG20260401195853.jpg": "2026-04-01 19:58:53", "IMG_20240412_134132.jpg": "2024-04-12 13:41:32", "Screenshot 2024-08-21 132906.png": "2024-08-21 13:29:06", "2024-08-08 20.43.42.jpg": "2024-08-08 20:43:42", "IMG-20240105-WA0001.jpg": "2024-01-05 00:00:00", "IMG_20240230_101010.jpg": None, "holiday.jpg": None, "20991231.jpg": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", imaging.name_date(F.col("n"), F.lit(2027)).cast("string").alias("d"))
    assert dict(df.collect()) == cases


def test_photo_meta(spark):
    rows = [
        (1, "a.jpg", 50, {"Make": " Acme ", "Model": " ", "DateTimeOriginal": "2020:01:02 03:04:05", "Orientation": "6", "ISOSpeedRatings": "200", "FNumber": "2.8", "LatitudeDeg": "10", "LatitudeMin": "30", "LatitudeSec": "0", "LatitudeRef": "S", "LongitudeDeg": "20", "LongitudeMin": "0", "LongitudeSec": "36", "LongitudeRef": "E"}, 40, 30),
        (2, "IMG_20210101.jpg", 50, {"DateTimeOriginal": "junk", "ISOSpeedRatings": "1.5", **{f"{c}{k}": "0" for c in ("Latitude", "Longitude") for k in ("Deg", "Min", "Sec")}}, 40, 30),
        (3, "x", 50, None, None, None),
    ]
    df = imaging.photo_meta(spark.createDataFrame(rows, "id long, name string, mtime long, tags map<string, string>, width int, height int"))
    got = {r["id"]: r for r in df.collect()}
    assert (got[1]["camera_make"], got[1]["camera_model"], got[1]["taken_at"], got[1]["taken_at_source"], got[1]["width"], got[1]["iso"], got[1]["gps_lat"], got[1]["gps_lon"]) == ("Acme", None, _at(2020, 1, 2, 3, 4, 5), "exif", 30, 200, -10.5, 20.01)
    assert (got[2]["taken_at"], got[2]["taken_at_source"], got[2]["iso"], got[2]["gps_lat"]) == (_at(2021, 1, 1), "filename", None, None)
    assert (got[3]["taken_at"], got[3]["taken_at_source"]) == (50, "mtime")


def test_greedy_groups(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    near = {i: {i} for i in range(60)}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    seen, want = set(), set()
    for i in range(60):
        if i not in seen and len(near[i]) > 1:
            seen |= near[i]
            want |= {(i, j) for j in near[i]}
    got = greedy.near_duplicate_groups(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_duplicate_faces(spark):
    faces = Library.of_driver_tables(spark, SF).face.collect()

    def box(f):
        return tuple(f[f"bbox_{c}"] / (f[f"src_{s}"] if f["src_w"] else 1) for c, s in zip("xywh", "whwh"))

    def overlap(a, b):
        shared = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return shared / (a[2] * a[3] + b[2] * b[3] - shared)

    def ruled(f):
        return bool(f["confirmed"] or f["rejected"])

    want, kept = set(), {}
    for f in sorted(faces, key=lambda f: (not ruled(f), f["id"])):
        same = [k for k in kept.setdefault(f["photo_id"], []) if overlap(box(f), box(k)) >= 0.5]
        differs = same and ruled(f) and (same[0]["rejected"] != f["rejected"] or None not in (same[0]["person_id"], f["person_id"]) and same[0]["person_id"] != f["person_id"])
        if same and not differs:
            want.add(f["id"])
        else:
            kept[f["photo_id"]].append(f)
    got = [r["id"] for r in catalogue.QUERIES["duplicate_faces"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and want


def test_weighted_search(spark):
    docs = spark.createDataFrame([(1, "running dogs", "x"), (2, "a dog", "run"), (3, None, "img 1234 dog"), (4, "", "")], "id long, caption string, tags string")
    weights = {"caption": 8.0, "tags": 6.0}
    ids = lambda q: {r["id"]: r["score"] for r in fulltext.search(docs, q, weights).collect()}
    assert set(ids("dog run")) == {1, 2}
    assert set(ids("img_1234")) == {3} and set(ids("img_12")) == {3} and not ids("1234_img")
    assert ids("do")[1] > 0 and ids("") == {} and ids("__") == {}
    n, d, mean = 4, 2, 9 / 4
    idf = max(1e-6, np.log((n - d + 0.5) / (d + 0.5)))
    assert ids("runs")[2] == pytest.approx(idf * 6 * 2.2 / (6 + 1.2 * (0.25 + 0.75 * 3 / mean)))


def test_sidecars(spark):
    text = sidecar.packet("a <b> & é", ["x", "y"], 5, [{"name": "Ann", "x": 0.2, "y": 0.3, "w": 0.1, "h": 0.1}])
    assert sidecar.contents(text) == ("a <b> & é", ["x", "y"], 5, ["Ann"])
    assert "0.200000" in text and text.startswith("<?xpacket") and sidecar.contents(text.encode()) == sidecar.contents(text)
    assert sidecar.packet(None, [], 3, None) is None
    assert sidecar.contents("<broken") == sidecar.contents(None) == (None, [], None, [])
    rows = [
        ("a <b> & é\n\"q\"", ["x", "y & z", ""], 5, [("Ann <1>", 0.25, 1 / 3, 0.1, 2e-7), (None, 1.0, 0.5, 12.5, 0.0)]),
        ("one", None, None, None), (None, ["t"], 3, []), ("", [], 5, None), (None, None, None, [("B", 0.1234565, 0.0, 1.0, 1.0)]), (None, None, None, None),
    ]
    made = spark.createDataFrame(rows, "caption string, tags array<string>, rating int, regions array<struct<name: string, x: double, y: double, w: double, h: double>>")
    got = made.select("caption", sidecar.written(F.struct("*")).alias("p")).collect()
    want = [sidecar.packet(c, tags, r, faces and [dict(zip(("name", *"xywh"), f)) for f in faces]) for c, tags, r, faces in rows]
    assert want[3] is want[5] is None
    for r, one in zip(got, want):
        assert r["p"] == one
    shares = [k / 16000 for k in range(0, 16001, 7)] + [k / 2560 for k in range(2561)] + [0.1234565, 0.0000005, -0.25, 1e-9]
    got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", sidecar._six(F.col("x")).alias("t")).collect()
    assert all(r["t"] == format(r["x"], ".6f") for r in got) and len(got) == len(shares)
    df = spark.createDataFrame([(text,), (None,)], "t string").select(sidecar.read("t").alias("s"))
    assert [r["s"]["rating"] for r in df.collect()] == [5, None]


def test_providers(spark):
    with pytest.raises(KeyError, match="first_words"):
        providers.provider("caption", "nothing")
    with pytest.raises(ValueError):
        providers.register("sound", "x")(object)
    with pytest.raises(TypeError):
        providers.register("caption", "x")(object)
    rows = spark.createDataFrame([(1, "one two three four five six"), (2, "short"), (3, None), (4, "a b c d e")], "id long, text string")
    got = {r["id"]: (r["state"], r["value"] and r["value"]["caption"], r["error"]) for r in providers.run_stage(rows, "caption", "first_words", "id", "text").collect()}
    assert got == {1: ("done", "one two three four five", None), 2: ("failed", None, "too few words"), 3: ("pending", None, None), 4: ("done", "a b c d e", None)}
    vectors = providers.run_stage(rows.where("text is not null"), "text", "hashed", "id", "text").collect()
    assert all(abs(sum(x * x for x in r["value"]) - 1) < 1e-5 for r in vectors)


def test_stream_takes_only_what_is_new(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "blake3 string, bytes long"
    for rows in ([("a", 1), ("b", 2), ("a", 1)], [("b", 2), ("c", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = ingest.start(spark.readStream.schema(schema).parquet(source), target, state)
        query.awaitTermination()
        assert ingest.progress(query)["rows"] == len(rows)
    photos = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(target)
    assert sorted(r["blake3"] for r in photos.collect()) == ["a", "b", "c"]
    assert ingest.enqueue(photos).count() == 12


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0
