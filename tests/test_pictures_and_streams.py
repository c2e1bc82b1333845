"""Picture bytes, scans as a stream, stages of providers, and faults of the state changes that are mended."""

import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenary.functions import imaging, providers
from lumenary.library import Library
from lumenary.operators import changes, filters, paths
from lumenary.sources import picture_fixture as P
from lumenary.sources import pictures
from lumenary.streaming import scans


def grey(data):
    return np.array(pictures.read(data)["grey"]).reshape(32, 32)


def test_png_of_all_kinds():
    rng = random.Random(1)
    px = [[rng.randrange(256) for _ in range(32)] for _ in range(32)]
    want = np.array(px, float)
    assert (grey(P.png([bytes(r) for r in px], 32)) == want).all()
    assert (grey(P.png([b"".join(bytes([v, 9]) for v in r) for r in px], 32, 4)) == want).all()  # with opacity
    assert (grey(P.png([b"".join(bytes([v, 9]) for v in r) for r in px], 32, 0, 16)) == want).all()
    colour = [[(v, 255 - v, (3 * v) % 256) for v in r] for r in px]
    luma = np.array([[(19595 * r + 38470 * g + 7471 * b + 32768) >> 16 for r, g, b in row] for row in colour], float)
    assert (grey(P.png([b"".join(bytes(p) for p in r) for r in colour], 32, 2)) == luma).all()
    assert (grey(P.png([b"".join(bytes(p) + b"\7" for p in r) for r in colour], 32, 6)) == luma).all()
    assert (grey(P.bmp(colour)) == luma).all() and (grey(P.bmp(colour, True)) == luma).all()
    bits = [[v & 1 for v in r] for r in px]
    packed = [np.packbits(r).tobytes() for r in bits]
    assert (grey(P.png(packed, 32, 0, 1)) == 255 * np.array(bits)).all()
    assert (grey(P.png(packed, 32, 3, 1, palette=b"\n\n\n\xc8\xc8\xc8")) == np.where(bits, 200, 10)).all()
    large = P.png([bytes([(x * 5 + y) % 200 for x in range(100)]) for y in range(70)], 100)
    assert pictures.read(large)["width"] == 100 and pictures.read(large)["height"] == 70 and grey(large).std() > 0
    flat = P.png([bytes([77] * 90)] * 50, 90)
    assert set(grey(flat).ravel()) == {77.0}


def test_faults_have_classes():
    good = P.png([bytes(range(32))] * 32, 32)
    tags = P.tiff({271: "Make"}, {}, {})
    fault = lambda data: pictures.read(data)["fault"]
    assert fault(good) is fault(tags[:0] + P.jpeg(10, 20, tags)) is None and fault(tags) == "damaged"  # a TIFF without a size
    assert fault(None) == fault(b"") == "empty" and fault(b"GIF89a") == "unknown"
    assert fault(good[:-20]) == fault(good[:30]) == fault(P.jpeg(10, 20, tags)[:30]) == fault(b"\xff\xd8\xff") == fault(b"BM") == fault(b"II*\0") == "truncated"
    broken = bytearray(good)
    broken[45] ^= 1
    assert fault(bytes(broken)) == "damaged"
    laced = bytearray(good)
    laced[28] = 1
    laced[29:33] = struct.pack(">I", zlib.crc32(bytes(laced[12:29])))
    assert fault(bytes(laced)) == "unsupported"
    assert fault(b"\xff\xd8\xff\xe1\0\x20Exif\0\0XX" + bytes(60)) == "damaged"
    loop = bytearray(P.tiff({256: 4, 257: 5}, {}, {}))
    at = loop.index(struct.pack("<HHI", pictures.EXIF_AT, 4, 1))
    loop[at + 8 : at + 12] = struct.pack("<I", 8)  # a directory within itself
    assert fault(bytes(loop)) == "damaged"
    rng = random.Random(2)
    for k in range(400):  # whatever the bytes are, there is a row
        data = bytearray(rng.choice([good, tags, P.jpeg(10, 20, tags), P.bmp([[(1, 2, 3)] * 5] * 4)]))
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(2, len(data))] = rng.randrange(256)
        assert fault(bytes(data)) in (None, "unknown", "truncated", "damaged", "unsupported", "too-large")


def test_tags_in_either_byte_order():
    for order in "<>":
        got = pictures.read(P.jpeg(400, 300, P.tiff({271: "Ab", 272: " A camera ", 274: 6, 306: "2020:01:02 03:04:05"}, {33434: [(1, 250)], 34855: 400, 37386: [(50, 0)], 42036: "Lens"}, {1: "S", 2: [(10, 1), (30, 1), (9, 2)], 3: "E", 4: [(20, 1), (0, 1), (0, 1)]}, order)))
        assert got["fault"] is None and (got["width"], got["height"]) == (400, 300)
        assert got["tags"] == {"Make": "Ab", "Model": " A camera ", "Orientation": "6", "DateTime": "2020:01:02 03:04:05", "ExposureTime": "0.004", "ISOSpeedRatings": "400", "LensModel": "Lens", "LatitudeRef": "S", "LatitudeDeg": "10.0", "LatitudeMin": "30.0", "LatitudeSec": "4.5", "LongitudeRef": "E", "LongitudeDeg": "20.0", "LongitudeMin": "0.0", "LongitudeSec": "0.0"}


def test_pictures_on_disk(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.png").write_bytes(P.png([bytes((x * y) % 251 for x in range(32)) for y in range(32)], 32))
    (tmp_path / "a" / "two.jpg").write_bytes(P.jpeg(640, 480, P.tiff({271: "M", 274: 8}, {36867: "2021:05:06 07:08:09"}, {})))
    (tmp_path / "a" / "three.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    files = paths.walk(spark, str(tmp_path)).withColumn("id", F.length("rel_path").cast("long")).withColumn("name", F.col("rel_path"))
    got = pictures.decoded(files.where("rel_path <> 'a/one.png'").select("id", "content")).collect()
    assert {(r["kind"], r["fault"]) for r in got} == {("jpeg", None), ("png", "truncated")}
    one = pictures.decoded(files.where("rel_path = 'a/one.png'").select("id", "content"))
    assert imaging.perceptual_hashes(one).first()["phash"] == imaging.hashes([[(x * y) % 251 for y in range(32) for x in range(32)]])[0]
    two = pictures.decoded(files.where("rel_path = 'a/two.jpg'").select("id", "content")).join(files.select("id", "name", "mtime"), "id").where("kind = 'jpeg'")
    row = imaging.photo_meta(two).first()
    assert (row["camera_make"], row["width"], row["height"], row["taken_at"], row["taken_at_source"]) == ("M", 480, 640, 1620284889, "exif")


def test_scans_of_a_stream(spark):
    lib = Library.of_driver_tables(spark, "/root/testdata/sf0.001")
    lib = lib.with_tables(root=lib.root.where("id in (3, 6)"), file=lib.file.where("root_id in (3, 6)"))
    watch = scans.Progress()
    spark.streams.addListener(watch)
    try:
        got = {(r["root_id"], r["scan"], r["rel_path"]): r["status"] for r in scans.three_scans(lib).collect()}
    finally:
        spark.streams.removeListener(watch)
    known, want = {}, {}
    for scan in (1, 2, 3):
        for f in lib.file.collect():
            i, key = f["id"], (f["root_id"], f["rel_path"])
            there = not (i % 7 == 0 and scan == 2 or i % 13 == 0 and scan < 3 or i % 17 == 0 and scan == 3)
            now = (f["mtime"] + 60 * (scan >= 2 and i % 5 == 0), f["size"] + (scan == 3 and i % 11 == 0))
            if there:
                want[(key[0], scan, key[1])] = "new" if key not in known else "unchanged" if known[key] == now else "changed"
                known[key] = now
            elif key in known and not (key[0] == 6 and scan == 2):  # that scan was never ended
                want[(key[0], scan, key[1])] = "missing"
    assert got == want and len(set(got.values())) == 4
    (at,) = watch.rows
    assert watch.rows[at] > 0 and watch.batches[at] >= 2


class Counted(providers.TextEmbedder):
    made = 0
    sizes: list = []

    def __init__(self):
        Counted.made += 1

    def run(self, batch):
        Counted.sizes.append(len(batch))
        if "down" in batch:
            raise providers.SystemicError("no model")
        if "bad" in batch:
            raise ValueError("bad payload")
        return [[float(len(p))] for p in batch]


def test_batches_cross_arrow_batches():
    parts = [pd.DataFrame({"k": range(3), "p": ["a" * 10] * 3}), pd.DataFrame({"k": range(3, 8), "p": ["a" * 10, None, "a" * 90, "b", "c"]})]
    sizes = lambda rows, size: [[k for k, _ in b] for b in providers._batches(parts, "k", "p", rows, size)]
    assert sizes(100, 1000) == [list(range(8))] and sizes(3, 1000) == [[0, 1, 2], [3, 4, 5], [6, 7]]
    assert sizes(100, 25) == [[0, 1], [2, 3, 4], [5], [6, 7]]
    assert providers.kept(Counted) is providers.kept(Counted) and Counted.made == 1
    run = lambda *p: providers._results(providers.kept(Counted), list(enumerate(p)))
    assert run("a", None, "bb") == [("done", [1.0], None), ("pending", None, None), ("done", [2.0], None)]
    assert run("a", "bad") == [("done", [1.0], None), ("failed", None, "bad payload")]
    assert run("a", "down") == [("pending", None, "no model")] * 2 and run(None) == [("pending", None, None)]


def test_folding_and_upserts(spark):
    names = spark.createDataFrame([("École.jpg",), ("école.jpg",), ("ÉCOLE.JPG",)], "n string")
    assert [r[0] for r in names.where(filters.like("n", "É")).collect()] == ["École.jpg", "ÉCOLE.JPG"]
    assert [r[0] for r in names.where(filters.like("n", "cOLE")).collect()] == ["École.jpg", "école.jpg", "ÉCOLE.JPG"]
    old = spark.createDataFrame([(1, "a", 5)], "k int, v string, w int")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 0), (2, "d", 9), (2, "d", 9), (3, None, None)], "k int, v string, w int")
    assert sorted(map(tuple, changes.upsert(old, new, ["k"]).collect())) == [(1, "c", 0), (2, "d", 9), (3, None, None)]
    assert sorted(map(tuple, changes.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "c", 5), (2, "d", 9), (3, None, None)]
    got = spark.createDataFrame([('["a*","b"]',), ("",), (None,), ("{",), ("[]",)], "g string").select(changes.globs("g")).collect()
    assert [r[0] for r in got] == [["a*", "b"], [], [], [], []]
    over = spark.createDataFrame([("/a/b",), ("a/b",), ("/",), ("a",), (None,)], "p string").select(paths.above(F.col("p")), paths.above(F.col("p"), False)).collect()
    assert [(r[0], r[1]) for r in over] == [(["", "/a", "/a/b"], ["", "/a"]), (["a", "a/b"], ["a"]), (["", "/"], [""]), (["a"], []), ([], [])]


def test_searches_in_expressions_as_in_python(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    from lumenary.plans import request

    rng = random.Random(3)
    bits = ["today", "Yesterday", "last week", "LAST year", "past 3 days", "past 12 months", "past 9999999 years", "past 99999999999999999999 weeks", "last winter", "this fall", "summer 2019", "Autumn", "may 2020", "december", "2018", "2099", "mayor", "x2019", "person:ann", "People:'Ann B' ", 'tag:"B C"', "tag:'x", "camera: nikon", "in:oslo", "from:'a'", "folder:a/b", "filename:.jpg", "type:x", "favourite", "STARRED", "favorites", "photos", "of", "the", "beach", "été", "naïve", "\t", "  ", "'", '"']
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(6))) for _ in range(400)] + ["", None]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for now in (datetime.fromisoformat("2024-02-29T23:30:00+05:30"), datetime(2024, 12, 31, 1, 2, 3, tzinfo=ZoneInfo("Europe/Berlin"))):
        for r in request.understood(table, "s", now).collect():
            want, got = request.understand(r["s"] or "", now), r["request"]
            assert (got["text"], got["date_from"], got["date_to"], got["favorite"]) == (want.text, *want.span, want.favorite), r["s"]
            assert {f: got[f] for f in ("person", "tag", "camera", "place", "folder", "filename") if got[f]} == want.only, r["s"]


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    import glob

    table = f"{tmp_path}/t"
    rows = spark.createDataFrame([(g, k, 10 * g + k) for g in range(4) for k in range(3)], "g int, k int, v int")
    rows.repartition("g").write.partitionBy("g").parquet(table)
    before = {g: sorted(glob.glob(f"{table}/g={g}/*.parquet")) for g in range(6)}
    new = spark.createDataFrame([(1, 2, -1), (1, 9, -2), (5, 0, -3)], "g int, k int, v int")
    assert changes.upsert_partitions(table, new, ["g", "k"], "g") == 2
    after = {g: sorted(glob.glob(f"{table}/g={g}/*.parquet")) for g in range(6)}
    assert {g for g in range(6) if before[g] != after[g]} == {1, 5}
    want = {(g, k): 10 * g + k for g in range(4) for k in range(3)} | {(1, 2): -1, (1, 9): -2, (5, 0): -3}
    assert {(r["g"], r["k"]): r["v"] for r in spark.read.parquet(table).collect()} == want


def test_state_of_a_scan_is_read_and_written_at_once(monkeypatch):
    import pandas as pd

    class Table:
        def __init__(self):
            self.held, self.calls = [], 0

        def exists(self):
            return bool(self.held)

        def get(self):
            self.calls += 1
            return iter(self.held)

        def put(self, values):
            self.calls, self.held = self.calls + 1, list(values)

        def appendValue(self, value):  # noqa: N802
            self.calls += 1
            self.held.append(value)

    monkeypatch.setattr(scans, "PARTS", 4)
    files, table = scans.Files(), Table()
    files.init(type("Handle", (), {"getListState": lambda self, name, schema: table})())

    def batch(scan, names, end=False):
        rows = [(1, scan, f"f{i}", 100 + (i == 3) * scan, 5) for i in names] + ([(1, scan, None, None, None)] if end else [])
        table.calls = 0
        out = pd.concat(files.handleInputRows((1, 0), iter([pd.DataFrame(rows, columns=["root_id", "scan", "rel_path", "mtime", "size"])]), None))
        assert table.calls <= 2 and len(table.held) <= 4
        return out.groupby("status")["rel_path"].count().to_dict()

    assert batch(1, range(1000)) == {"new": 1000}
    assert batch(1, range(1000), True) == {}
    assert batch(2, range(500)) == {"unchanged": 499, "changed": 1}
    for i in range(500, 520):
        assert batch(2, [i]) == {"unchanged": 1}
    assert batch(2, [1000], True) == {"new": 1, "missing": 480}
    assert batch(3, range(1001), True) == {"unchanged": 1000, "changed": 1}
