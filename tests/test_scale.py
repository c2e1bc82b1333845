"""Clusters, choices in order, near hashes and kept indexes against plain Python, with small blocks and hard shapes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary.operators import cluster, density, fulltext, greedy, nearest, text_index, vector_index
from lumenary.sources import shared


def _unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]


def _table(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")


def dbscan(v, least, min_rows):
    """(id, label) by the full matrix."""
    u = _unit(v)
    near = np.round(u @ u.T, 6) >= least
    np.fill_diagonal(near, True)
    core = near.sum(1) >= min_rows
    label = np.arange(len(v))
    while True:
        new = np.where(core, np.where(near & core, label, len(v)).min(1), label)
        if (new == label).all():
            break
        label = new
    out = {(i, label[i]) for i in np.flatnonzero(core)}
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        if len(around):
            out.add((i, around.min()))
    return out


@pytest.mark.parametrize("shape, least, min_rows", [("spread", 0.6, 5), ("rings", 0.97, 3), ("copies", 0.9, 20)])
def test_dbscan_against_all_pairs(spark, monkeypatch, shape, least, min_rows):
    monkeypatch.setattr(density, "BLOCK", 60)
    monkeypatch.setattr(density, "BALL", 4)
    rng = np.random.default_rng(7)
    if shape == "rings":  # chains of neighbours, with gaps
        at = np.sort(rng.uniform(0, 2 * np.pi, 240))
        v = np.stack([np.cos(at), np.sin(at), np.where(np.arange(240) % 2, 0.1, 2.0)], axis=1)
    elif shape == "copies":
        v = np.concatenate([np.repeat(rng.normal(size=(1, 5)), 150, axis=0), rng.normal(size=(150, 5)), np.repeat(rng.normal(size=(1, 5)), 19, axis=0)])
    else:
        v = np.repeat(rng.normal(size=(9, 4)), 30, axis=0) + rng.normal(size=(270, 4)) * (0.1 if shape == "tight" else 0.6)
    v = np.concatenate([v, np.zeros((2, v.shape[1]))])[rng.permutation(len(v) + 2)]
    assert {tuple(r) for r in density.dbscan(_table(spark, v), least, min_rows).collect()} == dbscan(v, least, min_rows)


def test_dbscan_of_a_dense_ball_writes_little(spark, monkeypatch):
    written = []
    before = density.checkpoint
    monkeypatch.setattr(density, "checkpoint", lambda df: written.append(before(df)) or written[-1])
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(3.0), *(F.rand(i) for i in range(7))).alias("embedding"))
    got = density.dbscan(rows, 0.5, 3)
    assert got.count() == n and got.where("label <> 0").isEmpty()
    assert sum(w.count() for w in written) < 2_000  # balls and facts about them, not rows or pairs of rows
    assert density.dbscan(rows.where("vec_id < 0"), 0.5, 3).count() == 0
    with pytest.raises(ValueError):
        density.dbscan(rows, 0.0, 3)


def first_fit(edges):
    """(id, kept) in order of places; rows that are never earlier come last."""
    place = {e: p for _, e, p, _ in edges}
    near, kept = {}, {}
    for later, earlier, p, agrees in edges:
        near.setdefault(later, []).append((p, earlier, agrees))
    for i in sorted(place, key=place.get) + [x for x, *_ in edges if x not in place]:
        found = next(((e, g) for _, e, g in sorted(near.get(i, [])) if kept[e]), None)
        kept[i] = found is None or not found[1]
    return set(kept.items())


@pytest.mark.parametrize("most", [500_000, 40])
def test_choices_in_order(spark, most):
    rng = random.Random(8)
    order = list(range(300))
    rng.shuffle(order)
    at = {x: k for k, x in enumerate(order)}
    pairs = {(rng.randrange(200), rng.randrange(200)) for _ in range(150)} | {(200 + i, 201 + i) for i in range(99)} | {(0, 150), (0, 151)}
    edges = [((a, b) if at[a] > at[b] else (b, a)) for a, b in pairs if a != b]
    edges = [(a, b, at[b], rng.random() < 0.8) for a, b in set(edges)]
    df = spark.createDataFrame(edges, "later long, earlier long, place long, agrees boolean")
    assert {tuple(r) for r in greedy.first_fit(df, most).collect()} == first_fit(edges)
    wide = df.withColumn("place", F.struct((F.col("place") % 2 == 1).alias("odd"), F.col("place")))
    edges = [(a, b, (p % 2 == 1, p), g) for a, b, p, g in edges]
    later = {a: (at[a] % 2 == 1, at[a]) for a, *_ in edges}
    ok = [e for e in edges if later[e[0]] > e[2]]
    keep = spark.createDataFrame([(a, b) for a, b, *_ in ok], "later long, earlier long")
    assert {tuple(r) for r in greedy.first_fit(wide.join(keep, ["later", "earlier"]), most).collect()} == first_fit(ok)


def test_a_long_chain_takes_few_jobs(spark):
    n = 100_000
    tracker, group = spark.sparkContext.statusTracker(), "chain"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = greedy.first_fit(spark.range(n).select((F.col("id") + 1).alias("later"), F.col("id").alias("earlier"), F.col("id").alias("place"), F.lit(True).alias("agrees")))
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.count() == n + 1 and got.where("kept <> (id % 2 = 0)").isEmpty() and jobs < 40


def test_thresholds_are_the_cheapest_that_lose_nothing():
    rng = np.random.default_rng(2)
    for most in (3, 7, 18, 40):
        costs = rng.integers(1, 1000, (4, 17)).astype(float)
        t = cluster.thresholds(costs, most)
        assert sum(x + 1 for x in t) >= most + 1
        price = lambda t: sum(costs[i, : x + 1].sum() for i, x in enumerate(t))
        best = min(price((a, b, c, d)) for a in range(-1, 17) for b in range(-1, 17) for c in range(-1, 17) if -1 <= (d := max(-1, most - 3 - a - b - c)) <= 16)
        assert price(t) == best
    even = np.array([[1e6] + [1] * 16] + [[1] * 17] * 3, float)
    assert cluster.thresholds(even, 18)[0] == -1 and cluster.thresholds(even, 50) is not None


def test_wide_hashes_with_a_hot_block(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 50)
    rng = random.Random(9)
    h = [(i, (0xBEEF << 16 | rng.getrandbits(16) | rng.getrandbits(32) << 32) if i % 3 else rng.getrandbits(64)) for i in range(300)]
    h += [(300 + i, x ^ sum(1 << b for b in rng.sample(range(64), i % 25))) for i, (_, x) in enumerate(h[:100])]
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in h], "id long, h long")
    for most in (12, 20):
        want = {(i, j, d) for i, x in h for j, y in h if i < j and (d := (x ^ y).bit_count()) <= most}
        assert {tuple(r) for r in cluster.near_hashes(df, most).collect()} == want
    assert cluster.near_hashes(df.where("id < 0"), 18).count() == 0


COLUMNS = {"caption": 8.0, "tags": 6.0, "ocr": 3.0}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(10)
    words = [a + b for a in ("run", "walk", "img", "cat", "Électric", "whale") for b in ("", "s", "ing", "_1")] + ["the"] * 20 + ["of"] * 8
    text = lambda n: None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(i * 37 % 5000, text(9), text(4), text(60)) for i in range(600)]
    return spark.createDataFrame(rows, "id long, caption string, tags string, ocr string").repartition(4)


def _hits(df):
    return {r["id"]: round(r["score"], 6) for r in df.collect()}


def test_index_finds_what_a_recount_finds(spark, texts):
    index = text_index.build(texts, shared.fresh(spark, "t"), COLUMNS)
    some = texts.where("id % 2 = 0").select("id")
    for query, prefix, k in (("the", False, 7), ("electric wh", True, 10_000), ("cats img_1 wal", True, 1), ("img_1 the", False, 9), ("nothing", False, 3), ("", True, 3)):
        want = _hits(fulltext.search(texts, query, COLUMNS, prefix))
        assert _hits(text_index.search(index, query, prefix)) == want, query
        best = sorted(want.items(), key=lambda x: (-x[1], x[0]))
        assert [tuple(r) for r in text_index.top(index, query, k, prefix).collect()] == best[:k]
    assert [tuple(r) for r in text_index.top(index, "img_1 the", 5, False, some).collect()] == [x for x in sorted(_hits(text_index.search(index, "img_1 the", False)).items(), key=lambda x: (-x[1], x[0])) if x[0] % 2 == 0][:5]
    assert text_index.opened(spark, shared.fresh(spark, "none")) is None
    empty = text_index.build(texts.where("id < 0"), shared.fresh(spark, "t"), COLUMNS)
    assert text_index.search(empty, "the").count() == text_index.top(empty, "the", 3).count() == 0


def test_updates_equal_a_new_index(spark, texts):
    folder = shared.fresh(spark, "t")
    text_index.build(texts.where("id % 5 <> 0").withColumn("ocr", F.when(F.col("id") % 3 == 0, F.lit("old walks of the whale")).otherwise(F.col("ocr"))), folder, COLUMNS)
    text_index.update(spark, folder, texts.where("id % 3 = 0 and id % 5 <> 0"), texts.where("id % 7 = 0").select("id"))
    text_index.update(spark, folder, texts.where("id % 5 = 0 or id % 7 = 0"))
    index = text_index.update(spark, folder, texts.limit(0), texts.where("id % 11 = 0").select("id").union(spark.range(90_000, 90_003)))
    merged = text_index.merge(spark, folder)
    whole = text_index.build(texts.where("id % 11 <> 0"), shared.fresh(spark, "t"), COLUMNS)
    assert (index.n, index.total) == (merged.n, merged.total) == (whole.n, whole.total) and len(index.segments) == 4 and len(merged.segments) == 1
    for state in (index, merged):
        assert {tuple(r) for r in text_index.terms(state).collect()} == {tuple(r) for r in text_index.terms(whole).collect()}
        for query in ("the wal", "img_1 of"):
            assert _hits(text_index.search(state, query)) == _hits(text_index.search(whole, query))
        assert text_index.top(state, "whales", 9).collect() == text_index.top(whole, "whales", 9).collect()
    assert text_index.opened(spark, folder).version == merged.version == 4


def test_a_search_reads_only_its_blocks(spark, texts):
    index = text_index.build(texts.unionByName(texts.withColumn("id", F.col("id") + 1_000_000).withColumn("ocr", F.lit("the"))), shared.fresh(spark, "t"), COLUMNS)
    plan = text_index.search(index, "img_1 wal")._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan and "StringStartsWith(term,walk)" in plan.replace("wal)", "walk)") and "c0" not in plan
    q = text_index._Query(index, "cat", False)
    bounds = {r["block"]: r["bound"] for r in q.bounds(q.documents()).collect()}
    best = {}
    for r in text_index.search(index, "cat", False).collect():
        best[r["id"] >> text_index.BLOCK] = max(best.get(r["id"] >> text_index.BLOCK, 0), r["score"])
    assert bounds.keys() == best.keys() and all(bounds[b] >= best[b] - 1e-9 for b in best)


@pytest.mark.parametrize("shape", ["random", "clustered", "copies"])
def test_vector_index_proves_its_best(spark, shape):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(9000, 12)) if shape == "random" else np.repeat(rng.normal(size=(9, 12)), 1000, axis=0) + (0.01 if shape == "clustered" else 0) * rng.normal(size=(9000, 12))
    v = (_unit(v) * np.where(np.arange(9000) % 3, 1, 0.5)[:, None]).astype("f4")
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(-1, None), (-2, [1.0]), (-3, [float("nan")] * 12), (-4, [0.0] * 12)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    folder = shared.fresh(spark, "v")
    assert vector_index.build(df, folder, "m", 12) == 9001
    for q in (v[5], np.zeros(12, "f4")):
        q = [float(x) for x in q]
        score = np.round(np.array([sum(float(a) * b for a, b in zip(r, q)) for r in v]), 6)
        want = sorted([(-s, i) for i, s in enumerate(score)] + [(0.0, -4)])[:50]
        got = [(r["id"], r["score"]) for r in vector_index.top(spark, folder, q, 50, -9.0, -99.0).collect()]
        assert got == [(i, -s) for s, i in want]
    assert vector_index.top(spark, folder, [1.0], 5, 0.0, 0.0).count() == 0
    vector_index.build(df.where("id < 0"), folder, "n", 12)
    assert vector_index.state(spark, folder)["model"] == "n" and vector_index.top(spark, folder, q, 5, -9.0, -99.0).count() == 1


@pytest.mark.parametrize("people, most", [(1, 3), (400, 1), (400, 2)])
def test_nearest_against_all(spark, monkeypatch, people, most):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "ROWS", 20)
    rng = np.random.default_rng(12)
    c = _unit(np.repeat(rng.normal(size=(40, 6)), 10, axis=0) + 0.2 * rng.normal(size=(400, 6)))[:people]
    c[people // 2 :: 7] = c[: len(c[people // 2 :: 7])]  # ties
    v = _unit(np.concatenate([c[rng.integers(0, people, 150)] + 0.1 * rng.normal(size=(150, 6)), rng.normal(size=(80, 6)), c[:1], np.zeros((1, 6)), np.repeat(c[:1], 60, axis=0)]))
    if people > 1:
        c[17] = 0
    ids = rng.permutation(people) * 3
    sim = np.round(v @ c.T, 6)
    want = {(k, int(ids[j]), sim[k, j], r) for k in range(len(v)) for r, j in enumerate(sorted(range(people), key=lambda j: (-sim[k, j], ids[j]))[:most], 1)}
    table = lambda rows, x, kind: spark.createDataFrame([(int(i), [float(y) for y in r]) for i, r in zip(rows, x)], kind)
    rows, named = table(range(len(v)), v, "key long, v array<double>"), table(ids, c, "person_id long, centroid array<double>")
    assert {tuple(r) for r in nearest.nearest(rows, named, most).collect()} == want
    assert nearest.nearest(rows, named.limit(0), most).count() == 0 and nearest.nearest(rows.limit(0), named, most).count() == 0


@pytest.mark.parametrize("most", (6, 14, 18))
def test_near_hashes_by_tiles_and_by_blocks_alike(spark, monkeypatch, most):
    rng = random.Random(most)
    h = [rng.getrandbits(64) for _ in range(150)]
    h += [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(22))) for x in h] + h[:20]
    want = {(i, j, d) for i, x in enumerate(h) for j, y in enumerate(h) if i < j and (d := (x ^ y).bit_count()) <= most}
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(h)], "id long, h long")
    monkeypatch.setattr(cluster, "BLOCK", 50)
    for dear, tile in ((1e9, 90), (0, 90)):
        monkeypatch.setattr(cluster, "DEAR", dear)
        monkeypatch.setattr(cluster, "TILE", tile)
        got = cluster.near_hashes(df, most)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
        # pairs of values are far more than Spark guesses: they are never sent to every task
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_meetings_count_all_pairs(spark):
    counts = np.zeros((2, 1 << 16))
    v = np.random.default_rng(3).integers(0, 1 << 16, (2, 300))
    for row, x in zip(counts, v):
        np.add.at(row, x, 1)
    want = [np.bincount(np.bitwise_count(x[:, None] ^ x).ravel(), minlength=17) for x in v]
    assert np.allclose(cluster._meetings(counts), want)


def test_postings_travel_once(spark, texts):
    rows = text_index._cut(texts, COLUMNS).select("id", "size", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("count"), "places")))
    plan = text_index._blocks(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(term") == 1 and "hashpartitioning" not in plan


def test_blocks_of_vectors_are_few_however_many_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sent = []
    for n in (300, 3000):
        cells = cluster.Cells(_table(spark, rng.normal(size=(n, 8))), 60)
        rows = cells.paired(cells.rows, 3.2)
        sent.append(rows.count() / n)
        met = rows.groupBy("lo", "hi").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        assert met <= 2 * -(-n // 4) + 120
    assert sent[1] <= 9  # 50 blocks before


def test_least_cosine_is_the_first_that_rounds_to_enough():
    for least in (0.35, 0.994, 0.5, 0.123457):
        x = cluster.least_cosine(least)
        assert np.round(x, 6) >= least > np.round(np.nextafter(x, -1), 6)


def test_whole_texts_are_stemmed_a_few_at_a_time(spark, monkeypatch):
    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(StringType()))
    def rows(texts):
        return texts.map(lambda _: [str(len(texts))] * 2)

    monkeypatch.setattr(fulltext.stem, "stemmed", rows)
    before, held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    monkeypatch.setattr(fulltext, "checkpoint", lambda df, *a: held.append(shared.checkpoint(df, *a)) or held[-1])
    docs = spark.range(0, 3000, 1, 1).select("id", F.lit("x").alias("caption"))
    fulltext.search(docs, str(fulltext.TEXTS), {"caption": 1.0})
    assert held[0].where("f0 > 0").count() == 3000  # each in a batch of TEXTS rows
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_decontamination_deals_windows_by_their_number(spark, monkeypatch):
    from lumenary.llm import decontaminate

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "TASK_WINDOWS", 20)
    monkeypatch.setattr(decontaminate, "TASK_SHINGLES", 20)
    dealt, kind = [], type(benchmark)
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by: dealt.append(n) or plain(self, n, *by))
    tasks = {}
    for n in (5, 20):
        dealt.clear()
        docs = spark.createDataFrame([(i, f"before {i} it {item} after") for i in range(n)], "doc_id long, text string")
        found = decontaminate.contaminated(docs, benchmark).collect()
        assert sorted((r.doc_id, r.start_word, r.similarity) for r in found) == [(i, 3, 1.0) for i in range(n)]
        tasks[n] = list(dealt)
    assert len(tasks[5]) == 4 and min(tasks[5]) >= 1 and all(b >= 3 * a for a, b in zip(tasks[5], tasks[20]))
