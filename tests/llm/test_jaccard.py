"""The n-gram Jaccard join against brute force over random texts, thresholds and shingle widths."""

import random

import pytest

from lumenary.llm import components, jaccard_join


def brute(rows, width, percent):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text) of distinct ids."""
    sets = {}
    for i, text in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def texts(seed, n):
    """Chains of edited copies, exact copies, passages in common, and short texts of few words."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(12)]
    out = []
    while len(out) < n:
        words = [rng.choice("abcdefgh") + str(rng.randrange(12)) for _ in range(rng.choice([2, 3, 5, 8, 12, 20, 40]))]
        if rng.random() < 0.4:
            words[rng.randrange(len(words)) :] = passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice("xyz") + str(rng.randrange(5))
            if rng.random() < 0.3:
                words = words[: max(1, len(words) - 1)]
    out[:4] = ["", None, " \t\n", "One two three".upper()]
    return list(enumerate(out))


@pytest.mark.parametrize("seed, width, percent", [(1, 5, 75), (2, 1, 30), (3, 2, 37), (5, 4, 95)])
def test_components_equal_brute_force(spark, monkeypatch, seed, width, percent):
    if seed % 2:  # hot parts, crowds compared in blocks, several tasks of verification
        monkeypatch.setattr(jaccard_join, "CROWD", 3)
        monkeypatch.setattr(jaccard_join, "HELD", 300)
        monkeypatch.setattr(jaccard_join, "HOT", 2)
    rows = texts(seed, 220)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.similar_components(docs, width, percent).collect())
    assert got == brute(rows, width, percent)


def test_crowded_postings_are_read_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", 3)
    plans, write = [], jaccard_join.T.checkpoint

    def checkpoint(df):
        if "meet" in df.columns:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(jaccard_join.T, "checkpoint", checkpoint)
    rows = texts(3, 120)
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 75)
    assert plans and not any("Join Inner, (node#" in p for p in plans)


def test_one_row_of_each_group_stays(spark):
    rows = texts(7, 200)
    extra = [(i, t, f"n{i}", i, "s") for i, t in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, node_ string, component long, s_id string")
    kept = jaccard_join.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted({c for i, n, c in brute(rows, 5, 75)})
    got = sorted((r.doc_id, r.text, r.node_, r.component, r.s_id) for r in kept.collect())
    assert got == [extra[i] for i in want]
    twice = docs.unionByName(docs).unionByName(docs.where("text is null").withColumn("doc_id", docs.doc_id + 1000))
    blank = {i for i, n, _ in brute(rows, 5, 75) if n == 0}
    ids = sorted(r.doc_id for r in jaccard_join.without_near_duplicates(twice).collect())
    assert ids == sorted([*want, *blank, *(i + 1000 for i, t in rows if t is None)])


def test_long_texts_and_repeated_rows(spark):
    long = " ".join(f"w{i % 7000}x{i % 13}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short text")] + [(4, "the same text of six words")] * 500 + [(None, "the same text of six words")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4), (None, 4)}


def test_connected_components_in_several_tasks(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(500, 500 + i) for i in range(1, 30)] + [(5, None), (7, 7)]
    low = {}

    def root(i):
        while low.setdefault(i, i) != i:
            i = low[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            low[y] = x
    want = {(i, root(i)) for i in low}
    df = spark.createDataFrame(edges, "u long, v long")
    for rows in (40, 1000):
        assert {tuple(r) for r in components.connected_components(df, rows).collect()} == want
    assert components.connected_components(df.where("u < 0")).count() == 0
