"""Odd rows and columns: nulls, empty and very long texts, repeated rows, empty tables, and names that clash."""

import pytest

import corpus_pipeline
from lumenary.llm import ann, bpe, decontaminate, jaccard_join, language_id, license_scan, pii, quality_cnn, toxicity, url_filter

LONG = " ".join(f"w{i % 977} all rights reserved x{i % 31}" for i in range(20_000))
TEXTS = [(1, "some words here and there, by Mrs. Anna Smith"), (1, "some words here and there, by Mrs. Anna Smith"), (2, None), (3, ""), (None, "no id at all in this row"), (4, LONG), (5, "ü" * 300)]
#: Names that the operators use themselves, or could.
NAMES = ["row", "score", "node", "component", "_rid", "rid", "words", "hits", "licences", "_words", "_found", "s", "bits", "node_", "value", "kind", "n_entities", "TOUCHED", "likely", "a.b", "lead", "u"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", *[f"{n}-{k}" for n in NAMES]) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", *(f"`{n}` string" for n in NAMES)]))


def extras(df):
    return sorted(tuple(r[n] for n in df.columns if n in NAMES) for r in df.collect())


def test_stages_keep_columns_of_any_name(spark, odd):
    items = spark.createDataFrame([(1, "nothing of this is in any text at all")], "item_id long, text string")
    net = quality_cnn.fit([], __import__("numpy").zeros(0, "f4"))
    every = odd.columns
    assert extras(quality_cnn.score(odd, net, every, "score_").select(*(f"`{c}`" for c in every))) == extras(odd)
    assert quality_cnn.score(odd, net, every).columns == [*(c for c in every if c != "score"), "score"]
    assert extras(decontaminate.clean(odd, items)) == extras(odd) and decontaminate.clean(odd, items).columns == every
    replaced = pii.replace(odd, "k")
    assert replaced.columns == [*(c for c in every if c != "n_entities"), "n_entities", "entity_kinds"]
    assert extras(replaced.drop("n_entities")) == extras(odd.drop("n_entities"))
    texts = {r["row"]: r.text for r in replaced.collect()}
    assert texts["row-2"] is None and texts["row-3"] == "" and texts["row-0"] == texts["row-1"] and "Smith" not in texts["row-0"] and texts["row-5"] == LONG
    found = license_scan.scan(odd, license_scan.document_frequencies(odd))
    assert extras(found.drop("licences")) == extras(odd.drop("licences")) and {r.n_licence_words for r in found.where("text is null or text = ''").collect()} == {0}
    (long,) = found.where("doc_id = 4").collect()
    assert len(long.licences) == 1 and len(long.licences[0].starts) == 20_000 and long.n_licence_words == 100_000
    kept = jaccard_join.without_near_duplicates(odd)
    assert kept.columns == every and extras(kept) == sorted(e for k, e in enumerate(extras(odd)) if k != 1)


def test_further_columns_are_ignored(spark, odd):
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.similar_components(odd).collect())[:2] == [(0, 3, 0), (1, 5, 1)]
    path = __import__("public_tokenizers").path("byte_bpe_50k.tiktoken")
    assert bpe.encode(odd, path, __import__("public_tokenizers").PATTERN).count() == len(TEXTS)
    assert decontaminate.contaminated(odd, odd.where("doc_id = 1").selectExpr("doc_id as item_id", "text")).select("doc_id").distinct().count() == 1
    labels = odd.selectExpr("doc_id", "cast(pmod(hash(text), 2) as int) as toxic", "text", "doc_id % 2 as quality", "lang")
    assert toxicity.score(odd, toxicity.train(labels)).count() == len(TEXTS)
    assert quality_cnn.score(odd, quality_cnn.train(odd, labels)).count() == len(TEXTS)
    got = language_id.identify(odd, language_id.train(odd)).collect()
    assert len(got) == len(TEXTS) and {r.lang_pred for r in got if r.doc_id in (2, 3)} == {"und"}


def test_empty_tables(spark, odd, tmp_path):
    none = odd.where("doc_id < 0")
    items = spark.createDataFrame([], "item_id long, text string")
    pages, rules = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.judge(pages, rules).count() == 0
    some = spark.createDataFrame([(1, "http://a.org/x"), (None, "http://b.org/y"), (None, None)], "page_id long, url string")
    assert sorted(str((r.page_id, r.host, r.rule, r.verdict)) for r in url_filter.judge(some, rules).collect()) == ["(1, 'a.org', None, 'allow')", "(None, '', None, 'allow')", "(None, 'b.org', None, 'allow')"]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(none, toxicity.train(none.selectExpr("doc_id", "text", "1 as toxic"))).count() == 0
    assert quality_cnn.score(none, quality_cnn.train(none, labels)).count() == 0
    none.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = none.selectExpr("doc_id", "text", "lang", "'' as source", "0L as n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, plain, str(tmp_path))
        assert out.count() == 0, name


def test_repeated_rows_and_ties(spark):
    rows = spark.createDataFrame([(1, "the quick brown fox", "en"), (1, "the quick brown fox", "en"), (2, "the quick brown fox", "de")] * 40, "doc_id long, text string, lang string")
    got = language_id.identify(rows, language_id.train(rows)).collect()
    assert len(got) == 120 and {r.lang_pred for r in got} == {"de"}  # as many in either: the first by name
    scored = toxicity.score(rows, toxicity.train(rows.selectExpr("doc_id", "text", "doc_id - 1 as toxic"))).collect()
    assert len(scored) == 120 and len({r.score for r in scored}) == 1
    both = rows.selectExpr("doc_id", "cast(doc_id as int) - 1 as quality")
    assert len({r.score for r in quality_cnn.score(rows, quality_cnn.train(rows, both)).collect()}) == 1
    found = license_scan.scan(rows, license_scan.document_frequencies(rows))
    assert found.count() == 120 and found.where("size(licences) > 0").count() == 0


def test_quality_is_the_same_at_every_place():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    net = {"embed": (513, quality_cnn.EMBED), "filters": (quality_cnn.WIDTH * quality_cnn.EMBED, quality_cnn.FILTERS), "bias": quality_cnn.FILTERS, "out": quality_cnn.FILTERS, "last": ()}
    net = {k: rng.normal(0, 0.4, n).astype(np.float32) if n else np.float32(0) for k, n in net.items()}
    some = ["the quick brown fox", "brown fox " * 100]
    for n in (1, 2, 7, 300):
        column = [t for i in range(n) for t in (*some, "x" * (37 * i))]
        got = quality_cnn.probabilities(net, pa.array(column))
        assert len(set(got[::3])) == len(set(got[1::3])) == 1 and got[0] != got[1]


def test_pages_and_vectors_with_clashing_columns(spark):
    clash = ["key", "part", "kind", "rule", "verdict", "salt"]
    extra = ", ".join(f"'x' as {n}" for n in clash)
    long = "http://a.Example.org/es/" + "p" * 1_000_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, "http://b.org/"), (3, "://")], "page_id long, url string").selectExpr("*", extra.split(", ")[0], *extra.split(", ")[1:])
    rules = spark.createDataFrame([("example.org", "/es/", "block"), ("example.org", "/es/", "no"), ("org", "/", "allow")], "host string, path string, verdict string").selectExpr("*", "'y' as key", "1 as part", "'z' as page_id")
    got = sorted((r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect() if r.page_id < 3)
    assert got == [(1, "a.example.org", 1_000_004, "example.org/es/", "block")] * 2 + [(2, "b.org", 1, "org/", "allow")]
    vectors = spark.range(60).selectExpr("id as vec_id", "array(cos(id), sin(id)) as embedding", "'x' as a", "1 as b", "null as v", "array(1) as ids", "2 as rank", "'q' as query_id")
    found = ann.nearest(vectors).collect()
    plain = ann.nearest(vectors.select("vec_id", "embedding")).collect()
    assert sorted(found) == sorted(plain) and len(found) == 60


def test_vectors_with_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(30 + i, [0.0, 1.0]) for i in range(3)] + [(3, [1.0, 0.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert got == {0: [(k, k) for k in range(1, 21)], 20: [(k + 1, k) for k in range(20)]}
