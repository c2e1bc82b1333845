"""The corpus operators on small tables: brute force, round trips, and the cases of null, empty and repeated rows."""

import pytest
from pyspark.sql import functions as F

from lumenary.llm import ann, bpe, decontaminate, jaccard_join, language_id, license_scan, pii, quality_cnn, toxicity, url_filter

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, LONG, "x"), (2, LONG, "y"), (3, LONG + " end", "z"), (4, "Hello there", "z"), (5, "hello  THERE", "z"), (6, "", "e"), (7, None, "n"), (None, "alone in the dark with six words", "n"), (8, "a b c d e f g", "n"), (8, "a b c d e f g", "n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, component_id string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_jaccard(docs, empty):
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs).collect()], key=str)
    want = [(1, 56, 1), (2, 56, 1), (3, 57, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6), (7, 0, 7), (8, 3, 8), (8, 3, 8), (None, 3, None)]
    assert got == sorted(want, key=str)
    assert jaccard_join.similar_components(empty).count() == 0
    kept = jaccard_join.without_near_duplicates(docs)
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "4", "6", "7", "8", "None"] and kept.columns == docs.columns


def test_bpe(docs, empty):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = docs.unionByName(docs.sparkSession.createDataFrame([(9, "naïve ½ 中文   x\r\n\t'll 😀" * 5, "")], docs.schema))
    got = bpe.decode(bpe.encode(odd, path, P.PATTERN, block_bytes=200), path).join(odd.select("doc_id", "text"), "doc_id")
    for r in got.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    by_id = {r.doc_id: list(r.ids) for r in bpe.encode(odd, path, P.PATTERN, block_bytes=200).collect()}
    for i, text, _ in [*ROWS, (9, "naïve ½ 中文   x\r\n\t'll 😀" * 5, "")]:
        assert by_id[i] == want.encode_ordinary(text or "")
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10, 40))), (2, None), (3, ""), (4, "Hello there"), (5, "not in any text of these at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert got[1, 1].start_word == 10 and got[1, 1].n_words == 30 and got[1, 1].similarity == 1.0
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(docs, items.where("item_id < 0")).count() == 0
    assert decontaminate.clean(docs, items).count() == 5


def test_decontaminate_borderline_copies(spark):
    import random
    from collections import Counter

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10)))

    def grams(words):
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))

    def weight(c):
        return sum(n * len("".join(g)) for g, n in c.items())

    items, docs, want = [], [], set()
    while len(want) < 400:
        item = [word() for _ in range(rng.randrange(25, 60))]
        copy = list(item)
        for i in rng.sample(range(len(copy)), rng.randrange(1, 4)):
            copy[i] = word()
        a, b = grams(item), grams(copy)
        if 0.75 <= weight(a & b) / weight(a | b) <= 0.85:
            want.add((len(items), len(items)))
            docs.append((len(items), " ".join(copy)))
            items.append((len(items), " ".join(item)))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_pii(spark, docs):
    text = "Mail a.b9@mail.example.com or A.B9@MAIL.EXAMPLE.COM, Mrs. Anna Smith, 4417744280351547 and 4417 7442 8035 1547, 10.0.0.7"
    rows = spark.createDataFrame([(1, text), (1, text), (2, "10.0.0.7 10.0.0.8"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted([(r.doc_id, r.text, r.n_entities) for r in pii.replace(rows, "k").collect()], key=str)
    assert len(got) == 5 and [n for *_, n in got] == [6, 6, 2, 0, 0]
    one, two = got[0][1], got[2][1]
    assert "Smith" not in one and "Mrs. " in one and "a.b9@" not in one
    mail = one.split()[1]
    assert mail.upper() + "," in one  # one entity, both forms
    digits = one.split(", ")[2].split(" and ")
    assert digits[0] == digits[1].replace(" ", "")
    a, b = two.split()
    assert a != b and one.endswith(a) and "10.0.0.7" not in two
    assert pii.replace(rows.where("doc_id > 9"), "k").count() == 0


def test_pii_cheap_test_lets_every_pattern_pass(spark):
    mentions = ["AKIA" + "QWERTYUIOPASDFGH", *(f"gh{c}_" + "abcdefXYZ" * 4 for c in "pousr"), "abcdef" * 6, "ABCDEF" * 6, "a@b.org", "Mrs. Smith", "Анна Петрова", "GB33 BUKB ABCD EFGH", "10.0.0.7", "+1 202 555 0147", "4417 7442 8035 1547", "123-45-6789"]
    rows = spark.createDataFrame([(i, f"see {x} there") for i, x in enumerate(mentions)], "doc_id long, text string")
    assert rows.where(F.col("text").rlike(pii.ANY) & ~F.col("text").rlike(pii.MAYBE)).count() == 0
    got = {r.doc_id: r for r in pii.replace(rows, "k").collect()}
    assert all(got[i].n_entities == 1 and x not in got[i].text for i, x in enumerate(mentions))


def test_pii_keeps_countries_checks_and_domains(spark):
    def remainder(iban):
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97

    mentions = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "DE11 3704 0044 0532 0130 00", "+49 30 1234567", "+1 202 555 0147", "+44 20 7946 0958", "+353 20 555 0147", "ann.b@mail.example.co.uk", "a@b.com", "2001:db8::ff00:42:8329", "2001:0DB8:85A3:0000:0000:8A2E:0370:7334", "fe80::1"]
    times = "at 12:30:45 or 10:20, a::b and std::vector"
    rows = spark.createDataFrame([(i, f"see {x} there") for i, x in enumerate(mentions)] + [(99, times)], "doc_id long, text string")
    rows_out = {r.doc_id: r for r in pii.replace(rows, "k").collect()}
    assert rows_out[99].text == times
    got = [rows_out[i].text[4:-6] for i in range(len(mentions))]
    assert all(a != b and rows_out[i].n_entities == 1 for i, (a, b) in enumerate(zip(mentions, got)))
    for a, b in zip(mentions[:3], got):
        assert b[:2] == a[:2] and b[4:] != a[4:] and remainder(a.replace(" ", "")) == remainder(b.replace(" ", "")) and len(a) == len(b)
    for i, code in ((3, "+49 "), (4, "+1 "), (5, "+44 "), (6, "+353 ")):
        assert got[i].startswith(code) and len(got[i]) == len(mentions[i]) and got[i][len(code) :] != mentions[i][len(code) :]
    assert got[7].endswith(".uk") and got[8].endswith(".com") and "example" not in got[7]
    import ipaddress

    for a, b in zip(mentions[9:], got[9:]):
        assert ipaddress.ip_address(b) != ipaddress.ip_address(a) and b.isupper() == a.isupper() and b.count(":") == a.count(":")


def test_licenses(docs, empty):
    rows = docs.sparkSession.createDataFrame([(1, "All rights-reserved. CC by; cc BY 4.0 under GNU General Public License, version 3"), (2, "all right reserved"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(rows, license_scan.document_frequencies(rows)).collect()}
    assert sorted({x.label for x in got[1].licences}) == ["cc-by", "cc-by-4.0", "gpl", "gpl-3.0", "reserved"]
    assert [list(x.starts) for x in got[1].licences if x.label == "cc-by"] == [[3, 5]]
    assert not got[2].licences and not got[3].licences and got[3].n_licence_words == 0
    assert license_scan.scan(empty, {}).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.ORG/es/x?q"), (2, "https://example.org/en/12#t"), (3, "https://badexample.org/en/12"), (4, None), (5, "no scheme"), (6, "http://x.com/fr/1"), (7, "http://y.net"), (8, "http://a,b.org/")], "page_id long, url string")
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2] == "com/fr/" and got[7] == ("y.net", "", None, "allow") and got[8][2] == "org/"


def test_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 8))
    v[100:140] = v[20]
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 900, 20)) and all(len(x) == 20 for x in got.values())
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(900), -s.round(9))) if i != q][:20]
        hits += len(set(best) & {i for i, _ in found.values()})
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_of_small_clusters_and_outliers(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ann, "LIST_ROWS", 10)  # a list for most of the clusters, fewer rows in it than a query asks for
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(120, 16)), 8, axis=0) + rng.normal(size=(960, 16)) * 1e-3
    v[::160] = rng.normal(size=(6, 16)) * 3
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    got, hits = {}, 0
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sorted(got) == list(range(0, 960, 20)) and all(len(x) == 20 for x in got.values())
    for q, found in got.items():
        hits += len(found & set([i for i in np.argsort(-(v @ v[q])) if i != q][:20]))
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame(rows[:12], "vec_id long, embedding array<double>")
    assert ann.nearest(few).count() == 11


def test_classifiers(spark, empty):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(400):
        words, bad = [word() for _ in range(60)], i % 4 == 0
        if bad:
            words[10:50:8] = ["nastyword"] * 5
        rows.append((i, " ".join(words) if i % 3 else " ".join(w + "%%%" for w in words), int(bad), int(i % 3 > 0), "de" if i % 2 else "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int, lang string")
    more = df.select("doc_id", "text").unionByName(spark.createDataFrame([(999, None), (998, "")], "doc_id long, text string"))
    model = toxicity.train(df.where("doc_id % 5 <> 0"))
    scored = toxicity.score(more, model).join(df.select("doc_id", "toxic"), "doc_id", "left")
    assert scored.where("score is null or score < 0 or score > 1").count() == 0 and scored.count() == 402
    assert scored.where("toxic is not null and doc_id % 5 = 0 and (score >= 0.3) <> (toxic = 1)").count() <= 4
    net = quality_cnn.train(more, df.where("doc_id % 5 <> 0"))
    scored = quality_cnn.score(more, net).join(df.select("doc_id", "quality"), "doc_id", "left")
    assert scored.count() == 402 and scored.where("quality is not null and doc_id % 5 = 0 and (score >= 0.5) <> (quality = 1)").count() <= 4
    assert toxicity.score(empty, model).count() == 0 and quality_cnn.score(empty, net).count() == 0


def test_toxic_expression_of_ordinary_words(spark):
    import random

    import numpy as np

    from lumenary.llm import _text as T

    rng = random.Random(6)
    rows = []
    for i in range(1500):
        words = [f"w{rng.randrange(2, 40)}" for _ in range(40)]
        words[10:12] = ["w0", "w1"] if i % 2 else ["w1", "w0"]
        rows.append((i, " ".join(words), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    new = spark.createDataFrame([(1, "w0 w1"), (2, "w1 w0")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(new, toxicity.train(df)).collect()}
    # Either word is as common in both classes; what tells is the pair, by more than a clipped ratio could.
    assert got[1].top_ratio - got[2].top_ratio > 1.2 and got[1].score > 0.5 > got[2].score
    # Exact counts, and contexts without a bound.
    raw = toxicity._counts(df)
    seen = {(a, b) for _, text, _ in rows for a, b in zip(text.split(), text.split()[1:])} | {(None, text.split()[0]) for _, text, _ in rows}
    hashed = {w: T.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), T.NOT_WORD)[0].view(np.int64)[0] for w in {b for _, b in seen}}
    at = {w: list(raw["words"].view(np.int64)).index(h) for w, h in hashed.items()}
    assert len(raw["words"]) == 42 and raw["backed"].sum() == len(seen)
    pairs = [(t, set(zip([None, *text.split()], text.split()))) for _, text, t in rows]
    for w, i in at.items():
        assert [raw["n"][c][i] for c in (0, 1)] == [sum(b == w for t, p in pairs if t == c for _, b in p) for c in (0, 1)]
        assert raw["backed"][i] == sum(b == w for _, b in seen)
    counts = {(int(k) >> 32, int(k) & 0xFFFFFFFF): tuple(n) for k, n in zip(raw["pairs"], raw["pair_n"].T)}
    start = list(raw["words"]).index(toxicity.START)
    for a, b in seen:
        n = tuple(sum((a, b) in p for t, p in pairs if t == c) for c in (0, 1))
        assert counts.get((start if a is None else at[a], at[b]), (0, 0)) == (n if max(n) > 0.75 else (0, 0))


def test_language(spark, empty):
    texts = {"en": "the quick brown fox jumps over the lazy dog and the cat", "de": "der schnelle braune fuchs springt über den faulen hund und die katze"}
    df = spark.createDataFrame([(i, t, lang) for i in range(10) for lang, t in texts.items()] + [(99, "zzz", None)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    new = spark.createDataFrame([(1, "the lazy cat and the dog"), (2, "die katze und der hund"), (3, None), (4, "123 !?"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(new, model).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(new, language_id.train(empty.withColumn("lang", F.lit("en")))).collect()} == {"und"}


@pytest.mark.parametrize("split", [False, True])
def test_neighbours_among_hundreds_of_lists(spark, monkeypatch, split):
    import numpy as np

    # Lists of ten rows, so that a query probes a small part of them; or a few large ones that are cut into such lists.
    monkeypatch.setattr(ann, "LIST_ROWS", 10)
    if split:
        monkeypatch.setattr(ann, "MOST_LISTS", 12)
        monkeypatch.setattr(ann, "SPLIT", 60)
        monkeypatch.setattr(ann, "GROUP_ROWS", 300)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16)) * 2
    v = centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 16)) * 0.5
    v[:1000] *= rng.uniform(0.2, 3, size=(1000, 1))  # of different lengths
    v[1000:1100] = v[7]  # one vector many times
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 4000, 20)) and all(len(x) == 20 for x in got.values())
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        found.sort()
        assert all(abs(score - s[i]) < 1e-9 for _, i, score in found) and len({i for _, i, _ in found} - {q}) == 20
        assert [(-round(x, 9), i) for _, i, x in found] == sorted((-round(x, 9), i) for _, i, x in found)
        least = np.sort(np.delete(s, q))[-20] - 1e-9
        hits += sum(score >= least for _, _, score in found)
    assert hits >= 0.9 * 20 * len(got)


def test_decontaminate_plans_stay_short(spark, docs, monkeypatch):
    """The driver plans fingerprints and near values once, not once for each block: its memory went beyond the limit by that."""
    lengths, write = [], decontaminate.T.checkpoint

    def measured(df):
        lengths.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df)

    monkeypatch.setattr(decontaminate.T, "checkpoint", measured)
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    decontaminate.clean(docs, items)
    assert max(lengths) < 30_000, lengths
