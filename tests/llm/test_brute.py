"""The corpus operators against plain Python on small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lumenary.llm import bpe, decontaminate, language_id, license_scan, pii, quality_cnn, toxicity, url_filter
from lumenary.llm import _text as T


def test_urls_against_all_rules(spark):
    rng = random.Random(1)
    labels = ["a", "b", "com", "org", "x-y", "www"]
    host = lambda k: ".".join(rng.choice(labels) for _ in range(k))
    path = lambda k: "".join("/" + rng.choice(["", "e", "en", "n1"]) for _ in range(k))
    rules = [(host(rng.randrange(1, 4)), path(rng.randrange(3)), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    pages = [(i, rng.choice(["http://", "https://", "ftp://", ""]) + rng.choice([str.upper, str.lower])(host(rng.randrange(1, 5))) + path(rng.randrange(4)) + rng.choice(["", "?q=/e", "#/n1"])) for i in range(700)]
    pages += [(700 + i, "http://a.com/e") for i in range(200)]  # a hot host

    def want(url):
        rest = url.partition("://")[2]
        h, p = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        h = h.lower()
        fits = [(r + q, v) for r, q, v in rules if (h == r or h.endswith("." + r)) and p.startswith(q)]
        best = max(fits, key=lambda x: (len(x[0]), [-ord(c) for c in x[0]]), default=None)
        return h, p, best and best[0], best[1] if best else "allow"

    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: want(u) for i, u in pages}


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def matches(docs, items, width=5, percent=75):
    """(doc_id, item_id) to (similarity, start) of the best window, by trying all."""
    out = {}
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    weight = lambda c: sum(n * len("".join(g)) for g, n in c.items())
    for item_id, text in items:
        iw = _words(text)
        k = min(width, len(iw))
        if not iw:
            continue
        own = grams(iw, k)
        for doc_id, body in docs:
            ws = _words(body)
            n = min(len(iw), len(ws))
            for s in range(len(ws) - n + 1 if n >= k else 0):
                c = grams(ws[s : s + n], k)
                both = weight(c & own)
                if both and 100 * both >= percent * weight(c | own):
                    sim = both / weight(c | own)
                    if sim > out.get((doc_id, item_id), (0, 0))[0]:
                        out[doc_id, item_id] = (sim, s)
    return out


@pytest.mark.parametrize("looked_up", [300_000, 40])
def test_decontamination_against_all_windows(spark, monkeypatch, looked_up):
    monkeypatch.setattr(decontaminate, "LOOKED_UP", looked_up)
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.2 else "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 8, 20, 40])))) for i in range(25)] + [(90, ""), (91, None), (92, "the the the the the the the")]
    docs = []
    for i in range(120):
        body = [word() for _ in range(rng.randrange(2, 120))]
        if i % 2:
            copy = items[rng.randrange(25)][1].split()
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            at = rng.randrange(len(body))
            body[at:at] = copy if i % 3 else copy + copy
        docs.append((i, "  ".join(body).upper() if i % 5 == 0 else "\n".join(body)))
    docs += [(900, None), (901, ""), (902, "the " * 40)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = matches(docs, items)
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in got} == {k: (round(s, 9), at) for k, (s, at) in want.items()} and len(want) > 20


def test_language_against_sets_of_grams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    counts = defaultdict(Counter)

    def grams(text):
        b = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in (text or "").encode())
        b = b" " + b + b"  "
        return [g for g in (b[i : i + 4] for i in range(len(b) - 3)) if g.strip()]

    for i, text, lang in rows:
        if i % 3:
            counts[lang].update(grams(text))
    held = {lang: {g for g, n in c.items() if n >= max(2, sum(c.values()) * language_id.MIN_SHARE)} for lang, c in counts.items()}
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs.where("doc_id % 3 <> 0"))).collect()}
    right = 0
    for i, text, lang in rows:
        g = grams(text)
        share = {x: sum(y in s for y in g) / max(len(g), 1) for x, s in held.items()}
        best = max(sorted(share), key=share.get)
        r = got[i]
        if r.lang_pred != "und":
            assert abs(r.score - share[r.lang_pred]) < 0.02 and share[best] - share[r.lang_pred] < 0.02
            right += r.lang_pred == lang
    assert right >= 0.95 * len(rows)


def test_names_keep_their_people_together(spark):
    text = "Mrs. Anna Smith met Anna Smith, Mrs. Smith and Dr. Smith; Mr. Peter Smith met Anna Brown, José García, Анна Петрова and Mr. Zebulon O’Neill. Mr. O’Neill wrote to josé@mail.es; 張偉先生, 王小明先生."
    (r,) = pii.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), "key").collect()
    m = re.match(r"Mrs\. (\S+) (\S+) met (\S+) (\S+), Mrs\. (\S+) and Dr\. (\S+); Mr\. (\S+) (\S+) met (\S+) (\S+), (\S+) (\S+), (\S+) (\S+) and Mr\. (\S+) (\S+)\. Mr\. (\S+) wrote to (\S+)@(\S+)\.(\S+); (\S+)先生, (\S+)先生\.", r.text)
    g = m.groups()
    anna, smith = g[0], g[1]
    assert (g[2], g[3], g[4], g[5], g[7], g[8]) == (anna, smith, smith, smith, smith, anna)
    assert anna in pii.GIVEN["latin", "f"] and anna != "Anna" and g[6] in pii.GIVEN["latin", "m"] and g[10] in pii.GIVEN["latin", "m"]
    assert g[12] in pii.GIVEN["cyrillic", "f"] and re.fullmatch("[а-яА-Я]+", g[13]) and g[14].endswith("on")
    assert g[15] == g[16] and len({smith, g[9], g[11], g[15], "Smith", "Brown"}) == 6
    assert not re.search("Smith|Brown|Garc|Zebulon|Neill|josé|mail|張|王", r.text) and r.n_entities == 13
    other = pii.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), "another").first()
    assert other.text != r.text
    with pytest.raises(ValueError):
        pii.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), "")


def test_replacements_stay_distinct_when_a_format_is_used_up(spark, monkeypatch):
    monkeypatch.setattr(pii, "WIDER", 4)
    rows = [("ip", f"{a}.{b}.1.1", None) for a in range(10) for b in range(10)] + [("given", f"Xavo{c}", "m") for c in "abcdefgh"]
    # A type of one digit, so that ten entities use it up.
    rows += [("digit", str(i), None) for i in range(10)]
    got = pii.assign(spark.createDataFrame(rows, "kind string, normal string, gender string"), "k").collect()
    assert len(got) == len(rows) == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & {(k, n) for k, n, _ in rows}


def test_entities_against_plain_replacement(spark):
    rng = random.Random(4)
    kinds = [lambda: f"u{rng.randrange(9)}@mail{rng.randrange(3)}.org", lambda: f"+1 (20{rng.randrange(9)}) 555-010{rng.randrange(9)}", lambda: f"10.0.{rng.randrange(9)}.7", lambda: f"123-45-678{rng.randrange(9)}", lambda: "4417 7442 8035 154" + str(rng.randrange(9))]
    docs = [(i, " ".join(rng.choice(kinds)() if rng.random() < 0.2 else rng.choice(["one", "two", "three,"]) for _ in range(40))) for i in range(80)] + [(200 + i, "u1@mail1.org again") for i in range(300)]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()}
    pattern = re.compile(r"\S+@\S+|\+1 \(\d{3}\) \d{3}-\d{4}|\d+\.\d+\.\d+\.\d+|\d{3}-\d{2}-\d{4}|\d{4} \d{4} \d{4} \d{4}")
    there, back = {}, {}
    for i, text in docs:
        old, new = pattern.findall(text), pattern.findall(got[i].text)
        assert len(old) == len(new) == got[i].n_entities and pattern.split(text) == pattern.split(got[i].text)
        for a, b in zip(old, new):
            assert there.setdefault(a, b) == b and back.setdefault(b, a) == a and a != b and b not in dict.fromkeys(x for _, t in docs for x in pattern.findall(t))


def test_licences_against_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    notices = [" ".join(t.words) for t in license_scan.BASE + license_scan.TEMPLATES]
    rows = []
    for i in range(150):
        words = [rng.choice(["the", "of", "license", "copy", "any", "Software", "zu", "été"]) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            n = rng.choice(notices).split()
            if rng.random() < 0.6:
                for _ in range(rng.randrange(1, 1 + len(n) // 4 + 1)):
                    at = rng.randrange(len(n))
                    n[at : at + rng.randrange(2)] = rng.choice([[], ["um"], ["um", "so"]]) if len(n) > 1 else ["um"]
            words += rng.choice([n, n[: len(n) // 2 + 1], n[len(n) // 3 :]])
        rows.append((i, rng.choice([" ", "-", ", "]).join(words).title()))
    rows += [(500, None), (501, ""), (502, "CC BY " * 400), (503, "all rights reserved")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = license_scan.op8_licenses(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(license_scan.SQL)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
    assert got.where("labels <> base_labels").count() > 40


def test_notices_of_whole_templates(spark):
    mit = next(t for t in license_scan.TEMPLATES if t.label == "mit" and len(t.words) > 50)
    edited = list(mit.words)
    edited[20:20] = ["my", "own"]
    del edited[60:64]
    rows = [(1, " ".join(mit.words)), (2, " ".join(edited)), (3, " ".join(mit.key)), (4, " ".join(w for w in mit.words if w not in mit.key)), (5, " ".join(edited[: len(edited) * 9 // 10]))]
    rows += [(10 + i, " ".join(mit.words[40:])) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {x.label: x.cover for x in r.licences} for r in license_scan.scan(df, license_scan.document_frequencies(df)).collect()}
    assert got[1] == {"mit": 1.0} and 0.9 < got[2]["mit"] < 1.0 and got[3] == got[4] == {} and 0.5 <= got[5]["mit"] < 0.95


def test_tokens_of_repeated_rows_in_small_blocks(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    same = "the same text, in every row  \n"
    rows = [(7, same)] * 1500 + [(8, "x" * 5000 + " é 中文\r\n\t "), (None, None)] + [(100 + i, f" {i} 'll  don't{i * '!'} {chr(0x400 + i)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.mode("overwrite").parquet(path_ := T.shared_folder(spark) + "/bpe-rows")
    df = spark.read.parquet(path_)
    sizes = [len(r.ids) for r in df.mapInArrow(bpe._pack_texts(2000), "block long, ids array<long>, texts binary").collect()]
    assert max(sizes) <= 2000 // len(same) + 40 and sum(sizes) == len(rows)
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in bpe.encode(df, path, P.PATTERN, 2000, True).collect())
    assert got == sorted((str(i), want.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)


def test_quality_of_a_text_depends_on_nothing_else():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(32, 127, int(n)).astype(np.uint8)).decode() for n in rng.integers(0, 700, 120)] + ["", None, "ab" * 9000]
    labels = rng.integers(0, 2, 60).astype(np.float32)
    net = quality_cnn.fit([(t or "").encode() for t in texts[:60]], labels)
    alone = np.concatenate([quality_cnn.probabilities(net, pa.array([t], pa.string())) for t in texts])
    order = rng.permutation(len(texts))
    together = quality_cnn.probabilities(net, pa.array([texts[i] for i in order], pa.string()))
    assert np.abs(alone[order] - together).max() < 1e-6
    # And is what a plain loop over chunks, windows and filters gives.
    for t in (texts[0], texts[5], ""):
        data = (t or "").encode()
        s, halves = quality_cnn._symbols(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        n = int(halves[0]) * quality_cnn.HALF
        y = {p: net["embed"][s[p : p + quality_cnn.WIDTH]].reshape(-1) @ net["filters"] + net["bias"] for p in range(0, n - quality_cnn.WIDTH + 1, quality_cnn.STRIDE)}
        chunks = [np.maximum(np.max([v for p, v in y.items() if k * quality_cnn.HALF <= p < (k + 2) * quality_cnn.HALF], axis=0), 0) for k in range(int(halves[0]) - 1)]
        p = 1 / (1 + np.exp(-(np.mean(chunks, axis=0) @ net["out"] + net["last"])))
        assert abs(p - quality_cnn.probabilities(net, pa.array([t]))[0]) < 1e-5


def test_quality_gradient():
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (40, 300, 900)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    s, h = quality_cnn._symbols(data, bounds)
    y, w = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    net = {k: v.astype(np.float64) for k, v in quality_cnn.fit([], np.zeros(0, np.float32)).items()}
    net["out"] = rng.normal(0, 0.3, quality_cnn.FILTERS)
    g = quality_cnn._gradient(net, s, h, y, w)

    def loss(net):
        p = quality_cnn._probability(net, quality_cnn._chunks(quality_cnn._tops(net, s, h)[0], h)[2])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.5e-4 * np.square(net["out"]).sum()

    for key in ("out", "filters", "embed", "bias"):
        at = np.unravel_index(np.argmax(np.abs(g[key])), g[key].shape)
        up, down = ({k: v.copy() for k, v in net.items()} for _ in range(2))
        up[key][at] += 1e-3
        down[key][at] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - g[key][at]) < 0.05 * abs(g[key][at]) + 1e-5


def test_toxic_scores_against_dictionaries(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 30))) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    raw = toxicity._counts(df)
    model = toxicity._model(raw)
    pairs = [(t, set(zip(["<s>", *text.split()], text.split()))) for _, text, t in rows]
    n = [Counter(p for t, ps in pairs if t == c for p in ps) for c in (0, 1)]
    share = [max(sum(n[c].values()) / min(sum(x.values()) for x in n), 1) for c in (0, 1)]
    words = sorted({b for c in n for _, b in c})
    unigram = [{w: sum(k for (_, b), k in n[c].items() if b == w) for w in words} for c in (0, 1)]
    backed = {w: len({a for c in n for a, b in c if b == w}) for w in words}
    own = [{w: max(unigram[c][w] - toxicity.DISCOUNT * share[c], 0) + share[c] * (toxicity.BACK_OFF * backed[w] + toxicity.ANY_WORD) for w in words} for c in (0, 1)]
    for c in (0, 1):  # the two marks have the back-off for any word
        total = sum(own[c].values()) + 2 * share[c] * toxicity.ANY_WORD
        own[c] = {w: x / total for w, x in own[c].items()}
    text = rows[0][1]
    want = 0.0
    for a, b in zip(["<s>", *text.split()], text.split()):
        logs = []
        for c in (0, 1):
            after = [k for (x, _), k in n[c].items() if x == a]
            left = sum(min(k, toxicity.DISCOUNT * share[c]) for k in after) + toxicity.PAIR_BACK_OFF * share[c]
            base = left * own[c][b] + share[c] * toxicity.ANY_PAIR
            logs.append(np.log((max(n[c][a, b] - toxicity.DISCOUNT * share[c], 0) + base) / base) + np.log(own[c][b]) + np.log(left / (sum(after) + toxicity.PAIR_BACK_OFF * share[c])))
        want += logs[1] - logs[0]
    data = np.frombuffer(text.encode(), np.uint8)
    assert abs(toxicity._evidence(model, data, np.array([0, len(data)]))[0, 0] - want / len(text.split())) < 1e-3


def test_toxic_model_within_its_bounds(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.2))}" for _ in range(60)), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    whole = toxicity._counts(df)
    monkeypatch.setattr(toxicity, "MODEL_PAIRS", 100)
    few = toxicity._counts(df)
    assert 0 < len(few["pairs"]) <= 100 < len(whole["pairs"]) and len(few["words"]) == len(whole["words"])
    least = (few["pair_n"] / few["share"][:, None]).max(0).min()
    rest = ~np.isin(whole["pairs"], few["pairs"])
    assert (whole["pair_n"][:, rest] / whole["share"][:, None]).max() <= least
    a, b = toxicity._model(whole), toxicity._model(few)
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    x, y = (toxicity._evidence(m, data, np.array([0, len(data)]))[0, 0] for m in (a, b))
    assert abs(x - y) <= np.log(1 + least / toxicity.ANY_PAIR)


def test_toxic_words_and_pairs_beyond_the_broadcast_count(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % 400) + (" you rotten thing" if i % 3 == 0 else "") for i in range(240)]
    rows = [(i, t, int(i % 3 == 0)) for i, t in enumerate(texts)] + [(None, "", 0), (7, None, 1), (7, "w1 rotten rotten new", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")

    def scores():
        return sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, *(round(x, 4) for x in (r.score, r.mean_ratio, r.top_ratio, r.top_words))) for r in toxicity.score(df, toxicity.train(df)).collect())

    whole = scores()
    for words, pairs in ((20, 50), (20, 1 << 20), (1 << 20, 50)):
        monkeypatch.setattr(toxicity, "MODEL_WORDS", words)
        monkeypatch.setattr(toxicity, "MODEL_PAIRS", pairs)
        assert np.allclose(scores(), whole, atol=2e-4)
