"""Centroid clustering, dominance counting and HTML extraction against plain Python, and their odd rows."""

import datetime as dt
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lumenary.llm import ann, centroids, dominance, html_text


def clustered(rows, k, rounds, seed, scale):
    """(vec_id, vector) to the rows of cluster(), with whole numbers of Python."""
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for j in range(len(c)):
            part = [v for (_, v), o in zip(rows, own) if o == j]
            if part:
                c[j] = [sum(x) // len(part) for x in zip(*part)]
    got = [(i, near(v)) for i, v in rows]
    of = lambda j: sum(d for _, (d, o) in got if o == j)
    return sorted(((i, j, d, of(j), sum(x[1][0] for x in got), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in got), key=str)


def _clusters(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk, spread", [(8192, 0.05), (50, 0.05), (64, 2.0)])
def test_clusters_against_whole_numbers(spark, monkeypatch, chunk, spread):
    monkeypatch.setattr(centroids, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(7, 5))
    rows = [(i, (middles[i % 7] + spread * rng.normal(size=5)).astype("f4").tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 0.0, 1.0]) for i in range(150)] + [(5, rows[5][1]), (None, rows[6][1])]  # one large group of copies
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert _clusters(centroids.cluster(table, 9, 4, 2, 5, 256)) == clustered(rows, 9, 4, 2, 256)


def test_clusters_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 9), (2, None, 9), (3, [], 9), (4, [1.0], 9), (5, [None, 1.0], 9), (6, [float("nan"), 1.0], 9), (7, [float("inf"), 1.0], 9), (None, [1.0, 3.0], 9), (1, [1.0, 2.0], 9), (8, [-1.0, -2.0], 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").withColumnRenamed("cluster", "distance")
    kept = [r[:2] for r in rows if r[0] in (None, 1, 8)]
    assert _clusters(centroids.cluster(table, 40, 5, 2, 2)) == clustered(kept, 40, 5, 2, 256)
    assert centroids.cluster(table.where("vec_id < 0"), 40, 5, 2, 2).count() == 0
    with pytest.raises(Exception, match="would not be exact"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 1.0])], "vec_id long, embedding array<float>"), 2, 1, 2, 2).count()


def test_bounds_settle_whole_balls():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-3, 4, (400, 4)) + m for m in ([0, 0, 0, 0], [500, 0, 0, 0], [0, 900, 0, 0])])
    t = centroids.tree(x)
    t["data"] = x[t["order"]]
    balls, owners, rows, own, d = centroids.filtered(t, np.array([[1, 0, 0, 0], [500, 1, 0, 0], [0, 900, 0, 1]]))
    assert len(rows) == 0 and t["size"][balls].sum() == len(x) and len(balls) < 10
    assert (t["first"][t["child"][t["child"] > 0]] == t["first"][t["child"] > 0]).all() and t["squares"][0] == np.square(x).sum()


def above(rows):
    """(sale_id, sold_at, total) to what sales_above() gives, by comparing all with all."""
    at = []
    for i, t, v in rows:
        s = None if t is None else (t - dt.datetime(1970, 1, 1)) // dt.timedelta(days=1)
        ok = v is not None and math.isfinite(v) and abs(v) < dominance.MOST_LEVEL // 100
        at.append((i, s, math.floor(math.floor(100 * v + 0.5) / 1000) if ok else None))
    stands = lambda i: 1 if i is None else 1 + zlib.crc32(str(i).encode()) % 3
    known = [x for x in at if None not in x[1:]]
    out = []
    for i, s, v in at:
        up = None if s is None or v is None else [j for j, t, w in known if t < s and w > v]
        out.append((i, s, v, None if up is None else len(up), None if up is None else sum(map(stands, up))))
    return sorted(out, key=str)


@pytest.mark.parametrize("days, most", [(40, 3_000), (3, 60_000_000), (20_000, 50)])
def test_dominance_against_all_pairs(spark, days, most):
    rng = random.Random(days)
    start = dt.datetime(1969, 12, 20)
    rows = [(i, start + dt.timedelta(days=rng.randrange(days), seconds=rng.randrange(86_400), microseconds=rng.randrange(10**6)), round(rng.uniform(-most, most) if i % 9 else 7.0, 2)) for i in range(400)]
    rows += [(5, rows[5][1], rows[5][2]), (None, rows[6][1], rows[6][2]), (-7, None, 3.0), (900, rows[7][1], None), (901, None, None), (902, rows[7][1], float("nan")), (903, rows[7][1], float("inf")), (904, rows[7][1], 1e300), (905, rows[7][1], 5.0)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "sale_id long, sold_at timestamp_ntz, total double, slot string, n_sales int").repartition(3)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Pacific/Auckland"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert sorted(map(tuple, dominance.sales_above(table).collect()), key=str) == above(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert dominance.sales_above(table.where("sale_id < -99")).count() == 0
    assert {r.n_sales for r in dominance.sales_above(table.where("total is null")).collect()} == {None}


def test_dominance_of_times_with_a_zone(spark):
    table = spark.sql("select 1L as sale_id, timestamp'1970-01-01 23:30:00 UTC' as sold_at, 99.0D as total union all select 2L, timestamp'1970-01-02 00:00:00 UTC', 5.0D")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert sorted(map(tuple, dominance.sales_above(table).collect())) == [(1, 0, 9, 0, 0), (2, 1, 0, 1, 1 + zlib.crc32(b"1") % 3)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def texts(markup):
    return [t for _, t in html_text.blocks(markup)]


def test_article_by_tag_role_class_and_page():
    body = "<h1>A &amp; B</h1><p>One  two\n<b>th</b>ree<br>four &eacute;&#8364;&nbsp;x</p><ul><li>first<li>second</ul><table><tr><td>1<td>2<tr><td>3</table>"
    want = ["A & B", "One two three four é€ x", "first", "second", "1 2", "3"]
    around = "<nav><a href=/>Home</a></nav><header><p>Site</p></header><div class='cookie-notice'><p>We use cookies</p></div>"
    after = "<aside><p>Side</p></aside><section id=comments><article class=comment><p>Nice, and a long comment about all of this and more of it!</p></article></section><footer>&copy; all</footer>"
    for begin, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div role=main>", "</div>"), ("<div class=\"entry-content\">", "</div>"), ("<div>", "</div>"), ("<form action=x><article class='post has-sidebar'>", "</article></form>")):
        page = f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t='<p>no</p>';</script></head><body class='has-sidebar'>{around}{begin}{body}{end}{after}</body></html>"
        assert texts(page) == want, begin
    assert texts(f"<article><header><h1>Title</h1></header>{body}<div class=ad>Buy</div><form><p>Mail</p></form><footer>tags</footer></article>") == ["Title", *want]


def test_broken_markup():
    assert texts("<article><p><b>one<br><p>two</b><p>three<!-- <p>no</p> --><p>four</i></div><p>five</article>") == ["one", "two", "three", "four", "five"]
    assert texts("<article><p>cut off <a href='x") == ["cut off"]
    assert texts("<article><p>a < b and c <3 d</p><p title=it's>e</p><p data-x='>'>f</p></article>") == ["a < b and c <3 d", "e", "f"]
    assert texts("<article>loose<p>para</p>tail<script>never ends<p>no") == ["loose", "para", "tail"]
    assert texts("just text &lt;b&gt;") == ["just text <b>"] and texts("") == texts(None) == texts("<p></p>") == []
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert texts(f"<article>{deep}<p>end</article>") == ["deep", "end"]
    assert texts("<p>Text of a page.</p><ul>" + "<li><a href=/x>Link here</a></li>" * 9 + "</ul>") == ["Text of a page."]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "extra", 3) for r in rows], "page_id long, url string, html string, host string, blocks int").repartition(3)


def test_templates_of_a_site_go_and_nothing_else(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    para = lambda n=30: " ".join(word() for _ in range(n))
    shared, copy, rows, want = para(60), [para() for _ in range(4)], [], {}
    for i in range(120):
        own = [para() for _ in range(3)] + ["Short."] * (i % 4 == 0) + [shared] * (i % 3 == 0)
        if i >= 80:  # one article forty times, each a little different
            own = list(copy)
            own[i % 4] += f" {word()}"
        site = f"http://{'WWW.Site' if i % 2 else 'www.site'}.org/{i}"
        rows.append((i, site, "<div id=x1><p>Join our friendly letter now</p></div><article>" + "".join(f"<p>{p}</p>" for p in own) + "<div><p>Read more of this site every day</p></div></article>"))
        want[i] = own
    for i in range(200, 203):  # too few pages to tell
        rows.append((i, "https://few.org", f"<article><p>{para()}</p><p>Same end.</p></article>"))
        want[i] = [rows[-1][2][12:].split("</p>")[0], "Same end."]
    for i in range(300, 320):  # pages of no host are no site
        rows.append((i, None if i % 2 else "no host", f"<p>{para()}</p><p>Same end.</p>"))
        want[i] = [rows[-1][2][3:].split("</p>")[0], "Same end."]
    rows += [(400, "http://www.site.org/empty", None), (401, "http://www.site.org/empty", ""), (None, None, "<p>no id</p>"), (None, None, "<p>no id</p>")]
    want |= {400: [], 401: []}
    for often in (1000, 1):  # hosts that are broadcast, and those that are joined
        html_text.FREQUENT, before = often, html_text.FREQUENT
        try:
            got = html_text.main_text(_pages(spark, rows)).collect()
        finally:
            html_text.FREQUENT = before
        assert len(got) == len(rows) and {r.page_id: r.text.split("\n") if r.text else [] for r in got if r.page_id is not None} == want
        assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id is None] == ["no id"] * 2
    assert html_text.main_text(_pages(spark, rows).where("page_id < 0")).count() == 0


@pytest.mark.parametrize("dim, norms", [(8, False), (16, True)])
def test_neighbours_without_clusters(spark, dim, norms):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(8000, dim))
    v = (v / np.linalg.norm(v, axis=1)[:, None] * (rng.uniform(0.3, 2, (8000, 1)) if norms else 1)).astype("f4")
    table = spark.createDataFrame([(i, [float(x) for x in r], "x") for i, r in enumerate(v)], "vec_id long, embedding array<float>, ids string").repartition(4)
    got = ann.nearest(table).toPandas()
    v, hits = v.astype("f8"), 0
    assert got.groupby("query_id").size().eq(20).all() and got["query_id"].nunique() == 400
    for q, g in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argpartition(-s, 20)[:20]) & set(g["vec_id"]))
    assert hits / 8000 >= 0.93


def test_lists_of_high_numbers_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 4)
    monkeypatch.setattr(ann, "SPLIT", 6)
    x = np.random.default_rng(3).standard_normal((1000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(rows, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: set([i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:5]) for q in range(0, 1000, 20)}
    assert set(got) == set(want) and sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)
