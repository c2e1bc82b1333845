"""Each registered library query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenary.plans import catalogue

SF = "/root/testdata/sf0.001"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple(None if r[i] is None or isinstance(r[i], float) and math.isnan(r[i]) else str(round(float(r[i]), 8)) if isinstance(r[i], (int, float)) or type(r[i]).__name__ == "Decimal" else str(r[i]) for i in order))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_dbscan_finds_chains(spark):
    from lumenary.operators.density import dbscan

    rows = [(i, [math.cos(i * 0.1), math.sin(i * 0.1)]) for i in range(8)] + [(100, [-1.0, 0.0])]
    got = {r["id"]: r["label"] for r in dbscan(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.994, 3).collect()}
    assert got == {i: 1 for i in range(8)}


def test_annotations_hold_whole_texts(spark, duck):
    from lumenary.sources.views import with_views

    cut = with_views("select count(*) from v_annotation a join documents d on d.doc_id = a.photo_id where a.model = 'm1' and a.caption || a.ocr_text <> d.text")
    assert duck.sql(cut).fetchall() == [(0,)]
    from lumenary.sources.views import table

    assert table(spark, SF, "select count(*) from v_annotation a join documents d on d.doc_id = a.photo_id where a.model = 'm1' and a.caption || a.ocr_text <> d.text").first()[0] == 0
