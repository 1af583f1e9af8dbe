"""Every query with SQL gives the same rows in DuckDB; every other query runs."""

import glob
import os
import unicodedata

import duckdb
import pytest

from folioflow.plans import catalog

from .conftest import SMALL


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [normal(x) for x in v]
    return float(v) if hasattr(v, "is_finite") else v


def lines(rows):
    return sorted(str([(k, normal(r[k])) for k in sorted(r)]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    got = [r.asDict(True) for r in df.collect()]
    cur = duck.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert lines(got) == lines(dict(zip(cols, r)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, table, key", [("overlap_join", "events", "event_id"), ("centre_weighted_mean", "embeddings", "vec_id")])
def test_no_row_is_left_out(spark, name, table, key):
    """Every interval overlaps itself; every box holds its own centre."""
    got = {r.id for r in catalog.QUERIES[name](spark, SMALL).select("id").collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()}


def test_whole_literals(spark):
    from folioflow.operators.blocks import forbidden_hits

    long = "x" * 45
    items = [f"{long} One two", f"{long} One three", "two", "b  c d", None, "e f", "", "c", "é", "ab", "😀x", "straße"]
    docs = [(1, f"a{long} ONE twofold"), (2, "ab  c de"), (3, "e\u00a0f"), (4, None), (5, ""), (6, f"{long} one"), (7, "cafe\u0301 😀X"), (8, "STRASSE"), (None, "two")]
    got = forbidden_hits(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i,) for i in items], "text string"), "doc_id")
    plain = lambda t: " ".join(unicodedata.normalize("NFC", t).split()).casefold()
    assert {r.doc_id: r.forbidden for r in got.collect()} == {d: sum(plain(i) in plain(t) for i in items if i is not None) if t is not None else 0 for d, t in docs}


@pytest.mark.parametrize("name", ["token_coverage_multiset", "ordered_subsequence_flag", "ocr_similarity"])
def test_every_turn_meets_its_successor(spark, name):
    turns = {(r.conv_id, r.turn) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn) for r in catalog.QUERIES[name](spark, SMALL).collect()}
    assert got == {(c, t) for c, t in turns if (c, t + 1) in turns}
