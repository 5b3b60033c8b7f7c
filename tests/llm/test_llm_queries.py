"""Every language query over edge cases and empty tables, and against SQL where there is one."""

import os

import duckdb
import pytest

from conftest import write_tables
from cuelake import llm

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_edge_and_empty_tables(spark, edge_folder, empty_folder, name):
    a = QUERIES[name](spark, edge_folder)
    a.collect()
    b = QUERIES[name](spark, empty_folder)
    assert b.count() == 0
    assert a.columns == b.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_found_columns(spark, edge_folder):
    want = {
        "p1_found": ["media_id", "char_from", "char_to"], "p2_found": ["media_id", "term"], "p3_found": ["media_id", "seg_ix", "lang"], "p4_found": ["media_id", "seg_ix", "pii_type", "occurrence"],
        "p6_found": ["media_id", "first_seg_ix", "last_seg_ix"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "category"],
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, edge_folder)
        assert df.columns == columns
        assert df.count() == df.distinct().count()


def test_terms_of_a_recording_with_a_third_of_all_tokens(spark, tmp_path):
    """A case there may be less likely than in the rest (z below 0); the counts decide."""
    hot = [(1, i, 1, float(i), i + 1.0, "quartz" if i < 3 else "filler", "A", None) for i in range(100)]
    small = [(2, i, 1, float(i), i + 1.0, "quartz" if i < 7 else "padding", "A", None) for i in range(10)]
    rest = [(3 + i // 10, i % 10, 1, 0.0, 1.0, "padding", "A", None) for i in range(190)]
    folder = write_tables(spark, tmp_path, {"segments": [*hot, *small, *rest]})
    z = {(r.media_id, r.term): r.z for r in QUERIES["p2_scores"](spark, folder).collect()}
    assert z[1, "quartz"] < 0
    got = {tuple(r) for r in QUERIES["p2_found"](spark, folder).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW segments AS SELECT * FROM '{folder}/segments.parquet/*.parquet'")
    assert got == set(con.sql(SQL["p2_found"]).fetchall()) == {(1, "quartz"), (1, "filler"), (2, "quartz")}
