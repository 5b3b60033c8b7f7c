"""Every query of the core over edge cases and empty tables; results against DuckDB on the smallest tables."""

import math
import os
import re
import sys
import unicodedata

import duckdb
import pytest
from conftest import write_tables

from cuelake.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_edge_and_empty_tables(spark, edge_folder, empty_folder, name):
    a = QUERIES[name](spark, edge_folder)
    a.collect()
    b = QUERIES[name](spark, empty_folder)
    rows = b.collect()
    assert len(rows) <= 1
    assert {f.name for f in a.schema} == {f.name for f in b.schema} or name.startswith("p5_")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_summary_replies_hold_whole_texts(spark, tmp_path):
    """Quotes, braces, line breaks, odd Unicode and long texts come back as they went in, without white space around."""
    head = "forty characters of plain text and more. "
    odd = ['"quoted" \\ and \\n', "{a} }{ ```json {}```", "line\nbreak\r\nand\ttab\x85\u2028x", "\U0001f600 e\u0301 \u0000\u0007 \ufeff \U0010ffff", "ends in space \u3000\u00a0\n", "[1, 2] } end }", "word " * 60_000]
    texts = [*(head + t for t in odd), *odd, None, "", " \n ", head + "{" * 5000]
    rows = [(i, t, "en" if i % 2 else None, " src ", 1, "notes" if i % 3 else None, 1, None) for i, t in enumerate(texts)]
    folder = write_tables(spark, tmp_path, {"documents": rows})
    white = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c in "\t\n\v\f\r" or unicodedata.category(c)[0] == "Z")
    want = {i: ((kind or "").strip(white), (t or "").strip(white), "\n".join(x for x in ((source or "").strip(white), lang) if x), "") for i, t, lang, source, _, kind, _, _ in rows}
    got = {r.doc_id: (r.tldr, r.summary, r.key_points, r.action_items) for r in QUERIES["summary_replies"](spark, folder).collect()}
    assert got.keys() == want.keys()
    assert [i for i in want if got[i] != want[i]] == []


def test_model_chapters_of_long_recordings(spark, tmp_path):
    """Long recordings take the model's path too: every line named, filled from the first line, or the local chapters."""
    words = "bridge storm kitchen river copper violin meadow lantern harbour sugar window engine".split()
    rows = [(m, i, 1, 30.0 * i, 30.0 * i + 20, f"{words[(i * m) % 12]} {words[(i + m) % 12]} number{i} came along take{m}", "A", None) for m in range(1, 25) for i in range(20)]
    folder = write_tables(spark, tmp_path, {"segments": rows, "transcripts": [(m, 1, "en", 600.0, None, "", "", None, []) for m in range(1, 25)]})

    def found(name):
        out = {}
        for r in QUERIES[name](spark, folder).collect():
            out.setdefault(r.media_id, []).append((r.chapter_no, r.start_s, r.title))
        return {m: sorted(c) for m, c in out.items()}

    made, local = found("model_chapters"), found("topic_chapters")
    assert made.keys() == set(range(1, 25))
    # A chapter that the model names has the first three words of a bucket; of neighbours nearer than a chapter's least length the last title stays.
    named = {m: sum(bool(re.fullmatch(r"\w+ \w+ number\d+", t)) for _, _, t in c) for m, c in made.items()}
    whole = [m for m in made if named[m] >= 9]
    filled = [m for m in made if m not in whole and made[m] != local[m]]
    fallen = [m for m in made if made[m] == local[m]]
    assert whole and filled and fallen
    assert len(whole) > len(fallen)
    assert all(made[m][0][1] == 0.0 and len(made[m]) >= 3 for m in filled)
