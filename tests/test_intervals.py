import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows_of
from cuelake.operators.intervals import IntervalMap, merge_intervals


def brute(intervals):
    out = []
    for s, e in sorted(i for i in intervals if i[1] > i[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_interval_map_is_the_union(pairs):
    held = IntervalMap()
    for s, n in pairs:
        held.insert(s, s + n)
    want = brute([(s, s + n) for s, n in pairs])
    assert list(zip(held.starts, held.ends, strict=True)) == want
    assert held.gaps() == [(a[1], b[0]) for a, b in zip(want, want[1:], strict=False)]


@pytest.mark.parametrize("bucket", [7, 50, 10_000])
def test_merge_equals_brute_force_whatever_the_buckets(spark, bucket):
    rng = random.Random(bucket)
    rows = [(k, s, s + rng.choice([0, 1, 2, 5, 60, -3])) for k in ("a", "b", None) for s in [rng.randrange(500) for _ in range(60)]]
    rows += [("a", 100, 333), ("c", 5, None), ("c", None, 6), ("d", 1, 2), ("d", 1, 2)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = rows_of(merge_intervals(df, ["k"], F.col("s"), F.col("e"), bucket))
    want = []
    for k in ("a", "b", None, "d"):
        union = brute([(s, e) for x, s, e in rows if x == k and s is not None and e is not None])
        want += [(k, "period", s, e) for s, e in union] + [(k, "gap", a[1], b[0]) for a, b in zip(union, union[1:], strict=False)]
    assert got == sorted(want, key=repr)


def test_merge_of_nothing(spark):
    assert merge_intervals(spark.createDataFrame([], "k string, s long, e long"), ["k"], F.col("s"), F.col("e")).count() == 0
