"""Union of intervals per entity: continuous periods and the gaps between them.

The core is an ordered map of disjoint intervals per key (``IntervalMap``): an insertion finds the intervals
that it overlaps or touches by binary search and replaces them by their union. One entity may hold a large part of
all rows, so an entity is split into time buckets by interval start; a task only ever holds the map of one bucket,
and the buckets of an entity are tied together through one summary row each:

1. keyed state per (entity, bucket): the bucket's disjoint intervals, whose ends may lie beyond the bucket;
2. ``carry``: the latest end in earlier buckets of the entity (a window over one number per bucket). An interval
   begins a period of the whole if it starts after the carry, as intervals of one bucket neither overlap nor touch;
3. each such beginning knows the end of the period before it, so gaps come out at once; the end of the last period
   begun in a bucket is what the next bucket with a beginning saw as the end before (a second window).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.session import materialise, partitions_for

#: Length of a time bucket in the unit of the intervals (here ten minutes of milliseconds).
BUCKET = 600_000


class IntervalMap:
    """Ordered disjoint intervals; intervals that overlap or touch become one."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: Sequence[int] = (), ends: Sequence[int] = ()) -> None:
        self.starts, self.ends = list(starts), list(ends)

    def insert(self, start: int, end: int) -> None:
        lo = bisect_left(self.ends, start)  # the first that ends at or after the start
        hi = bisect_right(self.starts, end)  # one past the last that starts at or before the end
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:], strict=False))

    def __len__(self) -> int:
        return len(self.starts)


def _bucket_maps(keys: list[str], schema: pa.Schema):
    """Feed rows sorted by key into one map after the other; a row per key comes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, IntervalMap()
        rows: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                rows = []

        def done() -> None:
            if current is not None:
                rows.append((*current, held.ends[-1], [{"f": s, "t": e} for s, e in zip(held.starts, held.ends, strict=True)]))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for key, start, end in zip(zip(*columns, strict=True), batch.column("_f").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                if key != current:
                    done()
                    current, held = key, IntervalMap()
                    if len(rows) >= 2000:
                        yield from flush()
                held.insert(start, end)
        done()
        yield from flush()

    return run


def bucket_periods(df: DataFrame, entity: list[str], start: Column, end: Column, bucket: int = BUCKET) -> DataFrame:
    """Disjoint intervals of each (entity, bucket): ``entity..., _bucket, _end, _periods``."""
    ready = df.select(*entity, start.cast("long").alias("_f"), end.cast("long").alias("_t")).where("_t > _f")
    ready = ready.withColumn("_bucket", F.floor(F.col("_f") / bucket).cast("long"))
    keys = [*entity, "_bucket"]
    fields = [ready.schema[k] for k in keys]
    periods = T.ArrayType(T.StructType([T.StructField("f", T.LongType()), T.StructField("t", T.LongType())]))
    out = T.StructType([*fields, T.StructField("_end", T.LongType()), T.StructField("_periods", periods)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    return ready.repartition(partitions_for(ready), *keys).sortWithinPartitions(*keys).mapInArrow(_bucket_maps(keys, arrow), out)


def merge_intervals(df: DataFrame, entity: list[str], start: Column, end: Column, bucket: int = BUCKET) -> DataFrame:
    """Rows ``entity..., kind ('period' | 'gap'), from_ms, to_ms``.

    Intervals with a null time or an end not after the start do not count; repeated rows change nothing. Null entity
    keys form an entity of their own. An empty table gives no rows. Columns of ``df`` other than those named by
    ``entity``, ``start`` and ``end`` are dropped, so clashing names do no harm.
    """
    local = materialise(bucket_periods(df, entity, start, end, bucket))
    by = Window.partitionBy(*entity).orderBy("_bucket")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(1, Window.unboundedFollowing)
    keys = [*entity, "_bucket"]

    def on(left: str, right: str) -> Column:
        same = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
        out = same[0]
        for x in same[1:]:
            out = out & x
        return out

    carried = local.select(*keys, "_end").withColumn("_carry", F.max("_end").over(before)).select(*keys, "_carry")
    tied = local.alias("l").join(carried.alias("c"), on("l", "c")).select("l.*", "c._carry")
    # Begun periods with the end before them; only the first of a bucket can look back over the bucket's edge.
    begun = F.expr(
        "filter(transform(_periods, (p, i) -> named_struct('f', p.f, 't', p.t, 'e', "
        "greatest(_carry, CASE WHEN i > 0 THEN _periods[i - 1].t END))), p -> p.e IS NULL OR p.f > p.e)"
    )
    tied = tied.withColumn("_begun", begun).drop("_periods")
    tied = tied.withColumn("_seen", F.when(F.size("_begun") > 0, F.struct(F.element_at("_begun", 1)["e"].alias("e"))))
    tied = materialise(tied)
    ahead = tied.select(*keys, F.first("_seen", ignorenulls=True).over(after).alias("_next"), F.max("_end").over(Window.partitionBy(*entity)).alias("_last"))
    whole = tied.where(F.size("_begun") > 0).alias("l").join(ahead.alias("c"), on("l", "c")).select("l.*", "c._next", "c._last")
    rows = F.expr(
        "flatten(transform(_begun, (p, i) -> array("
        "named_struct('kind', 'period', 'f', p.f, 't', coalesce(CASE WHEN i + 1 < size(_begun) THEN _begun[i + 1].e END, _next.e, _last)),"
        "named_struct('kind', 'gap', 'f', p.e, 't', p.f))))"
    )
    return (
        whole.select(*entity, F.explode(rows).alias("_r"))
        .where("_r.f IS NOT NULL")
        .select(*entity, F.col("_r.kind").alias("kind"), F.col("_r.f").alias("from_ms"), F.col("_r.t").alias("to_ms"))
    )


def milliseconds(seconds: str) -> Column:
    """Whole milliseconds of a column of seconds, halves to the even one; null, NaN and infinite times give null."""
    value = F.col(seconds)
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(9.0e12))
    return F.when(good, F.rint(value * 1000).cast("long"))
