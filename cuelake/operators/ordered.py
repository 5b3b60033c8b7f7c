"""Previous rows and running sums over an order, without a whole group in one task.

A window over ``keys`` puts all rows of a key into one task. Here a key is cut into blocks of its integer order column; the
windows run over (key, block), and only one summary row of each block goes through a window over the key. The rows are
exchanged once, by (key, block), for the window and for the join that brings the summary back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length of a block in the order column.
BLOCK = 4096


def _blocked(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("_blk", F.floor(F.col(order) / BLOCK).cast("long"))


def with_previous(rows: DataFrame, keys: list[str], order: str, columns: list[str], name: str = "_prev") -> DataFrame:
    """Adds ``name``, a struct of ``columns`` of the row before in the order of the key; null for the first."""
    at = [*keys, "_blk"]
    blocked = _blocked(rows, order)
    last = blocked.groupBy(*at).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_blk"))).select(*at, "_carry")
    inner = blocked.withColumn("_in", F.lag(F.struct(*columns)).over(Window.partitionBy(*at).orderBy(order)))
    return inner.join(carry, at).withColumn(name, F.coalesce("_in", "_carry")).drop("_in", "_carry", "_blk")


def with_running_sum(rows: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``column`` over the rows of the key up to and with this one."""
    at = [*keys, "_blk"]
    blocked = _blocked(rows, order)
    sums = blocked.groupBy(*at).agg(F.sum(column).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(*at, "_carry")
    inner = blocked.withColumn("_in", F.sum(column).over(Window.partitionBy(*at).orderBy(order)))
    return inner.join(carry, at).withColumn(name, F.col("_in") + F.col("_carry")).drop("_in", "_carry", "_blk")
