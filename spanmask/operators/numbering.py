"""Global row numbers without a single-task window.

The rows are range-partitioned and sorted by a total order and checkpointed,
so the partition boundaries are fixed.  A row's place in its partition is the
lower part of ``monotonically_increasing_id``; the rows before its partition
come from a join with one running count per partition.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

IN_PARTITION = (1 << 33) - 1


def row_numbers(df: DataFrame, order: list[tuple[Column, bool]], out: str = "pos",
                partitions: int | None = None) -> DataFrame:
    """``df`` plus a 1-based ``out`` column following ``order`` — (key, ascending) pairs, a total order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(k) for (c, _), k in zip(order, keys)])
    sort = [F.col(k).asc() if asc else F.col(k).desc() for (_, asc), k in zip(order, keys)]
    ranged = checkpoint(keyed.repartitionByRange(n, *sort).sortWithinPartitions(*sort).drop(*keys))
    placed = ranged.select("*", F.spark_partition_id().alias("_pid"),
                           F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)).alias("_place"))
    counts = placed.groupBy("_pid").agg((F.max("_place") + 1).alias("_rows"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_pid", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    # one row per partition
    return placed.join(F.broadcast(before), "_pid").withColumn(out, F.col("_before") + F.col("_place") + 1) \
        .drop("_pid", "_place", "_before")
