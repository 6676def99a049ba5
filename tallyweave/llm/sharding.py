"""Contiguous shards of near equal bytes, from global prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored


def balanced_shards(rows: DataFrame, size: str, shards: int) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: the order of the scan (in a file, its rows' order; Spark packs files by size) is kept
    and cut at equal byte targets.

    Each scan partition is summed on its own, the totals (one row a partition) are accumulated, and a row's
    prefix is its partition's start plus a running sum inside the partition, so no task holds more than one
    input split and no key groups rows. A row goes to the shard in which its middle byte falls.

    ``size`` must be a non-negative long; null counts as 0. Repeated rows, null ids and ties need no rule, for
    rows are told apart by their place. An empty table gives no rows. A row larger than a shard's target
    leaves neighbouring shards empty rather than being cut. Other columns stay; ones named shard or slot are replaced.
    """
    rows = rows.drop("shard", "slot")
    placed = stored(rows.withColumn("__at", F.monotonically_increasing_id()), "shards").withColumn("__part", F.shiftright("__at", 33))
    bytes_ = F.coalesce(F.col(size), F.lit(0))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    starts = (
        placed.groupBy("__part")
        .agg(F.sum(bytes_).alias("__b"), F.count("*").alias("__n"))
        .select(
            "__part",
            F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("__b0"),
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
            F.sum("__b").over(every).alias("__all"),
        )
    )
    inside = Window.partitionBy("__part").orderBy("__at")
    prefix = F.col("__b0") + F.sum(bytes_).over(inside) - bytes_
    numbered = placed.join(starts, "__part").select(
        *rows.columns,
        (F.col("__n0") + F.row_number().over(inside) - 1).alias("__row"),
        F.struct(prefix.alias("pre"), bytes_.alias("size"), F.col("__all").alias("all")).alias("__x"),
    )
    cut = numbered.withColumn(
        "shard",
        F.when(F.col("__x.all") == 0, F.lit(0))
        .otherwise(F.least(F.lit(shards - 1), F.expr(f"(2 * __x.pre + __x.size) * {shards}L div (2 * __x.all)")))
        .cast("int"),
    )
    first = cut.groupBy("shard").agg(F.min("__row").alias("__first"))  # one row a shard
    return cut.join(F.broadcast(first), "shard").select(*rows.columns, "shard", (F.col("__row") - F.col("__first")).alias("slot"))
