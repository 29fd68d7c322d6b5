"""Consecutive ids for new rows without sorting all of them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import staged


def numbered(rows: DataFrame, order: str, top: DataFrame) -> DataFrame:
    """rows with an id: their rank by order behind the number in top(top), one row.

    Rows are dealt to ranges of order and staged; a range's ids start behind the rows of the ranges before it.
    """
    rows = staged(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_part").count().select("_part", before.alias("_before"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    out = rows.withColumn("_rank", rank).join(F.broadcast(starts), "_part").join(F.broadcast(top))
    return out.withColumn("id", F.col("top") + F.col("_before") + F.col("_rank")).drop("_part", "_before", "_rank", "top")


def running(rows: DataFrame, key: str, order: str, **sums: str) -> DataFrame:
    """rows with running totals name=column by key in order; a key's rows are dealt to ranges, so one key may have any number.

    Only keys that span ranges have totals to carry over: at most one row a range, which is broadcast.
    """
    dealt = rows.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt, "running")
    upto = Window.partitionBy("_part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(key, "_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    carried = parts.select(key, "_part", *(F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums)).filter(F.col(f"_{next(iter(sums))}").isNotNull())
    out = dealt.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}).join(F.broadcast(carried), [key, "_part"], "left")
    return out.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in sums}).drop("_part", *(f"_{n}" for n in sums))
