"""Positions in a report's order (T1-T3, T6), as a column.

Rows are dealt by ranges of the order and sorted within, so no task sees all of them; a row's number is its place
in its range behind the sizes of the ranges before it, of which there is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import written

#: The lower bits of monotonically_increasing_id count a partition's rows, the upper ones partitions.
PLACE_BITS = 33


def positions(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """rows with their number from 1 in `order`, which should end in something that no two rows share."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(dealt, "ordered")
    part = F.shiftright("_at", PLACE_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_part", part).join(starts, "_part")
    place = F.col("_at") - F.call_function("shiftleft", F.col("_part"), F.lit(PLACE_BITS))
    return numbered.withColumn(name, F.col("_start") + place + 1).drop("_at", "_part", "_start")
