"""Places of rows in a total order, without a window over all of them.

Rows are range-partitioned by the order and numbered inside each partition; what the partitions before one hold is a prefix sum over
one row per partition. So a single group of any size is ranked by all tasks at once, and no task sees more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnscope.sources.stored import stored

#: monotonically_increasing_id() keeps the partition above this bit and the row's place in it below.
_SEAT_BITS = 33


def global_places(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """df with `name`, a row's number from 0 in the order of all rows. The result reads a stored table (discard() it when done).

    Equal keys share a partition: give an order that tells the rows of a hot key apart, or count them first.
    """
    seated = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seat", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_seat", _SEAT_BITS)
    sizes = seated.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # a row a partition: this window and what is broadcast are as small as their number
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = seated.join(F.broadcast(before), part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_seat").bitwiseAND(F.lit((1 << _SEAT_BITS) - 1)))
    out = placed.drop("_seat", "_part", "_before")
    out._stored_at = seated._stored_at
    return out


def running_totals(df: DataFrame, value: Column, *order: str | Column, name: str = "before") -> DataFrame:
    """df with `name`, the sum of value over all rows before a row in the order of all rows. The result reads a stored table (discard() it when done).

    Sums inside a range are windows over that range alone; what lies before a range is a prefix sum over one row per range.
    """
    seated = stored(df.withColumn("_value", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seat", F.monotonically_increasing_id()), "totals")
    seated_part = seated.withColumn("_part", F.shiftright("_seat", _SEAT_BITS))
    sums = seated_part.groupBy(F.col("_part").alias("_of")).agg(F.sum("_value").alias("_n"))
    # a row a partition, as above
    start = sums.select("_of", (F.sum("_n").over(W.orderBy("_of")) - F.col("_n")).alias("_start"))
    inside = F.sum("_value").over(W.partitionBy("_part").orderBy("_seat").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_value")
    out = seated_part.withColumn("_inside", inside).join(F.broadcast(start), F.col("_part") == F.col("_of")).withColumn(name, F.col("_start") + F.col("_inside"))
    out = out.drop("_seat", "_part", "_of", "_start", "_inside", "_value")
    out._stored_at = seated._stored_at
    return out
