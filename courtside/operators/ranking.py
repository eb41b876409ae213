"""Places in one order over a whole table, without a window over all its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.sources.storage import scratch

PART, AT = "_part", "_at"


def numbered(rows: DataFrame, order: list[Column | str], place: str = "place", weight: str | None = None) -> DataFrame:
    """rows with ``place``: how many rows come before, or the sum of their ``weight`` (whole numbers).

    Rows go to range partitions, are sorted there and written once, with their number in the partition. A partition's
    offset is what the partitions before it hold; these offsets, one row a partition, are all that passes through one
    task. ``order`` should tell rows apart: equal rows meet in one partition, and which comes first is left open.
    """
    path = scratch(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The low 33 bits of the id count the rows of a partition, from 0.
    ranged.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).write.parquet(path)
    kept = rows.sparkSession.read.parquet(path)
    held = F.count(F.lit(1)) if weight is None else F.sum(weight)
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy(PART).agg(held.alias("_held")).select(PART, F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    if weight is None:
        within = F.col(AT)
    else:
        within = F.coalesce(F.sum(weight).over(Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a range partition.
    return kept.join(F.broadcast(offsets), PART).withColumn(place, (F.col("_before") + within).cast("long")).drop(PART, AT, "_before")
