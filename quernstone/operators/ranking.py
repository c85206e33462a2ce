"""Positions in a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import cut_lineage

#: monotonically_increasing_id keeps the row's place inside its partition in the low 33 bits.
_LOW = 2**33 - 1


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Add the 0-based position of every row in the given order.

    The rows are range-partitioned and sorted, the sorted rows are checkpointed (range bounds come from a sample,
    so they must not be drawn twice), and each row's place inside its partition is shifted by the sizes of the
    partitions before it. Only one count per partition is gathered. Ties must be broken by ``order`` itself for
    a repeatable result. An empty input gives an empty output.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(shifts), "_part")  # at most as many rows as there are partitions
        .withColumn(out, F.col("_shift") + F.col("_place").bitwiseAND(F.lit(_LOW)))
        .drop("_place", "_part", "_shift")
    )
