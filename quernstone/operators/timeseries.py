"""Ordered and as-of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.blocks import carried, numbered


def quarter_split(df: DataFrame, group: str, order: str, bucket: str) -> DataFrame:
    """Add ``split``: the first and third quarter of every group are ``train``, the others ``test`` (quarters cut by whole division)."""
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    df = numbered(df, [group], [order], bucket).join(n, group)
    third = (F.col("_i") >= F.expr("_n div 2")) & (F.col("_i") < F.expr("(3 * _n) div 4"))
    return df.withColumn("split", F.when((F.col("_i") < F.expr("_n div 4")) | third, "train").otherwise("test")).drop("_i", "_n")


def linear_clock_join(left: DataFrame, right: DataFrame, group: str, left_index: str, right_index: str, offset: float, rate: float) -> DataFrame:
    """Left rows with the right row of index int(offset + left index * rate); its columns null if negative or absent."""
    at = (F.lit(offset) + F.col(left_index) * rate).cast("bigint")
    keyed = left.withColumn("_at", F.when(at >= 0, at))
    r = right.withColumnRenamed(group, "_g")
    return keyed.join(r, (F.col(group) == F.col("_g")) & (F.col("_at") == F.col(right_index)), "left").drop("_g", "_at")


def nearest_any(left: DataFrame, right: DataFrame, group: str, time: str, ident: str, bucket: str) -> DataFrame:
    """(group, time, ident, gap) of every distinct left instant: the right row nearest in time, no tolerance.

    Both sides are unioned by instant; the last right row at or before and the first at or after each instant are
    carried over, bucket by bucket. Equal distance: smaller id. Groups without right rows are left out; unset times and
    groups too.
    """
    known = F.col(group).isNotNull() & F.col(time).isNotNull()
    a = left.where(known).select(group, time).distinct().select(group, time, F.lit(None).cast("bigint").alias("_id"))
    b = right.where(known).groupBy(group, time).agg(F.min(ident).alias("_id"))
    mark = F.when(F.col("_id").isNotNull(), F.struct(F.col(time).alias("t"), F.col("_id").alias("id")))
    both = carried(a.unionByName(b), [group], [time], bucket, mark, "_before")
    both = carried(both, [group], [time], bucket, mark, "_after", backward=True).where("_id IS NULL")

    def candidate(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(time) - F.col(f"{c}.t")).alias("gap"), F.col(f"{c}.id").alias("id")))

    best = both.withColumn("_best", F.least(candidate("_before"), candidate("_after"))).where("_best IS NOT NULL")
    return best.select(group, time, F.col("_best.id").alias(ident), F.col("_best.gap").alias("gap"))


def hold_last(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, bucket: str) -> DataFrame:
    """Add ``out``: the value, or the last one known before it in its group; null if there is none yet."""
    return carried(df, group, order, bucket, F.col(value), out)
