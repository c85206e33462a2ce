"""Records of two tables paired by nearest time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.keys import set_clock, whole_number


def nearest_in_time(
    left: DataFrame,
    left_id: str,
    left_time: str,
    right: DataFrame,
    right_id: str,
    right_time: str,
    entity: str = "seq",
    tolerance: float = 0.040,
) -> DataFrame:
    """(left_id, entity_no, right_id, gap) of every left record with its nearest right record, or null.

    Both sides are first reduced to distinct instants per entity (the right side keeps the least id of an instant),
    so that an instant held by a third of all rows is one row. Instants fall into buckets as wide as the tolerance;
    the left instants look into their own and both adjacent buckets of the same entity, candidates are filtered by
    the exact difference in whole microseconds and the minimum (difference, right id) is kept. A bucket holds at most as many
    instants as the clock can tell apart, so hot entities are just many buckets.

    Defined results: ids count once, null ids are left out; a clock that is null, NaN, infinite, zero or negative,
    and a null entity, are never paired; one right record may serve several left ones; of two instants at the same
    distance the one with the smaller right id wins; empty tables leave all left records unpaired; other columns are
    never read.
    """
    width = round(tolerance * 1_000_000)

    def side(df: DataFrame, id_col: str, time: str) -> DataFrame:
        micros = F.round(set_clock(F.col(time).cast("double")) * 1_000_000).cast("bigint")
        return df.select(F.col(id_col).alias("_id"), whole_number(F.col(entity)).alias("_e"), micros.alias("_t")).where(F.col("_id").isNotNull())

    a = side(left, left_id, left_time)
    b = side(right, right_id, right_time).where("_e IS NOT NULL AND _t IS NOT NULL")
    bucket = F.floor(F.col("_t") / width)
    instants = (
        a.where("_e IS NOT NULL AND _t IS NOT NULL")
        .select("_e", "_t")
        .distinct()
        .select("_e", "_t", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    )
    images = b.groupBy("_e", F.col("_t").alias("_u")).agg(F.min("_id").alias("_right")).withColumn("_b", F.floor(F.col("_u") / width))
    best = (
        instants.join(images, ["_e", "_b"])
        .withColumn("_gap", F.abs(F.col("_t") - F.col("_u")))
        .where(F.col("_gap") <= width)
        .groupBy("_e", "_t")
        .agg(F.min(F.struct("_gap", "_right")).alias("_best"))
    )
    return (
        a.dropDuplicates(["_id"])
        .join(best, ["_e", "_t"], "left")
        .select(
            F.col("_id").alias(left_id),
            F.col("_e").alias("entity_no"),
            F.col("_best._right").alias(right_id),
            (F.col("_best._gap") / 1_000_000).alias("gap"),
        )
    )
