"""The highest-scoring items of every group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import write_stage


def top_per_group(
    rows: DataFrame,
    id_col: str,
    group: list[Column],
    score: Column,
    tie: Column,
    n: int,
    *,
    keep: Column | None = None,
    shares: tuple[float, ...] = (0.4, 0.75),
    most_hot: int = 1000,
) -> DataFrame:
    """(id, place) of the ``n`` best rows of every group: score descending, then ``tie`` and the id ascending.

    Descending score bands: a mergeable sketch gives the scores above which ``shares`` of all rows lie, and one narrow
    pass writes the columns that are needed partitioned by band. The bands are worked from the top; each reads its own
    files alone. Rows of groups that are filled already are anti-joined away before the others are ranked, on the same
    partitioning, by exact tie order; what a group lacks is taken from the band, and the work stops at the band below which
    no group lacks anything.

    Hot groups, those with more than one ``most_hot``-th of all rows, are thereby at most ``most_hot``: their list is sent to
    all tasks, so that rows of a filled one never leave their task, and an open one sends at most ``n`` keys per task (Spark's
    group limit before the shuffle).

    Defined results: rows with a null group column, a null or NaN score or a null id, or failing ``keep``, do not
    count; a null tie comes last; -0.0 equals 0.0; repeated ids count once; an empty table gives an empty result;
    other columns are never read.
    """
    g = [f"_g{i}" for i in range(len(group))]
    value = score.cast("double")
    usable = rows if keep is None else rows.where(keep)
    usable = usable.where(reduce(lambda x, y: x & y, [c.isNotNull() for c in [*group, value, F.col(id_col)]]) & ~F.isnan(value))

    # where the bands are cut is a matter of cost alone: the scan for it reads the scores only
    cuts = rows.where(value.isNotNull() & ~F.isnan(value)).agg(F.percentile_approx(value, [1 - s for s in sorted(shares)], 1000)).first()[0] or []
    cuts = sorted({float(c) for c in cuts}, reverse=True)
    band = reduce(lambda x, c: x + (value < c).cast("int"), cuts, F.lit(0))
    bands = write_stage(
        usable.select(*[c.alias(k) for c, k in zip(group, g)], (value + F.lit(0.0)).alias("_s"), tie.alias("_tie"), F.col(id_col).alias("_id"), band.alias("_band")),
        "bands",
        by="_band",
    )
    sizes = write_stage(bands.groupBy(*g).agg(F.max("_band").alias("_low"), F.count("*").alias("_n")), "band-groups")
    hot = sizes.where(F.col("_n") * most_hot > sizes.agg(F.sum("_n")).scalar()).select(*g)

    best = Window.partitionBy(*g).orderBy(F.desc("_s"), F.asc_nulls_last("_tie"), F.asc("_id"))

    def leading(df: DataFrame) -> DataFrame:  # copies of an id share one rank
        return df.withColumn("_k", F.dense_rank().over(best)).where(F.col("_k") <= n).select(*g, "_k", "_id").distinct()

    taken: DataFrame | None = None
    for at in range(len(cuts) + 1):
        left = bands.where(F.col("_band") == at)
        if taken is None:
            taken = write_stage(leading(left), "band-top")
        else:
            open_hot = hot.join(full, g, "left_anti")
            cold = left.join(F.broadcast(hot), g, "left_anti").join(full, g, "left_anti")
            more = leading(cold).unionByName(leading(left.join(F.broadcast(open_hot), g, "left_semi"))).join(held, g, "left")
            more = more.withColumn("_k", F.col("_k") + F.coalesce("_held", F.lit(0))).where(F.col("_k") <= n).select(*g, "_k", "_id")
            taken = taken.unionByName(write_stage(more, "band-top"))
        held = taken.groupBy(*g).agg(F.max("_k").alias("_held"))
        full = held.where(F.col("_held") >= n).select(*g)
        if at < len(cuts) and sizes.where(F.col("_low") > at).join(full, g, "left_anti").isEmpty():
            break
    return taken.select(F.col("_id").alias(id_col), F.col("_k").alias("place"))
