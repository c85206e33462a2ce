"""Ordered work on groups of any size: numbering, blocks with halo, and values carried across buckets.

A window over a whole group is one task. Here a group (a sequence that may hold a third of all rows) is cut along its
order instead: ``bucket`` is any SQL expression that never falls as the order rises (a minute, a frame number div
4096), rows of a bucket are handled in one task, and what buckets must know of each other is one small row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: str, out: str = "_i", finer: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based place of every row in its group; ``order`` must break all ties.

    ``finer``: whole-number SQL expressions by which a bucket with more than a thousandth of all rows is cut further; like
    the bucket they never fall as the order rises. There are at most a thousand such buckets, so their list is sent to all
    tasks.
    """
    g, b = list(group), ["_m", *[f"_f{i}" for i in range(len(finer))]]
    cut = df.withColumn("_m", F.expr(bucket))
    if finer:
        sizes = cut.groupBy(*g, "_m").agg(F.count("*").alias("_n"))
        large = sizes.where(F.col("_n") * 1000 > df.agg(F.count("*")).scalar()).select(*g, "_m", F.lit(True).alias("_large"))
        cut = cut.join(F.broadcast(large), [*g, "_m"], "left")
        lowest = F.lit(-(2**63)).cast("bigint")
        cut = cut.withColumns({f"_f{i}": F.coalesce(F.when(F.col("_large"), F.expr(e).cast("bigint")), lowest) for i, e in enumerate(finer)}).drop("_large")
    sizes = cut.groupBy(*g, *b).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*g).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy(*g, "_m").agg(F.sum("_n").alias("_n")).select(*g, "_m", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if finer:
        within = Window.partitionBy(*g, "_m").orderBy(*b[1:]).rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.join(sizes.withColumn("_w", F.coalesce(F.sum("_n").over(within), F.lit(0))), [*g, "_m"]).select(*g, *b, (F.col("_start") + F.col("_w")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*g, *b).orderBy(*order)) - 1
    return cut.withColumn("_p", place).join(starts, [*g, *b]).withColumn(out, F.col("_start") + F.col("_p")).drop(*b, "_p", "_start")


def blocked(df: DataFrame, index: str, block: int, halo: int) -> DataFrame:
    """Add the block ``_b`` a row is sent to and ``_core``: its own block, and neighbours within ``halo`` places of it."""
    own, at = F.floor(F.col(index) / block), F.col(index) % block
    none = F.array().cast("array<bigint>")
    to = F.concat(
        F.array(own),
        F.when((at < halo) & (own > 0), F.array(own - 1)).otherwise(none),
        F.when(at >= block - halo, F.array(own + 1)).otherwise(none),
    )
    return df.withColumn("_own", own).withColumn("_b", F.explode(to)).withColumn("_core", F.col("_b") == F.col("_own")).drop("_own")


def bounded_window(
    df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: str, reach: int, columns: dict, block: int = 4096
) -> DataFrame:
    """Add window columns that look at most ``reach`` rows back or ahead; ``columns``: name -> function of a window."""
    b = blocked(numbered(df, group, order, bucket), "_i", block, reach)
    w = Window.partitionBy(*group, "_b").orderBy("_i")
    return b.select("*", *[f(w).alias(n) for n, f in columns.items()]).where("_core").drop("_i", "_b", "_core")


def carried(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: str, value: Column, out: str, backward: bool = False) -> DataFrame:
    """Add the last value that is not null up to each row of its group (``backward``: the first from it on), rows that
    are equal in ``order`` included."""
    g = list(group)
    cut = df.withColumn("_m", F.expr(bucket)).withColumn("_v", value)
    inside = Window.partitionBy(*g, "_m").orderBy(*order)
    across = Window.partitionBy(*g).orderBy("_m")
    if backward:
        near = F.first("_v", ignorenulls=True).over(inside.rangeBetween(0, Window.unboundedFollowing))
        edge, far = F.min_by("_v", F.struct(*order)), F.first("_e", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing))
    else:
        near = F.last("_v", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, 0))
        edge, far = F.max_by("_v", F.struct(*order)), F.last("_e", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    edges = cut.where("_v IS NOT NULL").groupBy(*g, "_m").agg(edge.alias("_e"))
    every = cut.select(*g, "_m").distinct().join(edges, [*g, "_m"], "left").select(*g, "_m", far.alias("_far"))
    return cut.withColumn("_near", near).join(every, [*g, "_m"]).withColumn(out, F.coalesce("_near", "_far")).drop("_m", "_v", "_near", "_far")


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: str, columns: dict[str, str]) -> DataFrame:
    """Add running sums, each row included; ``columns``: new name -> summed column. ``order`` must break all ties."""
    g = list(group)
    cut = df.withColumn("_m", F.expr(bucket))
    totals = cut.groupBy(*g, "_m").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(columns.values())])
    before = Window.partitionBy(*g).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*g, "_m", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_c{i}") for i in range(len(columns))])
    upto = Window.partitionBy(*g, "_m").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({f"_s{i}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for i, c in enumerate(columns.values())})
    out = inside.join(carry, [*g, "_m"]).withColumns({n: F.col(f"_s{i}") + F.col(f"_c{i}") for i, n in enumerate(columns)})
    return out.drop("_m", *[f"_{k}{i}" for k in "sc" for i in range(len(columns))])
