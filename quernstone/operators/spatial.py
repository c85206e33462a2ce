"""Spatial joins through grid cells, so that only neighbours ever meet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping_pairs(
    a: DataFrame, b: DataFrame, keys: Sequence[str], extent_a: Sequence[str], extent_b: Sequence[str], cell: float, widest: int = 8, salts: int = 16
) -> DataFrame:
    """Rows of ``a`` and ``b`` with equal keys whose rectangles (x0, x1, y0, y1) touch, each pair once.

    Every rectangle is sent to the cells it covers and pairs meet only within a cell; of the cells a pair shares,
    the one with the lower corner of its intersection keeps it. A rectangle of more than ``widest`` cells a side (a bad
    extent) is not cut into cells: it meets the other side's rows of its key, which are dealt over ``salts`` for that.
    Column names of the two sides must differ except for the keys; rows with a null, NaN or infinite extent meet
    nothing.
    """

    def celled(df: DataFrame, e: Sequence[str], roles: tuple[list[int], list[int]]) -> DataFrame:
        """``roles``: where a narrow and where a wide row goes; 0: the grid, 1: wide rows of ``a``, 2: wide rows of ``b``."""
        ok = reduce(lambda p, q: p & q, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in e])
        df = df.where(ok & (F.col(e[1]) >= F.col(e[0])) & (F.col(e[3]) >= F.col(e[2])))
        wide = F.greatest(F.col(e[1]) - F.col(e[0]), F.col(e[3]) - F.col(e[2])) > widest * cell
        df = df.withColumn("_wide", wide).withColumn("_role", F.explode(F.when(wide, F.array(*map(F.lit, roles[1]))).otherwise(F.array(*map(F.lit, roles[0])))))

        def span(lo: str, hi: str) -> Column:
            return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))

        salt = F.pmod(F.xxhash64(*e), F.lit(salts)).cast("bigint")
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
        # the side whose wide rows a role is about goes to all salts, the other side to one
        here = F.col("_wide") & (F.col("_role") == roles[1][0])
        df = df.withColumn("_cx", F.explode(F.when(F.col("_role") == 0, span(e[0], e[1])).when(here, every).otherwise(F.array(salt))))
        return df.withColumn("_cy", F.explode(F.when(F.col("_role") == 0, span(e[2], e[3])).otherwise(F.array(F.lit(0).cast("bigint"))))).drop("_wide")

    both = celled(a, extent_a, ([0, 2], [1])).join(celled(b, extent_b, ([0, 1], [2, 1])), [*keys, "_role", "_cx", "_cy"])
    touch, home = [], []
    for i, c in ((0, "_cx"), (2, "_cy")):
        lo = F.greatest(F.col(extent_a[i]), F.col(extent_b[i]))
        touch.append(lo <= F.least(F.col(extent_a[i + 1]), F.col(extent_b[i + 1])))
        home.append(F.floor(lo / cell) == F.col(c))
    at_home = (F.col("_role") > 0) | reduce(lambda p, q: p & q, home)
    return both.where(reduce(lambda p, q: p & q, touch) & at_home).drop("_role", "_cx", "_cy")


def within_radius(a: DataFrame, b: DataFrame, keys: Sequence[str], at_a: Sequence[str], at_b: Sequence[str], radius: float, closed: bool = False) -> DataFrame:
    """Pairs of points with equal keys nearer than ``radius`` (``closed``: at most), with their squared distance ``d2``.

    The cells are as wide as the radius; ``a`` looks into its own and all adjacent cells, in any number of dimensions. Null,
    NaN and infinite places are near nothing; places too far out for a cell number share the outermost cell.
    """
    near_ = a
    for i, c in enumerate(at_a):
        own = F.floor(F.col(c) / radius)
        near_ = near_.withColumn(f"_c{i}", F.explode(F.array(F.try_subtract(own, F.lit(1)), own, F.try_add(own, F.lit(1)))))
    cells_b = b
    for i, c in enumerate(at_b):
        cells_b = cells_b.withColumn(f"_c{i}", F.floor(F.col(c) / radius))
    cells = [f"_c{i}" for i in range(len(at_a))]
    d2 = reduce(lambda p, q: p + q, [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(at_a, at_b)])
    both = near_.join(cells_b, [*keys, *cells]).withColumn("d2", d2).drop(*cells)
    return both.where((F.col("d2") <= radius * radius) if closed else (F.col("d2") < radius * radius))


def neighbour_slots(pairs: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` partners of every ``key`` by ``order`` in the slots 0 to n - 1; slots beyond the last partner hold the first."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    first = pairs.withColumn("_k", rank).where(F.col("_k") <= n)
    met = first.groupBy(*key).agg(F.max("_k").alias("_met"))
    to = F.concat(F.array(F.col("_k") - 1), F.when(F.col("_k") == 1, F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: s >= F.col("_met"))).otherwise(F.array().cast("array<int>")))
    return first.join(met, list(key)).withColumn("slot", F.explode(to)).drop("_k", "_met")
