"""Radar cube operators on long tables (one row per cell)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.blocks import running_sums
from quernstone.operators.frames import sidelobes, window_means, window_quantiles


def order_statistics(df: DataFrame, by: Sequence[str], value: str, share: float, ranges: int = 1024) -> DataFrame:
    """(by, _q): the exact, interpolated ``share`` quantile of ``value`` in every group; null and NaN values don't count.

    The values are counted, their groups cut into ``ranges`` equal value ranges and the counts summed up along them, so that
    no task holds the values of a whole group.
    """
    keys = [*by, "_one"]
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_one", F.lit(1))
    n = known.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ends = n.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    n = n.join(ends, keys).withColumn("_range", F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * ranges), F.lit(0)))
    upto = running_sums(n, keys, ["_v"], "_range", {"_upto": "_n"})
    at = (F.col("_all") - 1) * share
    first, second = F.floor(at), F.least(F.floor(at) + 1, F.col("_all") - 1)
    picked = upto.groupBy(*keys).agg(F.min(F.when(F.col("_upto") > first, F.col("_v"))).alias("_a"), F.min(F.when(F.col("_upto") > second, F.col("_v"))).alias("_b"), F.first(at - first).alias("_part"))
    return picked.select(*by, (F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))).alias("_q"))


def above_quantile(df: DataFrame, by: Sequence[str], value: str, top: float, bounded: bool = True) -> DataFrame:
    """Rows whose value is strictly above the (1 - top) quantile of their group, exact and interpolated.

    ``bounded``: groups are parts of one frame's cube or cloud, whose values fit one aggregation buffer. Groups of any
    size (``bounded=False``) go by :func:`order_statistics`.
    """
    if bounded:
        q = df.groupBy(*by).agg(F.percentile(value, F.lit(1 - top)).alias("_q"))
    else:
        q = order_statistics(df, by, value, 1 - top)
    if not by:
        return df.where(F.col(value) > q.scalar())
    return df.join(q, list(by)).where(F.col(value) > F.col("_q")).drop("_q")


def offsets_around(guard: Sequence[int], train: Sequence[int]) -> list[tuple[int, ...]]:
    """Training cells of a CFAR window: the outer box of guard + train cells without the guard box."""
    outer = product(*[range(-(g + t), g + t + 1) for g, t in zip(guard, train)])
    return [o for o in outer if any(abs(x) > g for x, g in zip(o, guard))]


def _given(cells: DataFrame, by: Sequence[str], axes: Sequence[str], offsets: Sequence[tuple[int, ...]], power: str) -> DataFrame:
    """Every cell's power at each cell that it trains."""
    give = F.array(*[F.struct(*[F.lit(-x).alias(f"d{i}") for i, x in enumerate(o)]) for o in offsets])
    return cells.withColumn("_o", F.explode(give)).select(*by, *[(F.col(a) + F.col(f"_o.d{i}")).alias(a) for i, a in enumerate(axes)], F.col(power).alias("_p"))


def ca_cfar(
    cells: DataFrame, axes: Sequence[str], sizes: Sequence[int], power: str, guard: Sequence[int], train: Sequence[int], pfa: float, edges: str,
    by: Sequence[str] = (), unknown: float | None = None,
) -> DataFrame:
    """Cells with ``mean`` (of the training cells), ``threshold`` and ``detected`` (strictly above it), in cubes told apart by ``by``.

    Every cell adds its power to the cells it trains, by exploding a bounded list of offsets (as many as the window
    has cells) and summing: partial sums are combined before the shuffle, no cell ever meets all others. ``edges``:
    ``mirror`` reflects the cube at its ends without repeating the end cell, ``zero`` counts cells outside as 0; absent cells
    count as 0. Cells of power ``unknown`` take the mean of their cube, in which they count as 0, and are never detected. The
    factor is N (pfa^(-1/N) - 1) with N training cells.
    """
    by, axes = list(by), list(axes)
    offsets = offsets_around(guard, train)
    n = len(offsets)
    alpha = n * (pfa ** (-1.0 / n) - 1)
    if unknown is not None:
        known = F.when(F.col(power) != unknown, F.col(power))
        level = cells.groupBy(*by).agg((F.coalesce(F.sum(known), F.lit(0.0)) / F.count("*")).alias("_level"))
        cells = cells.join(level, by) if by else cells.withColumn("_level", level.scalar())
        cells = cells.withColumn("_train", F.coalesce(known, "_level")).drop("_level")
    else:
        cells = cells.withColumn("_train", F.col(power))
    here = cells.select(*by, *axes, "_train")
    if edges == "mirror":
        # a cell appears at its own place and at its reflections beyond the ends
        for a, s, reach in zip(axes, sizes, [g + t for g, t in zip(guard, train)]):
            images = F.array(F.col(a), -F.col(a), 2 * (s - 1) - F.col(a))
            here = here.withColumn(a, F.explode(F.array_distinct(images))).where(F.col(a).between(-reach, s - 1 + reach))
    inside = reduce(lambda x, y: x & y, [(F.col(a) >= 0) & (F.col(a) < s) for a, s in zip(axes, sizes)])
    mean = _given(here, by, axes, offsets, "_train").where(inside).groupBy(*by, *axes).agg((F.sum("_p") / n).alias("mean"))
    return (
        cells.join(mean, [*by, *axes], "left")
        .withColumn("mean", F.coalesce("mean", F.lit(0.0)))
        .withColumn("threshold", F.col("mean") * alpha)
        .withColumn("detected", (F.col("_train") > F.col("threshold")) & (F.col(power) != unknown if unknown is not None else F.lit(True)))
        .drop("_train")
    )


def os_cfar(
    cells: DataFrame, axes: Sequence[str], sizes: Sequence[int], power: str, guard: Sequence[int], train: Sequence[int], share: float, factor: float = 1.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Ordered-statistic CFAR: threshold is ``factor`` times the ``share`` quantile of the known training cells.

    Cells nearer to an end than the window reaches are never detected; powers of -1 are unknown and train nothing. A
    cell's training values are at most as many as the window has cells.
    """
    keys = [*by, *axes]
    level = _given(cells.where(F.col(power) != -1), by, axes, offsets_around(guard, train), power).groupBy(*keys).agg(F.percentile("_p", F.lit(share)).alias("level"))
    reach = [g + t for g, t in zip(guard, train)]
    inner = reduce(lambda x, y: x & y, [(F.col(a) >= r) & (F.col(a) < s - r) for a, s, r in zip(axes, sizes, reach)])
    return cells.join(level, keys, "left").withColumn("detected", F.coalesce(inner & (F.col(power) != -1) & (F.col(power) > F.col("level") * factor), F.lit(False)))


def sidelobe_filter(cells: DataFrame, by: Sequence[str], sizes: Sequence[int], power: str, weight: Column, guard: Sequence[int], train: Sequence[int], pfa: float, rate: float, pad: tuple[int, int]) -> DataFrame:
    """(by, ri, ai, ei, kept_os, kept_padded) of the cells that a zero-edge CA-CFAR detects in (ri, ai, ei) cubes.

    Their power times ``weight`` is summed over elevation; in every range row the azimuth cells strictly above the (1 -
    rate) quantile of the whole row (empty cells are 0, a quantile of 0 keeps nothing) are kept, then widened by ``pad``
    cells in range and azimuth. The two flags tell whether a detection lies in a kept and in a widened cell.
    """
    by, axes = list(by), ["ri", "ai", "ei"]
    points = ca_cfar(cells, axes, sizes, power, guard, train, pfa, "zero", by).where("detected").select(*by, *axes, (F.col(power) * weight).alias("_w"))
    row = points.groupBy(*by, "ri", "ai").agg(F.sum("_w").alias("_w"))
    values = F.sort_array(F.concat(F.collect_list("_w"), F.array_repeat(F.lit(0.0), (F.lit(sizes[1]) - F.count("*")).cast("int"))))  # one row of a cube
    at = (sizes[1] - 1) * (1 - rate)
    lo, part = int(at), at - int(at)
    level = row.groupBy(*by, "ri").agg(values.alias("_v"))
    low, high = F.col("_v")[lo], F.col("_v")[min(lo + 1, sizes[1] - 1)]
    level = level.select(*by, "ri", (low + part * (high - low)).alias("_q"))
    kept = row.join(level, [*by, "ri"]).where("_q > 0 AND _w > _q").select(*by, "ri", "ai", F.lit(True).alias("_kept"))
    step = [F.array(*[F.lit(i) for i in range(-p, p + 1)]) for p in pad]
    wide = kept.withColumn("_i", F.explode(step[0])).withColumn("_j", F.explode(step[1])).select(*by, (F.col("ri") + F.col("_i")).alias("ri"), (F.col("ai") + F.col("_j")).alias("ai"), F.lit(True).alias("_wide")).distinct()
    out = points.join(kept, [*by, "ri", "ai"], "left").join(wide, [*by, "ri", "ai"], "left")
    return out.select(*by, *axes, F.coalesce("_kept", F.lit(False)).cast("int").alias("kept_os"), F.coalesce("_wide", F.lit(False)).cast("int").alias("kept_padded"))


def framed_ca_cfar(cells: DataFrame, frame: str, axes: Sequence[str], power: str, guard: Sequence[int], train: Sequence[int], pfa: float) -> DataFrame:
    """:func:`ca_cfar` with zero edges where the cells are dealt by ``frame``: a cube is one frame's, and a task holds it."""
    offsets = offsets_around(guard, train)
    n = len(offsets)
    out = window_means(cells, frame, axes, power, offsets).withColumn("threshold", F.col("mean") * (n * (pfa ** (-1.0 / n) - 1)))
    return out.withColumn("detected", F.col(power) > F.col("threshold"))


def framed_os_cfar(cells: DataFrame, frame: str, axes: Sequence[str], sizes: Sequence[int], power: str, guard: Sequence[int], train: Sequence[int], share: float, factor: float = 1.0) -> DataFrame:
    """:func:`os_cfar` where the cells are dealt by ``frame``: a cube is one frame's, and a task holds it."""
    out = window_quantiles(cells, frame, axes, power, offsets_around(guard, train), share, -1.0)
    inner = reduce(lambda x, y: x & y, [(F.col(a) >= g + t) & (F.col(a) < s - g - t) for a, s, g, t in zip(axes, sizes, guard, train)])
    return out.withColumn("detected", F.coalesce(inner & (F.col(power) != -1) & (F.col(power) > F.col("level") * factor), F.lit(False)))


def framed_sidelobe_filter(cells: DataFrame, frame: str, sizes: Sequence[int], power: str, weight: Column, guard: Sequence[int], train: Sequence[int], pfa: float, rate: float, pad: tuple[int, int]) -> DataFrame:
    """:func:`sidelobe_filter` where the cells are dealt by ``frame``: a cube is one frame's, and a task holds it."""
    offsets = offsets_around(guard, train)
    n = len(offsets)
    return sidelobes(cells.withColumn("_w", F.col(power) * weight), frame, sizes[1], power, "_w", offsets, n * (pfa ** (-1.0 / n) - 1), rate, pad)


def interpolated(cells: DataFrame, at: DataFrame, index: Sequence[str], position: Sequence[str], values: Sequence[str], ident: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(ident, by, values) at positions in cell units: bilinear, trilinear and so on from the 2**n cells around.

    ``index`` are the integer axes of ``cells``, ``position`` the matching columns of ``at``, ``values`` one or more features
    of a cell. Every position asks its corner cells of its own cube by equality, weights are summed; absent cells count as 0.
    """
    corners = []
    for bits in product((0, 1), repeat=len(position)):
        w = F.lit(1.0)
        for b, p in zip(bits, position):
            part = F.col(p) - F.floor(p)
            w = w * (part if b else 1 - part)
        corners.append(F.struct(*[(F.floor(p) + b).cast("int").alias(f"_{i}") for i, (b, p) in enumerate(zip(bits, position))], w.alias("_w")))
    want = at.select(*ident, *by, F.explode(F.array(*corners)).alias("_c")).select(*ident, *by, "_c.*")
    have = cells.select(*by, *[F.col(c).cast("int").alias(f"_{i}") for i, c in enumerate(index)], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    keys = [*by, *[f"_{i}" for i in range(len(index))]]
    sums = [F.sum(F.col("_w") * F.coalesce(f"_v{i}", F.lit(0.0))).alias(v) for i, v in enumerate(values)]
    return want.join(have, keys, "left").groupBy(*ident, *by).agg(*sums)
