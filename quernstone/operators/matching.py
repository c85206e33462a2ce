"""Greedy matching, suppression and sampling: distributed candidate search, then one ordered pass per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.geometry import iou, overlap
from quernstone.operators import kernels
from quernstone.operators.spatial import overlapping_pairs, within_radius
from quernstone.session import write_stage


@F.pandas_udf(T.DoubleType())
def rotated_iou(a1: pd.Series, a2: pd.Series, a3: pd.Series, a4: pd.Series, a5: pd.Series, b1: pd.Series, b2: pd.Series, b3: pd.Series, b4: pd.Series, b5: pd.Series) -> pd.Series:
    """IoU of two rotated rectangles (x, y, length, width, yaw), an Arrow batch of pairs at a time."""
    return pd.Series(kernels.paired_iou(np.column_stack([a1, a2, a3, a4, a5]), np.column_stack([b1, b2, b3, b4, b5])))


@F.pandas_udf(T.DoubleType())
def rotated_area(a1: pd.Series, a2: pd.Series, a3: pd.Series, a4: pd.Series, a5: pd.Series, b1: pd.Series, b2: pd.Series, b3: pd.Series, b4: pd.Series, b5: pd.Series) -> pd.Series:
    """Common area of two rotated rectangles (x, y, length, width, yaw), an Arrow batch of pairs at a time."""
    return pd.Series(kernels.paired_iou(np.column_stack([a1, a2, a3, a4, a5]), np.column_stack([b1, b2, b3, b4, b5]), "area"))


def height_overlap(y1: Column, h1: Column, y2: Column, h2: Column, centre: float = 1.0) -> Column:
    """Common height of two boxes given at the ``centre`` share of their height (1: at the bottom, y down; 0.5: in the middle)."""
    return overlap(y1 - h1 * centre, y1 + h1 * (1 - centre), y2 - h2 * centre, y2 + h2 * (1 - centre))


def rotated_iou_3d(common: Column, height: Column, one: Column, two: Column) -> Column:
    """3D intersection over union: common BEV area times common height, over the union of the two volumes."""
    return iou(common * height, one, two)


def bev(df: DataFrame, p: str, ident: str, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """BEV rectangle (x, z, l, w, ry) of KITTI boxes under prefixed names with its enclosing extents."""
    c = F.col
    r = F.sqrt(c("l") * c("l") + c("w") * c("w")) / 2
    return df.select(
        *keys, c(ident), *extra, c("loc_x").alias(f"{p}x"), c("loc_z").alias(f"{p}z"), c("l").alias(f"{p}l"), c("w").alias(f"{p}w"), c("rot_y").alias(f"{p}r"),
        (c("loc_x") - r).alias(f"{p}x0"), (c("loc_x") + r).alias(f"{p}x1"), (c("loc_z") - r).alias(f"{p}z0"), (c("loc_z") + r).alias(f"{p}z1"),
    )


def bev_candidates(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float = 8.0) -> DataFrame:
    """Pairs of :func:`bev` rows (prefixes a and b) whose extents touch, with their rotated IoU."""
    near = overlapping_pairs(a, b, keys, ["ax0", "ax1", "az0", "az1"], ["bx0", "bx1", "bz0", "bz1"], cell)
    # KITTI's yaw turns the x-z plane the other way round
    return near.withColumn("iou", rotated_iou("ax", "az", "al", "aw", -F.col("ar"), "bx", "bz", "bl", "bw", -F.col("br")))


def greedy_pairs(
    pairs: DataFrame, group: Sequence[str], claimant: str, target: str, priority: Sequence[Column], preference: Sequence[Column], spare: str | None = None
) -> DataFrame:
    """One-to-one matches among candidate pairs: claimants in ``priority`` order take their best free target.

    A claimant ranks its targets by ``preference``. In a group of C claimants and T targets a target is surely taken
    after T claimants that could have it, and a claimant never looks past its C best targets, so only those pairs are kept
    (exactly, by rank): a group has at most min(C, T) squared pairs however lopsided it is. The pass itself is a stream over
    sorted partitions: the state is the set of taken ids of the current group. Returns the rows of ``pairs`` that matched;
    with ``spare``, a column of that name tells them (false) from the next target that was free for the claimant (true).
    """
    g = list(group)
    per_group = pairs.groupBy(*g).agg(F.countDistinct(target).alias("_targets"), F.countDistinct(claimant).alias("_claimants"))
    nth = F.dense_rank().over(Window.partitionBy(*g, target).orderBy(*priority, F.col(claimant)))
    choice = F.dense_rank().over(Window.partitionBy(*g, claimant).orderBy(*preference, F.col(target)))
    kept = pairs.withColumn("_nth", nth).withColumn("_choice", choice).join(per_group, g)
    kept = kept.where((F.col("_nth") <= F.col("_targets")) & (F.col("_choice") <= F.col("_claimants") + F.lit(1 if spare else 0))).drop("_nth", "_choice", "_targets", "_claimants")
    ordered = kept.withColumn("_g", F.xxhash64(*g)).repartition(*g).sortWithinPartitions(*g, *priority, F.col(claimant), *preference, F.col(target))
    columns = ordered.columns

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, free, given, spared = None, set(), set(), set()
        for batch in batches:
            role = np.full(len(batch), -1)
            for i, row in enumerate(zip(*[batch[k] for k in g], batch[claimant], batch[target])):
                if row[:-2] != key:
                    key, free, given, spared = row[:-2], set(), set(), set()
                if row[-1] in free:
                    continue
                if row[-2] not in given:
                    given.add(row[-2]), free.add(row[-1])
                    role[i] = 0
                elif spare and row[-2] not in spared:
                    spared.add(row[-2])
                    role[i] = 1
            kept = batch[role >= 0]
            yield kept.assign(**{spare: role[role >= 0] == 1}) if spare else kept

    ordered = ordered.select(*columns)
    schema = T.StructType([*ordered.schema.fields, *([T.StructField(spare, T.BooleanType())] if spare else [])])
    return ordered.mapInPandas(take, schema).drop("_g")


def suppressed(
    boxes: DataFrame, keys: Sequence[str], ident: str, score: str, threshold: float, most: int | None = None, by: str = "rotated", batch: int = 4096
) -> DataFrame:
    """Non-maximum suppression: the ids that stay, best score first, ties by id.

    ``by``: "rotated" or "aligned" overlap above ``threshold``, or "circle" (squared centre distance of at most it).
    ``most``: only so many best boxes of a group enter, where a head has such a limit of its own.

    Boxes are settled in rounds: the ``batch`` best undecided ones of every group in one ordered pass where the rank limit has
    brought them, then all worse ones that a kept box drops leave by the grid join, until none is undecided. So a group of any
    size is decided to its end with at most ``batch`` boxes in a task at once; groups of up to ``batch`` boxes take one round.
    A row given twice counts once; rows with a null key, id or score are in no group; boxes with a null, NaN or infinite
    place, or size or yaw where ``by`` looks at them, suppress nothing and stay.
    """
    k = list(keys)
    c = F.col
    sides = ["loc_x", "loc_z", "l", "w", "rot_y"]
    best = Window.partitionBy(*k).orderBy(F.desc(score), F.asc(ident))
    left = boxes.select(*k, ident, score, *[c(x).cast("double") for x in sides]).dropna(subset=[*k, ident]).where(c(score).isNotNull())
    if most is not None:
        left = left.withColumn("_rank", F.dense_rank().over(best)).where(c("_rank") <= most).drop("_rank")
    done = None
    while True:
        top = left.withColumn("_rank", F.dense_rank().over(best)).where(c("_rank") <= batch).sortWithinPartitions(*k, "_rank")
        schema = T.StructType([*top.schema.fields, T.StructField("_kept", T.BooleanType())])
        seen = write_stage(top.mapInPandas(_settled(k, sides, threshold, by, batch), schema), "nms-seen")
        kept = seen.where("_kept").select(*k, ident)
        done = kept if done is None else done.unionByName(kept)
        # groups with a full batch may have worse boxes yet; written, so that Spark knows how few they are
        last = write_stage(seen.where(c("_rank") == batch).select(*k, c(score).alias("_score"), c(ident).alias("_id")), "nms-last")
        if last.isEmpty():
            return done
        worse = (c(score) < c("_score")) | ((c(score) == c("_score")) & (c(ident) > c("_id")))
        rest = write_stage(left.join(last, k).where(worse).drop("_score", "_id"), "nms-rest")
        a = bev(seen.where("_kept").join(last, k, "left_semi"), "a", ident, k).withColumnRenamed(ident, "_ia")
        b = bev(rest, "b", ident, k).withColumnRenamed(ident, "_ib")
        dropped = _clashes(a, b, k, threshold, by).select(*k, c("_ib").alias(ident)).distinct()
        left = write_stage(rest.join(dropped, [*k, ident], "left_anti"), "nms-left")


def _clashes(a: DataFrame, b: DataFrame, k: Sequence[str], threshold: float, by: str) -> DataFrame:
    """Pairs of :func:`bev` rows (prefixes a and b) of which the better suppresses the worse."""
    c = F.col
    if by == "circle":
        return within_radius(a, b, k, ["ax", "az"], ["bx", "bz"], threshold**0.5, closed=True)
    if by == "aligned":
        sides = [(c(f"{p}x") - c(f"{p}w") / 2, c(f"{p}x") + c(f"{p}w") / 2, c(f"{p}z") - c(f"{p}l") / 2, c(f"{p}z") + c(f"{p}l") / 2) for p in "ab"]
        (ax0, ax1, az0, az1), (bx0, bx1, bz0, bz1) = sides
        near = overlapping_pairs(a, b, k, ["ax0", "ax1", "az0", "az1"], ["bx0", "bx1", "bz0", "bz1"], 8.0)
        both = overlap(ax0, ax1, bx0, bx1) * overlap(az0, az1, bz0, bz1)
        return near.where(iou(both, c("al") * c("aw"), c("bl") * c("bw")) > threshold)
    if by == "rotated":
        return bev_candidates(a, b, k).where(c("iou") > threshold)
    raise ValueError(f"unknown suppression {by!r}")


def _settled(k: Sequence[str], sides: Sequence[str], threshold: float, by: str, batch: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The ordered pass over ranked boxes, whole groups of at most ``batch`` ranks at a time.

    Gives the kept boxes and the last one of every full batch; only full groups need their boxes again, others come without sides.
    """

    def clash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        if by == "rotated":
            flip = np.array([1.0, 1.0, 1.0, 1.0, -1.0])  # as in bev_candidates
            return kernels.paired_iou(one * flip, two * flip) > threshold
        (dx, dz), (l1, w1), (l2, w2) = np.abs(one[:, :2] - two[:, :2]).T, one[:, 2:4].T, two[:, 2:4].T
        if by == "circle":
            return dx * dx + dz * dz <= (threshold**0.5) ** 2
        (x1, z1), (x2, z2) = one[:, :2].T, two[:, :2].T
        wide = np.minimum(x1 + w1 / 2, x2 + w2 / 2) - np.maximum(x1 - w1 / 2, x2 - w2 / 2)
        deep = np.minimum(z1 + l1 / 2, z2 + l2 / 2) - np.maximum(z1 - l1 / 2, z2 - l2 / 2)
        common = np.maximum(wide, 0.0) * np.maximum(deep, 0.0)
        union = l1 * w1 + l2 * w2 - common
        return np.divide(common, union, out=np.zeros(len(common)), where=union != 0) > threshold

    def clashes(box: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Clashing rows i < j of one group; ``end`` is the row behind each row's group."""
        half = np.full(len(box), threshold**0.5 / 2) if by == "circle" else np.hypot(box[:, 2], box[:, 3]) / 2
        used = box[:, : {"circle": 2, "aligned": 4, "rotated": 5}[by]]
        place = np.where(np.isfinite(used).all(axis=1)[:, None], box[:, :2], np.nan)  # NaN is near nothing
        found, some, held = [], [], 0

        def check() -> None:
            i, j = (np.concatenate(x) for x in zip(*some))
            hit = clash(box[i], box[j])
            found.append((i[hit], j[hit]))
            some.clear()

        at, lag = np.arange(len(box)), 0
        while True:
            lag += 1
            at = at[at + lag < end[at]]
            if not len(at):
                break
            near = at[(np.abs(place[at] - place[at + lag]) <= (half[at] + half[at + lag])[:, None] + 1e-9).all(axis=1)]
            some.append((near, near + lag))
            held += len(near)
            if held > 100_000:
                check()
                held = 0
        if some:
            check()
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (at, at)

    def settle(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        begins = np.flatnonzero(first)
        ends = np.append(begins[1:], len(rows))
        end = np.repeat(ends, ends - begins)
        i, j = clashes(rows[sides].to_numpy(dtype=float), end)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        stays = np.ones(len(rows), dtype=bool)
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
        for lo, hi in zip(starts, np.append(starts[1:], len(i))):
            if stays[i[lo]]:
                stays[j[lo:hi]] = False
        rank = rows["_rank"].to_numpy()
        full = rank[end - 1] == batch
        shown = rows.assign(_kept=stays)
        shown.loc[~full, list(sides)] = np.nan
        return shown[stays | (rank == batch)]

    def passes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in batches:
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            group = rows[list(k)]
            first = (group != group.shift()).any(axis=1).to_numpy()
            fresh = first | (rows["_rank"] != rows["_rank"].shift()).to_numpy()  # not a row given twice
            rows, first = rows[fresh].reset_index(drop=True), first[fresh]
            if not len(rows):
                continue
            start = np.flatnonzero(first)[-1]  # the last group may go on
            if start:
                yield settle(rows[:start], first[:start])
            held = rows[start:].reset_index(drop=True)
        if held is not None and len(held):
            yield settle(held, np.arange(len(held)) == 0)

    return passes


def farthest_sample(points: DataFrame, keys: Sequence[str], ident: Sequence[str], xyz: Sequence[str], count: int | Column) -> DataFrame:
    """(keys, ident, place) of farthest point sampling per group, started at the first point by ``ident``.

    ``count``: how many points of a group, a number or a column that is the same for a whole group. Every round holds each
    point's least squared distance from the picked ones, takes the farthest of every group (ties to the first) by partial
    aggregation and sends these few rows back, so that a group of any size is many tasks; a round is written before the next.
    A group ends early when all its points coincide with picked ones.
    """
    k, c = list(keys), F.col
    spot = F.struct(*[c(x) for x in xyz])
    left = write_stage(points.select(*k, *ident, *xyz, F.lit(float("inf")).alias("_far"), (F.lit(count) if isinstance(count, int) else count).cast("bigint").alias("_most")), "far")
    most = left.agg(F.max("_most")).first()[0] or 0
    picked = []
    for place in range(most):
        open_ = left.where((c("_most") > place) & (c("_far") > 0))
        # the farthest: least of (minus distance, ident)
        best = open_.groupBy(*k).agg(F.min_by(F.struct(F.struct(*ident).alias("i"), spot.alias("s")), F.struct((-c("_far")).alias("d"), *ident)).alias("_b"))
        best = write_stage(best.select(*k, "_b.i", "_b.s"), "far-best")
        picked.append(best.select(*k, "i.*", F.lit(place).cast("bigint").alias("place")))
        if place + 1 < most:
            d2 = sum(((c(x) - c(f"s.{x}")) * (c(x) - c(f"s.{x}")) for x in xyz[1:]), (c(xyz[0]) - c(f"s.{xyz[0]}")) * (c(xyz[0]) - c(f"s.{xyz[0]}")))
            left = write_stage(left.where(c("_most") > place + 1).join(best.drop("i"), k).withColumn("_far", F.least("_far", d2)).drop("s"), "far")
    if not picked:
        return points.select(*k, *ident, F.lit(0).cast("bigint").alias("place")).limit(0)
    return reduce(DataFrame.unionByName, picked)


def cheapest_pairs(pairs: DataFrame, group: Sequence[str], row: str, column: str, cost: str, missing: float) -> DataFrame:
    """Optimal one-to-one assignment per group from candidate pairs; absent pairs cost ``missing`` and are not returned.

    In a group of R rows, of a row's R cheapest columns the other rows leave one free, so some optimal assignment uses
    only those; just they are kept (exactly, by rank), which bounds a group by R squared pairs however many columns it
    has. The augmenting-path solver gets one connected component of the pairs at a time.
    """
    g = list(group)
    rank = F.row_number().over(Window.partitionBy(*g, row).orderBy(F.asc(cost), F.asc(column)))
    per_group = pairs.groupBy(*g).agg(F.countDistinct(row).alias("_rows"))
    kept = pairs.withColumn("_rank", rank).join(per_group, g).where(F.col("_rank") <= F.col("_rows")).select(*pairs.columns)

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        (rows, i), (cols, j) = np.unique(p[row], return_inverse=True), np.unique(p[column], return_inverse=True)
        of_row = kernels.pair_components(i, j, len(rows), len(cols))
        costs, keep = p[cost].to_numpy(dtype=float), np.zeros(len(p), dtype=bool)
        order = np.argsort(of_row[i], kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(of_row[i][order])) + 1):
            (r, ri), (c, cj) = np.unique(i[at], return_inverse=True), np.unique(j[at], return_inverse=True)
            matrix = np.full((len(r), max(len(r), len(c))), missing)
            matrix[ri, cj] = costs[at]
            keep[at] = (kernels.cheapest_assignment(matrix)[ri] == cj) & (costs[at] < missing)
        return p[keep]

    return kept.groupBy(*g).applyInPandas(solve, pairs.schema)


def chained(boxes: DataFrame, keys: Sequence[str], order: Sequence[str], threshold: float) -> DataFrame:
    """Boxes (x0, x1, y0, y1) that continue their object: overlap of more than ``threshold`` with the last one kept.

    The first box of every object starts its chain. A stream over sorted partitions whose state is one box per object.
    """
    k = list(keys)
    rows = boxes.repartition(*k).sortWithinPartitions(*k, *order)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for i, row in enumerate(zip(*[batch[c] for c in k], batch["x0"], batch["x1"], batch["y0"], batch["y1"])):
                box = row[-4:]
                if row[:-4] != key:
                    key, last = row[:-4], None
                if last is not None:
                    w, h = min(box[1], last[1]) - max(box[0], last[0]), min(box[3], last[3]) - max(box[2], last[2])
                    common = max(w, 0.0) * max(h, 0.0)
                    union = (box[1] - box[0]) * (box[3] - box[2]) + (last[1] - last[0]) * (last[3] - last[2]) - common
                    if not (union > 0 and common / union > threshold):
                        continue
                keep[i], last = True, box
            yield batch[keep]

    return rows.mapInPandas(follow, rows.schema)
