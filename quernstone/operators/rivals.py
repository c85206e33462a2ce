"""One-to-one matches of labels and detections within whole frames: the rows of both are shuffled once by frame, without cells or
candidate pairs, and matched in the task that has them. A row given twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators import kernels
from quernstone.operators.frames import by_frame
from quernstone.operators.kernels import pair_blocks, run_starts

FRAME = ["seq", "frame"]
_BOX = ["loc_x", "loc_z", "l", "w", "rot_y"]
_WIDE = 32.0  # half the diagonal of a bad extent; such labels are met apart, so that they don't widen the search of the others


class Sides:
    """Labels (``a``) and detections (``b``) of some whole frames, each id once; the rows of a group (frame and class) have one number."""

    def __init__(self, rows: pa.RecordBatch):
        new = self._changes(rows, [*FRAME, "cls"])
        once = new | self._changes(rows, ["_side", "_id"])
        rows, group = (rows, np.cumsum(new)) if once.all() else (rows.filter(pa.array(once)), np.cumsum(new)[once])
        frame = np.cumsum(self._changes(rows, FRAME))
        side, named = rows.column("_side").to_numpy(), rows.column("cls").is_valid().to_numpy(zero_copy_only=False)
        self.at = [np.flatnonzero((side == k) & named) for k in (0, 1)]
        self.a, self.b = (rows.take(pa.array(at)) for at in self.at)
        self.group_a, self.group_b = (group[at] for at in self.at)
        self.frame_a = frame[self.at[0]]
        # every detection's condition as a number, and which were seen in a frame, by detections of no class too
        self.names = rows.column("cond").dictionary_encode()
        cond = self.names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.cond = cond[self.at[1]].astype(np.int64)
        self.seen = np.unique(np.column_stack([frame, cond])[side == 1], axis=0)

    @staticmethod
    def _changes(rows: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
        new = np.zeros(rows.num_rows, dtype=bool)
        new[:1] = True
        for c in columns:
            v = rows.column(c)
            v = v.dictionary_encode().indices if pa.types.is_string(v.type) or pa.types.is_large_string(v.type) else v
            known, v = v.is_valid().to_numpy(zero_copy_only=False), v.fill_null(0).to_numpy(zero_copy_only=False)
            new[1:] |= (v[1:] != v[:-1]) | (known[1:] != known[:-1])
        return new

    def conditions(self, codes: np.ndarray) -> pa.Array:
        return self.names.dictionary.take(pa.array(codes))


def numbers(rows: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """(rows, columns), NaN for null."""
    return np.column_stack([rows.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns])


def sides(labels: DataFrame, found: DataFrame, lines: dict[str, Column] | None = None) -> DataFrame:
    """The rows of both, ids as ``_id``, dealt by frame; ``lines``: columns of labels that are made behind the shuffle."""
    a = labels.withColumnRenamed("gt_id", "_id").withColumn("_side", F.lit(0))
    b = found.withColumnRenamed("pred_id", "_id").withColumn("_side", F.lit(1))
    rows = a.unionByName(b, allowMissingColumns=True).where("seq IS NOT NULL AND frame IS NOT NULL").repartition(*FRAME)
    return rows.withColumns({"_frame": F.xxhash64(*FRAME), **{k: F.when(F.col("_side") == 0, v) for k, v in (lines or {}).items()}})


def _passes(rows: DataFrame, work, schema: T.StructType) -> DataFrame:
    return by_frame(rows, "_frame", [*FRAME, "cls", "_side", "_id"], lambda batch: work(Sides(batch)), schema)


def _joined(some: list[tuple], kinds: Sequence[type]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*some)) if some else tuple(np.zeros(0, dtype=k) for k in kinds)


def overlaps(s: Sides, least: float, closed: bool, label_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, detection, iou): pairs of a group whose rotated BEV overlap is above ``least`` (``closed``: at least)."""
    place, ends = [], []
    for rows in (s.a, s.b):
        p = numbers(rows, _BOX)
        half = np.sqrt(p[:, 2] * p[:, 2] + p[:, 3] * p[:, 3]) / 2
        place.append(p)
        ends.append(np.column_stack([p[:, 0] - half, p[:, 0] + half, p[:, 1] - half, p[:, 1] + half]))
    (a, b), (ea, eb) = place, ends
    radius = [(e[:, 1] - e[:, 0]) / 2 for e in ends]
    ok = [np.flatnonzero(np.isfinite(e).all(axis=1)) for e in ends]
    flip, some = np.array([1.0, 1.0, 1.0, 1.0, -1.0]), []  # KITTI's yaw turns the x-z plane the other way round
    for wide in (False, True):
        of = ok[0][(radius[0][ok[0]] > _WIDE) == wide]
        if not len(of) or not len(ok[1]):
            continue
        reach = radius[1][ok[1]] + radius[0][of].max()
        for j, i in pair_blocks(s.group_b[ok[1]], b[ok[1], 0], s.group_a[of], a[of, 0], reach, np.arange(len(ok[1]))):
            i, j = of[i], ok[1][j]
            touch = np.ones(len(i), dtype=bool)
            for k in (0, 2):
                touch &= np.maximum(ea[i, k], eb[j, k]) <= np.minimum(ea[i, k + 1], eb[j, k + 1])
            i, j = i[touch], j[touch]
            one, two = a[i] * flip, b[j] * flip
            iou = kernels.paired_iou(one, two) if label_first else kernels.paired_iou(two, one)
            hit = iou >= least if closed else iou > least
            some.append((i[hit], j[hit], iou[hit]))
    return _joined(some, (int, int, float))


def claims(claimant: np.ndarray, target: np.ndarray, most: int = 1) -> np.ndarray:
    """What each pair is: 0 if the claimant takes the target, 1 if it is the next one free for it (``most`` is 2), else -1.

    The pairs of a claimant lie together, the best first, and claimants are in the order of their turn.
    """
    role, taken, now, k = np.full(len(claimant), -1), set(), -1, 0
    for p, (c, t) in enumerate(zip(claimant.tolist(), target.tolist())):
        if c != now:
            now, k = c, 0
        if k < most and t not in taken:
            role[p] = k
            if k == 0:
                taken.add(t)
            k += 1
    return role


def best_first(s: Sides, least: float, closed: bool, label_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """The label that each detection takes, or -1, and their overlap: in a group and condition detections by falling score take the free label they overlap most.

    Ties: the lower line (none first), then the lower ids.
    """
    i, j, iou = overlaps(s, least, closed, label_first)
    score, line = numbers(s.b, ["score", "line_idx"]).T
    ident, label = s.b.column("_id").to_numpy(), s.a.column("_id").to_numpy()
    order = np.lexsort((label[i], -iou, ident[j], np.nan_to_num(line, nan=-np.inf)[j], -score[j], s.cond[j], s.group_b[j]))
    i, j, iou = i[order], j[order], iou[order]
    won = claims(j, s.cond[j] * len(label) + i) == 0
    of, by = np.full(len(ident), -1), np.full(len(ident), np.nan)
    of[j[won]], by[j[won]] = i[won], iou[won]
    return of, by


def _taken(rows: pa.RecordBatch, column: str, of: np.ndarray) -> pa.Array:
    """The column's value in the row ``of``, null where that is -1."""
    return rows.column(column).take(pa.array(of, mask=of < 0))


def own_counts(labels: DataFrame, behind: dict[str, Column], grades: int, least: float) -> DataFrame:
    """(cls, difficulty, metric, num_gt, counted, first, tp, used), summed within some frames: labels matched with themselves as detections of one score.

    The matches are those of :func:`quernstone.operators.evaluation.graded_precision` for image ("bbox"), "bev" and "3d" overlaps above ``least``: ``first``
    are the true ones of its first pass, ``tp`` and ``used`` those of its second at the one threshold there is, ``counted`` the detections that
    are not ignored. ``behind``: columns made behind the shuffle, the image box (u0, u1, v0, v1) and, as bits of the difficulties, where a row is
    ignored as a label (``off_label``) and as a detection (``off_found``). Rows of a frame and class at one place are one label, of the least id.

    Convex boxes with a centre, of circumradius r and s, have their centres at most max(r, s) (1 / overlap - 1) apart, as the moment about either
    centre of what both share is that of what one lacks; so only few labels need their overlap with others. Most have none and match themselves.
    """
    names = ("bbox", "bev", "3d")
    rows = labels.where("seq IS NOT NULL AND frame IS NOT NULL").repartition(*FRAME).withColumn("_frame", F.xxhash64(*FRAME))
    numbers_of = [T.StructField(k, T.LongType()) for k in ("num_gt", "counted", "first", "tp", "used")]
    schema = T.StructType([labels.schema["cls"], T.StructField("difficulty", T.IntegerType()), T.StructField("metric", T.StringType()), *numbers_of])

    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        new = Sides._changes(rows, [*FRAME, "cls"])
        once = new | Sides._changes(rows, ["gt_id"])
        rows, group = rows.filter(pa.array(once)), np.cumsum(new)[once]
        alone = _first_at_place(rows, group)
        rows, group = rows.filter(pa.array(alone)), group[alone]
        every = np.arange(rows.num_rows)
        line = numbers(rows, ["line_idx"])[:, 0]
        rank = np.empty(len(every), dtype=np.int64)
        rank[np.lexsort((np.nan_to_num(line, nan=-np.inf), group))] = every  # no line first, ties by id
        cls = rows.column("cls").dictionary_encode()
        code, classes = cls.indices.to_numpy(), len(cls.dictionary)
        off_label, off_found = (rows.column(k).to_numpy() for k in ("off_label", "off_found"))
        with np.errstate(all="ignore"):  # overlaps of boxes without number are told as Spark would
            met = dict(zip(names, (_image_overlaps(rows, group, least), *_box_overlaps(rows, group, least))))
        for metric, (own, value, i, j, overlap) in met.items():
            rivalled = np.zeros(len(every), dtype=bool)
            rivalled[i] = True
            at = np.flatnonzero(own & rivalled)
            i, j, overlap = np.concatenate([i, at]), np.concatenate([j, at]), np.concatenate([overlap, value[at]])

            def taken(*preference: np.ndarray) -> np.ndarray:
                """The row that each row takes as a label, or -1."""
                order = np.lexsort((rank[j], *preference, rank[i]))
                won = order[claims(i[order], j[order]) == 0]
                of = np.where(own & ~rivalled, every, -1)
                of[i[won]] = j[won]
                return of

            one, two = taken(), {}
            for k in range(grades):
                label, found = (off_label >> k) & 1 == 0, (off_found >> k) & 1 == 0
                if (seen := found.tobytes()) not in two:
                    two[seen] = taken(np.where(found[j], -overlap, 0.0), ~found[j])
                of = two[seen]
                used = (of >= 0) & found[of]
                counts = [np.bincount(code[x], minlength=classes) for x in (label, found, (one >= 0) & label & found[one], used & label, used)]
                some = np.flatnonzero(np.any(counts, axis=0))
                what = [pa.array(np.full(len(some), k, dtype=np.int32)), pa.array([metric] * len(some), pa.string())]
                yield pa.RecordBatch.from_arrays([cls.dictionary.take(pa.array(some)), *what, *[pa.array(n[some].astype(np.int64)) for n in counts]], schema.names)

    shown = ["_frame", *labels.columns, *[v.alias(k) for k, v in behind.items()]]
    parts = by_frame(rows, "_frame", [*FRAME, "cls", "gt_id", "line_idx", "loc_x", "loc_z"], work, schema, shown)
    keys = ["cls", "difficulty", "metric"]
    return parts.groupBy(*keys).agg(*[F.sum(f.name).alias(f.name) for f in numbers_of])


def _first_at_place(rows: pa.RecordBatch, group: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its group at its place; nulls are one place, as are NaN."""
    keys = [group]
    for k in ("loc_x", "loc_z"):
        at, known = numbers(rows, [k])[:, 0], rows.column(k).is_valid().to_numpy(zero_copy_only=False)
        keys += [np.isnan(at) + ~known * 1, np.nan_to_num(at, nan=0.0, posinf=np.inf, neginf=-np.inf)]
    order = np.lexsort(keys[::-1])
    first = np.zeros(len(order), dtype=bool)
    first[:1] = True
    for v in keys:
        first[1:] |= v[order[1:]] != v[order[:-1]]
    out = np.empty(len(order), dtype=bool)
    out[order] = first
    return out


def _above(common: np.ndarray, one: np.ndarray, two: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The intersection over union and whether it is above ``least``, as Spark compares: NaN is above, nothing over nothing is not."""
    union = one + two - common
    value = common / union
    return (union != 0) & ((value > least) | np.isnan(value)), value


def _within(group: np.ndarray, ok: np.ndarray, x: np.ndarray, half: np.ndarray, odd: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the rows ``ok`` of one group that may overlap by more than ``least``; where a group has an ``odd`` row, that may touch."""
    strange = np.zeros(int(group.max(initial=0)) + 1, dtype=bool)
    strange[group[ok & odd]] = True
    at = np.flatnonzero(ok)
    reach = half[at] * np.where(strange[group[at]], 2.0, 1 / least - 1)
    for i, j in kernels.reached_pairs(group[at], x[at], reach + 1e-9 * (np.abs(x[at]) + half[at])):
        yield at[i], at[j]


def _image_overlaps(rows: pa.RecordBatch, group: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(own, value, i, j, overlap): whether and by how much rows overlap themselves, and the pairs of different rows, either way round, that do."""
    e = numbers(rows, ["u0", "u1", "v0", "v1"])
    ok = np.isfinite(e).all(axis=1) & (e[:, 1] >= e[:, 0]) & (e[:, 3] >= e[:, 2])
    wide, tall = e[:, 1] - e[:, 0], e[:, 3] - e[:, 2]
    size, some = wide * tall, []
    hit, value = _above(size, size, size, least)
    for i, j in _within(group, ok, (e[:, 0] + e[:, 1]) / 2, wide / 2, ~(np.maximum(wide, tall) < 1e100), least):
        both = [np.minimum(e[i, k + 1], e[j, k + 1]) - np.maximum(e[i, k], e[j, k]) for k in (0, 2)]
        touch = (both[0] >= 0) & (both[1] >= 0)
        i, j, common = i[touch], j[touch], (both[0] * both[1])[touch]
        above, overlap = _above(common, size[i], size[j], least)
        some += [(i[above], j[above], overlap[above]), (j[above], i[above], overlap[above])]
    return ok & hit, value, *_joined(some, (int, int, float))


def _box_overlaps(rows: pa.RecordBatch, group: np.ndarray, least: float) -> list[tuple[np.ndarray, ...]]:
    """As :func:`_image_overlaps`, of the BEV and of the 3D boxes."""
    box, (h, y) = numbers(rows, _BOX), numbers(rows, ["h", "loc_y"]).T
    flip, bare = np.array([1.0, 1.0, 1.0, 1.0, -1.0]), ~rows.column("loc_y").is_valid().to_numpy(zero_copy_only=False)
    half, size = np.sqrt(box[:, 2] * box[:, 2] + box[:, 3] * box[:, 3]) / 2, box[:, 2] * box[:, 3]
    ok = np.isfinite(np.column_stack([box[:, :2] - half[:, None], box[:, :2] + half[:, None], box[:, 4]])).all(axis=1) & (size > 0)
    low, high = y - h, y + h * 0.0

    def both(i: np.ndarray, j: np.ndarray, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield _above(common, size[i], size[j], least)
        # a place that is null doesn't bound the common height, NaN is above all numbers
        top = np.where(bare[i], high[j], np.where(bare[j], high[i], np.fmin(high[i], high[j])))
        bottom = np.where(bare[i], low[j], np.where(bare[j], low[i], np.maximum(low[i], low[j])))
        tall = np.where(bare[i] & bare[j], 0.0, np.maximum(top - bottom, 0.0))
        yield _above(common * tall, size[i] * h[i], size[j] * h[j], least)

    every, some = np.arange(len(box)), ([], [])
    own = list(both(every, every, size))
    for i, j in _within(group, ok, box[:, 0], half, ~((h < 1e100) & (np.abs(y) < 1e100)), least):
        close = np.abs(box[i, 1] - box[j, 1]) <= 2 * half[i]  # i has the larger reach
        i, j = np.concatenate([i[close], j[close]]), np.concatenate([j[close], i[close]])
        common = kernels.paired_overlap(box[i] * flip, box[j] * flip)
        i, j, common = i[common > 0], j[common > 0], common[common > 0]
        for met, (above, overlap) in zip(some, both(i, j, common)):
            met.append((i[above], j[above], overlap[above]))
    return [(ok & hit, value, *_joined(met, (int, int, float))) for (hit, value), met in zip(own, some)]


def rebuilt(labels: DataFrame, found: DataFrame, dims: Sequence[str], records: dict[str, Column], lines: dict[str, Column]) -> DataFrame:
    """(pred_id, cond, gt_id, track, ambiguous): see :func:`quernstone.plans.tables.j12_x12_rebuilt_ids`.

    ``lines`` and ``records`` are the rounded dimensions ("a" or "b" and the name of ``dims``) of a label as a line and as a record.
    """
    rows = sides(labels, found, {**lines, **records})
    schema = T.StructType([*found.select("pred_id", "cond").schema.fields, *labels.select("gt_id", F.col("trk_id").alias("track")).schema.fields, T.StructField("ambiguous", T.BooleanType())])

    def work(s: Sides) -> Iterator[pa.RecordBatch]:
        line, record = (numbers(s.a, [p + k for k in dims]) for p in "ab")
        x = list(dims).index("loc_x")
        ok = [np.flatnonzero(np.isfinite(v).all(axis=1)) for v in (line, record)]
        some = []
        for i, j in pair_blocks(s.group_a[ok[0]], line[ok[0], x], s.group_a[ok[1]], record[ok[1], x], 0.005, np.arange(len(ok[0]))):
            i, j = ok[0][i], ok[1][j]
            same = (np.abs(line[i] - record[j]) < 0.005).all(axis=1)
            some.append((i[same], j[same]))
        i, j = _joined(some, (int, int))
        ident, at = s.a.column("_id").to_numpy(), numbers(s.a, ["line_idx"])[:, 0]
        order = np.lexsort((ident[j], ident[i], np.nan_to_num(at, nan=-np.inf)[i], s.group_a[i]))
        i, j = i[order], j[order]
        role = claims(i, j, 2)
        record_of, unsure = np.full(len(ident), -1), np.zeros(len(ident), dtype=bool)
        record_of[i[role == 0]] = j[role == 0]
        unsure[i[role == 1]] = True
        of, _ = best_first(s, 0.5, False, False)
        has = of >= 0
        track, doubt = np.full(len(of), -1), np.zeros(len(of), dtype=bool)
        track[has], doubt[has] = record_of[of[has]], unsure[of[has]]
        yield pa.RecordBatch.from_arrays([s.b.column("_id"), s.b.column("cond"), _taken(s.a, "_id", of), _taken(s.a, "trk_id", track), pa.array(doubt)], schema.names)

    return _passes(rows, work, schema)


def fates(labels: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(pred_id, seq, frame, cond, cls, score, gt_id, iou, fate): every detection of a class with the label it got ("tp") or none ("fp"), and
    ("fn") every label that was missed under a condition seen in its frame, be it by detections of no class.
    """
    rows = sides(labels, found)
    schema = T.StructType(
        [*found.select("pred_id", *FRAME, "cond", "cls", "score").schema.fields, *labels.select("gt_id").schema.fields, T.StructField("iou", T.DoubleType()), T.StructField("fate", T.StringType())]
    )
    for field in schema.fields:
        field.nullable = True

    def work(s: Sides) -> Iterator[pa.RecordBatch]:
        of, iou = best_first(s, least, True, True)
        hit = pa.array(np.where(of >= 0, "tp", "fp"))
        yield pa.RecordBatch.from_arrays([*s.b.select(["_id", *FRAME, "cond", "cls", "score"]).columns, _taken(s.a, "_id", of), pa.array(iou, mask=of < 0), hit], schema.names)
        first, last = (np.searchsorted(s.seen[:, 0], s.frame_a, side) for side in ("left", "right"))
        i = np.repeat(np.arange(len(first)), last - first)
        cond = s.seen[np.arange(len(i)) - np.repeat(np.cumsum(last - first) - last, last - first), 1]
        got, n = np.flatnonzero(of >= 0), len(first)
        missed = ~np.isin(cond * n + i, s.cond[got] * n + of[got])
        a, n = s.a.take(pa.array(i[missed])), int(missed.sum())
        none = [pa.nulls(n, s.b.column(c).type) for c in ("_id", "score")]
        yield pa.RecordBatch.from_arrays(
            [none[0], *a.select(FRAME).columns, s.conditions(cond[missed]), a.column("cls"), none[1], a.column("_id"), pa.nulls(n, pa.float64()), pa.array(["fn"] * n, pa.string())], schema.names
        )

    return _passes(rows, work, schema)


def nearest_assignment(labels: DataFrame, found: DataFrame, radius: float, missing: float) -> DataFrame:
    """(gt_id, cond, pred_id, cost): labels and detections of a frame, class and condition assigned at least total distance.

    Only pairs nearer than ``radius`` count; a label without one costs ``missing``. As in :func:`quernstone.operators.matching.cheapest_pairs`, some
    optimal assignment uses of a label's detections only as many as its group has labels, the cheapest; the others go at once.
    A component of one label is settled by its cheapest detection, the rest by the augmenting-path solver.
    """
    rows = sides(labels, found)
    schema = T.StructType([*labels.select("gt_id").schema.fields, *found.select("cond", "pred_id").schema.fields, T.StructField("cost", T.DoubleType())])

    def cheapest(row: np.ndarray, cost: np.ndarray, ident: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The ``most`` cheapest pairs of every row, by row, cost and id."""
        order = np.lexsort((ident, cost, row))
        starts = run_starts(row[order])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        return order[rank < most[order]]

    def work(s: Sides) -> Iterator[pa.RecordBatch]:
        place = [numbers(x, ["loc_x", "loc_z"]) for x in (s.a, s.b)]
        ok = [np.flatnonzero(np.isfinite(p).all(axis=1)) for p in place]
        ident, conds = s.b.column("_id").to_numpy(), len(s.names.dictionary)
        in_group = np.bincount(s.group_a)
        some = []
        for i, j in pair_blocks(s.group_a[ok[0]], place[0][ok[0], 0], s.group_b[ok[1]], place[1][ok[1], 0], radius, np.arange(len(ok[0]))):
            i, j = ok[0][i], ok[1][j]
            d = place[0][i] - place[1][j]
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
            near = d2 < radius * radius
            i, j, cost = i[near], j[near], np.sqrt(d2[near])
            of = cheapest(i * conds + s.cond[j], cost, ident[j], in_group[s.group_a[i]])
            some.append((i[of], j[of], cost[of]))
        i, j, cost = _joined(some, (int, int, float))
        row = i * conds + s.cond[j]
        # as many as the labels of the group that have a pair under the condition
        first = np.unique(row, return_index=True)[1]
        group = np.unique(s.group_a[i] * conds + s.cond[j], return_inverse=True)[1]
        of = cheapest(row, cost, ident[j], np.bincount(group[first], minlength=1)[group])
        i, j, cost, row = i[of], j[of], cost[of], row[of]
        (each, ri), (cols, cj) = np.unique(row, return_inverse=True), np.unique(j, return_inverse=True)
        of_row = kernels.pair_components(ri, cj, len(each), len(cols))
        part = of_row[ri]
        alone = np.bincount(of_row, minlength=1)[part] == 1
        keep = np.zeros(len(row), dtype=bool)
        keep[run_starts(row)] = True  # a row's cheapest pair comes first
        keep &= alone & (cost < missing)
        rest = np.flatnonzero(~alone)
        rest = rest[np.argsort(part[rest], kind="stable")]
        starts = run_starts(part[rest])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rest)]):
            at = rest[lo:hi]
            (r, pi), (_, c, pj) = np.unique(i[at], return_inverse=True), np.unique(ident[j[at]], return_index=True, return_inverse=True)
            matrix = np.full((len(r), max(len(r), len(c))), missing)
            matrix[pi, pj] = cost[at]
            keep[at] = (kernels.cheapest_assignment(matrix)[pi] == pj) & (cost[at] < missing)
        i, j = pa.array(i[keep]), pa.array(j[keep])
        yield pa.RecordBatch.from_arrays([s.a.column("_id").take(i), s.b.column("cond").take(j), s.b.column("_id").take(j), pa.array(cost[keep])], schema.names)

    return _passes(rows, work, schema)
