"""Labels and detections matched within whole frames: one shuffle of the rows alone, and the matches of the joins they replace."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from quernstone.functions import geometry as g
from quernstone.operators import kernels
from quernstone.operators.evaluation import equal_scores_precision, recall_picks
from quernstone.operators.matching import bev, bev_candidates, cheapest_pairs, greedy_pairs
from quernstone.operators.spatial import within_radius
from quernstone.plans import domain as d
from quernstone.plans.benchmark import _rotated_pairs, report
from tests.oracle import DATA
from tests.test_frames import nodes_of
from tests.test_whole_jobs import GT, PR

KEYS = ["seq", "frame", "cls"]
KNOWN = "seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL"


def crowd(spark, folder):
    """Crowded frames of two classes; rows given twice, equal scores and lines, unknown keys, places without number, a bad extent."""
    rng = random.Random(5)
    nan, far = float("nan"), float("inf")

    def spot():
        return round(rng.uniform(0, 14), 2), round(rng.uniform(0, 14), 2)

    labels, found = [], []
    for i in range(160):
        x, z = spot()
        labels.append((i, "21", f"{i % 5:06d}", rng.choice([None, 1, 2, 3]), rng.choice(["sed", " Bus "]), 1.5, 2.0, rng.choice([3.0, 4.0]), x, 0.0, z, rng.uniform(-3, 3), rng.choice([None, i]), False))
    twins = [(1000 + k, *r[1:12], 1000 + k, False) for k, r in enumerate(labels[:60])]  # equal boxes under another id
    labels += [*twins, *labels[:20], (900, "21", "000001", 1, "sed", 1.5, 80.0, 90.0, 5.0, 0.0, 5.0, 0.1, 900, False)]
    labels += [(901, "21", "000001", 1, "sed", 1.5, 2.0, 4.0, nan, 0.0, 5.0, 0.1, 901, False), (902, "21", "000001", 1, "sed", 1.5, None, 4.0, 5.0, 0.0, far, 0.1, 902, False)]
    labels += [(903, None, "000001", 1, "sed", 1.5, 2.0, 4.0, 5.0, 0.0, 5.0, 0.1, 903, False), (904, "21", "000001", 1, None, 1.5, 2.0, 4.0, 5.0, 0.0, 5.0, 0.1, 904, False)]
    for i in range(700):
        _, seq, frame, _, cls, h, w, l, x, y, z, rot, trk, _ = labels[rng.randrange(160)]
        x, z, score = round(x + rng.gauss(0, 0.4), 2), round(z + rng.gauss(0, 0.4), 2), rng.choice([None, nan, 0.5, rng.random()])
        found.append((i, seq, frame, rng.choice(["fog", "original"]), rng.choice([None, 1, 2, 3]), cls, h, w, l, x, y, z, rot, score, trk, False))
    found += [*found[:40], (900, "21", "000001", "fog", 1, "sed", 1.5, 80.0, 90.0, 5.0, 0.0, 5.0, 0.1, 0.4, 1, False), (901, "21", "000001", "fog", 1, "sed", 1.5, 2.0, 4.0, None, 0.0, nan, 0.1, 0.9, 1, False)]
    found += [(902, "21", "000002", "clear", 1, None, 1.5, 2.0, 4.0, 5.0, 0.0, 5.0, 0.1, 0.9, 1, False), (903, "21", "000001", None, 1, "sed", 1.5, 2.0, 4.0, 5.0, 0.0, 5.0, 0.1, 0.9, 1, False)]
    rng.shuffle(labels), rng.shuffle(found)
    spark.createDataFrame(labels, GT).repartition(3).write.parquet(f"{folder}/gt_lines.parquet")
    spark.createDataFrame(found, PR).repartition(3).write.parquet(f"{folder}/pred_lines.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    return crowd(spark, tmp_path_factory.mktemp("crowd"))


@pytest.fixture(params=["7", "10000"])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def shuffles_once(query):
    nodes = nodes_of(query)
    assert len([n for n in nodes if n.startswith("Exchange")]) == 1
    assert not [n for n in nodes if n.startswith(("Generate", "SortMergeJoin", "BroadcastHashJoin", "Window"))]


def test_rebuilt_ids_shuffle_rows_once(spark):
    shuffles_once(queries()["j12_x12_rebuilt_ids"](spark, DATA))


def test_rebuilt_ids_are_those_of_the_joins(spark, crowded, batches):
    c, dims = F.col, ["h", "w", "l", "loc_x", "loc_y", "loc_z", "rot_y"]
    base = d.gt(spark, crowded).where(KNOWN)
    lines = base.select("gt_id", "line_idx", *KEYS, *[F.round(k, 2).alias("a" + k) for k in dims])
    records = base.select(c("gt_id").alias("rid"), c("trk_id").alias("track"), *KEYS, *[F.round(c(k) + c("gt_id") % 2 * 0.001, 2).alias("b" + k) for k in dims])
    near = within_radius(lines, records, KEYS, ["aloc_x", "aloc_z"], ["bloc_x", "bloc_z"], 0.0075)
    for k in dims:
        near = near.where(F.abs(c("a" + k) - c("b" + k)) < 0.005)
    records_of = {}
    for r in greedy_pairs(near, KEYS, "gt_id", "rid", [F.asc("line_idx")], [], spare="spare").collect():
        track, unsure = records_of.get(r.gt_id, (None, False))
        records_of[r.gt_id] = (track, True) if r.spare else (r.track, unsure)
    found = d.preds(spark, crowded).where(KNOWN).where("cond IS NOT NULL")
    a = bev(found, "a", "pred_id", KEYS, [c("cond"), F.coalesce("score", F.lit(0.0)).alias("score"), c("line_idx")])
    pairs = bev_candidates(a, bev(base, "b", "gt_id", KEYS), KEYS).where("iou > 0.5")
    hit = {r.pred_id: r.gt_id for r in greedy_pairs(pairs, [*KEYS, "cond"], "pred_id", "gt_id", [F.desc("score"), F.asc("line_idx")], [F.desc("iou")]).collect()}
    want = {r.pred_id: (r.cond, hit.get(r.pred_id), *records_of.get(hit.get(r.pred_id), (None, False)), r.pred_id not in hit) for r in found.collect()}
    rows = queries()["j12_x12_rebuilt_ids"](spark, crowded).collect()
    assert {r.pred_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)
    assert len(hit) > 100 and any(v[3] for v in want.values())


def test_assignment_shuffles_rows_once(spark):
    shuffles_once(queries()["j27_cheapest_assignment"](spark, DATA))


def test_assignment_costs_what_that_of_the_joins_costs(spark, crowded, batches):
    c = F.col
    gt, found = d.gt(spark, crowded).where(KNOWN), d.preds(spark, crowded).where(KNOWN).where("cond IS NOT NULL")
    near = within_radius(gt.select(*KEYS, "gt_id", c("loc_x").alias("ax"), c("loc_z").alias("az")), found.select(*KEYS, "cond", "pred_id", c("loc_x").alias("bx"), c("loc_z").alias("bz")), KEYS, ["ax", "az"], ["bx", "bz"], 10.0)
    near = near.select(*KEYS, "cond", "gt_id", "pred_id", F.sqrt("d2").alias("cost"))
    group = {r.pred_id: (r.frame, r.cls, r.cond) for r in found.collect()}

    def totals(rows):
        for n in ("gt_id", "pred_id"):
            assert len({(r.cond, r[n]) for r in rows}) == len(rows)
        return {k: (len(v), pytest.approx(sum(v), abs=1e-4)) for k in set(group.values()) if (v := [r.cost for r in rows if group[r.pred_id] == k])}

    got = queries()["j27_cheapest_assignment"](spark, crowded).collect()
    assert totals(got) == totals(cheapest_pairs(near, [*KEYS, "cond"], "gt_id", "pred_id", "cost", 1000.0).collect())
    cost = {(r.gt_id, r.pred_id): r.cost for r in near.collect()}
    assert all(r.cost == pytest.approx(cost[r.gt_id, r.pred_id], abs=1e-6) and group[r.pred_id][2] == r.cond for r in got) and len(got) > 200


def test_prediction_rows_shuffle_rows_once(spark):
    shuffles_once(queries()["x05_prediction_rows"](spark, DATA))


def test_prediction_rows_are_those_of_the_joins(spark, crowded, batches):
    c = F.col
    labels, rows = d.gt(spark, crowded).where(KNOWN), d.preds(spark, crowded).where("seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL")
    found = rows.where(KNOWN).withColumn("score", F.coalesce("score", F.lit(0.0)))
    pairs = _rotated_pairs(spark, crowded, labels, found).withColumn("iou", g.iou(c("area"), c("al") * c("aw"), c("bl") * c("bw"))).where("iou >= 0.3")
    taken = {r.pred_id: r for r in greedy_pairs(pairs, [*KEYS, "cond"], "pred_id", "gt_id", [F.desc("score"), c("p_line")], [F.desc("iou")]).collect()}
    want = [(r.pred_id, r.seq, r.frame, r.cond, r.cls, r.score, t and t.gt_id, t and pytest.approx(t.iou, abs=1e-6), "tp" if t else "fp") for r in found.collect() for t in [taken.get(r.pred_id)]]
    hit = {(t.gt_id, t.cond) for t in taken.values()}
    seen = {(r.seq, r.frame, r.cond) for r in rows.collect()}
    missed = {(None, r.seq, r.frame, cond, r.cls, None, r.gt_id, None, "fn") for r in labels.collect() for seq, frame, cond in seen if (seq, frame) == (r.seq, r.frame) and (r.gt_id, cond) not in hit}
    got = [tuple(r) for r in queries()["x05_prediction_rows"](spark, crowded).collect()]
    assert {r for r in got if r[-1] == "fn"} == missed and any(r[3] == "clear" for r in missed)
    assert sorted((r for r in got if r[-1] != "fn"), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert len(got) == len(want) + len(missed) and len(taken) > 200


def test_labels_as_predictions_are_judged_as_by_the_joins(spark, crowded):
    query = queries()["x11_labels_as_predictions"](spark, crowded)
    assert not [f for f in query.inputFiles() if "gt_lines" in f]  # the labels are read and chosen once
    labels = d.gt(spark, crowded).where(KNOWN).where("l > 0 AND w > 0 AND h > 0").dropDuplicates([*KEYS, "loc_x", "loc_z"])
    found = labels.withColumns({"pred_id": F.col("gt_id"), "cond": F.lit("labels"), "score": F.lit(1.0)})
    want = report(labels, found, {"bbox": (0.7,), "bev": (0.7,), "3d": (0.7,)}).select("cls", "difficulty", "metric", "num_gt", F.round("ap", 6).alias("ap"))
    rows = sorted(map(tuple, query.collect()))
    assert rows == sorted(map(tuple, want.collect())) and any(r[4] > 0 for r in rows)


def test_labels_as_predictions_leave_the_frames_as_counts(spark, crowded):
    query = queries()["x11_labels_as_predictions"](spark, crowded)
    assert {f.rsplit("/", 2)[1].split("-")[0] for f in query.inputFiles()} == {"judged"}
    assert not [n for n in nodes_of(query) if n.startswith(("Exchange", "Generate", "SortMergeJoin", "BroadcastHashJoin", "Window", "BroadcastExchange"))]


@pytest.mark.parametrize("batch", ["5", "10000"])
def test_labels_as_predictions_of_odd_labels(spark, tmp_path, batch):
    rng, nan, far = random.Random(8), float("nan"), float("inf")
    labels = []
    for i in range(120):  # some groups so dense that labels take each other's place
        x, z = round(rng.uniform(-3, 3), 1), round(rng.uniform(8, 12), 1)
        labels.append((i, f"{i % 3}", "7", rng.choice([None, 1, 2]), rng.choice(["sed", "bus", "ped"]), rng.choice([1.2, 0.4]), 2.0, 4.0, x, 0.0, z, rng.choice([0.0, 0.1]), None, rng.choice([None, True, False])))
    odd = [(nan, 0.0, 0.0), (1.5, nan, 0.1), (1.5, None, 0.2), (1.4, None, 3.0), (far, 0.0, 0.3), (1e200, 0.0, 0.4)]  # height, place, shift
    labels += [(300 + i, "9", f"{rng.randrange(2)}", i, "odd", h, 2.0, 4.0, 1.0 + shift, y, 9.0, 0.0, None, False) for i, (h, y, shift) in enumerate(odd * 3) if not i % 7 == 6]
    labels += [(400, "9", "8", 1, "sed", 1.5, 2.0, 4.0, 0.0, 0.0, 9.0, 0.0, None, False), (401, "9", "8", 1, "sed", 1.5, 2.0, 4.0, -0.0, 0.0, 9.0, 0.0, None, False)]  # one place
    labels += [(i, "9", "9", 1, "sed", 1.5, 2.0, 4.0, x, 0.0, 9.0, 0.0, None, False) for i, x in ((410, None), (420, None), (430, nan), (440, nan))]
    labels += [(450, "9", f, 1, c, 1.5, 2.0, 4.0, 0.0, 0.0, 9.0, 0.0, None, False) for f, c in (("10", "van"), ("11", "van"), ("10", "van"))]  # one id in two frames
    labels += [(460, "9", "12", 1, "tree", 1.5, 2.0, 4.0, 0.0, 0.0, 9.0, nan, None, False), (470, "9", "12", 1, "tree", 1.5, far, 4.0, 5.0, 0.0, 9.0, 0.0, None, False)]
    spark.createDataFrame(labels, GT).repartition(3).write.parquet(f"{tmp_path}/gt_lines.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(tuple, queries()["x11_labels_as_predictions"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    labels = d.gt(spark, str(tmp_path)).where(KNOWN).where("l > 0 AND w > 0 AND h > 0").dropDuplicates([*KEYS, "loc_x", "loc_z"])
    found = labels.withColumns({"pred_id": F.col("gt_id"), "cond": F.lit("labels"), "score": F.lit(1.0)})
    want = report(labels, found, {"bbox": (0.7,), "bev": (0.7,), "3d": (0.7,)}).select("cls", "difficulty", "metric", "num_gt", F.round("ap", 6).alias("ap"))
    assert got == sorted(map(tuple, want.collect()))
    assert {"sed", "odd", "van", "tree"} < {r[0] for r in got} and [r[3] for r in got if r[0] == "van"] == [1] * 9


def test_a_label_as_prediction_meets_itself(spark, tmp_path):
    # clipped by itself this box loses a fifth of its area
    spark.createDataFrame([(10, "21", "1", 1, "bus", 3.0, 2.83, 8.35, 1.04, 0.0, 63.46, -0.83, None, False)], GT).write.parquet(f"{tmp_path}/gt_lines.parquet")
    assert {r.metric: r.ap for r in queries()["x11_labels_as_predictions"](spark, str(tmp_path)).collect() if r.difficulty == 2} == dict.fromkeys(("bbox", "bev", "3d"), round(100 / 41, 6))


def test_samples_of_equal_scores_are_those_of_recall(spark):
    rows = [(n, tp) for n in (1, 2, 3, 19, 20, 21, 39, 40, 41, 42, 43, 80, 500, 5001) for tp in sorted({0, 1, 2, n // 3, n // 2, n - 1, n}) if tp <= n]
    n = spark.createDataFrame(rows, "num_gt long, num_tp long")
    counts = n.select("*", F.col("num_tp").alias("first"), F.lit(1).alias("tp"), F.lit(4).alias("counted"), F.lit(1).alias("used"))
    got = {(r.num_gt, r.num_tp): round(r.ap * 41 * 4 / 100) for r in equal_scores_precision(counts).collect()}
    want = {(r.num_gt, r.num_tp): r["count"] for r in recall_picks(n, ["num_gt", "num_tp"]).groupBy("num_gt", "num_tp").count().collect()}
    assert got == {k: want.get(k, 0) for k in rows}


@pytest.mark.parametrize("most", [3, 300_000])
def test_reached_pairs_against_all_pairs(most):
    rng = np.random.default_rng(2)
    group, x, reach = np.sort(rng.integers(0, 6, 90)), rng.uniform(0, 9, 90), rng.choice([0.0, 0.3, 0.3, 5.0], 90)
    got = [(a, b) for i, j in kernels.reached_pairs(group, x, reach, most) for a, b in zip(i.tolist(), j.tolist())]
    want = {(a, b) for a in range(90) for b in range(a) if group[a] == group[b] and abs(x[a] - x[b]) <= max(reach[a], reach[b])}
    assert len(got) == len(want) and {(max(p), min(p)) for p in got} == want
    assert all(reach[a] >= reach[b] for a, b in got)
