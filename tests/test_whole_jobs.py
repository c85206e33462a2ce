"""Nothing is left out: detections of a crowded frame, far anchors, every point."""

import itertools
import random

import numpy as np
import pytest

from quernstone.operators import kernels
from quernstone.operators.matching import cheapest_pairs, suppressed
from quernstone.plans import matching, scenes

GT = "gt_id long, seq string, frame string, line_idx int, cls_kw string, h double, w double, l double, loc_x double, loc_y double, loc_z double, rot_y double, trk_id long, ambiguous boolean"
PR = "pred_id long, seq string, frame string, condition string, line_idx int, cls_kw string, h double, w double, l double, loc_x double, loc_y double, loc_z double, rot_y double, score double, trk_id long, is_fp boolean"


def label(i, x, z, w=2.0, l=4.0):
    return (i, "21", "000001", i, "sed", 1.5, w, l, x, 0.0, z, 0.0, i, False)


def detection(i, x, z, score, w=2.0, l=4.0, rot=0.0):
    return (i, "21", "000001", "original", i, "sed", 1.5, w, l, x, 0.0, z, rot, score, i, False)


def stored(spark, folder, labels, detections=()):
    spark.createDataFrame(list(labels), GT).write.parquet(f"{folder}/gt_lines.parquet")
    spark.createDataFrame(list(detections), PR).write.parquet(f"{folder}/pred_lines.parquet")
    return str(folder)


def test_assignment_considers_detections_of_any_score(spark, tmp_path):
    crowd = [detection(i, 8.0 + i / 100, 0.0, 0.9) for i in range(100)]
    sf = stored(spark, tmp_path, [label(1, 0.0, 0.0), label(2, 50.0, 0.0)], [*crowd, detection(200, 0.5, 0.0, 0.1), detection(201, 50.0, 1.0, None)])
    got = {(r.gt_id, r.pred_id, r.cost) for r in scenes.j27_cheapest_assignment(spark, sf).collect()}
    assert got == {(1, 200, 0.5), (2, 201, 1.0)}


def test_assignment_considers_every_label(spark, tmp_path):
    sf = stored(spark, tmp_path, [label(i, 30.0 * i, 0.0) for i in range(70)], [detection(i, 30.0 * i, 1.0, 0.5) for i in range(70)])
    assert scenes.j27_cheapest_assignment(spark, sf).count() == 70


def test_cheapest_pairs_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, r, c, rng.uniform(0, 9)) for g in range(6) for r in range(4) for c in range(9) if rng.random() < 0.45]
    got = cheapest_pairs(spark.createDataFrame(rows, "g int, r int, c int, cost double").repartition(3), ["g"], "r", "c", "cost", 1000.0).collect()
    for g in range(6):
        cost = {(r, c): v for k, r, c, v in rows if k == g}
        best = min(sum(cost.get((r, c), 1000.0) for r, c in enumerate(p)) for p in itertools.permutations(range(9), 4))
        mine = [(x.r, x.c) for x in got if x.g == g]
        assert len({r for r, _ in mine}) == len({c for _, c in mine}) == len(mine)
        assert sum(cost[m] for m in mine) + 1000.0 * (4 - len(mine)) == pytest.approx(best)


def test_pair_components():
    assert list(kernels.pair_components(np.array([0, 1, 2, 2, 3]), np.array([0, 1, 0, 2, 3]), 4, 4)) == [0, 1, 0, 3]


@pytest.mark.parametrize("query", [matching.t05_t07_rotated_nms, scenes.t06_aligned_nms, scenes.t08_circle_nms])
def test_suppression_decides_every_box(spark, tmp_path, query):
    apart = [detection(i, 10.0 * i, 0.0, 0.9 - i / 10_000) for i in range(600)]
    sf = stored(spark, tmp_path, [], [*apart, detection(900, 5990.5, 0.0, 0.01), detection(901, -90.0, 0.0, 0.02)])
    assert {r.pred_id for r in query(spark, sf).collect()} == {*range(600), 901}


@pytest.mark.parametrize("by", ["rotated", "aligned", "circle"])
def test_suppression_does_not_depend_on_batches(spark, by):
    rng = np.random.default_rng(7)
    rows = [(int(i % 3 == 0), i, float(np.round(rng.uniform(), 1)), *map(float, rng.uniform(0, 14, 2)), *map(float, rng.uniform(1, 4, 2)), float(rng.uniform(-3, 3))) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, id int, score double, loc_x double, loc_z double, l double, w double, rot_y double")
    one, many = (sorted(r.id for r in suppressed(df, ["k"], "id", "score", 1.5 if by == "circle" else 0.1, by=by, batch=n).collect()) for n in (4096, 7))
    assert one == many and len(one) < 90


@pytest.mark.parametrize("by", ["rotated", "aligned", "circle"])
def test_suppression_of_odd_rows(spark, by):
    nan, far = float("nan"), float("inf")
    rows = [(1, 1, 0.9, 0.0, 0.0, 4.0, 2.0, 0.0), (1, 1, 0.9, 0.0, 0.0, 4.0, 2.0, 0.0), (1, 2, 0.8, 0.1, 0.0, 4.0, 2.0, 0.0),
            (1, 3, 0.7, nan, 0.0, 4.0, 2.0, 0.0), (1, 4, 0.6, None, 0.0, 4.0, 2.0, 0.0), (1, 5, 0.5, far, 0.0, 4.0, 2.0, 0.0),
            (1, 6, None, 0.0, 0.0, 4.0, 2.0, 0.0), (None, 7, 0.9, 0.0, 0.0, 4.0, 2.0, 0.0), (1, None, 0.9, 0.0, 0.0, 4.0, 2.0, 0.0),
            (2, 8, 0.5, 0.0, 0.0, 4.0, 2.0, 0.0), (2, 9, 0.5, 0.0, 0.0, 4.0, 2.0, 0.0), (2, 9, 0.5, 0.0, 0.0, 4.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, id int, score double, loc_x double, loc_z double, l double, w double, rot_y double")
    for n in (4096, 2, 1):
        assert sorted(r.id for r in suppressed(df, ["k"], "id", "score", 0.1, by=by, batch=n).collect()) == [1, 3, 4, 5, 8]
    assert suppressed(df.limit(0), ["k"], "id", "score", 0.1, by=by).count() == 0
