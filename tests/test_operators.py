import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.operators import blocks, corruption, kernels
from quernstone.operators.components import connected_components, star_edges
from quernstone.operators.evaluation import average_precision
from quernstone.operators.matching import greedy_pairs, suppressed
from quernstone.operators.ranking import global_rank
from quernstone.operators.spatial import overlapping_pairs


def test_global_rank(spark):
    values = [random.Random(3).randrange(50) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(5)
    got = {r.id: r.k for r in global_rank(df, [F.desc("v"), F.asc("id")], "k").collect()}
    want = {i: k for k, (i, _) in enumerate(sorted(enumerate(values), key=lambda x: (-x[1], x[0])))}
    assert got == want
    assert global_rank(df.where("v < 0"), [F.asc("v")], "k").count() == 0


def test_blocked_windows_equal_plain_ones(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(3), i * 3 + rng.randrange(3), i, float(rng.randrange(9)) if rng.random() < 0.4 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, t int, id int, v double").repartition(6)
    w = Window.partitionBy("g").orderBy("t", "id")
    plain = df.select(
        "id", (F.row_number().over(w) - 1).alias("n"), F.lag("id", 2).over(w).alias("lag"), F.last("v", ignorenulls=True).over(w).alias("last"),
        F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next"), F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("sum"),
    )
    cut = blocks.numbered(df, ["g"], ["t", "id"], "t div 100", "n")
    cut = blocks.bounded_window(cut, ["g"], ["t", "id"], "t div 70", 2, {"lag": lambda w: F.lag("id", 2).over(w)}, block=17)
    cut = blocks.carried(cut, ["g"], ["t", "id"], "t div 50", F.col("v"), "last")
    cut = blocks.carried(cut, ["g"], ["t", "id"], "t div 50", F.col("v"), "next", backward=True)
    cut = blocks.running_sums(cut, ["g"], ["t", "id"], "t div 40", {"sum": "v"})
    assert sorted(map(tuple, cut.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def _union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], "random"])
def test_components(spark, edges):
    if edges == "random":
        rng = random.Random(5)
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == _union_find([(a, b) for a, b in edges if a != b])


def test_star_edges_tie_a_hot_key_without_pairs(spark):
    rows = [(i, "k") for i in range(200)] + [(None, "k"), (7, None), (500, "other")]
    edges = star_edges(spark.createDataFrame(rows, "n long, k string"), "n", "k", salts=4)
    assert edges.count() == 199
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_rotated_overlap_goldens():
    box = np.array([[0, 0, 4, 2, 0.3]])
    assert kernels.paired_iou(box, box)[0] == pytest.approx(1.0)
    a, b = np.array([[0, 0, 2, 2, 0.0]]), np.array([[2, 0, 2, 2, 0.0]])
    assert kernels.paired_iou(a, b)[0] == pytest.approx(0.0, abs=1e-9)
    assert kernels.paired_iou(a, np.array([[1, 0, 2, 2, 0.0]]))[0] == pytest.approx(1 / 3)
    assert kernels.paired_iou(a, np.array([[0, 0, 2, 2, np.pi / 4]]), "area")[0] == pytest.approx(8 * (np.sqrt(2) - 1))
    far = np.array([[1e5, 1e5, 3, 2, 1.0]])
    assert kernels.paired_iou(far, far)[0] == pytest.approx(1.0, abs=1e-4)


def test_rotated_overlap_against_sampling():
    rng = np.random.default_rng(2)
    a = np.column_stack([rng.uniform(-1, 1, (20, 2)), rng.uniform(1, 3, (20, 2)), rng.uniform(-3, 3, 20)])
    b = np.column_stack([rng.uniform(-1, 1, (20, 2)), rng.uniform(1, 3, (20, 2)), rng.uniform(-3, 3, 20)])
    grid = np.stack(np.meshgrid(np.linspace(-4, 4, 401), np.linspace(-4, 4, 401)), -1).reshape(-1, 2)

    def inside(box):
        d = grid - box[:2]
        c, s = np.cos(box[4]), np.sin(box[4])
        return (np.abs(d[:, 0] * c + d[:, 1] * s) <= box[2] / 2) & (np.abs(-d[:, 0] * s + d[:, 1] * c) <= box[3] / 2)

    want = [(inside(x) & inside(y)).sum() * 0.0004 for x, y in zip(a, b)]
    assert np.allclose(kernels.paired_overlap(a, b), want, atol=0.05)
    assert np.allclose(kernels.paired_overlap(a, b), kernels.paired_overlap(b, a))


def test_assignment_is_cheapest():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (5, 5)):
        cost = rng.uniform(0, 1, (n, m))
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        got = kernels.cheapest_assignment(cost)
        assert len(set(got)) == n and sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(best)


def test_farthest_points():
    xyz = np.array([[0, 0, 0], [1, 0, 0], [5, 0, 0], [5, 1, 0.0]])
    assert list(kernels.farthest_points(xyz, 3)) == [0, 3, 1] or list(kernels.farthest_points(xyz, 3))[:2] == [0, 3]


def test_greedy_pairs_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(g, p, t, (p * 7919 + g) % 17 / 17, round(rng.random(), 2)) for g in range(6) for p in range(30) for t in range(4) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "g int, p int, t int, score double, iou double").repartition(4)
    got = {(r.g, r.p, r.t) for r in greedy_pairs(df, ["g"], "p", "t", [F.desc("score")], [F.desc("iou")]).collect()}
    want = set()
    for g in range(6):
        free = set()
        for p in sorted({r[1] for r in rows if r[0] == g}, key=lambda p: (-((p * 7919 + g) % 17 / 17), p)):
            for _, _, t, _, _ in sorted([r for r in rows if r[0] == g and r[1] == p], key=lambda r: (-r[4], r[2])):
                if t not in free:
                    free.add(t)
                    want.add((g, p, t))
                    break
    assert got == want


def test_suppression_against_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 80
    b = np.column_stack([rng.uniform(0, 12, (n, 2)), rng.uniform(1, 4, (n, 2)), rng.uniform(-3, 3, n)])
    score = np.round(rng.uniform(0, 1, n), 1)
    rows = [(1, i, float(score[i]), *map(float, b[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, id int, score double, loc_x double, loc_z double, l double, w double, rot_y double")
    got = sorted(r.id for r in suppressed(df, ["k"], "id", "score", 0.1, 60).collect())
    order = sorted(range(n), key=lambda i: (-score[i], i))[:60]
    kept = []
    flip = b * np.array([1, 1, 1, 1, -1])
    for i in order:
        if all(kernels.paired_iou(flip[[j]], flip[[i]])[0] <= 0.1 for j in kept):
            kept.append(i)
    assert got == sorted(kept)


def test_overlapping_pairs_are_all_found_once(spark):
    rng = random.Random(6)

    def box(i):
        x, y = rng.uniform(-20, 20), rng.uniform(-20, 20)
        return (i % 2, i, x, x + rng.uniform(0, 9), y, y + rng.uniform(0, 9))

    a, b = [box(i) for i in range(60)], [box(i) for i in range(60)]
    a += [(0, 60, -1e6, 1e6, -3.0, -2.0), (1, 61, 0.0, 50.0, 0.0, 1.0)]  # more cells than a rectangle is cut into
    b += [(0, 60, 2.0, 3.0, -1e6, 5e6), (1, 61, 0.0, 0.5, -40.0, 40.0), (0, 62, 1.0, float("inf"), 0.0, 1.0)]
    da = spark.createDataFrame([*a, (0, 99, None, 1.0, 0.0, 1.0)], "k int, i int, ax0 double, ax1 double, ay0 double, ay1 double")
    db = spark.createDataFrame(b, "k int, j int, bx0 double, bx1 double, by0 double, by1 double")
    got = [(r.i, r.j) for r in overlapping_pairs(da, db, ["k"], ["ax0", "ax1", "ay0", "ay1"], ["bx0", "bx1", "by0", "by1"], 4.0).collect()]
    want = [(p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3] and p[4] <= q[5] and q[4] <= p[5] and q[3] < 1e300]
    assert sorted(got) == sorted(want)


def _stepwise_ap(rows):
    n = sum(r[2] or r[4] for r in rows)
    tp = sorted((r[1] for r in rows if r[2]), reverse=True)
    cut, k = [], 0  # the k-th sample lies at recall k / 40, compared in whole numbers
    for i, s in enumerate(tp):
        if i < len(tp) - 1 and (2 * i + 3) * 20 < k * n:
            continue
        cut.append(s)
        k += 1
    prec = []
    for t in cut:
        a, b = sum(r[2] and r[1] >= t for r in rows), sum(r[3] and r[1] >= t for r in rows)
        prec.append(a / (a + b))
    for i in range(len(prec) - 2, -1, -1):
        prec[i] = max(prec[i], prec[i + 1])
    return sum(prec) / 41 * 100


@pytest.mark.parametrize("n", [1, 5, 39, 40, 200])
def test_average_precision_against_stepwise(spark, n):
    rng = random.Random(n)
    rows = []
    for _ in range(n):
        hit = rng.random() < 0.7
        rows.append(("a", rng.random() if hit else 0.0, hit, False, not hit))
    rows += [("a", rng.random(), False, True, False) for _ in range(n)] + [("b", 0.5, False, True, False)]
    df = spark.createDataFrame(rows, "cls string, score double, is_tp boolean, is_fp boolean, is_fn boolean")
    got = {r.cls: r.ap for r in average_precision(df, ["cls"]).collect()}
    assert got == {"a": pytest.approx(_stepwise_ap([r for r in rows if r[0] == "a"]))}


def test_labels_as_predictions_give_full_precision(spark):
    rows = [("a", i / 100, True, False, False) for i in range(100)]
    df = spark.createDataFrame(rows, "cls string, score double, is_tp boolean, is_fp boolean, is_fn boolean")
    assert average_precision(df, ["cls"]).first().ap == pytest.approx(100.0)


def test_corruptions_do_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 5).alias("frame"), F.lit(1.0).alias("x"), F.lit(2.0).alias("power"))
    steps = [
        ("gaussian_noise", {"keys": ["id"], "columns": {"x": 0.5}, "seed": 3}),
        ("partial_loss", {"by": ["frame"], "share": 0.3, "draw": F.pmod(F.xxhash64("id"), F.lit(1_000_003)), "ties": ["id"], "columns": ["power"]}),
        ("dropout", {"keys": ["id"], "rate": 0.2, "seed": 3}),
    ]
    one, many = ({tuple(r) for r in corruption.corrupt(df.repartition(p), steps).collect()} for p in (1, 16))
    assert one == many and 180 < len(one) < 300
    lost = corruption.partial_loss(df, ["frame"], 0.3, F.col("id"), ["id"], ["power"]).groupBy("frame").agg(F.count_if(F.col("power") == 0).alias("n"))
    assert {r.n for r in lost.collect()} == {18}


def test_null_and_zero_blackouts_differ_and_unknown_effects_fail(spark):
    df = spark.createDataFrame([(1, 2.5)], "id int, power double")
    assert corruption.complete_loss(df, ["power"]).first().power is None
    assert corruption.complete_loss(df, ["power"], zero=True).first().power == 0.0
    with pytest.raises(ValueError, match="unknown effect"):
        corruption.corrupt(df, [("blur", {})])


def test_noise_moments(spark):
    df = spark.range(20_000).select(corruption.normal(1, "n", F.col("id")).alias("z"))
    m, s = df.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(m) < 0.03 and abs(s - 1) < 0.03


def _graded_by_hand(labels, found, pairs, level, grade):
    """Benchmark precision of one class and metric, label by label; ``pairs``: (gt, pred) -> overlap."""
    occ, trunc, least = grade
    off = {g: o > occ or t > trunc or h <= least for g, o, t, h in labels}
    low = {p: h < least for p, _, h in found}

    def pass_(threshold, counted):
        used, tps = set(), []
        for g, *_ in labels:
            best = None
            for p, s, _ in found:
                if p in used or s < threshold or pairs.get((g, p), 0) <= level:
                    continue
                rank = (low[p], -pairs[g, p] if not low[p] else 0) if counted else (-s,)
                if best is None or rank < best[0]:
                    best = (rank, p)
            if best:
                used.add(best[1])
                if not off[g] and not low[best[1]]:
                    tps.append(dict((p, s) for p, s, _ in found)[best[1]])
        return tps, sum(1 for p, s, _ in found if s >= threshold and not low[p] and p not in used)

    n = sum(not v for v in off.values())
    scores = sorted(pass_(-1, False)[0], reverse=True)
    cut, k = [], 0
    for i, s in enumerate(scores):
        if i < len(scores) - 1 and (2 * i + 3) * 20 < k * n:
            continue
        cut.append(s)
        k += 1
    prec = []
    for t in cut:
        tps, fp = pass_(t, True)
        prec.append(len(tps) / max(1, len(tps) + fp))
    return sum(max(prec[i:]) for i in range(len(prec))) / 41 * 100


@pytest.mark.parametrize("seed", [1, 2])
def test_graded_precision_against_label_by_label(spark, seed):
    from quernstone.operators.evaluation import DIFFICULTIES, graded_precision

    rng = random.Random(seed)
    frames = {}
    labels, found, pairs = [], [], []
    for f in range(12):
        gs = [(100 * f + i, rng.randrange(3), rng.choice([0.0, 0.2, 0.4]), rng.choice([20.0, 30.0, 60.0])) for i in range(6)]
        ps = [(100 * f + i, round(rng.random(), 3) + f * 1e-5 + i * 1e-6, rng.choice([20.0, 30.0, 60.0])) for i in range(7)]
        over = {(g[0], p[0]): round(rng.random(), 3) for g in gs for p in ps if rng.random() < 0.35}
        frames[f] = (gs, ps, over)
        labels += [(1, f, *g) for g in gs]
        found += [(1, f, *p) for p in ps]
        score = {p[0]: p[1] for p in ps}
        pairs += [(1, f, "bev", g, p, v, g, p, 0.0) for (g, p), v in over.items()]
    a = spark.createDataFrame(labels, "k int, f int, gt_id long, occluded int, truncated double, height double")
    b = spark.createDataFrame(found, "k int, f int, pred_id long, score double, height double")
    c = spark.createDataFrame(pairs, "k int, f int, metric string, gt_id long, pred_id long, overlap double, g_line long, p_line long, turn double")
    got = {r.difficulty: r.ap for r in graded_precision(a, b, c, ["k"], ["f"], {"bev": (0.3,)}).collect()}
    for i, grade in enumerate(DIFFICULTIES):
        # frames are judged apart: give every frame's labels and detections their own ids and one list
        gs = [g for f in frames for g in frames[f][0]]
        ps = [p for f in frames for p in frames[f][1]]
        over = {k: v for f in frames for k, v in frames[f][2].items()}
        assert got[i] == pytest.approx(_graded_by_hand(gs, ps, over, 0.3, grade))


def test_farthest_sample_in_rounds(spark):
    from quernstone.operators import kernels
    from quernstone.operators.matching import farthest_sample

    rng = np.random.default_rng(5)
    rows = [(k, i, *map(float, rng.uniform(0, 9, 3))) for k in range(3) for i in range(30)]
    got = farthest_sample(spark.createDataFrame(rows, "k int, i int, x double, y double, z double"), ["k"], ["i"], ["x", "y", "z"], 6).collect()
    for k in range(3):
        own = np.array([r[2:] for r in rows if r[0] == k])
        assert [r.i for r in sorted((r for r in got if r.k == k), key=lambda r: r.place)] == list(kernels.farthest_points(own, 6))


def test_order_statistics_equal_the_exact_quantile(spark):
    from quernstone.operators.radar import order_statistics

    rng = random.Random(9)
    rows = [(g, rng.choice([rng.random(), 0.5, float("nan")])) for g in range(4) for _ in range(50)] + [(9, 3.0), (8, None)]
    got = {r.g: r._q for r in order_statistics(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", 0.9, ranges=8).collect()}
    for g in {g for g, v in rows if v is not None and v == v}:
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None and v == v], 0.9))
    assert set(got) == {0, 1, 2, 3, 9}
