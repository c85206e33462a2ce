import math
import random

import numpy as np
import pytest

from quernstone.operators import path_residuals as pr
from quernstone.operators.spikes import implausible_readings

T0 = 1_650_000_000_000_000
SCHEMA = "odo_id long, seq string, timestamp long, local_x double, local_y double, local_z double, _id string, _t int"


def drive(n, seed=1, noise=0.05):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = i * 0.1
        rows.append([i + 1, "21" if i % 3 else "seq_021", T0 + i * 100_000, 3 * s + rng.gauss(0, noise), 20 * math.sin(s / 40) + rng.gauss(0, noise), rng.gauss(0, noise), "clash", None])
    return rows


def flags(spark, rows, **kw):
    out = implausible_readings(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), **kw)
    return {r.odo_id: (r.out_of_range, r.off_path, r.hanging) for r in out.collect()}


@pytest.mark.parametrize("block", [2048, 70])
def test_spikes_hangs_and_ranges(spark, block):
    rows = drive(400)
    for at, k in ((50, 1), (90, 2), (139, 3), (210, 1), (212, 1)):  # 139: across a block of 70
        for j in range(k):
            rows[at + j][3] += 1.5
    for j in range(4):  # four in a row are no spike
        rows[300 + j][4] += 2.0
    for j in range(8):  # nine that hang, the first is no case
        rows[341 + j][3] = rows[340][3]
    for j in range(6):  # seven are too few
        rows[371 + j][4] = rows[370][4]
    rows[10][3], rows[20][4], rows[30][5] = float("nan"), float("inf"), 60_000.0
    rows[40][2], rows[45][2] = 0, None
    rows[60][3] = None
    got = flags(spark, rows + [rows[50]], block=block)
    spikes = {51, 91, 92, 140, 141, 142, 211, 213}
    assert {k for k, v in got.items() if v[1]} == spikes
    assert {k for k, v in got.items() if v[2]} == set(range(342, 350))
    assert {k for k, v in got.items() if v[0]} == {11, 21, 31, 41, 46}


def test_order_of_rows_and_partitions_do_not_matter(spark):
    rows = drive(300, seed=4)
    rows[100][3] += 3
    one = flags(spark, rows)
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(7)
    assert {r.odo_id for r in implausible_readings(df).collect()} == set(one) == {101}


def test_empty_null_and_lone_readings(spark):
    assert flags(spark, []) == {}
    rows = [[1, None, T0, 1.0, 1.0, 1.0, "", 0], [2, None, T0, float("nan"), 1.0, 1.0, "", 0], [None, "3", 0, 1.0, 1.0, 1.0, "", 0], [4, "3", T0, None, None, None, "", 0]]
    assert flags(spark, rows) == {2: (True, False, False)}


def test_season_is_taken_out():
    t = np.arange(200) / 10
    v = t + np.tile([0.0, 0.0, 0.8, 0.0], 50)
    v[77] += 30
    left = v - pr.season_of(v, np.arange(200) % 4, 4)
    assert np.abs(np.diff(np.delete(left, 77), 2)).max() < 0.25


def test_deviate_test_against_published_value():
    # n = 54, alpha = 0.05, first critical value 3.159 (Rosner 1983)
    n, p = 54, 1 - 0.05 / (2 * 54)
    t = pr.t_quantile(np.array([p]), np.array([n - 2]))[0]
    assert abs((n - 1) * t / math.sqrt((n - 2 + t * t) * n) - 3.159) < 2e-3


def test_still_runs_anchor_at_the_first():
    v = np.array([0, 0.0004, 0.0008, 0.0012, 0.0013, 0.0014, 0.0015, 0.0016, 0.0017, 0.0018, 9.0])
    assert list(np.flatnonzero(pr.still_runs(v, 0.001, 8))) == list(range(3, 10))


def test_a_source_with_a_third_of_spikes(spark):
    rows = drive(3000, noise=0.02)
    at = [i + j for i in range(20, 2960, 9) for j in range(3)]
    for i in at:
        rows[i][5] += 2.0
    got = flags(spark, rows)
    assert {k for k, v in got.items() if v[1]} == {i + 1 for i in at}


def test_second_and_last_but_one_reading_are_judged(spark):
    rows = drive(60)
    rows[1][3] += 2.0
    rows[58][4] -= 2.0
    assert {k for k, v in flags(spark, rows).items() if v[1]} == {2, 59}


def test_spikes_beside_a_season(spark):
    rows = drive(600, noise=0.01)
    for i, r in enumerate(rows):
        r[5] += 1.5 if i % 10 == 4 else 0.0
    rows[137][5] += 4.0
    rows[304][5] -= 1.5  # missing where the season has it
    assert {k for k, v in flags(spark, rows, period=10).items() if v[1]} == {138, 305}


def test_a_stuck_clock_is_numbered_like_any_other(spark):
    rows = drive(200)
    for i, r in enumerate(rows):
        r[2] = T0 + (i // 90) * 1_000_000
    from quernstone.operators.blocks import numbered

    df = spark.createDataFrame([(r[0], "s", r[2]) for r in rows], "id long, k string, t long").repartition(5)
    for finer in ([], ["t", "id div 7"]):
        got = {r.id: r._i for r in numbered(df, ["k"], ["t", "id"], "t div 60000000", finer=finer).collect()}
        assert got == {i + 1: i for i in range(200)}
