import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions.keys import exact_seconds
from quernstone.llm import queries
from quernstone.llm.nearest import nearest_in_time
from quernstone.llm.sampling import sample_by_targets
from quernstone.llm.splits import balanced_bins, deal_bins, grouped_splits
from quernstone.llm.terms import term_frequencies
from quernstone.llm.topn import top_per_group
from tests.oracle import DATA, connection, same


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA), queries.SQL[name], duck)


# --- splits


def splits(spark, records, ties, targets=(("train", 750), ("test", 250)), **kw):
    r = spark.createDataFrame(records, "gt_id long, e long, _id string, split int")
    t = spark.createDataFrame(ties, "e long, k string, _g int")
    g = spark.createDataFrame(list(targets), "split_name string, share_permille int")
    return grouped_splits(r, "gt_id", "e", t, "e", "k", g, **kw).collect()


def test_tied_records_share_a_split(spark):
    rng = random.Random(2)
    records = [(i, rng.randrange(60), "clash", 0) for i in range(900)]
    ties = [(e, f"k{e // 3}", 1) for e in range(30)] + [(2, "x", 1), (3, "x", 1), (2, "x", 1), (None, "x", 1), (5, None, 1)]
    got = splits(spark, records + records[:40] + [(None, 1, "", 0), (9000, None, "", 0)], ties, bins=20)
    assert sorted(r.gt_id for r in got) == [*range(900), 9000]
    group = {r.entity_no: r.group_entity for r in got if r.entity_no is not None}
    assert group[4] == group[0] == 0 and group[29] == 27 and group[40] == 40
    assert {r.group_size for r in got if r.entity_no == 4} == {6} and {r.group_size for r in got if r.entity_no == 40} == {1}
    for g in set(group.values()):
        assert len({r.split for r in got if r.group_entity == g}) == 1
    lone = [r for r in got if r.gt_id == 9000][0]
    assert lone.group_entity is None and lone.split in ("train", "test")
    assert abs(sum(r.split == "train" for r in got) / len(got) - 0.75) < 0.06


def test_no_records_no_ties_no_targets(spark):
    assert splits(spark, [], []) == []
    assert {r.group_size for r in splits(spark, [(1, 5, "", 0), (2, 5, "", 0)], [])} == {1}
    assert [r.split for r in splits(spark, [(1, 5, "", 0)], [], targets=[])] == [None]


def test_largest_differencing_balances(spark):
    rng = random.Random(7)
    weights = [(f"n{i}", rng.randrange(1, 1000)) for i in range(257)]
    out = balanced_bins(spark.createDataFrame(weights, "n string, w int"), "n", "w", 8).collect()
    assert sorted(r.n for r in out) == sorted(n for n, _ in weights)
    load = [sum(r.w for r in out if r.bin == b) for b in range(8)]
    assert max(load) - min(load) < 30 and sum(load) == sum(w for _, w in weights)
    deep = balanced_bins(spark.createDataFrame(weights, "n string, w int"), "n", "w", 8, cell_rows=20, fan=3).collect()
    assert sorted((r.n, r.w) for r in deep) == sorted((r.n, r.w) for r in out)
    load = [sum(r.w for r in deep if r.bin == b) for b in range(8)]
    assert max(load) - min(load) < 60
    few = balanced_bins(spark.createDataFrame(weights[:3], "n string, w int"), "n", "w", 8).collect()
    assert len({r.bin for r in few}) == 3
    assert deal_bins([(0, 5.0), (1, 5.0)], [("a", 1), ("b", 1)]) == {0: "a", 1: "b"}


def test_whole_tables_are_split_near_their_targets(spark):
    got = queries.p1_split(spark, DATA).toPandas()
    assert got.gt_id.is_unique and got.split.notna().all()
    assert (got.dropna(subset="group_entity").groupby("group_entity").split.nunique() == 1).all()
    want = queries.table(spark, DATA, "split_targets").toPandas().set_index("split_name").share_permille
    largest = got.groupby("group_entity").size().max() / len(got)  # a group is never cut
    real = got.split.value_counts(normalize=True)
    assert all(abs(real.get(s, 0) - share / want.sum()) <= max(0.02, largest) for s, share in want.items())


def test_notations_of_one_instant_tie(spark):
    df = spark.createDataFrame([("1643290031.8694271",), (" 1.6432900318694271e9",), ("1643290031.8694271000 ",), ("0.000",), ("  ",), (None,), ("x",)], "t string")
    got = [r.k for r in df.select(exact_seconds(F.col("t")).alias("k")).collect()]
    assert got[0] is not None and got[0] == got[1] == got[2] and got[3:] == [None] * 4


# --- samples


def sample(spark, rows, targets, **kw):
    r = spark.createDataFrame(rows, "desc_id long, road_type string, climate string, _s string, quota int")
    alias = spark.createDataFrame([("road_type", "city", "urban"), ("road_type", "urban", "urban"), ("road_type", "hwy", "highway"), ("climate", "rain", "rain"), ("climate", "fog", "fog")], "field_name string, alias string, tag string")
    t = spark.createDataFrame(targets, "road_type string, climate string, share_permille int, min_rows int")
    got, report = sample_by_targets(r, "desc_id", ["road_type", "climate"], alias, t, **kw)
    return got.collect(), {(x.road_type, x.climate): x for x in report.collect()}


def test_quotas_are_met_exactly_and_exhausted_ones_reported(spark):
    rows = [(i, "Ci-ty ", "RAIN\r\n", "", 0) for i in range(3000)] + [(5000 + i, "hwy", "fog", "", 0) for i in range(7)] + [(9000, "city", "??", "", 0), (9001, None, "rain", "", 0), (None, "city", "rain", "", 0)]
    targets = [("urban", "rain", 500, 10), ("highway", "fog", 10, 9), ("highway", "rain", 0, 0)]
    got, rep = sample(spark, rows + rows[:500], targets, slots=16)
    n = 3007 // 4
    assert rep["urban", "rain"].quota == 500 * n // 1000 == rep["urban", "rain"].taken
    assert sum(r.road_type == "urban" for r in got) == 500 * n // 1000 and len({r.desc_id for r in got}) == len(got)
    assert rep["highway", "fog"].exhausted and sum(r.road_type == "highway" for r in got) == 7
    assert not rep["highway", "rain"].exhausted
    again, _ = sample(spark, rows[::-1], targets, slots=16)
    assert {r.desc_id for r in again} == {r.desc_id for r in got}
    other, _ = sample(spark, rows, targets, slots=1)  # slots do not change the sample
    assert {r.desc_id for r in other} == {r.desc_id for r in got}


def test_sample_is_uniform(spark):
    rows = [(i, "city", "rain", "", 0) for i in range(4000)]
    got, _ = sample(spark, rows, [("urban", "rain", 1000, 0)], slots=64)
    assert len(got) == 1000 and 430 < sum(r.desc_id < 2000 for r in got) < 570


def test_empty_sample(spark):
    got, rep = sample(spark, [], [("urban", "rain", 500, 3)])
    assert got == [] and rep["urban", "rain"].quota == 3 and rep["urban", "rain"].exhausted


# --- terms


def test_terms_against_counting(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["7", "seq_08", "300 ", None, "1000000"]), rng.choice([" A\t", "a", "b\r\n", "", None, "long " * 50]), "clash") for i in range(400)]
    df = spark.createDataFrame(rows + rows[:50] + [(None, "7", "a", "")], "id long, seq string, v string, _word string").repartition(6)
    got = {r.term: (r.n_rows, r.n_records, r.mark) for r in term_frequencies(df, "id", "seq", ["v"]).collect()}
    want = {}
    for i, s, v, _ in rows:
        t = (v or "").strip(" \t\r\n").lower()
        if t:
            want.setdefault(t, [0, set()])
            want[t][0] += 1
            want[t][1] |= {s} - {None}
    assert {k: v[:2] for k, v in got.items()} == {k: (n, len(s)) for k, (n, s) in want.items()}
    assert all(v[2] == "common" for v in got.values())
    assert term_frequencies(df.where("id < 0"), "id", "seq", ["v"]).count() == 0


def test_rare_comes_before_common(spark):
    df = spark.createDataFrame([(i, "1", "x") for i in range(4)] + [(9, None, "y")], "id long, seq string, v string")
    assert {(r.term, r.n_records, r.mark) for r in term_frequencies(df, "id", "seq", ["v"]).collect()} == {("x", 1, "rare"), ("y", 0, "rare")}


# --- nearest


def test_nearest_against_brute_force(spark):
    rng = random.Random(8)
    nan = float("nan")
    left = [(i, str(i % 3), rng.choice([None, nan, 0.0, -5.0]) if i % 17 == 0 else 1000 + round(rng.random() * 3, 6), "c") for i in range(300)]
    right = [(i, f"seq_{i % 3}", rng.choice([None, nan, 0.0]) if i % 23 == 0 else 1000 + round(rng.random() * 3, 2), "c") for i in range(300)]
    a = spark.createDataFrame(left + left[:20] + [(None, "1", 1000.0, "c"), (900, None, 1000.0, "c")], "scan long, seq string, t double, _b string")
    b = spark.createDataFrame(right + right[:9], "image long, seq string, t double, _e string")
    got = {r.scan: r.image for r in nearest_in_time(a, "scan", "t", b, "image", "t").collect()}
    want = {900: None}
    for i, s, t, _ in left:
        best = None
        if t is not None and t == t and t > 0:
            for j, q, u, _ in right:
                if q == f"seq_{s}" and u is not None and u == u and u > 0:
                    gap = abs(round(t * 1e6) - round(u * 1e6))
                    if gap <= 40_000:
                        best = min(best or (gap, j), (gap, j))
        want[i] = best and best[1]
    assert got == want
    assert nearest_in_time(a.where("scan < 0"), "scan", "t", b, "image", "t").count() == 0
    assert {r.image for r in nearest_in_time(a, "scan", "t", b.where("image < 0"), "image", "t").collect()} == {None}


# --- top n


@pytest.mark.parametrize("shares", [(0.4,), (0.05, 0.1, 0.5, 0.9), ()])
def test_top_n_against_sorting(spark, shares):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        g = 0 if rng.random() < 0.4 else rng.randrange(60)
        s = rng.choice([None, float("nan"), 0.0, -0.0]) if rng.random() < 0.1 else round(rng.random(), 2) if g % 3 else 0.01
        rows.append((i, g if rng.random() > 0.03 else None, s, rng.choice([None, 0, 1, 2]), "clash"))
    df = spark.createDataFrame(rows + rows[:200] + [(None, 1, 0.9, 0, "")], "id long, g int, s double, line int, _k string").repartition(5)
    got = {(r.id, r.place) for r in top_per_group(df, "id", [F.col("g")], F.col("s"), F.col("line"), 3, shares=shares or (1.0,)).collect()}
    want = set()
    for g in range(60):
        own = sorted((r for r in rows if r[1] == g and r[2] is not None and r[2] == r[2]), key=lambda r: (-r[2], 99 if r[3] is None else r[3], r[0]))
        want |= {(r[0], k + 1) for k, r in enumerate(own[:3])}
    assert got == want


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "id long, g int, s double, line int")
    assert top_per_group(df, "id", [F.col("g")], F.col("s"), F.col("line"), 3).count() == 0
