"""Queries on whole frames: only the rows themselves are shuffled, and the results are those of the SQL on odd clouds too."""

import random

import duckdb
import numpy as np
import pytest

from __spark_entry__ import oracle_sql, queries
from quernstone.operators import kernels
from quernstone.operators.frames import Cells
from tests.oracle import DATA, same

SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
NEAR = ["a35_inverse_distance", "j21_r09_ball_counts", "j23_three_nearest", "r09_statistical_outliers", "j21_ball_query", "a34_vector_pool"]
CUBES = ["r03_os_cfar", "r04_sidelobe_filter", "r02_ca_cfar_zero"]


def nodes_of(df) -> list[str]:
    """The nodes of the plan, from the top down to its scans."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip(" :+-*()0123456789") for line in plan.split("\n")]


@pytest.mark.parametrize("name", [*NEAR, *CUBES, "j22_voxel_query"])
def test_rows_are_shuffled_once_and_alone(spark, name):
    nodes = nodes_of(queries()[name](spark, DATA))
    shuffles = [i for i, n in enumerate(nodes) if n.startswith("Exchange") and "FLOOR" in n]
    assert len(shuffles) == 1
    assert not [n for n in nodes[shuffles[0] :] if n.startswith(("Generate", "SortMergeJoin", "BroadcastHashJoin"))]


@pytest.fixture(scope="module")
def cloud(spark, tmp_path_factory):
    """A dense frame, a row given twice, rows of one key at two places, nulls and NaN."""
    rng = random.Random(8)
    rows = [(rng.randrange(16), rng.randrange(2000), rng.randrange(40), rng.randrange(1, 8), float(rng.randrange(1, 51)), rng.randrange(100, 10**7) / 100, 0.05, 0.02, "N") for _ in range(300)]
    rows += [(rng.randrange(16, 400), rng.randrange(2000), rng.randrange(40), rng.randrange(1, 8), float(rng.randrange(1, 51)), rng.randrange(100, 10**7) / 100, 0.05, 0.02, "R") for _ in range(300)]
    one = (1000, 5, 5, 1, 10.0, 7.25, 0.0, 0.0, "A")
    rows += [one, one, (1000, 5, 5, 1, 11.0, 7.25, 0.0, 0.0, "A"), (1001, 6, 6, 2, 12.0, 9.5, 0.0, 0.0, "A"), (None, 6, 6, 2, 12.0, 9.5, 0.0, 0.0, "A")]
    rows += [(1001, None, 6, 2, 12.0, 9.5, 0.0, 0.0, "A"), (1001, 7, 6, None, 12.0, 9.5, 0.0, 0.0, "A"), (1002, 7, 6, 1, None, 9.5, 0.0, 0.0, "A"), (1003, 7, 6, 1, float("nan"), 9.5, 0.0, 0.0, "A")]
    folder = tmp_path_factory.mktemp("cloud")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    return str(folder), duck


@pytest.mark.parametrize("batch", ["7", "10000"])
@pytest.mark.parametrize("name", NEAR + CUBES)
def test_odd_clouds_equal_sql(spark, cloud, name, batch):
    folder, duck = cloud
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        same(queries()[name](spark, folder), oracle_sql()[name], duck)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pair_blocks_give_every_near_pair_once():
    rng = np.random.default_rng(1)
    f = np.sort(rng.integers(0, 5, 200))
    x = rng.uniform(0, 20, 200)
    group = np.cumsum(rng.uniform(size=200) < 0.7)
    got = [list(zip(i.tolist(), j.tolist())) for i, j in kernels.pair_blocks(f, x, f, x, 2.0, group, most=50)]
    pairs = [p for b in got for p in b]
    assert sorted(pairs) == sorted((i, j) for i in range(200) for j in range(200) if f[i] == f[j] and abs(x[i] - x[j]) <= 2.0)
    assert len(got) > 10 and not any({group[i] for i, _ in a} & {group[i] for i, _ in b} for a, b in zip(got, got[1:]))


def test_least_of_runs():
    value, tie = np.array([3.0, 1.0, 1.0, 2.0, np.inf, 5.0]), np.array([0, 9, 4, 0, 0, 0])
    assert kernels.least(value, tie, np.array([0, 4]), 3).tolist() == [[2, 1, 3], [5, -1, -1]]


@pytest.mark.parametrize("most", [20_000_000, 0])
def test_cells_around_by_table_and_by_search(most):
    rng = np.random.default_rng(2)
    cells = sorted({(int(f), int(a) * 1000 if a > 6 else int(a), int(b)) for f, a, b in rng.integers(0, 9, (150, 3))})
    f, a, b = map(np.array, zip(*cells))
    value = {c: float(i) for i, c in enumerate(cells)}
    steps = [(1, -2), (0, 0), (-1, 1)]
    for (da, db), got in zip(steps, Cells(f, [a, b], (1, 2), most).around(steps, np.arange(len(cells), dtype=float), -1.0)):
        assert got.tolist() == [value.get((x, y + da, z + db), -1.0) for x, y, z in cells]
