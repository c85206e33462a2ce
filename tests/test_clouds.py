"""ASCII clouds: archives hold every frame's file, and are read as plain files are."""

import os
import random
import tarfile

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from quernstone.plans import files
from quernstone.session import new_folder
from quernstone.sources import clouds, text
from tests.oracle import DATA, same
from tests.test_frames import SCHEMA, nodes_of

NAME = "s05_s06_s07_clouds"


@pytest.fixture
def root(spark, monkeypatch):
    """Where the query writes."""
    path = new_folder(spark, "clouds")
    monkeypatch.setattr(files, "new_folder", lambda *_: path)
    return path.removeprefix("file://")


def stored(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    return duck


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_odd_points_equal_sql(spark, tmp_path, batch):
    """Frames beyond a million and below 0, points of no frame, nulls, NaN, infinite values, prices of many decimals."""
    rng, end = random.Random(5), (0.0, 0.0, "A")
    rows = [(rng.choice([rng.randrange(64), rng.randrange(30000), 16_000_000 + rng.randrange(64), 160_000_000 + rng.randrange(64), -rng.randrange(1, 64)]), rng.randrange(2000), i, rng.randrange(1, 8), rng.randrange(1, 5000) / 100, rng.randrange(100, 10**7) / 100, *end) for i in range(500)]
    rows += [(None, 6, 1, 2, 12.0, 9.5, *end), (None, 6, 2, 1, 12.0, 9.5, *end), (5, None, 6, 2, 12.0, 9.5, *end), (5, 7, 6, None, 12.0, 9.5, *end), (5, 7, None, 1, 12.0, 9.5, *end)]
    rows += [(5, 7, 7, 1, None, 9.5, *end), (5, 7, 8, 1, 3.0, None, *end), (5, 7, 9, 1, float("nan"), float("inf"), *end), (5, 7, 10, 1, -float("inf"), float("nan"), *end)]
    rows += [(90, 1, i, 1, q, p, *end) for i, (q, p) in enumerate([(0.00002, 12.34496), (-0.00002, 0.00496), (1e-9, 1e-7), (1e9, 1e15), (1.0, 0.125), (2.0, -0.125)])]
    duck = stored(spark, tmp_path, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        same(queries()[NAME](spark, str(tmp_path)), oracle_sql()[NAME], duck)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_points(spark, tmp_path):
    duck = stored(spark, tmp_path, [])
    same(queries()[NAME](spark, str(tmp_path)), oracle_sql()[NAME], duck)


def test_archives_hold_a_file_a_frame(spark, root):
    rows = queries()[NAME](spark, DATA)
    assert not [n for n in nodes_of(rows) if n.startswith(("Exchange", "SortMergeJoin", "BroadcastHashJoin"))]
    points = {r.frame: r.n for r in spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("cast(floor(l_orderkey / 16) as bigint) frame").groupBy("frame").count().withColumnRenamed("count", "n").collect()}
    found = {}
    archives = [f"{d}/{n}" for d, _, names in os.walk(root) for n in names if not n.endswith(".crc")]
    assert len(archives) == len({f // 512 for f in points}) < len(points)
    for a in archives:
        with tarfile.open(a) as t:
            for n in t.getnames():
                lines = t.extractfile(n).read().decode().splitlines()
                found[int(n.removeprefix("os2-64/os2-64_").removesuffix(".pcd"))] = len(lines) - 13
                assert lines[2].startswith("FIELDS x y z intensity") and lines[10:13] == [f"WIDTH {len(lines) - 13}", f"POINTS {len(lines) - 13}", "DATA ascii"]
                assert all(len(line.split(" ")) == 9 for line in lines[13:])
    assert found == points


HEAD = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity t\n" + "H\n" * 9 + "DATA ascii\n"
ODD = {
    "plain": HEAD + "1.5 2 3 4 5\n6 7 null 9 10\n",
    "no end": HEAD + "1.5 2 3 4 5\n6 7 8 9 10",
    "windows": HEAD.replace("\n", "\r\n") + "1.5 2 3 4 5\r\n6 7 8 9 10\r\n",
    "blank lines": HEAD + "\n1 2 3 4 5\n\n\n6 7 8 9 10\n",
    "blanks": HEAD + "  1  2\t3 4 5 \n6 7 8 9 10\n",
    "words": HEAD + "1 x 3 4 5\n6 7 8 NaN 10\n1e3 +7 -Infinity 9 10\n",
    "long lines": HEAD + "1 2 3 4 5 6 7 8 9 10 11\n6 7 8 9 10\n",
    "other fields": HEAD.replace("x y z", "z y x") + "1 2 3 4 5\n",
    "longer head": HEAD.replace("DATA", "# c\nDATA") + "1 2 3 4 5\n",
    "no points": HEAD,
    "no data": "FIELDS x y\n1 2\n",
    "empty": "",
}


@pytest.mark.parametrize("names", [*[[n] for n in ODD], list(ODD)], ids=lambda n: n[0] if len(n) == 1 else "all")
def test_archives_are_read_as_plain_files(spark, tmp_path, names):
    for i, n in enumerate(names):
        (tmp_path / f"5/os2/os2-64_{i:05d}.pcd").parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"5/os2/os2-64_{i:05d}.pcd").write_bytes(ODD[n].encode())
    path, bodies, keep = str(tmp_path / "*/os2/*.pcd"), [ODD[n].encode() for n in names], ["x", "y", "z", "intensity"]
    plain = lambda rows, get: sorted((int(r.frame[-5:]), r.ordinal, *[str(get(r)[k]) for k in keep]) for r in rows.collect())
    packed = lambda t: sorted((r["file"], r["ordinal"], *[str(r[k]) for k in keep]) for r in t.to_pylist())
    assert packed(clouds.fixed_points(bodies, keep)) == plain(text.ascii_cloud(spark, path), lambda r: r)
    assert packed(clouds.headed_points(bodies, keep)) == plain(text.headed_cloud(spark, path), lambda r: r["values"])


def test_short_lines_have_null_fields():
    body = (HEAD + "1 2\n \n6 7 8 9 10\n").encode()
    rows = [(0, 1.0, 2.0, None), (1, None, None, None), (2, 6.0, 7.0, 9.0)]
    for t in (clouds.fixed_points([body], ["x", "y", "intensity"]), clouds.headed_points([body], ["x", "y", "intensity"])):
        assert [(r["ordinal"], r["x"], r["y"], r["intensity"]) for r in t.to_pylist()] == rows
