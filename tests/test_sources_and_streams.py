import pytest
from pyspark.sql import functions as F

from quernstone.sources import sinks, text
from quernstone.streaming import windows


def put(tmp_path, name, body):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(body)
    return str(p)


HEAD = "* idx(tesseract_os2-64_cam-front_os1-128_cam-lrr)=00034_00001_00002_00003_00004, timestamp=1643180000.25"


def test_label_versions(spark, tmp_path):
    put(tmp_path, "v1/1/label/00001.txt", f"{HEAD}\n*, 3, 2, Sedan, 10.5, -1.0, 0.5, 90, 2.0, 0.9, 0.8\n*, 4, 2, Sedan, x, 0, 0, 0, 1, 1, 1\n")
    df = text.label_lines(spark, str(tmp_path / "v1/*/label/*.txt"), "v1_0").orderBy("line_idx")
    a, b = df.collect()
    assert (a.seq, a.frame, a.cls, a.track_id, a.prev_track_id, a.available, a.l, a.w, a.bad) == ("1", "00001", "Sedan", 3, 2, "R", 4.0, 1.8, False)
    assert a.yaw == pytest.approx(1.5707963) and b.bad
    # the header may lack its line end before the first object
    put(tmp_path, "v2/2/label/00002.txt", f"{HEAD}*, R, 7, Bus, 1, 2, 3, 0, 4, 1, 1\n*, L, 8, Sedan, 1, 2, 3, 180, 2, 1, 1")
    c = text.label_lines(spark, str(tmp_path / "v2/*/label/*.txt"), "v2_1").orderBy("line_idx").collect()
    assert [(r.available, r.track_id, r.cls, r.bad) for r in c] == [("R", 7, "Bus", False), ("L", 8, "Sedan", False)]
    h = text.label_headers(spark, str(tmp_path / "v2/*/label/*.txt")).first()
    assert (h.rdr, h.ldr64, h.camr, h.tstamp) == ("00034", "00001", "00004", "1643180000.25")


def test_kitti_lines(spark, tmp_path):
    line = "sed 0.00 0 0 50 50 150 150 1.5 1.9 4.2 1 2 3 0.1"
    put(tmp_path, "m.txt", f"3_000001_camera_smear_high {line} 0.9\n3_000002_original dummy 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0\nbad line\n")
    rows = text.merged_kitti(spark, str(tmp_path / "m.txt")).orderBy("frame").collect()
    assert [(r.seq, r.frame, r.cond, r.cls, r.score) for r in rows] == [("3", "000001", "camera_smear_high", "sed", 0.9), ("3", "000002", "original", "dummy", 0.0)]
    gt = text.kitti_rows(spark.createDataFrame([(line,), ("",)], "line string")).collect()
    assert len(gt) == 1 and gt[0].score is None and gt[0].loc_z == 3.0


def test_clouds_clocks_and_lists(spark, tmp_path):
    head = "\n".join(["# .PCD", "VERSION .7", "FIELDS x y z intensity", *["H"] * 7, "POINTS 2", "H", "DATA ascii"])
    put(tmp_path, "c/5/os2/os2-64_00001.pcd", head + "\n1 2 3 4\n5 6 7 8\n")
    fixed = text.ascii_cloud(spark, str(tmp_path / "c/*/os2/*.pcd")).orderBy("ordinal").collect()
    assert [(r.seq, r.ordinal, r.x, r.intensity, r.ring) for r in fixed] == [("5", 0, 1.0, 4.0, None), ("5", 1, 5.0, 8.0, None)]
    named = text.headed_cloud(spark, str(tmp_path / "c/*/os2/*.pcd")).orderBy("ordinal").collect()
    assert named[1]["values"] == {"x": 5.0, "y": 6.0, "z": 7.0, "intensity": 8.0}
    put(tmp_path, "t/5/time/os.txt", "os2-64_00001.pcd, 1643180000.1\nos2-64_00002.pcd, nan-is-not-a-number\n")
    clock = text.sensor_clock(spark, str(tmp_path / "t/5/time/os.txt")).orderBy("line_idx").collect()
    assert [(r.sensor, r.idx, r.seconds) for r in clock] == [("os2-64", "00001", 1643180000.1), ("os2-64", "00002", None)]
    put(tmp_path, "k/5/info_calib/c.txt", "frame difference, x, y\n-34, 2.5, -0.3\n")
    cal = text.calibration(spark, str(tmp_path / "k/*/info_calib/*.txt")).first()
    assert (cal.seq, cal.frame_diff, cal.dx, cal.dy, cal.dz) == ("5", -34, 2.5, -0.3, 0.7)
    put(tmp_path, "d/5/description.txt", "urban, night, rain\n")
    assert tuple(text.descriptions(spark, str(tmp_path / "d/*/description.txt")).first()) == ("5", "urban", "night", "rain")
    put(tmp_path, "s/train.txt", "5,00001.txt\n6,00002.txt\n")
    assert {tuple(r) for r in text.split_list(spark, str(tmp_path / "s/train.txt")).collect()} == {("train", "5", "00001.txt"), ("train", "6", "00002.txt")}


def test_result_blocks_and_latest_run(spark, tmp_path):
    put(tmp_path, "r.txt", "Conf thr: 0.3, Condition: original\ncls: sed\nbbox: 1.0\n\nConf thr: 0.5, Condition: rain\ncls: bus\n")
    got = {(r.conf_thr, r.condition, r.key, r.value) for r in text.result_blocks(text.file_lines(spark, str(tmp_path / "r.txt"))).collect()}
    assert got == {(0.3, "original", "cls", "sed"), (0.3, "original", "bbox", "1.0"), (0.5, "rain", "cls", "bus")}
    runs = spark.createDataFrame([("1", "a", 5), ("1", "b", 3)], "seq string, path string, mtime int")
    assert text.latest_run(runs, ["seq"], "mtime").first().path == "a" and text.latest_run(runs, ["seq"], "path").first().path == "b"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "city", 1.5, "x"), ("2", None, float("nan"), "y")], "seq string, road string, v double, line string")
    sinks.write_facts(df, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 2
    sinks.write_fan_out(df, str(tmp_path / "fan"), ["road"], "line")
    fan = spark.read.text(str(tmp_path / "fan"))
    assert {(r.condition, r.value) for r in fan.collect()} == {("all", "x"), ("all", "y"), ("city", "x")}
    for i in range(5):
        put(tmp_path, f"small/{i}.txt", f"{i}\n")
    assert sinks.merge_small_files(spark, str(tmp_path / "small"), str(tmp_path / "merged"), 1) == 5
    put(tmp_path, "less/0.txt", "0\n")
    with pytest.raises(ValueError, match="shrink"):
        sinks.merge_small_files(spark, str(tmp_path / "less"), str(tmp_path / "merged"), 1)
    sinks.write_summary(df.select("seq", "v"), str(tmp_path / "csv"))
    assert {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {("1", "1.5"), ("2", None)}


def _stream(spark, tmp_path, rows, schema):
    d = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(d)
    return spark.readStream.schema(schema).parquet(d)


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_held_values_in_a_stream(spark, tmp_path):
    rows = [(1, "a", 1, None), (2, "a", 2, 5.0), (3, "a", 3, None), (4, "b", 1, None)]
    s = _stream(spark, tmp_path, rows, "id long, k string, t int, v double")
    assert {(r.id, r.held) for r in _drain(windows.hold_last(s, "k", "t", "id", "v"), "held").collect()} == {(1, None), (2, 5.0), (3, 5.0), (4, None)}


def test_windows_in_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a") for m in (0, 5, 20, 59)]
    s = _stream(spark, tmp_path, rows, "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.n for r in _drain(windows.tumbling_counts(s, "ts", "k"), "tumbling", "complete").collect()] == [4]
    assert sorted(r.n for r in _drain(windows.session_counts(s, "ts", "k", "10 minutes"), "sessions", "complete").collect()) == [1, 1, 2]
    assert sum(r.n for r in _drain(windows.sliding_counts(s, "ts", "k", "1 hour", "30 minutes"), "sliding", "complete").collect()) == 8


def test_poses_odometry_and_dumps(spark, tmp_path):
    put(tmp_path, "p/4/odom/rel.txt", "1 0 0 0 1 2 3\n" + " ".join(["0"] * 12) + "\n1 2\n")
    got = text.poses(spark, str(tmp_path / "p/*/odom/*.txt")).orderBy("frame").collect()
    assert [(r.seq, r.good, r.relative is not None, r.matrix is not None) for r in got] == [("4", True, True, False), ("4", True, False, True), ("4", False, False, False)]
    put(tmp_path, "o/seq_12_local.csv", "timestamp,local_x,local_y,local_z\n5,1.5,2,3\n")
    assert tuple(text.local_odometry(spark, str(tmp_path / "o/*.csv")).first()) == (12, 5, 1.5, 2.0, 3.0)
    lines = spark.createDataFrame([("camera: changed=True params={'sigma': 0.5, 'on': True}",), ("lidar: changed=False params={}",)], "line string")
    got = {r.sensor: (r.changed, r.params) for r in text.dump_meta(lines).collect()}
    assert got == {"camera": (True, {"sigma": "0.5", "on": "true"}), "lidar": (False, {})}


def test_arrays_as_cells(spark, tmp_path):
    import numpy as np

    from quernstone.sources.arrays import axis_table, npy_cells

    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    a[0, 0, 1] = -1
    np.save(tmp_path / "cube.npy", a)
    got = {(r.z, r.y, r.x): r.value for r in npy_cells(spark, str(tmp_path / "*.npy"), ["z", "y", "x"], missing=-1.0).collect()}
    assert len(got) == 23 and got[1, 2, 3] == 23.0 and (0, 0, 1) not in got
    with pytest.raises(Exception, match="axes"):
        npy_cells(spark, str(tmp_path / "*.npy"), ["y", "x"]).count()
    assert axis_table(spark, "az", [0, 180], degrees=True).collect()[1].az == pytest.approx(3.14159265)


def test_chains_follow_the_last_kept_box(spark):
    from quernstone.operators.matching import chained

    rows = [(1, i, x, x + 4.0, 0.0, 2.0) for i, x in enumerate((0.0, 1.0, 50.0, 2.0, 90.0))] + [(2, 0, 7.0, 8.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, t int, x0 double, x1 double, y0 double, y1 double")
    assert sorted((r.k, r.t) for r in chained(df, ["k"], ["t"], 0.01).collect()) == [(1, 0), (1, 1), (1, 3), (2, 0)]


def test_a_broken_merge_is_put_right(spark, tmp_path):
    spark.createDataFrame([(f"l{i}",) for i in range(4)], "value string").write.text(str(tmp_path / "new"))
    spark.createDataFrame([("old",)], "value string").write.text(str(tmp_path / "m._old"))  # left by a run that broke between its moves
    assert sinks.merge_small_files(spark, str(tmp_path / "new"), str(tmp_path / "m"), 1) == 4
    assert not (tmp_path / "m._old").exists() and not (tmp_path / "m._stage").exists()


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    import types

    from quernstone import session

    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda *_: None))
    try:
        session.shared_dir(fake)
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("no error")
