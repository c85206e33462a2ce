"""Round trips: tables written in the sources' file formats to the shared folder and read again by the readers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.keys import set_clock, whole_number
from quernstone.operators.evaluation import match_rows_by_track
from quernstone.plans import domain as d
from quernstone.plans.domain import CE, FR, GT, PR, PT, TG, Catalogue, _n
from quernstone.session import new_folder, table
from quernstone.sources import arrays, clouds, sinks, text

query = Catalogue()
_KNOWN = "seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL"
_BOX = ("h", "w", "l", "loc_x", "loc_y", "loc_z", "rot_y")


def _r(c, n: int = 6):
    return F.round(c, n)


def _str(*columns):
    return [F.col(c).cast("string") for c in columns]


def _name(prefix: str, column: str = "frame", digits: int = 6, end: str = ".txt"):
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), digits, "0"), F.lit(end))


def _label_text(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Label files of four versions (by sequence modulo four), written; their folder and the labels."""
    root = new_folder(spark, "labels")
    gt = d.gt(spark, sf).where(_KNOWN).withColumn("_v", F.col("seq") % 4).withColumn("_track", F.coalesce("trk_id", F.lit(-1)).cast("string"))
    nums = [F.col(c).cast("string") for c in ("loc_z", "loc_x", "loc_y")] + [F.degrees("rot_y").cast("string")] + [(F.col(c) / 2).cast("string") for c in ("l", "w", "h")]
    seen = F.when(F.coalesce("ambiguous", F.lit(False)), "L").otherwise("R")
    forms = ((", ", ["_track", F.lit("-1"), "cls"]), (",", [seen, "_track", F.lit("-1"), "cls"]), (", ", ["_track", "cls"]), (", ", [seen, "_track", "cls"]))
    line = None
    for v, (sep, first) in enumerate(forms):
        one = F.concat(F.lit(f"*{sep}"), F.concat_ws(sep, *first, *nums))
        line = F.when(F.col("_v") == v, one) if line is None else line.when(F.col("_v") == v, one)
    head = F.concat(F.lit("* idx(tesseract_os2-64_cam-front_os1-128_cam-lrr)="), F.concat_ws("_", *[F.lpad(((F.col("frame") + i) % 100000).cast("string"), 5, "0") for i in range(5)]), F.lit(", timestamp=1643180000.25\n"))
    path = F.concat(F.lit("v"), F.col("_v").cast("string"), F.lit("/"), F.col("seq").cast("string"), _name("/label/"))
    sinks.write_files(sinks.text_files(gt.withColumn("_line", line), path, ["line_idx", "gt_id"], "_line", head), root)
    sinks.write_files(spark.range(1).select(F.lit("v0/notes/label/000000.txt").alias("path"), F.lit("no sequence").cast("binary").alias("content")), root)
    return root, gt


@query(f"""WITH {GT} SELECT seq, lpad(CAST(frame AS VARCHAR), 6, '0') AS frame, CASE WHEN seq % 4 IN (1, 3) AND ambiguous THEN 'L' ELSE 'R' END AS available, coalesce(trk_id, -1) AS track_id, cls, round(loc_z, 6) + 0.0 AS x, round(loc_x, 6) + 0.0 AS y, round(loc_y, 6) + 0.0 AS z, round(rot_y, 6) + 0.0 AS yaw,
round(l, 6) + 0.0 AS l, round(w, 6) + 0.0 AS w, round(h, 6) + 0.0 AS h FROM gt WHERE {_KNOWN}""")  # fmt: skip
def s03_s04_label_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All labels written as files of the four label versions and read back."""
    root, _ = _label_text(spark, sf)
    out = None
    for v, version in enumerate(text.LABEL_VERSIONS):
        part = text.label_lines(spark, f"{root}/v{v}/*/label/*.txt", version).where("seq RLIKE '^[0-9]+$'")
        out = part if out is None else out.unionByName(part)
    return out.where("NOT bad").select(F.col("seq").cast("bigint").alias("seq"), "frame", "available", "track_id", "cls", *[_r(k).alias(k) for k in ("x", "y", "z", "yaw", "l", "w", "h")])


@query(f"""WITH {GT}, f AS (SELECT seq, frame FROM gt WHERE {_KNOWN} GROUP BY ALL) SELECT seq, lpad(CAST(frame AS VARCHAR), 6, '0') || '.txt' AS name, CAST(row_number() OVER (PARTITION BY seq ORDER BY frame) - 1 AS INT) AS place FROM f WHERE seq % 2 = 0""")
def s01_s02_label_files(spark: SparkSession, sf: str) -> DataFrame:
    """Label files enumerated: sequences as numbers, names in order, folders that are no number passed over, a portion of the sequences."""
    root, gt = _label_text(spark, sf)
    even = [r[0] for r in gt.where("seq % 2 = 0").select("seq").distinct().collect()]  # the portion is a list by nature
    return text.label_files(spark, f"{root}/v*", "label", even)


@query(f"""WITH {GT} SELECT seq, frame, cls, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in _BOX)} FROM gt WHERE {_KNOWN} AND cls <> 'dummy'""")
def s17_s18_kitti_files(spark: SparkSession, sf: str) -> DataFrame:
    """Labels written as KITTI files and read by their six-digit names, beside files of other names and blank lines."""
    root = new_folder(spark, "kitti")
    gt = d.gt(spark, sf).where(_KNOWN)
    line = F.concat_ws(" ", "cls", F.lit("0.00 0 0 50 50 150 150"), *[F.format_string("%.4f", F.col(c)) for c in _BOX])
    files = sinks.text_files(gt.withColumn("_line", line), F.concat(F.col("seq").cast("string"), _name("/label_2/")), ["line_idx", "gt_id"], "_line", F.lit("\n"))
    sinks.write_files(files, root)
    sinks.write_files(files.select(F.regexp_replace("path", r"\.txt$", ".note.txt").alias("path"), "content"), root)
    rows = text.kitti_files(spark, f"{root}/*/label_2/*.txt")
    return rows.select(F.col("seq").cast("bigint").alias("seq"), F.col("frame").cast("bigint").alias("frame"), "cls", *[_r(c, 4).alias(c) for c in _BOX])


@query(f"""WITH {PR} SELECT seq, frame, cond, cls, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in _BOX)}, round(coalesce(score, 0), 4) + 0.0 AS score FROM pr WHERE {_KNOWN} AND cond IS NOT NULL""")
def s19_k04_merged_text(spark: SparkSession, sf: str) -> DataFrame:
    """Detections written as tagged lines in many files, merged into few without shrinking, and read back."""
    root = new_folder(spark, "merged")
    p = d.preds(spark, sf).where(_KNOWN).where("cond IS NOT NULL")
    nums = [F.format_string("%.4f", F.col(c)) for c in _BOX]
    tag = F.concat_ws("_", *_str("seq", "frame"), "cond")
    p.select(F.concat_ws(" ", tag, "cls", F.lit("0.00 0 0 50 50 150 150"), *nums, F.format_string("%.4f", F.coalesce("score", F.lit(0.0)))).alias("value")).write.text(f"{root}/small")
    sinks.merge_small_files(spark, f"{root}/small", f"{root}/one", 2)
    rows = text.merged_kitti(spark, f"{root}/one")
    return rows.select(F.col("seq").cast("bigint").alias("seq"), F.col("frame").cast("bigint").alias("frame"), "cond", "cls", *[_r(c, 4).alias(c) for c in (*_BOX, "score")])


@query(f"WITH {PT} SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY ok, ln, pk, sk, power) - 1 AS INT) AS ordinal, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z, round(power, 2) + 0.0 AS intensity, round(y, 4) + 0.0 AS by_name FROM pt")
def s05_s06_s07_clouds(spark: SparkSession, sf: str) -> DataFrame:
    """Points written as ASCII clouds and read by fixed header length and by the header's field names; one attribute by name."""
    root, schema = new_folder(spark, "clouds"), "frame bigint, ordinal int, x double, y double, z double, intensity double, by_name double"
    order = [F.col(c).asc_nulls_last() for c in ("ok", "ln", "pk", "sk", "power", "x")]
    p = d.sequenced_points(spark, sf, "ok", "ln", "pk", "sk", "x", "y", "z", "power")
    # the intensity in full: it is rounded once more
    if not sinks.write_files(clouds.ascii_archives(p, "seq", "frame", order, {"x": 4, "y": 4, "z": 4, "power": None}, "os2-64/os2-64_"), root):
        return spark.createDataFrame([], schema)

    def both(names: list[str], files: list[bytes]) -> pa.RecordBatch:
        fixed, named = clouds.fixed_points(files, ["x", "y", "z", "intensity"]), clouds.headed_points(files, ["y"])
        rows = clouds.joined(fixed, named.rename_columns(["file", "ordinal", "by_name"])).combine_chunks()
        frame = pa.array([clouds.frame_of(n) for n in names], pa.int64()).take(rows["file"].combine_chunks())
        digits = {"x": 4, "y": 4, "z": 4, "intensity": 2, "by_name": 4}
        values = [clouds.rounded_column(rows[c].combine_chunks(), n) for c, n in digits.items()]
        return pa.RecordBatch.from_arrays([frame, rows["ordinal"].combine_chunks(), *values], ["frame", "ordinal", *digits])

    return clouds.archived(spark, root, both, schema)


_CLK = "CASE WHEN timestamp_pc > 0 AND NOT isnan(timestamp_pc) AND NOT isinf(timestamp_pc) THEN timestamp_pc END"


@query(f"""WITH l AS (SELECT DISTINCT ON (scan_id) scan_id, {_n('seq')} AS seq, {_CLK} AS t FROM lidar_frames WHERE scan_id IS NOT NULL) SELECT seq, lpad(CAST(scan_id AS VARCHAR), 7, '0') AS idx, 'os2-64' AS sensor, round(t, 6) AS seconds FROM l WHERE seq IS NOT NULL AND t IS NOT NULL""")
def s25_sensor_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """Clock files of every sequence."""
    root = new_folder(spark, "clocks")
    l = table(spark, sf, "lidar_frames").where("scan_id IS NOT NULL").dropDuplicates(["scan_id"]).select("scan_id", whole_number(F.col("seq")).alias("seq"), set_clock(F.col("timestamp_pc")).alias("t")).where("seq IS NOT NULL AND t IS NOT NULL")
    line = F.concat(_name("os2-64_", "scan_id", 7, ".pcd"), F.lit(", "), F.format_string("%.6f", F.col("t")))
    sinks.write_files(sinks.text_files(l.withColumn("_line", line), F.concat(F.col("seq").cast("string"), F.lit("/time/os2-64.txt")), ["scan_id"], "_line"), root)
    seq, _ = text.path_ids(F.col("path"))
    return text.sensor_clock(spark, f"{root}/*/time/*.txt").select(seq.cast("bigint").alias("seq"), "idx", "sensor", _r("seconds").alias("seconds"))


@query(f"""WITH {FR}, {TG}, c AS (SELECT seq, CAST(min(ldr64) - min(rdr) AS INT) AS frame_diff FROM fr GROUP BY seq HAVING min(ldr64) - min(rdr) IS NOT NULL), t AS (SELECT seq, coalesce(min(road), 'none') AS road_type, coalesce(nullif(min(capture_time), ''), 'none') AS capture_time, coalesce(min(weather), 'none') AS climate FROM tg WHERE seq IS NOT NULL GROUP BY seq)
SELECT c.seq, frame_diff, round(2.5 + c.seq % 5 * 0.1, 6) + 0.0 AS dx, -0.3::DOUBLE AS dy, 0.7::DOUBLE AS dz, road_type, capture_time, climate, 1000.0::DOUBLE + c.seq % 7 AS fx, CAST(CASE WHEN c.seq % 2 = 0 THEN 1920 ELSE 1280 END AS INT) AS width, 720 AS height FROM c JOIN t ON t.seq = c.seq""")  # fmt: skip
def s13_s14_s15_sequence_files(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration, camera and description files of every sequence; half of the camera files name no image size."""
    root, c = new_folder(spark, "sequences"), F.col
    diff = d.frames(spark, sf).groupBy("seq").agg((F.min("ldr64") - F.min("rdr")).alias("diff")).where("diff IS NOT NULL")
    tags = d.tags(spark, sf).where("seq IS NOT NULL").groupBy("seq").agg(*[F.coalesce(F.nullif(F.min(k), F.lit("")), F.lit("none")).alias(k) for k in ("road", "capture_time", "weather")])
    s = diff.join(tags, "seq")
    calib = F.concat(F.lit("frame difference, x, y\n"), F.concat_ws(", ", c("diff").cast("string"), F.format_string("%.1f", 2.5 + c("seq") % 5 * 0.1), F.lit("-0.3")), F.lit("\n"))
    camera = F.concat(F.lit("# camera\nfx: "), (1000 + c("seq") % 7).cast("string"), F.lit("\nfy: 1010\ncx: 640\ncy: 360\n"), F.when(c("seq") % 2 == 0, "width: 1920\nheight: 720\n").otherwise(""))
    tag = F.concat_ws(", ", "road", "capture_time", "weather")
    parts = F.array(*[F.struct(F.concat(c("seq").cast("string"), F.lit(p)).alias("path"), v.cast("binary").alias("content")) for p, v in (("/info_calib/calib.txt", calib), ("/info_cam/front.yml", camera), ("/description.txt", tag))])
    sinks.write_files(s.select(F.explode(parts).alias("f")).select("f.*"), root)
    out = text.calibration(spark, f"{root}/*/info_calib/*.txt").join(text.descriptions(spark, f"{root}/*/description.txt"), "seq").join(text.camera_calibration(spark, f"{root}/*/info_cam/*.yml").select("seq", "fx", "width", "height"), "seq")
    return out.select(c("seq").cast("bigint").alias("seq"), "frame_diff", _r("dx").alias("dx"), "dy", "dz", "road_type", "capture_time", "climate", "fx", "width", "height")


@query(f"""WITH {GT}, {PR}, g AS (SELECT * FROM gt WHERE {_KNOWN}), p AS (SELECT * FROM pr WHERE {_KNOWN} AND cond IS NOT NULL), seen AS (SELECT DISTINCT seq, frame, cond FROM p),
o AS (SELECT seq, frame, trk_id, min(gt_id) AS gt_id FROM g WHERE trk_id IS NOT NULL GROUP BY ALL), b AS (SELECT DISTINCT seq, frame, cond, trk_id FROM p WHERE trk_id IS NOT NULL AND NOT is_fp),
m AS (SELECT s.cond, o.gt_id, b.trk_id IS NOT NULL AS hit FROM o JOIN seen s USING (seq, frame) LEFT JOIN b ON b.seq = o.seq AND b.frame = o.frame AND b.cond = s.cond AND b.trk_id = o.trk_id)
SELECT cond, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn, (SELECT count(*) FROM p WHERE p.cond = m.cond AND is_fp) AS fp FROM m GROUP BY cond""")  # fmt: skip
def s20_s27_track_files(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, detections, missed and unmatched labels written as the four tracked texts, read back and judged by track."""
    root, c = new_folder(spark, "tracked"), F.col
    gt, p = d.gt(spark, sf).where(_KNOWN), d.preds(spark, sf).where(_KNOWN).where("cond IS NOT NULL")
    box = [F.format_string("%.4f", c(k)) for k in _BOX]

    def put(df: DataFrame, name: str, *parts) -> None:
        df.select(F.concat_ws(" ", *parts).alias("value")).write.text(f"{root}/{name}")

    at, tag = F.concat_ws("_", *_str("seq", "frame")), F.concat_ws("_", *_str("seq", "frame"), "cond")
    trk, flag = F.coalesce(c("trk_id").cast("string"), F.lit("None")), lambda k: F.coalesce(c(k).cast("int").cast("string"), F.lit("None"))
    put(gt, "gts", at, "cls", trk, flag("ambiguous"), *box)
    put(p, "preds", tag, "cls", trk, flag("is_fp"), *box, F.coalesce(F.format_string("%.4f", c("score")), F.lit("None")))
    put(gt.where("trk_id IS NULL"), "unmatched", at, "cls", *box)
    missed = match_rows_by_track(gt, p).where("is_fn").select("seq", "frame", "cond", "gt_id").join(gt.select("gt_id", "line_idx"), "gt_id")
    put(missed, "fn", tag, F.concat(F.lit("gt_line_idx="), F.coalesce(c("line_idx"), F.lit(0)).cast("string")))
    labels = text.tracked_labels(spark, f"{root}/gts").withColumn("gt_id", F.monotonically_increasing_id())
    found = text.tracked_detections(spark, f"{root}/preds").withColumn("pred_id", F.monotonically_increasing_id())
    rows = match_rows_by_track(labels, found).groupBy("cond").agg(F.count_if("is_tp").alias("tp"), F.count_if("is_fp").alias("fp"))
    fn = text.missed_lines(spark, f"{root}/fn").where("line_idx IS NOT NULL").groupBy("cond").agg(F.count("*").alias("fn"))
    lone = text.unmatched_labels(spark, f"{root}/unmatched").where("h IS NULL").agg(F.count("*")).scalar()  # lines that do not parse: none
    return rows.where("tp + fp > 0 OR cond IS NOT NULL").join(fn, "cond", "left").select("cond", "tp", (F.coalesce("fn", F.lit(0)) + lone).alias("fn"), "fp")


@query(f"""WITH {PR}, n AS (SELECT cond, cls, count(*) AS n, count(*) FILTER (is_fp) AS f FROM pr WHERE cond IS NOT NULL AND cls IS NOT NULL GROUP BY ALL) SELECT cond AS condition, 0.3::DOUBLE AS conf_thr, cls || ' detections' AS key, CAST(n AS VARCHAR) AS value FROM n UNION ALL SELECT cond, 0.3, cls || ' false', CAST(f AS VARCHAR) FROM n""")
def s21_s22_s23_result_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Result texts of two runs a condition, the newer by name and by time read back block by block."""
    root, c = new_folder(spark, "results"), F.col
    n = d.preds(spark, sf).where("cond IS NOT NULL AND cls IS NOT NULL").groupBy("cond", "cls").agg(F.count("*").alias("n"), F.count_if("is_fp").alias("f"))
    lines = n.select("cond", F.concat("cls", F.lit(" detections: "), c("n").cast("string"), F.lit("\n"), "cls", F.lit(" false: "), c("f").cast("string")).alias("_line"), "cls")
    for run in ("run_1", "run_2"):  # the second is newer by name and by time
        kept = lines if run == "run_2" else lines.where("cls = 'sed'")
        head = F.concat(F.lit("Conf thr: 0.3, Condition: "), "cond", F.lit("\n"))
        sinks.write_files(sinks.text_files(kept, F.concat("cond", F.lit(f"/{run}/complete_results.txt")), ["cls"], "_line", head), root)
    runs = spark.read.format("binaryFile").load(f"{root}/*/*/complete_results.txt").select("path", "modificationTime", F.element_at(F.split("path", "/"), -3).alias("cond"), F.element_at(F.split("path", "/"), -2).alias("name"))
    newest = text.latest_run(runs, ["cond"], "name").join(text.latest_run(runs, ["cond"], "modificationTime"), ["cond", "path"])
    blocks = text.result_blocks(text.file_lines(spark, f"{root}/*/*/complete_results.txt"))
    return blocks.withColumn("_p", F.regexp_replace("path", "^file:/+", "/")).join(newest.select(F.regexp_replace("path", "^file:/+", "/").alias("_p")), "_p", "left_semi").select("condition", "conf_thr", "key", "value")


@query("""SELECT user_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS frame, round(value, 6) + 0.0 AS tx, event_type AS sensor, event_id % 3 = 0 AS changed, CAST(event_id AS VARCHAR) AS gain FROM events""")
def s24_s26_poses_and_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Pose files of 3 by 4 matrices and sensor dump lines of every user's events."""
    root, c = new_folder(spark, "poses"), F.col
    e = table(spark, sf, "events")
    matrix = F.concat(F.lit("1 0 0 "), F.format_string("%.6f", c("value")), F.lit(" 0 1 0 0 0 0 1 0"))
    sinks.write_files(sinks.text_files(e.withColumn("_line", matrix), F.concat(c("user_id").cast("string"), F.lit("/poses/poses.txt")), ["event_id"], "_line"), root)
    flag = F.when(c("event_id") % 3 == 0, "True").otherwise("False")
    dump = F.concat("event_type", F.lit(": changed="), flag, F.lit(" params={'gain': '"), c("event_id").cast("string"), F.lit("', 'on': True}"))
    sinks.write_files(sinks.text_files(e.withColumn("_line", dump), F.concat(c("user_id").cast("string"), F.lit("/dump/meta.txt")), ["event_id"], "_line"), root)
    p = text.poses(spark, f"{root}/*/poses/*.txt").where("good").select(c("seq").cast("bigint").alias("seq"), "frame", _r(c("matrix")[3]).alias("tx"))
    seq, _ = text.path_ids(c("path"))
    lines = text.file_lines(spark, f"{root}/*/dump/*.txt").select(seq.cast("bigint").alias("seq"), c("line_idx").alias("frame"), "line")
    dumps = text.dump_meta(lines, keep=["seq", "frame"]).select("seq", "frame", "sensor", "changed", c("params")["gain"].alias("gain"))
    return p.join(dumps, ["seq", "frame"])


_CUBE = f"{CE}, cube AS (SELECT frame, ri, ai, ei, avg(p) AS p FROM ce GROUP BY ALL)"


@query(f"""WITH {_CUBE}, v AS (SELECT frame, ri, ai, 7 - ei AS ei, p FROM cube WHERE ri BETWEEN 2 AND 29 AND 7 - ei BETWEEN 1 AND 6), n AS (SELECT frame, ri, ai, count(*) AS filled FROM v GROUP BY ALL)
SELECT v.frame, v.ri, v.ai, v.ei, round(p, 4) + 0.0 AS p, round(10 * log10(p), 5) + 0.0 AS db, filled, round(0.46::DOUBLE * v.ri, 6) + 0.0 AS rng, round(radians(v.ai * 6.0 - 48), 6) + 0.0 AS azimuth FROM v JOIN n ON n.frame = v.frame AND n.ri = v.ri AND n.ai = v.ai""")  # fmt: skip
def s09_s10_s12_k08_cubes(spark: SparkSession, sf: str) -> DataFrame:
    """Cubes written as one array file a frame, read as cells, elevation turned over, cut to a region, in decibels, with physical axes."""
    root, axes = new_folder(spark, "cubes"), ["ri", "ai", "ei"]
    cube = d.cells(spark, sf).groupBy("frame", *axes).agg(F.avg("p").alias("p"))
    sinks.write_files(sinks.array_files(cube, "frame", axes, [32, 16, 8], "p"), root)
    cells = arrays.npy_cells(spark, f"{root}/*.npy", axes, "p", missing=-1.0).select(whole_number(F.regexp_extract("path", r"cube_(\d+)\.npy", 1)).alias("frame"), *axes, "p")
    view = arrays.cube_view(cells, axes, {"ei": 8}, {"ri": (2, 29), "ei": (1, 6)}, "p")
    ranges, azimuths = arrays.axis_table(spark, "rng", [0.46 * i for i in range(32)]), arrays.axis_table(spark, "azimuth", [i * 6.0 - 48 for i in range(16)], degrees=True)
    view = view.join(ranges.withColumnRenamed("rng_idx", "ri"), "ri").join(azimuths.withColumnRenamed("azimuth_idx", "ai"), "ai")
    return view.select("frame", *axes, _r("p", 4).alias("p"), _r("db", 5).alias("db"), "filled", _r("rng").alias("rng"), _r("azimuth").alias("azimuth"))


@query(f"""WITH {PT} SELECT ok, ln, pk, sk, round(CASE WHEN sk % 9 = 0 THEN 100 ELSE doppler END + 1.93, 6) + 0.0 AS doppler FROM pt WHERE pk % 32 BETWEEN 3 AND 28""")
def s11_doppler_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Doppler values inside a region, the sentinel of unknown ones replaced, then shifted."""
    p = d.points(spark, sf).select("ok", "ln", "pk", "sk", (F.col("pk") % 32).alias("ri"), F.when(F.col("sk") % 9 == 0, -10.0).otherwise(F.col("doppler")).alias("doppler"))
    return arrays.doppler_view(p, "doppler", -10.0, 100.0, 1.93, {"ri": (3, 28)}).select("ok", "ln", "pk", "sk", _r("doppler").alias("doppler"))


@query(f"WITH {PT} SELECT frame, count(*) AS n, round(sum(round(x, 1)), 2) + 0.0 AS x, round(sum(round(y, 1)), 2) + 0.0 AS y, round(min(z), 3) + 0.0 AS low, round(max(z), 3) + 0.0 AS high FROM pt GROUP BY frame")
def k07_binary_clouds(spark: SparkSession, sf: str) -> DataFrame:
    """Clouds written in binary, one file a frame, and read back."""
    root = new_folder(spark, "binary")
    sinks.write_files(sinks.binary_clouds(d.points(spark, sf), "frame", ["x", "y", "z"]), root)
    v = F.col("values")
    p = arrays.binary_cloud(spark, f"{root}/*.pcd").select(whole_number(F.regexp_extract("path", r"cloud_(\d+)\.pcd", 1)).alias("frame"), *[v[k].alias(k) for k in "xyz"])
    return p.groupBy("frame").agg(F.count("*").alias("n"), _r(F.sum(F.round("x", 1)), 2).alias("x"), _r(F.sum(F.round("y", 1)), 2).alias("y"), _r(F.min("z"), 3).alias("low"), _r(F.max("z"), 3).alias("high"))


@query(f"""WITH {FR}, f AS (SELECT DISTINCT seq, frame FROM fr) SELECT CASE WHEN seq % 5 = 0 THEN 'test' ELSE 'train' END AS split, seq, frame, CASE WHEN frame % 2 = 0 THEN 'even' ELSE 'odd' END AS tag FROM f""")
def k09_k10_lists_and_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Split lists and tag files of all frames, written and read back."""
    root, c = new_folder(spark, "lists"), F.col
    f = d.frames(spark, sf).select("seq", "frame").distinct()
    sinks.write_split_lists(f.select("seq", F.when(c("seq") % 5 == 0, "test").otherwise("train").alias("split"), _name("").alias("label")), f"{root}/splits")
    sinks.write_tags(f.select("seq", "frame", F.when(c("frame") % 2 == 0, "even").otherwise("odd").alias("tag")), f"{root}/tags")
    part = F.split("value", ",")
    lists = spark.read.text(f"{root}/splits").select("split", part[0].cast("bigint").alias("seq"), whole_number(part[1]).alias("frame"))
    tags = spark.read.schema("frame bigint, tag string, seq bigint").option("header", True).csv(f"{root}/tags")
    return lists.join(tags, ["seq", "frame"]).select("split", "seq", "frame", "tag")


@query(f"""WITH {PR} SELECT seq, cond, count(*) AS n, round(CAST(sum(CAST(score AS DECIMAL(18,9))) AS DOUBLE) / count(score), 9) + 0.0 AS mean_score FROM pr WHERE seq IS NOT NULL AND cond IS NOT NULL GROUP BY ALL""")
def k03_k06_facts_and_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Detections written as a fact table by sequence, summed up from it into a CSV report and read back."""
    root = new_folder(spark, "facts")
    sinks.write_facts(d.preds(spark, sf).where("seq IS NOT NULL"), f"{root}/facts")
    mean = F.sum(F.col("score").cast("decimal(18,9)")).cast("double") / F.count("score")  # the same for any order of rows
    summary = spark.read.parquet(f"{root}/facts").where("cond IS NOT NULL").groupBy("seq", "cond").agg(F.count("*").alias("n"), _r(mean, 9).alias("mean_score"))
    sinks.write_summary(summary, f"{root}/summary")
    return spark.read.schema("seq bigint, cond string, n bigint, mean_score double").option("header", True).csv(f"{root}/summary")
