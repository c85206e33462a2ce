"""Readers of the text formats: labels, KITTI lines, point clouds, clocks, calibration, descriptions, result blocks.

Every reader turns whole files or lines into rows with Column expressions only. Lines that do not parse are kept with
null fields or a flag, never dropped silently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of a label line by version: separator pattern, least and greatest number of fields (0: open).
LABEL_VERSIONS = {"v1_0": (", ", 11, 11), "v1_1": (",", 12, 12), "v2_0": (", ", 10, 0), "v2_1": (", ", 11, 0)}


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_idx, line) of text files, line numbers from 0 within each file.

    Files are read whole (labels, clocks and scans are small files; a corpus has many) and exploded with positions.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_idx", "line"))
    return lines.where("line <> ''")


def path_ids(path: Column) -> tuple[Column, Column]:
    """Sequence folder and file stem of ".../<seq>/<folder>/<stem>.<ext>"."""
    parts = F.split(path, "/")
    return F.element_at(parts, -3), F.regexp_extract(F.element_at(parts, -1), r"^([^.]*)", 1)


def _num(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def label_lines(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Object lines of label files: degrees to radians, half extents doubled, header recovered from a broken first line.

    ``bad`` marks lines with a wrong number of fields or a number that does not parse.
    """
    sep, least, most = LABEL_VERSIONS[version]
    seq, frame = path_ids(F.col("path"))
    # a header may lack its line end before the first object: cut every text at "*" marks (a class word may hold a star), first piece is the header
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    pieces = raw.select(seq.alias("seq"), frame.alias("frame"), F.posexplode(F.split("value", r"\*(?=\s*,|\s*idx)")).alias("pos", "piece"))
    body = pieces.where("pos > 0 AND NOT piece RLIKE '^\\\\s*idx'").select("seq", "frame", (F.col("pos") - 2).alias("line_idx"), F.trim(F.regexp_replace("piece", r"[\r\n]+", "")).alias("line"))
    f = F.transform(F.split(F.regexp_replace("line", r"^,\s*", ""), sep.strip() if version == "v1_1" else sep), lambda x: F.trim(x))
    at = 1 if version in ("v1_1", "v2_1") else 0  # an availability field comes first
    track = 2 if version.startswith("v1") else 1
    body = body.withColumn("f", f)
    n = F.size("f") + 1  # the mark itself is a field
    cls_at = at + track
    box = [_num(F.get("f", F.lit(cls_at + 1 + i))) for i in range(7)]
    ok = (n >= least) & (F.lit(most == 0) | (n <= most))
    for b in box:
        ok = ok & b.isNotNull()
    x, y, z, th, hl, hw, hh = box
    return body.select(
        "seq", "frame", "line_idx", F.lit(version).alias("version"), (F.get("f", F.lit(0)) if at else F.lit("R")).alias("available"),
        F.get("f", F.lit(cls_at)).alias("cls"), F.get("f", F.lit(at)).try_cast("bigint").alias("track_id"),
        (F.get("f", F.lit(at + 1)).try_cast("bigint") if track == 2 else F.lit(None).cast("bigint")).alias("prev_track_id"),
        x.alias("x"), y.alias("y"), z.alias("z"), F.radians(th).alias("yaw"), (hl * 2).alias("l"), (hw * 2).alias("w"), (hh * 2).alias("h"), (~F.coalesce(ok, F.lit(False))).alias("bad"),
    )


def label_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header of every label file: sensor indices and time stamp."""
    seq, frame = path_ids(F.col("path"))
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    idx = F.split(F.regexp_extract("value", r"idx\([^)]*\)=([0-9_]+)", 1), "_")
    names = ("rdr", "ldr64", "camf", "ldr128", "camr")
    return raw.select(seq.alias("seq"), frame.alias("frame"), *[F.get(idx, F.lit(i)).alias(n) for i, n in enumerate(names)],
                      F.nullif(F.regexp_extract("value", r"timestamp=([0-9.eE+-]+)", 1), F.lit("")).alias("tstamp"))


def kitti_fields(line: Column) -> list[Column]:
    """Columns of one KITTI line; score null if absent, numbers null if they do not parse."""
    f = F.split(F.trim(line), r"\s+")
    names = ("truncated", "occluded", "alpha", "x0", "y0", "x1", "y1", "h", "w", "l", "loc_x", "loc_y", "loc_z", "rot_y", "score")
    return [F.get(f, F.lit(0)).alias("cls"), *[F.get(f, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)]]


def kitti_rows(lines: DataFrame, line: str = "line", keep_dummy: bool = False) -> DataFrame:
    """Parsed KITTI lines beside the other columns; blank lines and lines with fewer than 15 fields are no rows.

    ``dummy`` lines stand for "no detection": dropped by the plain reader, kept where the frame itself must be known.
    """
    others = [c for c in lines.columns if c != line]
    ok = lines.where(F.size(F.split(F.trim(line), r"\s+")) >= 15)
    rows = ok.select(*others, *kitti_fields(F.col(line)))
    return rows if keep_dummy else rows.where("cls <> 'dummy'")


def merged_kitti(spark: SparkSession, path: str) -> DataFrame:
    """Merged result text: "<seq>_<frame>_<condition> <KITTI line>"; the condition keeps its underscores."""
    raw = spark.read.text(path)
    tag = F.split(F.regexp_extract("value", r"^(\S+)", 1), "_", 3)
    keyed = raw.select(F.get(tag, F.lit(0)).alias("seq"), F.get(tag, F.lit(1)).alias("frame"), F.get(tag, F.lit(2)).alias("cond"), F.regexp_replace("value", r"^\S+\s+", "").alias("line"))
    return kitti_rows(keyed, keep_dummy=True)


def ascii_cloud(spark: SparkSession, path: str, skip: int = 13, columns: tuple[str, ...] = ("x", "y", "z", "intensity", "t", "reflectivity", "ring", "ambient", "range")) -> DataFrame:
    """Points of ASCII clouds with a fixed-length header; their order is kept as ``ordinal``."""
    seq, frame = path_ids(F.col("path"))
    f = F.split(F.trim("line"), r"\s+")
    return file_lines(spark, path).where(F.col("line_idx") >= skip).select(
        seq.alias("seq"), frame.alias("frame"), (F.col("line_idx") - skip).alias("ordinal"), *[F.get(f, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(columns)]
    )


def headed_cloud(spark: SparkSession, path: str) -> DataFrame:
    """Points of ASCII clouds whose header names the fields: (seq, frame, ordinal, values map by field)."""
    seq, frame = path_ids(F.col("path"))
    lines = file_lines(spark, path).withColumn("_key", F.regexp_extract("line", r"^([A-Z#]+)\b", 1))
    head = lines.where("_key = 'FIELDS'").select("path", F.slice(F.split(F.trim("line"), r"\s+"), 2, 1000).alias("fields"))
    start = lines.where("_key = 'DATA'").select("path", F.col("line_idx").alias("_data"))
    body = lines.drop("_key").join(start, "path").where("line_idx > _data").join(head, "path")
    values = F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.try_cast("double"))
    return body.select(seq.alias("seq"), frame.alias("frame"), (F.col("line_idx") - F.col("_data") - 1).alias("ordinal"), F.map_from_arrays("fields", F.slice(values, F.lit(1), F.size("fields"))).alias("values"))


def sensor_clock(spark: SparkSession, path: str) -> DataFrame:
    """Clock lines "<file>_<idx>, <epoch seconds>"."""
    f = F.split("line", r",\s*")
    name = F.get(f, F.lit(0))
    return file_lines(spark, path).select(
        "path", "line_idx", F.regexp_extract(name, r"^(.*)_[0-9]+", 1).alias("sensor"), F.regexp_extract(name, r"_([0-9]+)[^_]*$", 1).alias("idx"), _num(F.get(f, F.lit(1))).alias("seconds")
    )


def calibration(spark: SparkSession, path: str, z: float = 0.7) -> DataFrame:
    """Second line of calibration files "frame difference, x, y"; the height is a parameter."""
    f = F.split("line", r",\s*")
    seq, _ = path_ids(F.col("path"))
    return file_lines(spark, path).where("line_idx = 1").select(
        seq.alias("seq"), _num(F.get(f, F.lit(0))).cast("int").alias("frame_diff"), _num(F.get(f, F.lit(1))).alias("dx"), _num(F.get(f, F.lit(2))).alias("dy"), F.lit(z).alias("dz")
    )


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Description files "road,time,climate"."""
    f = F.split(F.trim("line"), ",")
    seq = F.element_at(F.split("path", "/"), -2)
    return file_lines(spark, path).where("line_idx = 0").select(seq.alias("seq"), *[F.trim(F.get(f, F.lit(i))).alias(n) for i, n in enumerate(("road_type", "capture_time", "climate"))])


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """Split lists "seq,label file"."""
    f = F.split("line", ",")
    return file_lines(spark, path).select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("split"), F.get(f, F.lit(0)).alias("seq"), F.trim(F.get(f, F.lit(1))).alias("label"))


def result_blocks(lines: DataFrame, file: str = "path", index: str = "line_idx", line: str = "line") -> DataFrame:
    """Blocks of a results text: a header "Conf thr: <t>, Condition: <c>" and "key: value" lines until the next header."""
    w = Window.partitionBy(file).orderBy(index)
    head = r"Conf thr:\s*([0-9.]+)\s*,\s*Condition:\s*(\S+)"
    t = lines.withColumn("_head", F.col(line).rlike(head).cast("int")).withColumn("_block", F.sum("_head").over(w))
    named = t.where("_block > 0").withColumn("thr", F.regexp_extract(line, head, 1)).withColumn("cond", F.regexp_extract(line, head, 2))
    per = Window.partitionBy(file, "_block")
    named = named.withColumn("conf_thr", F.max(F.nullif("thr", F.lit(""))).over(per).try_cast("double")).withColumn("condition", F.max(F.nullif("cond", F.lit(""))).over(per))
    body = named.where("_head = 0").where(F.col(line).contains(":"))
    return body.select(file, "conf_thr", "condition", F.trim(F.regexp_extract(line, r"^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))


def latest_run(runs: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest run of every key: ``by`` is its modification time or its name."""
    return runs.groupBy(*keys).agg(F.max_by("path", F.struct(by, "path")).alias("path"))


def poses(spark: SparkSession, path: str) -> DataFrame:
    """Pose files: 12 numbers a line are the rows of a 3x4 matrix, 7 a quaternion (w, x, y, z) and a translation."""
    seq, _ = path_ids(F.col("path"))
    v = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    return file_lines(spark, path).select(
        seq.alias("seq"), F.col("line_idx").alias("frame"), F.when(F.size(v) == 12, v).alias("matrix"), F.when(F.size(v) == 7, v).alias("relative"), F.size(v).isin(7, 12).alias("good")
    )


def local_odometry(spark: SparkSession, path: str) -> DataFrame:
    """CSV files "timestamp,local_x,local_y,local_z" with a header; the sequence is in the file name (seq_<n>_local)."""
    df = spark.read.schema("timestamp bigint, local_x double, local_y double, local_z double").option("header", True).csv(path)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"seq_(\d+)_local", 1).try_cast("bigint").alias("seq"), *df.columns)


def dump_meta(lines: DataFrame, line: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """Sensor dump lines "<sensor>: changed=<True|False> params=<dict>": sensor, flag and the dict as a map of texts, beside the columns to ``keep``."""
    body = F.regexp_extract(line, r"params=(\{.*\})", 1)
    as_json = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return lines.select(
        *keep, F.regexp_extract(line, r"^\s*([\w-]+):", 1).alias("sensor"), (F.regexp_extract(line, r"changed=(\w+)", 1) == "True").alias("changed"), F.from_json(as_json, "map<string,string>").alias("params")
    )


def label_files(spark: SparkSession, root: str, folder: str, portion: list[int] | None = None) -> DataFrame:
    """(seq, name, place) of label files "<root>/<seq>/<folder>/<name>.txt", sequences as numbers, places by name within a sequence.

    Only folders that are whole numbers are sequences; ``portion`` keeps the listed ones. File contents are not read.
    """
    found = spark.read.format("binaryFile").load(f"{root}/*/{folder}/*.txt").select(F.split("path", "/").alias("p"))
    named = found.select(F.element_at("p", -3).alias("d"), F.element_at("p", -1).alias("name")).where(F.col("d").rlike("^[0-9]+$"))
    named = named.select(F.col("d").cast("bigint").alias("seq"), "name")
    if portion is not None:
        named = named.where(F.col("seq").isin(portion))
    return named.withColumn("place", F.row_number().over(Window.partitionBy("seq").orderBy("name")) - 1)  # names alone


def kitti_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of KITTI files named by six digits, with sequence and frame; other files of the folders are passed over."""
    seq, frame = path_ids(F.col("path"))
    lines = file_lines(spark, path).where(F.col("path").rlike(r"/[0-9]{6}\.txt$"))
    return kitti_rows(lines.select(seq.alias("seq"), frame.alias("frame"), "line_idx", "line"))


def _words(spark: SparkSession, path: str, parts: int) -> DataFrame:
    """(f, tag): the words of every line, the first cut at underscores into at most ``parts``."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(f.alias("f"), F.split(F.get(f, F.lit(0)), "_", parts).alias("tag"))


def _box(first: int) -> list[Column]:
    return [F.get("f", F.lit(first + i)).try_cast("double").alias(n) for i, n in enumerate(("h", "w", "l", "loc_x", "loc_y", "loc_z", "rot_y"))]


def tracked_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines "<seq>_<frame> class track ambiguous h w l x y z ry"."""
    w = _words(spark, path, 2)
    return w.select(*[F.get("tag", F.lit(i)).alias(n) for i, n in enumerate(("seq", "frame"))], F.get("f", F.lit(1)).alias("cls"), F.get("f", F.lit(2)).try_cast("bigint").alias("trk_id"), (F.get("f", F.lit(3)) == "1").alias("ambiguous"), *_box(4))


def tracked_detections(spark: SparkSession, path: str) -> DataFrame:
    """Lines "<seq>_<frame>_<condition> class track is_fp h w l x y z ry score"."""
    w = _words(spark, path, 3)
    tag = [F.get("tag", F.lit(i)).alias(n) for i, n in enumerate(("seq", "frame", "cond"))]
    return w.select(*tag, F.get("f", F.lit(1)).alias("cls"), F.get("f", F.lit(2)).try_cast("bigint").alias("trk_id"), (F.get("f", F.lit(3)) == "1").alias("is_fp"), *_box(4), F.get("f", F.lit(11)).try_cast("double").alias("score"))


def missed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines "<seq>_<frame>_<condition> gt_line_idx=<n>"."""
    w = _words(spark, path, 3)
    tag = [F.get("tag", F.lit(i)).alias(n) for i, n in enumerate(("seq", "frame", "cond"))]
    return w.select(*tag, F.regexp_extract(F.get("f", F.lit(1)), r"^gt_line_idx=(\d+)$", 1).try_cast("int").alias("line_idx"))


def unmatched_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines "<seq>_<frame> class h w l x y z ry"."""
    w = _words(spark, path, 2)
    return w.select(*[F.get("tag", F.lit(i)).alias(n) for i, n in enumerate(("seq", "frame"))], F.get("f", F.lit(1)).alias("cls"), *_box(2))


def camera_calibration(spark: SparkSession, path: str, width: int = 1280, height: int = 720) -> DataFrame:
    """Camera calibration files of flat "key: value" lines: fx, fy, cx, cy and the image size, the usual one where none is given."""
    seq, _ = path_ids(F.col("path"))
    pairs = file_lines(spark, path).where(F.col("line").contains(":"))
    key, value = F.trim(F.regexp_extract("line", "^([^:#]*):", 1)), F.regexp_extract("line", r":\s*([-+0-9.eE]+)", 1).try_cast("double")
    by = pairs.groupBy(seq.alias("seq")).agg(*[F.max(F.when(key == k, value)).alias(k) for k in ("fx", "fy", "cx", "cy", "width", "height")])
    return by.withColumns({"width": F.coalesce("width", F.lit(width)).cast("int"), "height": F.coalesce("height", F.lit(height)).cast("int")})
