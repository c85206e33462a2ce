"""Typed views of the domain tables, as DataFrames and as SQL with the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.keys import exact_seconds, trimmed, whole_number
from quernstone.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries of one module with their SQL, registered by decorator under the function's name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


_BOX = ("h", "w", "l", "loc_x", "loc_y", "loc_z", "rot_y")


def gt(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """Ground-truth boxes: each id once, sequence and frame as numbers, class word trimmed and in lower case; ``once`` as in :func:`preds`."""
    rows = table(spark, d, "gt_lines").where("gt_id IS NOT NULL")
    return (
        (rows.dropDuplicates(["gt_id"]) if once else rows)
        .select("gt_id", whole_number(F.col("seq")).alias("seq"), whole_number(F.col("frame")).alias("frame"), "line_idx",
                F.lower(trimmed(F.col("cls_kw"))).alias("cls"), *_BOX, "trk_id", "ambiguous")
    )


def preds(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """Predicted boxes: keys as numbers, condition in lower case without outer blanks, no ``dummy`` lines.

    Each id comes once; ``once`` is false for operators that count a repeated row once themselves.
    """
    rows = table(spark, d, "pred_lines").where("pred_id IS NOT NULL").where(F.coalesce(F.col("cls_kw") != "dummy", F.lit(True)))
    return (
        (rows.dropDuplicates(["pred_id"]) if once else rows)
        .select("pred_id", whole_number(F.col("seq")).alias("seq"), whole_number(F.col("frame")).alias("frame"),
                F.lower(F.trim("condition")).alias("cond"), "line_idx", F.lower(trimmed(F.col("cls_kw"))).alias("cls"), *_BOX,
                F.when(~F.isnan("score"), F.col("score")).alias("score"), "trk_id", "is_fp")
    )


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frame records: sensor indices as numbers, time as an exact decimal; repeated rows add nothing."""
    return (
        table(spark, d, "frame_meta")
        .select(whole_number(F.col("seq")).alias("seq"), whole_number(F.col("frame")).alias("frame"),
                *[whole_number(F.col(c)).alias(c) for c in ("rdr", "ldr64", "ldr128", "camf", "camr")], exact_seconds(F.col("tstamp")).alias("t"))
        .where("seq IS NOT NULL AND frame IS NOT NULL")
        .distinct()
    )


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Frame descriptions with the tags of the alias table; null where a word is unknown."""
    alias = table(spark, d, "tag_alias")
    out = table(spark, d, "frame_desc").where("desc_id IS NOT NULL").dropDuplicates(["desc_id"])
    out = out.select("desc_id", whole_number(F.col("seq")).alias("seq"), whole_number(F.col("frame")).alias("frame"), "road_type", "capture_time", "climate")
    for f, o in (("road_type", "road"), ("climate", "weather")):
        words = alias.where(F.col("field_name") == f).select(F.col("alias").alias(f"_{o}"), F.col("tag").alias(o))
        out = out.withColumn(f"_{o}", F.regexp_replace(F.lower(f), "[^a-z]", "")).join(words, f"_{o}", "left").drop(f"_{o}", f)
    return out.withColumn("capture_time", F.regexp_replace(F.lower("capture_time"), "[^a-z]", ""))


_POINT = {
    "frame": ("cast(floor(l_orderkey / 16) as bigint)", "l_orderkey"), "ok": ("l_orderkey", "l_orderkey"), "ln": ("l_linenumber", "l_linenumber"), "pk": ("l_partkey", "l_partkey"), "sk": ("l_suppkey", "l_suppkey"),
    "x": ("cast(l_quantity as double) * 1.4", "l_quantity"), "y": ("(l_partkey % 320) / 10.0D - 16", "l_partkey"), "z": ("cast(l_linenumber as double) - 2", "l_linenumber"),
    "power": ("cast(l_extendedprice as double)", "l_extendedprice"),
}


def points(spark: SparkSession, d: str) -> DataFrame:
    """Radar-like points derived from the line items: integer arithmetic first, so that every engine agrees."""
    return table(spark, d, "lineitem").selectExpr(
        *[f"{e} {c}" for c, (e, _) in _POINT.items()], "(cast(l_discount as double) - cast(l_tax as double)) * 20 doppler", "l_returnflag flag",
    )


def framed_points(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The given columns of :func:`points`, frame first, dealt by frame; they are derived behind the shuffle, which so moves the least."""
    columns = ("frame", *columns)
    raw = table(spark, d, "lineitem").where("l_orderkey IS NOT NULL").select(*dict.fromkeys(_POINT[c][1] for c in columns))
    return raw.repartition(F.expr(_POINT["frame"][0])).selectExpr(*[f"{_POINT[c][0]} {c}" for c in columns])


def sequenced_points(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """As :func:`framed_points`, but dealt by ``seq``, a run of 512 frames; points of no frame are a sequence of their own."""
    columns = ("frame", *columns)
    raw = table(spark, d, "lineitem").select(*dict.fromkeys(_POINT[c][1] for c in columns))
    seq = F.expr(f"shiftright(coalesce({_POINT['frame'][0]}, -4611686018427387904L), 9)")
    return raw.repartition(seq).select(seq.alias("seq"), *[F.expr(_POINT[c][0]).alias(c) for c in columns])


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Polar power tensors derived from the line items, one a frame of 256 orders: Doppler, range, azimuth, elevation index, power."""
    return _cells(table(spark, d, "lineitem"))


def _cells(lines: DataFrame) -> DataFrame:
    return (
        lines
        .groupBy(F.expr("cast(floor(l_orderkey / 256) as bigint)").alias("frame"), F.expr("cast(l_suppkey % 8 as int)").alias("di"), F.expr("cast(l_partkey % 32 as int)").alias("ri"),
                 F.expr("cast(l_orderkey % 16 as int)").alias("ai"), F.expr("cast(l_linenumber as int)").alias("ei"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("p"))
    )


def framed_cube(spark: SparkSession, d: str) -> DataFrame:
    """Mean power of :func:`cells` by frame, range, azimuth and elevation; the rows are dealt by frame once, all sums are made there."""
    raw = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").repartition(F.expr("cast(floor(l_orderkey / 256) as bigint)"))
    return _cells(raw).groupBy("frame", "ri", "ai", "ei").agg(F.avg("p").alias("p"))


def _n(c: str) -> str:
    return f"try_cast(nullif(regexp_extract({c}, '([0-9]+)', 1), '') AS BIGINT)"


GT = f"""gt AS (SELECT DISTINCT ON (gt_id) gt_id, {_n('seq')} AS seq, {_n('frame')} AS frame, line_idx, lower(trim(cls_kw, E' \\t\\r\\n')) AS cls,
 h, w, l, loc_x, loc_y, loc_z, rot_y, trk_id, ambiguous FROM gt_lines WHERE gt_id IS NOT NULL)"""
PR = f"""pr AS (SELECT DISTINCT ON (pred_id) pred_id, {_n('seq')} AS seq, {_n('frame')} AS frame, lower(trim(condition)) AS cond, line_idx,
 lower(trim(cls_kw, E' \\t\\r\\n')) AS cls, h, w, l, loc_x, loc_y, loc_z, rot_y, CASE WHEN NOT isnan(score) THEN score END AS score, trk_id, is_fp
 FROM pred_lines WHERE pred_id IS NOT NULL AND coalesce(cls_kw <> 'dummy', true))"""
FR = f"""fr AS (SELECT DISTINCT {_n('seq')} AS seq, {_n('frame')} AS frame, {_n('rdr')} AS rdr, {_n('ldr64')} AS ldr64, {_n('ldr128')} AS ldr128,
 {_n('camf')} AS camf, {_n('camr')} AS camr FROM frame_meta WHERE {_n('seq')} IS NOT NULL AND {_n('frame')} IS NOT NULL)"""
TG = f"""tg AS (SELECT DISTINCT ON (desc_id) desc_id, {_n('seq')} AS seq, {_n('frame')} AS frame, regexp_replace(lower(capture_time), '[^a-z]', '', 'g') AS capture_time,
 a.tag AS road, b.tag AS weather FROM frame_desc f LEFT JOIN tag_alias a ON a.field_name = 'road_type' AND a.alias = regexp_replace(lower(f.road_type), '[^a-z]', '', 'g')
 LEFT JOIN tag_alias b ON b.field_name = 'climate' AND b.alias = regexp_replace(lower(f.climate), '[^a-z]', '', 'g') WHERE desc_id IS NOT NULL)"""
PT = """pt AS (SELECT CAST(floor(l_orderkey / 16) AS BIGINT) AS frame, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
 CAST(l_quantity AS DOUBLE) * 1.4 AS x, (l_partkey % 320) / 10.0::DOUBLE - 16 AS y, CAST(l_linenumber AS DOUBLE) - 2 AS z, CAST(l_extendedprice AS DOUBLE) AS power,
 (CAST(l_discount AS DOUBLE) - CAST(l_tax AS DOUBLE)) * 20 AS doppler, l_returnflag AS flag FROM lineitem)"""
CE = """ce AS (SELECT CAST(floor(l_orderkey / 256) AS BIGINT) AS frame, CAST(l_suppkey % 8 AS INT) AS di, CAST(l_partkey % 32 AS INT) AS ri, CAST(l_orderkey % 16 AS INT) AS ai, CAST(l_linenumber AS INT) AS ei,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS p FROM lineitem GROUP BY ALL)"""
