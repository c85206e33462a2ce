"""Queries that match, suppress and sample; tested against brute force where SQL cannot state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import geometry as g
from quernstone.operators.frames import grid_pools, near_counts, near_rows, near_voxels
from quernstone.operators.matching import bev, bev_candidates, farthest_sample, greedy_pairs, suppressed
from quernstone.operators.spatial import within_radius
from quernstone.plans import domain as d
from quernstone.plans.domain import PT, Catalogue

query = Catalogue()
_KEYS = ["seq", "frame", "cls"]


def _matches(spark: SparkSession, sf: str, threshold: float, strict: bool = False) -> DataFrame:
    known = "seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL"
    labels = bev(d.gt(spark, sf).where(known), "a", "gt_id", _KEYS)
    found = bev(d.preds(spark, sf).where(known).where("cond IS NOT NULL"), "b", "pred_id", _KEYS, [F.col("cond"), F.coalesce("score", F.lit(0.0)).alias("score")])
    pairs = bev_candidates(labels, found, _KEYS).where(F.col("iou") > threshold if strict else F.col("iou") >= threshold)
    return greedy_pairs(pairs, [*_KEYS, "cond"], "pred_id", "gt_id", [F.desc("score")], [F.desc("iou")])


@query()
def j13_g01_bev_matches(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one matches of detections and labels of a class by rotated BEV overlap of at least 0.5, best scores first."""
    return _matches(spark, sf, 0.5).select("gt_id", "pred_id", "cond", F.round("iou", 6).alias("iou"))


@query()
def x05_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    """True, false and missed detections per condition and class from the BEV matches."""
    known = "seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL"
    hit = _matches(spark, sf, 0.5).groupBy("cond", "cls").agg(F.count("*").alias("tp"))
    p = d.preds(spark, sf).where(known).where("cond IS NOT NULL")
    n_pred = p.groupBy("cond", "cls").agg(F.count("*").alias("preds"))
    seen = p.select("seq", "frame", "cond").distinct()
    n_gt = d.gt(spark, sf).where(known).join(seen, ["seq", "frame"]).groupBy("cond", "cls").agg(F.count("*").alias("gts"))
    both = n_gt.join(n_pred, ["cond", "cls"], "full").join(hit, ["cond", "cls"], "left").na.fill(0)
    return both.select("cond", "cls", "tp", (F.col("preds") - F.col("tp")).alias("fp"), (F.col("gts") - F.col("tp")).alias("fn"))


@query()
def j14_strict_matches(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one matches by a rotated BEV overlap strictly above 0.3, best scores first, and every label left without one.

    ``pred_id`` is null for a label that no detection of a condition seen in its frame got.
    """
    known = "seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL"
    seen = d.preds(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL").select("seq", "frame", "cond").distinct()
    labels = d.gt(spark, sf).where(known).select("seq", "frame", "gt_id").join(seen, ["seq", "frame"]).select("gt_id", "cond")
    return labels.join(_matches(spark, sf, 0.3, strict=True).select("gt_id", "cond", "pred_id"), ["gt_id", "cond"], "left")


@query()
def j16_nearest_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Clean detections, in line order, matched one to one to the nearest detection of their class under each condition, within 5 m."""
    p = d.preds(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL AND cond IS NOT NULL")
    base = p.where("cond = 'original'").select(*_KEYS, "line_idx", F.col("pred_id").alias("base_id"), *[F.col(f"loc_{k}").alias(f"a{k}") for k in "xyz"])
    other = p.where("cond <> 'original'").select(*_KEYS, "cond", "pred_id", *[F.col(f"loc_{k}").alias(f"b{k}") for k in "xyz"])
    pairs = within_radius(base, other, _KEYS, ["ax", "ay", "az"], ["bx", "by", "bz"], 5.0, closed=True)
    return greedy_pairs(pairs, [*_KEYS, "cond"], "base_id", "pred_id", [F.asc("line_idx")], [F.asc("d2")]).select("base_id", "pred_id", "cond", F.round(F.sqrt("d2"), 6).alias("moved"))


@query()
def t05_t07_rotated_nms(spark: SparkSession, sf: str) -> DataFrame:
    """Detections left by class-wise rotated suppression in every frame, condition and class."""
    p = d.preds(spark, sf, once=False).where("seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL AND cond IS NOT NULL")
    return suppressed(p, ["seq", "frame", "cond", "cls"], "pred_id", "score", 0.1).select("pred_id")


@query()
def t14_farthest_points(spark: SparkSession, sf: str) -> DataFrame:
    """Eight farthest points of every frame's cloud."""
    return farthest_sample(d.points(spark, sf), ["frame"], ["ok", "ln", "pk", "sk", "power"], ["x", "y", "z"], 8)


_BALL = """a AS (SELECT frame, ok, ln, pk, sk, x, y, z FROM pt), j AS (SELECT a.ok, a.ln, a.pk, a.sk, a.frame, b.ok AS bok, b.ln AS bln, b.pk AS bpk, b.sk AS bsk,
 (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM a JOIN pt b ON a.frame = b.frame)"""


@query(f"WITH {PT}, {_BALL} SELECT ok, ln, pk, sk, count(*) AS n FROM j WHERE d2 < 9 GROUP BY ALL")
def j21_r09_ball_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Points nearer than 3 m to every point, itself included."""
    key = ["ok", "ln", "pk", "sk"]
    return near_counts(d.framed_points(spark, sf, *key, "x", "y", "z"), "frame", key, ["x", "y", "z"], 3.0).drop("frame")


@query(f"""WITH {PT}, {_BALL}, r AS (SELECT *, row_number() OVER (PARTITION BY ok, ln, pk, sk, frame ORDER BY d2, bok, bln, bpk, bsk) AS k FROM j WHERE d2 <= 36)
SELECT ok, ln, pk, sk, bok, bln, bpk, bsk, CAST(k AS INT) AS k, round(d2, 6) + 0.0 AS d2 FROM r WHERE k <= 3""")  # fmt: skip
def j23_three_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest points within 6 m of every point; ties by key."""
    key = ["ok", "ln", "pk", "sk"]
    near = near_rows(d.framed_points(spark, sf, *key, "x", "y", "z"), "frame", key, ["x", "y", "z"], 6.0, 3, key, closed=True)
    return near.select(*key, F.posexplode("near").alias("k", "b")).select(*key, *[F.col(f"b.{k}").alias("b" + k) for k in key], (F.col("k") + 1).alias("k"), F.round("b.d2", 6).alias("d2"))


def _slots(n: int):
    """The rows of ``near`` in the slots 0 to n - 1; slots beyond the last hold the first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(s.alias("slot"), F.get("near", F.when(s < F.size("near"), s).otherwise(0)).alias("b")))


@query(f"""WITH {PT}, {_BALL}, r AS (SELECT *, row_number() OVER (PARTITION BY ok, ln, pk, sk, frame ORDER BY bok, bln, bpk, bsk) AS k, count(*) OVER (PARTITION BY ok, ln, pk, sk, frame) AS n FROM j WHERE d2 < 9)
SELECT ok, ln, pk, sk, CAST(s AS INT) AS slot, bok, bln, bpk, bsk FROM r, (SELECT unnest(range(0, 4)) AS s) WHERE k = CASE WHEN s < n THEN s + 1 ELSE 1 END""")  # fmt: skip
def j21_ball_query(spark: SparkSession, sf: str) -> DataFrame:
    """Ball query: of every point the first four points in key order nearer than 3 m, empty slots filled with the first."""
    key = ["ok", "ln", "pk", "sk"]
    near = near_rows(d.framed_points(spark, sf, *key, "x", "y", "z"), "frame", key, ["x", "y", "z"], 3.0, 4, key, by_key=True)
    return near.select(*key, F.inline(_slots(4))).select(*key, "slot", *[F.col(f"b.{k}").alias("b" + k) for k in key])


_VOXELS = "vx AS (SELECT frame, CAST(floor(x / 3) AS BIGINT) AS vx, CAST(floor(y / 3) AS BIGINT) AS vy, CAST(floor(z / 2) AS BIGINT) AS vz, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pt GROUP BY ALL)"


@query(f"""WITH {PT}, {_VOXELS}, j AS (SELECT p.ok, p.ln, p.pk, p.sk, p.frame, v.vx, v.vy, v.vz, power(p.x - cx, 2) + power(p.y - cy, 2) + power(p.z - cz, 2) AS d2,
v.vz - floor(p.z / 2) AS dz, v.vy - floor(p.y / 3) AS dy, v.vx - floor(p.x / 3) AS dx FROM pt p JOIN vx v ON v.frame = p.frame AND abs(v.vz - floor(p.z / 2)) <= 1 AND abs(v.vy - floor(p.y / 3)) <= 1 AND abs(v.vx - floor(p.x / 3)) <= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, ok, ln, pk, sk ORDER BY dz, dy, dx) AS k, count(*) OVER (PARTITION BY frame, ok, ln, pk, sk) AS n FROM j WHERE round(d2, 9) <= 9)
SELECT ok, ln, pk, sk, CAST(s AS INT) AS slot, vx, vy, vz FROM r, (SELECT unnest(range(0, 3)) AS s) WHERE k = CASE WHEN s < n THEN s + 1 ELSE 1 END""")  # fmt: skip
def j22_voxel_query(spark: SparkSession, sf: str) -> DataFrame:
    """Voxel query: of every point the first three voxels around it, in the order of their offsets, whose mean point is at most 3 m away; empty slots take the first."""
    key = ["ok", "ln", "pk", "sk"]
    near = near_voxels(d.framed_points(spark, sf, *key, "x", "y", "z"), "frame", key, ["z", "y", "x"], [2.0, 3.0, 3.0], 3.0, 3)
    return near.select(*key, F.inline(_slots(3))).select(*key, "slot", "b.vx", "b.vy", "b.vz")


_BOXES = "bx AS (SELECT frame, ok AS bok, ln AS bln, pk AS bpk, sk AS bsk, x AS cx, y AS cy, z AS cz, (ok % 628) / 100.0::DOUBLE AS yaw FROM pt)"
_IN = """i AS (SELECT bx.*, pt.ok, pt.ln, pt.pk, pt.sk, pt.power FROM bx JOIN pt ON pt.frame = bx.frame AND abs(cos(yaw)*(x-cx) + sin(yaw)*(y-cy)) <= 3 AND abs(-sin(yaw)*(x-cx) + cos(yaw)*(y-cy)) <= 2 AND abs(z - cz) <= 2)"""


def _inside(spark: SparkSession, sf: str) -> DataFrame:
    p = d.points(spark, sf)
    c = F.col
    boxes = p.select("frame", *[c(k).alias("b" + k) for k in ("ok", "ln", "pk", "sk")], c("x").alias("cx"), c("y").alias("cy"), c("z").alias("cz"), (c("ok") % 628 / 100.0).alias("yaw"))
    near = within_radius(boxes, p, ["frame"], ["cx", "cy"], ["x", "y"], 4.0, closed=True)
    return near.where(g.in_box(c("x"), c("y"), c("z"), c("cx"), c("cy"), c("cz"), F.lit(6.0), F.lit(4.0), F.lit(4.0), c("yaw")))


@query(f"""WITH {PT}, {_BOXES}, {_IN} SELECT bok, bln, bpk, bsk, count(*) AS n, round(CAST(sum(CAST(power AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) + 0.0 AS mean_power, max(power) AS max_power FROM i GROUP BY ALL""")
def j18_a31_a32_points_in_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Points inside rotated boxes: number, mean and maximum power of every box."""
    mean = F.sum(F.col("power").cast("decimal(18,2)")).cast("double") / F.count("*")
    return _inside(spark, sf).groupBy("bok", "bln", "bpk", "bsk").agg(F.count("*").alias("n"), F.round(mean, 4).alias("mean_power"), F.max("power").alias("max_power"))


_LOCAL = "cos(yaw)*(pt.x-cx) + sin(yaw)*(pt.y-cy) AS u, -sin(yaw)*(pt.x-cx) + cos(yaw)*(pt.y-cy) AS v, pt.z - cz AS t"


@query(f"""WITH {PT}, {_BOXES}, {_IN.replace("bx.*,", f"bx.*, {_LOCAL},")}, s AS (SELECT bok, bln, bpk, bsk, power, CAST(least(2, greatest(0, floor(round((u + 3) / 2, 9)))) AS INT) AS su, CAST(least(1, greatest(0, floor(round((v + 2) / 2, 9)))) AS INT) AS sv, CAST(least(1, greatest(0, floor(round((t + 2) / 2, 9)))) AS INT) AS st FROM i)
SELECT bok, bln, bpk, bsk, su, sv, st, count(*) AS n, max(power) AS max_power, round(CAST(sum(CAST(power AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) + 0.0 AS mean_power FROM s GROUP BY ALL""")  # fmt: skip
def a32_sub_voxel_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Region-aware pooling: every box is cut into 3 by 2 by 2 sub-voxels along its own axes; maximum and mean power of each filled one."""
    c = F.col
    u, v = g.rotated(c("x") - c("cx"), c("y") - c("cy"), -c("yaw"))

    def part(e, half: float, n: int):  # faces belong to the outer sub-voxels
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.round((e + half) / (2 * half / n), 9)))).cast("int")

    s = _inside(spark, sf).select("bok", "bln", "bpk", "bsk", "power", part(u, 3.0, 3).alias("su"), part(v, 2.0, 2).alias("sv"), part(c("z") - c("cz"), 2.0, 2).alias("st"))
    mean = F.sum(c("power").cast("decimal(18,2)")).cast("double") / F.count("*")
    return s.groupBy("bok", "bln", "bpk", "bsk", "su", "sv", "st").agg(F.count("*").alias("n"), F.max("power").alias("max_power"), F.round(mean, 4).alias("mean_power"))


@query(f"""WITH {PT}, {_BOXES}, c AS (SELECT *, unnest([-1.5, 1.5])::DOUBLE AS gu FROM bx), g AS (SELECT *, unnest([-1.0, 1.0])::DOUBLE AS gv FROM c),
k AS (SELECT bok, bln, bpk, bsk, frame, gu, gv, cx + cos(yaw)*gu - sin(yaw)*gv AS kx, cy + sin(yaw)*gu + cos(yaw)*gv AS ky FROM g)
SELECT bok, bln, bpk, bsk, gu, gv, count(*) AS n, CAST(sum(CAST(power AS DECIMAL(18,2))) AS DOUBLE) AS total, round(avg(x - kx), 6) + 0.0 AS mean_dx FROM k JOIN pt ON pt.frame = k.frame AND round(abs(x - kx), 9) <= 2 AND round(abs(y - ky), 9) <= 2 GROUP BY ALL""")  # fmt: skip
def a34_vector_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Vector pooling: of four key points in every box the points of the 4 m local grid cell around each, summed and averaged relative to it."""
    c, key = F.col, ["ok", "ln", "pk", "sk"]
    p = d.framed_points(spark, sf, *key, "x", "y", "power").withColumn("yaw", c("ok") % 628 / 100.0)
    p = p.select("frame", *key, "x", "y", F.cos("yaw").alias("co"), F.sin("yaw").alias("si"), (c("power").cast("decimal(18,2)") * 100).cast("bigint").alias("cents"))
    pools = grid_pools(p, "frame", key, ["x", "y"], ["co", "si"], [(u, v) for u in (-1.5, 1.5) for v in (-1.0, 1.0)], 2.0, "cents")
    return pools.select(*[c(k).alias("b" + k) for k in key], "gu", "gv", "n", (c("cents") / 100.0).alias("total"), F.round("mean_dx", 6).alias("mean_dx"))


@query(f"WITH {PT}, {_BOXES}, {_IN} SELECT pt.frame, count(*) AS n FROM pt WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.ok = pt.ok AND i.ln = pt.ln AND i.pk = pt.pk AND i.sk = pt.sk AND i.power = pt.power) GROUP BY ALL")
def j19_points_outside_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Points in no box, per frame."""
    key = ["ok", "ln", "pk", "sk", "power"]
    return d.points(spark, sf).join(_inside(spark, sf).select(*key).distinct(), key, "left_anti").groupBy("frame").agg(F.count("*").alias("n"))


@query(f"""WITH {PT}, {_BOXES}, {_IN}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, bok, bln, bpk, bsk ORDER BY ok, ln, pk, sk, power) AS k, count(*) OVER (PARTITION BY frame, bok, bln, bpk, bsk) AS n FROM i)
SELECT bok, bln, bpk, bsk, CAST(s AS INT) AS slot, ok, ln, pk, sk FROM r, (SELECT unnest(range(0, 8)) AS s) WHERE k <= 8 AND s % least(n, 8) = k - 1""")  # fmt: skip
def a33_box_point_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight points of every box in key order, repeated cyclically to eight slots."""
    b = ["frame", "bok", "bln", "bpk", "bsk"]
    w = Window.partitionBy(*b)
    r = _inside(spark, sf).withColumn("k", F.row_number().over(w.orderBy("ok", "ln", "pk", "sk", "power"))).withColumn("n", F.count("*").over(w)).where("k <= 8")
    slots = r.withColumn("slot", F.explode(F.array(*[F.lit(i) for i in range(8)]))).where("slot % least(n, 8) = k - 1")
    return slots.select("bok", "bln", "bpk", "bsk", "slot", "ok", "ln", "pk", "sk")
