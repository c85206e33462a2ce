"""Queries of rotated and image overlaps and of the graded benchmark report."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import geometry as g
from quernstone.operators.evaluation import DIFFICULTIES, equal_scores_precision, graded_precision, ignored_bits
from quernstone.operators.matching import bev, height_overlap, rotated_area, rotated_iou_3d
from quernstone.operators.rivals import fates, own_counts
from quernstone.operators.spatial import overlapping_pairs
from quernstone.plans import domain as d
from quernstone.plans.domain import GT, PR, Catalogue
from quernstone.session import write_stage

query = Catalogue()
_KEYS = ["seq", "frame", "cls"]
_KNOWN = "seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL"


def _r(c, n: int = 6):
    return F.round(c, n)


def _rotated_pairs(spark: SparkSession, sf: str, labels: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Labels and detections of a class and frame whose extents touch, with their common BEV area and common height."""
    c = F.col
    labels = d.gt(spark, sf).where(_KNOWN) if labels is None else labels
    found = d.preds(spark, sf).where(_KNOWN).where("cond IS NOT NULL") if found is None else found
    a = bev(labels, "a", "gt_id", _KEYS, [c("loc_y").alias("ay"), c("h").alias("ah"), c("line_idx").alias("g_line")])
    b = bev(found, "b", "pred_id", _KEYS, [c("loc_y").alias("by"), c("h").alias("bh"), c("cond"), c("score"), c("line_idx").alias("p_line")])
    near = overlapping_pairs(a, b, _KEYS, ["ax0", "ax1", "az0", "az1"], ["bx0", "bx1", "bz0", "bz1"], 8.0)
    near = near.withColumn("area", rotated_area("ax", "az", "al", "aw", -c("ar"), "bx", "bz", "bl", "bw", -c("br")))
    return near.withColumn("tall", height_overlap(c("ay"), c("ah"), c("by"), c("bh")))


# the common polygon in SQL: corners of each rectangle in the other and crossings of edges, about their centre
_POLYGON = """near AS (SELECT gt_id, pred_id, g.cls, p.cond, g.l AS al, g.w AS aw, p.l AS bl, p.w AS bw, g.h AS ah, p.h AS bh, g.loc_y AS ay, p.loc_y AS by_, p.rot_y - g.rot_y AS t,
 cos(p.rot_y)*(g.loc_x-p.loc_x) - sin(p.rot_y)*(g.loc_z-p.loc_z) AS du, sin(p.rot_y)*(g.loc_x-p.loc_x) + cos(p.rot_y)*(g.loc_z-p.loc_z) AS dv
 FROM gt g JOIN pr p ON g.seq = p.seq AND g.frame = p.frame AND g.cls = p.cls WHERE p.cond IS NOT NULL AND power(g.loc_x-p.loc_x, 2) + power(g.loc_z-p.loc_z, 2) <= power(sqrt(g.l*g.l+g.w*g.w)/2 + sqrt(p.l*p.l+p.w*p.w)/2, 2)),
k AS (SELECT unnest([0,1,2,3]) AS k, unnest([1,-1,-1,1]) AS sx, unnest([1,1,-1,-1]) AS sy, unnest([-1,-1,1,1]) AS tx, unnest([1,-1,-1,1]) AS ty),
c AS (SELECT near.*, k, sx*bl/2 AS pu, sy*bw/2 AS pv, du + sx*al/2*cos(t) - sy*aw/2*sin(t) AS cu, dv + sx*al/2*sin(t) + sy*aw/2*cos(t) AS cv, du + tx*al/2*cos(t) - ty*aw/2*sin(t) AS eu, dv + tx*al/2*sin(t) + ty*aw/2*cos(t) AS ev FROM near, k),
x AS (SELECT gt_id, pred_id, k, CASE WHEN q < 2 THEN (CASE q WHEN 0 THEN bl/2 ELSE -bl/2 END - cu) / nullif(eu - cu, 0) ELSE (CASE q WHEN 2 THEN bw/2 ELSE -bw/2 END - cv) / nullif(ev - cv, 0) END AS s, cu, cv, eu, ev, bl, bw, q FROM c, (SELECT unnest([0,1,2,3]) AS q)),
cross_ AS (SELECT gt_id, pred_id, k, q, cu + s*(eu-cu) AS u, cv + s*(ev-cv) AS v FROM x WHERE s BETWEEN 0 AND 1 AND CASE WHEN q < 2 THEN abs(cv + s*(ev-cv)) <= bw/2 ELSE abs(cu + s*(eu-cu)) <= bl/2 END),
pts AS (SELECT gt_id, pred_id, cu AS u, cv AS v FROM c WHERE abs(cu) <= bl/2 + 1e-9 AND abs(cv) <= bw/2 + 1e-9
 UNION ALL SELECT gt_id, pred_id, pu, pv FROM c WHERE abs(cos(t)*(pu-du) + sin(t)*(pv-dv)) <= al/2 + 1e-9 AND abs(-sin(t)*(pu-du) + cos(t)*(pv-dv)) <= aw/2 + 1e-9
 UNION ALL SELECT gt_id, pred_id, u, v FROM cross_),
m AS (SELECT *, atan2(v - avg(v) OVER w, u - avg(u) OVER w) AS ang FROM pts WINDOW w AS (PARTITION BY gt_id, pred_id)),
o AS (SELECT gt_id, pred_id, u, v, coalesce(lead(u) OVER w, first_value(u) OVER w) AS nu, coalesce(lead(v) OVER w, first_value(v) OVER w) AS nv FROM m WINDOW w AS (PARTITION BY gt_id, pred_id ORDER BY ang, u, v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
poly AS (SELECT gt_id, pred_id, abs(sum(u*nv - v*nu)) / 2 AS area FROM o GROUP BY ALL)"""


@query(f"""WITH {GT}, {PR}, {_POLYGON}, f AS (SELECT n.*, area, greatest(0, least(ay, by_) - greatest(ay - ah, by_ - bh)) AS tall FROM near n JOIN poly USING (gt_id, pred_id) WHERE area > 1e-4)
SELECT gt_id, pred_id, round(area / (al*aw + bl*bw - area), 5) + 0.0 AS bev, round(area / (al*aw), 5) + 0.0 AS of_first, round(area * tall / (al*aw*ah + bl*bw*bh - area*tall), 5) + 0.0 AS box3d FROM f""")  # fmt: skip
def g01_g03_g04_j20_rotated_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Rotated BEV overlap over the union and over the first box, and rotated 3D overlap, of every touching pair of a class and frame."""
    c = F.col
    one, two = c("al") * c("aw"), c("bl") * c("bw")
    solid = rotated_iou_3d(c("area"), c("tall"), one * c("ah"), two * c("bh"))
    return _rotated_pairs(spark, sf).where("area > 1e-4").select("gt_id", "pred_id", _r(g.iou(c("area"), one, two), 5).alias("bev"), _r(c("area") / one, 5).alias("of_first"), _r(solid, 5).alias("box3d"))


@query(f"WITH {GT}, {PR}, {_POLYGON} SELECT gt_id, pred_id, count(*) AS crossings FROM cross_ GROUP BY ALL")
def j32_edge_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """How often the edges of two touching rotated boxes cross: all edges against all edges of the pair."""
    c = F.col
    p = _rotated_pairs(spark, sf)
    x, z = c("ax") - c("bx"), c("az") - c("bz")
    t = c("br") - c("ar")
    u, v = F.cos("br") * x - F.sin("br") * z, F.sin("br") * x + F.cos("br") * z
    corners = g.bev_corners(u, v, c("al"), c("aw"), t)
    p = p.select("gt_id", "pred_id", "bl", "bw", corners.alias("_c"))
    edges = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get("_c", i).alias("p"), F.get("_c", (i + 1) % 4).alias("q")))

    def met(e):
        out = []
        for a, b, along, across in (("x", "y", "bl", "bw"), ("y", "x", "bw", "bl")):
            for sign in (1, -1):
                s = F.try_divide(sign * c(along) / 2 - e["p"][a], e["q"][a] - e["p"][a])
                out.append(F.when(s.between(0, 1) & (F.abs(e["p"][b] + s * (e["q"][b] - e["p"][b])) <= c(across) / 2), 1).otherwise(0))
        return out[0] + out[1] + out[2] + out[3]

    n = F.aggregate(edges, F.lit(0), lambda acc, e: acc + met(e)).cast("bigint")
    return p.select("gt_id", "pred_id", n.alias("crossings")).where("crossings > 0")


_FLAT = """SELECT {id}, seq, frame, cls{extra}, loc_x - dx/2 AS x0, loc_x + dx/2 AS x1, loc_z - dz/2 AS z0, loc_z + dz/2 AS z1 FROM
(SELECT *, CASE WHEN t THEN w ELSE l END AS dx, CASE WHEN t THEN l ELSE w END AS dz FROM (SELECT *, abs(rot_y - floor(rot_y/pi() + 0.5)*pi()) >= pi()/4 AS t FROM {tab}))"""


def _flat(df: DataFrame, p: str, ident: str) -> DataFrame:
    c = F.col
    turn = F.abs(g.wrapped(c("rot_y"), math.pi)) >= math.pi / 4
    dx, dz = F.when(turn, c("w")).otherwise(c("l")), F.when(turn, c("l")).otherwise(c("w"))
    return df.select(*_KEYS, ident, (c("loc_x") - dx / 2).alias(f"{p}x0"), (c("loc_x") + dx / 2).alias(f"{p}x1"), (c("loc_z") - dz / 2).alias(f"{p}z0"), (c("loc_z") + dz / 2).alias(f"{p}z1"))


@query(f"""WITH {GT}, {PR}, a AS ({_FLAT.format(id='gt_id', extra='', tab='gt')}), b AS ({_FLAT.format(id='pred_id', extra='', tab='pr')}),
i AS (SELECT gt_id, pred_id, greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.z1,b.z1)-greatest(a.z0,b.z0),0) AS i, (a.x1-a.x0)*(a.z1-a.z0) AS sa, (b.x1-b.x0)*(b.z1-b.z0) AS sb FROM a JOIN b ON a.seq = b.seq AND a.frame = b.frame AND a.cls = b.cls)
SELECT gt_id, pred_id, round(i/(sa+sb-i), 6) + 0.0 AS iou FROM i WHERE i > 0""")  # fmt: skip
def g07_nearest_aligned_bev(spark: SparkSession, sf: str) -> DataFrame:
    """BEV overlap of boxes turned to their nearest axis: length and width change places from 45 degrees on."""
    a, b = _flat(d.gt(spark, sf), "a", "gt_id"), _flat(d.preds(spark, sf), "b", "pred_id")
    c = F.col
    near = overlapping_pairs(a, b, _KEYS, ["ax0", "ax1", "az0", "az1"], ["bx0", "bx1", "bz0", "bz1"], 8.0)
    common = g.overlap(c("ax0"), c("ax1"), c("bx0"), c("bx1")) * g.overlap(c("az0"), c("az1"), c("bz0"), c("bz1"))
    sizes = [(c(f"{k}x1") - c(f"{k}x0")) * (c(f"{k}z1") - c(f"{k}z0")) for k in "ab"]
    return near.withColumn("i", common).where("i > 0").select("gt_id", "pred_id", _r(g.iou(c("i"), *sizes)).alias("iou"))


_F = 800.0


def image_sides(p: str = "") -> dict[str, Column]:
    """The image box (u0, u1, v0, v1) of a KITTI box seen by a pinhole camera, null nearer than 1 m, under a prefix."""
    c = F.col
    ahead = F.when(c("loc_z") > 1, c("loc_z"))
    return {
        f"{p}u0": 640 + _F * (c("loc_x") - c("l") / 2) / ahead, f"{p}u1": 640 + _F * (c("loc_x") + c("l") / 2) / ahead,
        f"{p}v0": 360 + _F * (c("loc_y") - c("h")) / ahead, f"{p}v1": 360 + _F * c("loc_y") / ahead,
    }


def image_box(df: DataFrame, p: str) -> DataFrame:
    """Add :func:`image_sides`."""
    return df.withColumns(image_sides(p))


def image_iou(a: str = "a", b: str = "b"):
    """Overlap of two image boxes under prefixed names."""
    c = F.col
    common = g.overlap(c(f"{a}u0"), c(f"{a}u1"), c(f"{b}u0"), c(f"{b}u1")) * g.overlap(c(f"{a}v0"), c(f"{a}v1"), c(f"{b}v0"), c(f"{b}v1"))
    return g.iou(common, *[(c(f"{k}u1") - c(f"{k}u0")) * (c(f"{k}v1") - c(f"{k}v0")) for k in (a, b)])


def _image_pairs(labels: DataFrame, found: DataFrame) -> DataFrame:
    a = image_box(labels, "a").select(*_KEYS, "gt_id", F.col("line_idx").alias("g_line"), "au0", "au1", "av0", "av1")
    b = image_box(found, "b").select(*_KEYS, "pred_id", "cond", F.col("line_idx").alias("p_line"), "bu0", "bu1", "bv0", "bv1")
    return overlapping_pairs(a, b, _KEYS, ["au0", "au1", "av0", "av1"], ["bu0", "bu1", "bv0", "bv1"], 100.0)


_IMG = "SELECT *, 640 + 800.0::DOUBLE*(loc_x - l/2)/loc_z AS u0, 640 + 800.0::DOUBLE*(loc_x + l/2)/loc_z AS u1, 360 + 800.0::DOUBLE*(loc_y - h)/loc_z AS v0, 360 + 800.0::DOUBLE*loc_y/loc_z AS v1 FROM {tab} WHERE loc_z > 1"


@query(f"""WITH {GT}, {PR}, a AS ({_IMG.format(tab='gt')}), b AS ({_IMG.format(tab='pr')}), i AS (SELECT gt_id, pred_id, greatest(least(a.u1,b.u1)-greatest(a.u0,b.u0),0)*greatest(least(a.v1,b.v1)-greatest(a.v0,b.v0),0) AS i,
 (a.u1-a.u0)*(a.v1-a.v0) AS sa, (b.u1-b.u0)*(b.v1-b.v0) AS sb FROM a JOIN b ON a.seq = b.seq AND a.frame = b.frame AND a.cls = b.cls WHERE b.cond IS NOT NULL) SELECT gt_id, pred_id, round(i/(sa+sb-i), 6) + 0.0 AS iou FROM i WHERE i > 1e-6""")  # fmt: skip
def g05_image_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of the image boxes of labels and detections of a class and frame."""
    c = F.col
    near = _image_pairs(d.gt(spark, sf).where(_KNOWN), d.preds(spark, sf).where(_KNOWN).where("cond IS NOT NULL"))
    common = g.overlap(c("au0"), c("au1"), c("bu0"), c("bu1")) * g.overlap(c("av0"), c("av1"), c("bv0"), c("bv1"))
    return near.where(common > 1e-6).select("gt_id", "pred_id", _r(image_iou()).alias("iou"))


def _rectangle_points(p: str):
    return g.bev_corners(F.col(f"{p}x"), F.col(f"{p}z"), F.col(f"{p}l"), F.col(f"{p}w"), -F.col(f"{p}r"))


_RECT = """n AS (SELECT gt_id, pred_id, g.loc_x AS ax, g.loc_z AS az, g.l AS al, g.w AS aw, -g.rot_y AS ar, p.loc_x AS bx, p.loc_z AS bz, p.l AS bl, p.w AS bw, -p.rot_y AS br FROM gt g JOIN pr p ON g.seq = p.seq AND g.frame = p.frame AND g.cls = p.cls WHERE p.cond IS NOT NULL
 AND abs(g.loc_x-p.loc_x) <= sqrt(g.l*g.l+g.w*g.w)/2 + sqrt(p.l*p.l+p.w*p.w)/2 AND abs(g.loc_z-p.loc_z) <= sqrt(g.l*g.l+g.w*g.w)/2 + sqrt(p.l*p.l+p.w*p.w)/2),
s AS (SELECT unnest([0,1,2,3]) AS k, unnest([1,-1,-1,1]) AS sx, unnest([1,1,-1,-1]) AS sy),
p8 AS (SELECT gt_id, pred_id, k, ax + sx*al/2*cos(ar) - sy*aw/2*sin(ar) AS x, az + sx*al/2*sin(ar) + sy*aw/2*cos(ar) AS z FROM n, s UNION ALL SELECT gt_id, pred_id, k + 4, bx + sx*bl/2*cos(br) - sy*bw/2*sin(br), bz + sx*bl/2*sin(br) + sy*bw/2*cos(br) FROM n, s),
dir AS (SELECT a.gt_id, a.pred_id, a.k AS i, b.k AS j, (b.x-a.x)/sqrt(power(b.x-a.x,2)+power(b.z-a.z,2)) AS ux, (b.z-a.z)/sqrt(power(b.x-a.x,2)+power(b.z-a.z,2)) AS uz FROM p8 a JOIN p8 b ON a.gt_id = b.gt_id AND a.pred_id = b.pred_id AND a.k < b.k WHERE power(b.x-a.x,2)+power(b.z-a.z,2) > 1e-12),
ext AS (SELECT d.gt_id, d.pred_id, i, j, (max(x*ux + z*uz) - min(x*ux + z*uz)) * (max(z*ux - x*uz) - min(z*ux - x*uz)) AS area FROM dir d JOIN p8 ON p8.gt_id = d.gt_id AND p8.pred_id = d.pred_id GROUP BY ALL)"""


@query(f"WITH {GT}, {PR}, {_RECT} SELECT gt_id, pred_id, round(min(area), 5) + 0.0 AS area FROM ext GROUP BY ALL")
def g09_smallest_enclosing(spark: SparkSession, sf: str) -> DataFrame:
    """Area of the smallest rectangle, turned freely, round two boxes: one of its sides lies along an edge of their hull.

    All 28 lines through two of the eight corners are tried, among which the edges of the hull are.
    """
    p = _rotated_pairs(spark, sf).select("gt_id", "pred_id", F.concat(_rectangle_points("a"), _rectangle_points("b")).alias("_p"))
    lines = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(8) for j in range(i + 1, 8)])

    def area(k):
        a, b = F.get("_p", k["i"]), F.get("_p", k["j"])
        long = F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
        ux, uy = (b["x"] - a["x"]) / long, (b["y"] - a["y"]) / long
        along, across = F.transform("_p", lambda q: q["x"] * ux + q["y"] * uy), F.transform("_p", lambda q: q["y"] * ux - q["x"] * uy)
        return F.when(long > 1e-6, (F.array_max(along) - F.array_min(along)) * (F.array_max(across) - F.array_min(across)))

    return p.select("gt_id", "pred_id", F.round(F.array_min(F.transform(lines, area)), 5).alias("area"))


_HULL = [(8.0, -9.0), (45.0, -12.0), (62.0, 1.0), (44.0, 13.0), (9.0, 10.0)]


@query(f"""WITH {d.PT} SELECT frame, count(*) FILTER ({" AND ".join(f"({x2 - x1})*(y - ({y1})) - ({y2 - y1})*(x - ({x1})) >= 0" for (x1, y1), (x2, y2) in zip(_HULL, _HULL[1:] + _HULL[:1]))}) AS inside FROM pt GROUP BY frame""")
def g10_points_in_hull(spark: SparkSession, sf: str) -> DataFrame:
    """Points in a convex hull, its border included, per frame."""
    return d.points(spark, sf).groupBy("frame").agg(F.count_if(g.in_convex(F.col("x"), F.col("y"), _HULL)).alias("inside"))


# --- the graded report


def _grounds() -> dict[str, Column]:
    """Height in the image, occlusion and truncation of labels."""
    c = F.col
    tall = F.when(c("loc_z") > 1, _F * c("h") / c("loc_z"))
    return {"height": tall, "occluded": F.coalesce(c("ambiguous").cast("int"), F.lit(0)), "truncated": c("gt_id") % 10 / 20.0}


def _joined_pairs(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of image, BEV and 3D overlap as :func:`graded_precision` takes them."""
    c = F.col
    flat = _rotated_pairs(None, "", labels, found)
    one, two = c("al") * c("aw"), c("bl") * c("bw")
    both = F.array(
        F.struct(F.lit("bev").alias("metric"), g.iou(c("area"), one, two).alias("overlap")),
        F.struct(F.lit("3d").alias("metric"), rotated_iou_3d(c("area"), c("tall"), one * c("ah"), two * c("bh")).alias("overlap")),
    )
    flat = flat.where("area > 0").withColumn("_o", F.explode(both)).select("cond", *_KEYS, "gt_id", "pred_id", "g_line", "p_line", "_o.*")
    image = _image_pairs(labels, found).select("cond", *_KEYS, "gt_id", "pred_id", "g_line", "p_line", F.lit("bbox").alias("metric"), image_iou().alias("overlap"))
    angle = c("rot_y") - F.atan2("loc_x", "loc_z")
    pairs = flat.unionByName(image).join(labels.select("gt_id", angle.alias("_a")), "gt_id").join(found.select("pred_id", angle.alias("_b")), "pred_id")
    return pairs.withColumn("turn", c("_a") - c("_b")).drop("_a", "_b")


def report(labels: DataFrame, found: DataFrame, levels: dict) -> DataFrame:
    """:func:`graded_precision` of labels against detections per condition and class by image, BEV and 3D overlap."""
    c = F.col
    labels, found = labels.where(_KNOWN).withColumns(_grounds()), found.where(_KNOWN).where("cond IS NOT NULL").withColumn("score", F.coalesce("score", F.lit(0.0)))
    seen = found.select("seq", "frame", "cond").distinct()
    pairs = _joined_pairs(labels, found)
    tall = F.when(c("loc_z") > 1, _F * c("h") / c("loc_z"))
    return graded_precision(
        labels.join(seen, ["seq", "frame"]).select("cond", *_KEYS, "gt_id", "occluded", "truncated", "height"),
        found.select("cond", *_KEYS, "pred_id", "score", tall.alias("height")), pairs, ["cond", "cls"], ["seq", "frame"], levels,
    )


@query()
def a10_a11_a14_a15_graded_report(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision and orientation similarity by condition, class, difficulty, metric (image box, BEV, 3D) and least overlap."""
    out = report(d.gt(spark, sf), d.preds(spark, sf), {"bbox": (0.5, 0.7), "bev": (0.3, 0.5), "3d": (0.3, 0.5)})
    return out.select("cond", "cls", "difficulty", "metric", "level", "num_gt", *[_r(k).alias(k) for k in ("ap", "ap11", "aos")])


@query()
def a13_mean_over_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision averaged over ten overlap levels from 0.5 to 0.95, by condition, class, difficulty and metric."""
    ten = tuple(v / 100 for v in range(50, 100, 5))
    out = report(d.gt(spark, sf), d.preds(spark, sf), {"bbox": ten, "bev": ten, "3d": ten})
    return out.groupBy("cond", "cls", "difficulty", "metric").agg(_r(F.avg("ap")).alias("mean_ap"), _r(F.avg("aos")).alias("mean_aos"))


@query()
def x05_prediction_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The table of prediction rows: every detection with the label it got or as false, and every label missed under a condition seen in its frame."""
    box = ["line_idx", "loc_x", "loc_z", "l", "w", "rot_y"]
    found = d.preds(spark, sf, once=False).where("cond IS NOT NULL").select("pred_id", *_KEYS, "cond", F.coalesce("score", F.lit(0.0)).alias("score"), *box)
    rows = fates(d.gt(spark, sf, once=False).where(_KNOWN).select("gt_id", *_KEYS, *box), found, 0.3)
    return rows.withColumn("iou", _r("iou"))


def _one_place(labels: DataFrame) -> DataFrame:
    """Of an id in several frames or classes only the rows of one of them."""
    at = F.xxhash64(*_KEYS)
    places = labels.groupBy("gt_id").agg(F.min(at).alias("_at"), F.max(at).alias("_last")).where("_at <> _last").select("gt_id", "_at")
    return labels.join(write_stage(places, "places"), "gt_id", "left").where(F.coalesce(at == F.col("_at"), F.lit(True))).drop("_at")


@query()
def x11_labels_as_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation check: labels given as detections reach full precision for every class, difficulty and metric that has labels."""
    labels = d.gt(spark, sf, once=False).where(_KNOWN).where("l > 0 AND w > 0 AND h > 0").drop("trk_id")
    counts = own_counts(_one_place(labels), {**image_sides(), **ignored_bits(**_grounds())}, len(DIFFICULTIES), 0.7)
    counts = write_stage(counts.where("num_gt > 0"), "judged")  # a row for each of the result
    return equal_scores_precision(counts).select("cls", "difficulty", "metric", "num_gt", _r("ap").alias("ap"))


_STEPS = """n AS (SELECT cls, score, count(*) FILTER (NOT is_fp) AS tp, count(*) FILTER (is_fp) AS fp FROM pr WHERE cls IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
w AS (SELECT cls, score, sum(tp) OVER o AS ctp, sum(fp) OVER o AS cfp FROM n WINDOW o AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {PR}, {_STEPS} SELECT cls, score, CAST(ctp AS BIGINT) AS ctp, CAST(cfp AS BIGINT) AS cfp, round(max(ctp / (ctp + cfp)) OVER (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS envelope FROM w WHERE ctp + cfp > 0""")
def w03_w04_precision_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Running true and false detections by falling score per class, and the running maximum of precision from the right."""
    n = d.preds(spark, sf).where("cls IS NOT NULL AND score IS NOT NULL").groupBy("cls", "score").agg(F.count_if(~F.col("is_fp")).alias("tp"), F.count_if("is_fp").alias("fp"))
    down = Window.partitionBy("cls").orderBy(F.desc("score"))
    w = n.select("cls", "score", F.sum("tp").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("ctp"), F.sum("fp").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("cfp"))
    w = w.where("ctp + cfp > 0").withColumn("p", F.col("ctp") / (F.col("ctp") + F.col("cfp")))
    return w.select("cls", "score", "ctp", "cfp", _r(F.max("p").over(down.rowsBetween(0, Window.unboundedFollowing)), 9).alias("envelope"))
