"""Queries over boxes: filters, projections, class statistics, track joins, transitions and overlaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import geometry as g
from quernstone.operators.blocks import numbered
from quernstone.operators.evaluation import average_precision, match_rows_by_track, transition_rates
from quernstone.operators.spatial import overlapping_pairs
from quernstone.plans import domain as d
from quernstone.plans.domain import GT, PR, Catalogue

query = Catalogue()
ROI = {"x": (-6.4, 6.4), "y": (-2.0, 6.0), "z": (0.0, 72.0)}


def _r(c, n: int = 6):
    return F.round(c, n)


@query(f"WITH {GT} SELECT gt_id FROM gt WHERE loc_x BETWEEN -6.4 AND 6.4 AND loc_y BETWEEN -2 AND 6 AND loc_z BETWEEN 0 AND 72")
def f02_label_roi(spark: SparkSession, sf: str) -> DataFrame:
    """Labels inside the region of interest, bounds included."""
    df = d.gt(spark, sf)
    return df.where(F.col("loc_x").between(*ROI["x"]) & F.col("loc_y").between(*ROI["y"]) & F.col("loc_z").between(*ROI["z"])).select("gt_id")


@query(f"WITH {GT} SELECT gt_id, round(degrees(atan2(-loc_x, loc_z)), 6) + 0.0 AS az FROM gt WHERE degrees(atan2(-loc_x, loc_z)) BETWEEN -20 AND 20")
def f03_azimuth_fov(spark: SparkSession, sf: str) -> DataFrame:
    """Labels whose centre lies in the azimuth field of view (z is forward, x to the right)."""
    az = g.azimuth(F.col("loc_z"), -F.col("loc_x"))
    return d.gt(spark, sf).where(az.between(-20, 20)).select("gt_id", _r(az).alias("az"))


_CORNER = "degrees(atan2(-(loc_x + {sx}*l/2*cos(rot_y) + {sz}*w/2*sin(rot_y)), loc_z - {sx}*l/2*sin(rot_y) + {sz}*w/2*cos(rot_y)))"


@query(
    f"WITH {GT} SELECT gt_id FROM gt WHERE "
    + " AND ".join(_CORNER.format(sx=sx, sz=sz) + " BETWEEN -45 AND 45" for sx in (1, -1) for sz in (1, -1))
)
def f04_all_apexes_in_fov(spark: SparkSession, sf: str) -> DataFrame:
    """Labels none of whose BEV corners leaves the field of view."""
    corners = g.bev_corners(F.col("loc_x"), F.col("loc_z"), F.col("l"), F.col("w"), -F.col("rot_y"))
    inside = F.forall(corners, lambda c: g.azimuth(c["y"], -c["x"]).between(-45, 45))
    return d.gt(spark, sf).where(inside).select("gt_id")


@query(f"WITH {GT} SELECT gt_id, cls FROM gt WHERE cls IN ('sed', 'bus', 'ped', 'mot', 'bic') AND NOT ambiguous")
def f05_considered_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the considered classes that are available."""
    return d.gt(spark, sf).where(F.col("cls").isin("sed", "bus", "ped", "mot", "bic") & ~F.col("ambiguous")).select("gt_id", "cls")


@query(f"WITH {GT}, {d.FR} SELECT seq, frame FROM fr WHERE EXISTS (SELECT 1 FROM gt WHERE gt.seq = fr.seq AND gt.frame = fr.frame) GROUP BY ALL")
def f06_frames_with_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that hold at least one label."""
    fr = d.frames(spark, sf).select("seq", "frame").distinct()
    return fr.join(d.gt(spark, sf), ["seq", "frame"], "left_semi")


@query(f"""WITH {PR} SELECT cond, count(*) FILTER (score > 0.3) AS above, count(*) FILTER (score >= 0.3) AS at_least, count(score) AS scored
FROM pr WHERE cond IS NOT NULL GROUP BY cond""")  # fmt: skip
def f14_f15_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Detections kept by the strict and by the inclusive confidence filter."""
    df = d.preds(spark, sf).where("cond IS NOT NULL")
    return df.groupBy("cond").agg(
        F.sum((F.col("score") > 0.3).cast("int")).alias("above"),
        F.sum((F.col("score") >= 0.3).cast("int")).alias("at_least"),
        F.count("score").alias("scored"),
    )


@query(f"""WITH {PR}, want AS (SELECT * FROM (VALUES (3, 21), (1, 112), (2, 999999)) v(pos, seq)),
s AS (SELECT DISTINCT seq FROM pr) SELECT w.pos, CAST(w.seq AS BIGINT) AS seq, s.seq IS NULL AS missing FROM want w LEFT JOIN s ON s.seq = w.seq""")  # fmt: skip
def f13_explicit_list(spark: SparkSession, sf: str) -> DataFrame:
    """An explicit list of sequences in its order, with those that are missing."""
    want = spark.createDataFrame([(3, 21), (1, 112), (2, 999999)], "pos int, seq bigint")
    have = d.preds(spark, sf).select("seq").distinct().withColumn("_have", F.lit(True))
    return want.join(have, "seq", "left").select("pos", "seq", F.col("_have").isNull().alias("missing"))


@query(f"""WITH {GT} SELECT gt_id, round(loc_z + 2.5, 6) + 0.0 AS x, round(-loc_x + 0.3, 6) + 0.0 AS y, round(-loc_y + 0.7, 6) + 0.0 AS z, round(l, 6) + 0.0 AS xl, round(w, 6) + 0.0 AS yl, round(h, 6) + 0.0 AS zl,
round(rot_y - floor(rot_y / (2*pi()) + 0.5) * 2*pi(), 6) + 0.0 AS yaw FROM gt""")  # fmt: skip
def m01_m22_sensor_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """KITTI rows as sensor-frame boxes after calibration, yaw wrapped into one turn."""
    df = d.gt(spark, sf)
    return df.select(
        "gt_id", _r(F.col("loc_z") + 2.5).alias("x"), _r(-F.col("loc_x") + 0.3).alias("y"), _r(-F.col("loc_y") + 0.7).alias("z"),
        _r(F.col("l")).alias("xl"), _r(F.col("w")).alias("yl"), _r(F.col("h")).alias("zl"), _r(g.wrapped(F.col("rot_y"), 2 * math.pi)).alias("yaw"),
    )


@query(
    f"WITH {GT}, k AS (SELECT unnest(range(8)) AS k), s AS (SELECT k, 1 - 2*(k & 1) AS sx, 1 - 2*((k >> 1) & 1) AS sy, 1 - 2*((k >> 2) & 1) AS sz FROM k)"
    " SELECT gt_id, CAST(k AS INT) AS k, round(loc_z + sx*l/2*cos(rot_y) - sy*w/2*sin(rot_y), 6) + 0.0 AS x, round(-loc_x + sx*l/2*sin(rot_y) + sy*w/2*cos(rot_y), 6) + 0.0 AS y,"
    " round(-loc_y + sz*h/2, 6) + 0.0 AS z FROM gt CROSS JOIN s"
)
def m15_corners(spark: SparkSession, sf: str) -> DataFrame:
    """The eight corners of every label."""
    c = F.col
    corners = g.box_corners(c("loc_z"), -c("loc_x"), -c("loc_y"), c("l"), c("w"), c("h"), c("rot_y"))
    return d.gt(spark, sf).select("gt_id", F.explode(corners).alias("p")).select("gt_id", "p.k", *[_r(c(f"p.{a}")).alias(a) for a in "xyz"])


_CAM = [[1000.0, 0.0, 640.0, 5.0], [0.0, 1000.0, 360.0, -3.0], [0.0, 0.0, 1.0, 0.2]]


@query(f"""WITH {GT}, q AS (SELECT gt_id, 1000*loc_x + 640*loc_z + 5 AS u, 1000*loc_y + 360*loc_z - 3 AS v, loc_z + 0.2 AS dep FROM gt)
SELECT gt_id, round(u/dep, 6) + 0.0 AS px, round(v/dep, 6) + 0.0 AS py, round(dep, 6) + 0.0 AS dep FROM q
WHERE dep > 0 AND u/dep BETWEEN 0 AND 1279 AND v/dep BETWEEN 0 AND 719""")  # fmt: skip
def m18_f21_projected_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Label centres on the camera image, those in front of it and inside it."""
    u, v, dep = g.projected(F.col("loc_x"), F.col("loc_y"), F.col("loc_z"), _CAM)
    return d.gt(spark, sf).where((dep > 0) & u.between(0, 1279) & v.between(0, 719)).select("gt_id", _r(u).alias("px"), _r(v).alias("py"), _r(dep).alias("dep"))


@query(f"""WITH {GT}, e AS (SELECT gt_id, sqrt(4.5*4.5 + 1.9*1.9) AS dg, * EXCLUDE (gt_id) FROM gt WHERE l > 0 AND w > 0 AND h > 0)
SELECT gt_id, round(loc_z/dg, 6) + 0.0 AS xt, round(-loc_x/dg, 6) + 0.0 AS yt, round((-loc_y + 1)/1.6, 6) + 0.0 AS zt, round(ln(l/4.5), 6) + 0.0 AS lt, round(ln(w/1.9), 6) + 0.0 AS wt,
round(ln(h/1.6), 6) + 0.0 AS ht, round(rot_y, 6) + 0.0 AS rt, true AS round_trip FROM e""")  # fmt: skip
def m25_residual_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Box residuals against one anchor, and whether decoding gives the box back."""
    c, lit = F.col, F.lit
    box = {"x": c("loc_z"), "y": -c("loc_x"), "z": -c("loc_y"), "l": c("l"), "w": c("w"), "h": c("h"), "r": c("rot_y")}
    anchor = {"x": lit(0.0), "y": lit(0.0), "z": lit(-1.0), "l": lit(4.5), "w": lit(1.9), "h": lit(1.6), "r": lit(0.0)}
    code = dict(zip("xyzlwhr", g.residual_encoded(box, anchor)))
    back = g.residual_decoded(code, anchor)
    same = F.lit(True)
    for k, b in zip("xyzlwhr", back):
        same = same & (F.abs(b - box[k]) < 1e-9)
    return d.gt(spark, sf).where("l > 0 AND w > 0 AND h > 0").select("gt_id", *[_r(code[k]).alias(f"{k}t") for k in "xyzlwh"], _r(code["r"]).alias("rt"), same.alias("round_trip"))


@query(f"""WITH {PR}, c AS (SELECT DISTINCT cond FROM pr WHERE cond IS NOT NULL), t AS (SELECT cond, string_split(cond, '_') AS a FROM c),
s AS (SELECT cond, a, CASE WHEN cond <> 'original' AND a[-1] IN ('low','medium','high') THEN a[-1] END AS severity FROM t),
m AS (SELECT cond, severity, CASE WHEN severity IS NULL THEN a ELSE a[:-2] END AS a FROM s),
n AS (SELECT cond, severity, a, CASE WHEN cond <> 'original' AND a[1] IN ('camera','radar','lidar') THEN a[1] END AS modality FROM m)
SELECT cond, modality, coalesce(nullif(array_to_string(CASE WHEN modality IS NULL THEN a ELSE a[2:] END, '_'), ''), cond) AS effect, severity,
CASE WHEN regexp_matches(cond, '^(.*)_(low|medium|high)$') THEN regexp_extract(cond, '^(.*)_(low|medium|high)$', 1) ELSE cond END AS effect_with_modality FROM n""")  # fmt: skip
def m28_m29_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Condition names taken apart into modality, effect and severity."""
    return d.preds(spark, sf).where("cond IS NOT NULL").select("cond").distinct().select("cond", *condition_parts(F.col("cond")))


def condition_parts(cond) -> list:
    """modality, effect, severity, and the effect that keeps its modality (see :func:`m28_m29_conditions`)."""
    tail = F.regexp_extract(cond, "(?:^|_)(low|medium|high)$", 1)
    severity = F.when((cond != "original") & (tail != ""), tail)
    body = F.when(severity.isNotNull(), F.regexp_replace(cond, "_?(low|medium|high)$", "")).otherwise(cond)
    head = F.regexp_extract(body, "^(camera|radar|lidar)(?:_|$)", 1)
    modality = F.when((cond != "original") & (head != ""), head)
    effect = F.when(modality.isNotNull(), F.regexp_replace(body, "^(camera|radar|lidar)_?", "")).otherwise(body)
    kept = F.regexp_extract(cond, "^(.*)_(low|medium|high)$", 1)
    return [
        modality.alias("modality"), F.coalesce(F.nullif(effect, F.lit("")), cond).alias("effect"), severity.alias("severity"),
        F.when(cond.rlike("^(.*)_(low|medium|high)$"), kept).otherwise(cond).alias("effect_with_modality"),
    ]


@query(f"""WITH {GT} SELECT cls, count(*) AS n, round(avg(l), 6) + 0.0 AS mean_l, round(avg(w), 6) + 0.0 AS mean_w, round(avg(h), 6) + 0.0 AS mean_h, min(loc_x) AS min_x, max(loc_x) AS max_x,
min(loc_y) AS min_y, max(loc_y) AS max_y, min(loc_z) AS min_z, max(loc_z) AS max_z FROM gt WHERE cls IS NOT NULL GROUP BY cls""")  # fmt: skip
def a01_a02_class_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean size and extremes of every class."""
    df = d.gt(spark, sf).where("cls IS NOT NULL")
    ends = [f(F.col(f"loc_{a}")).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return df.groupBy("cls").agg(F.count("*").alias("n"), *[_r(F.avg(k)).alias(f"mean_{k}") for k in ("l", "w", "h")], *ends)


@query(f"""WITH {GT} SELECT cls, count(*) FILTER (NOT ambiguous) AS sure, count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (ambiguous IS NULL) AS unknown
FROM gt WHERE cls IS NOT NULL GROUP BY cls""")  # fmt: skip
def a03_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by class and availability, zero-filled."""
    state = F.when(F.col("ambiguous").isNull(), "unknown").when(F.col("ambiguous"), "ambiguous").otherwise("sure")
    df = d.gt(spark, sf).where("cls IS NOT NULL").withColumn("state", state)
    return df.groupBy("cls").pivot("state", ["sure", "ambiguous", "unknown"]).count().na.fill(0)


@query(f"WITH {GT}, {PR} SELECT pred_id, gt_id, CAST(gt.loc_x IS NOT NULL AS BOOLEAN) AS found FROM pr LEFT JOIN (SELECT seq, frame, trk_id, min(gt_id) AS gt_id, any_value(loc_x) AS loc_x FROM gt WHERE trk_id IS NOT NULL GROUP BY ALL) gt ON gt.seq = pr.seq AND gt.frame = pr.frame AND gt.trk_id = pr.trk_id")
def j01_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Every prediction with the label of its track in the same frame; null keys never match."""
    keys = ["seq", "frame", "trk_id"]
    one = d.gt(spark, sf).where("trk_id IS NOT NULL").groupBy(*keys).agg(F.min("gt_id").alias("gt_id"))
    return d.preds(spark, sf).join(one, keys, "left").select("pred_id", "gt_id", F.col("gt_id").isNotNull().alias("found"))


@query(f"""WITH {GT}, {PR}, c AS (SELECT DISTINCT seq, frame, cond FROM pr WHERE seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL),
o AS (SELECT seq, frame, trk_id, min(gt_id) AS gt_id FROM gt WHERE trk_id IS NOT NULL AND seq IS NOT NULL AND frame IS NOT NULL GROUP BY ALL)
SELECT o.gt_id, c.cond FROM o JOIN c USING (seq, frame) WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.seq = o.seq AND pr.frame = o.frame AND pr.cond = c.cond AND pr.trk_id = o.trk_id AND NOT pr.is_fp)""")  # fmt: skip
def j02_u03_missed(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that no true detection of a condition names, per condition seen in their frame."""
    return match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf)).where("is_fn").select("gt_id", "cond")


_ROWS = f"""{GT}, {PR}, seen AS (SELECT DISTINCT seq, frame, cond FROM pr WHERE seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL),
one AS (SELECT seq, frame, trk_id, min(gt_id) AS gt_id, min_by(cls, gt_id) AS cls FROM gt WHERE trk_id IS NOT NULL AND seq IS NOT NULL AND frame IS NOT NULL GROUP BY ALL),
best AS (SELECT seq, frame, cond, trk_id, max(coalesce(score, 0)) AS score FROM pr WHERE trk_id IS NOT NULL AND NOT is_fp AND seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL GROUP BY ALL),
m AS (SELECT one.gt_id, one.seq, one.cls, seen.cond, b.score, b.trk_id IS NOT NULL AS hit FROM one JOIN seen USING (seq, frame) LEFT JOIN best b ON b.seq = one.seq AND b.frame = one.frame AND b.cond = seen.cond AND b.trk_id = one.trk_id),
rows_ AS (SELECT cond, cls, seq, coalesce(score, 0) AS score, hit AS is_tp, false AS is_fp, NOT hit AS is_fn FROM m
 UNION ALL SELECT pr.cond, pr.cls, pr.seq, coalesce(pr.score, 0), false, true, false FROM pr WHERE cond IS NOT NULL AND seq IS NOT NULL AND frame IS NOT NULL AND is_fp)"""


def _ap_sql(rows: str, key: str, every: int = 1) -> str:
    """SQL of :func:`average_precision` over a CTE named rows_ with the columns ``key`` and cls."""
    part = f"PARTITION BY {key}, cls"
    return f"""{rows}, n AS (SELECT {key}, cls, count(*) FILTER (is_tp OR is_fn) AS num_gt, count(*) FILTER (is_tp) AS num_tp, count(*) FILTER (is_fp) AS num_fp FROM rows_ WHERE cls IS NOT NULL GROUP BY ALL),
u AS (SELECT {key}, cls, score, count(*) FILTER (is_tp) AS tp, count(*) FILTER (is_fp) AS fp FROM rows_ WHERE cls IS NOT NULL AND NOT is_fn GROUP BY ALL),
w AS (SELECT *, sum(tp) OVER o AS ctp, sum(fp) OVER o AS cfp FROM u WINDOW o AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT {key}, cls, num_gt, num_tp, unnest(range(0, 41)) AS k FROM n WHERE num_gt > 0 AND num_tp > 0),
c AS (SELECT *, k + max(greatest(0, CAST(ceil((k * num_gt / 20.0 - 3) / 2) AS BIGINT)) - k) OVER ({part} ORDER BY k) AS i FROM k),
p AS (SELECT {key}, cls, i FROM c WHERE i < num_tp - 1 UNION SELECT {key}, cls, num_tp - 1 FROM c),
q AS (SELECT p.{key}, p.cls, p.i, arg_min(w.ctp / (w.ctp + w.cfp), w.ctp) AS prec FROM p JOIN w ON w.{key} = p.{key} AND w.cls = p.cls AND w.tp > 0 AND w.ctp > p.i GROUP BY ALL),
e AS (SELECT {key}, cls, i, row_number() OVER ({part} ORDER BY i) - 1 AS j, max(prec) OVER ({part} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS prec FROM q),
s AS (SELECT {key}, cls, sum(prec) FILTER (j % {every} = 0) AS total FROM e GROUP BY ALL),
ap_ AS (SELECT n.{key}, n.cls, num_gt, num_tp, num_fp, coalesce(total, 0) / {40 // every + 1} * 100 AS ap FROM n LEFT JOIN s ON s.{key} = n.{key} AND s.cls = n.cls WHERE num_gt > 0)"""


@query(f"WITH {_ap_sql(_ROWS, 'cond')} SELECT cond, cls, num_gt, num_tp, num_fp, round(ap, 6) + 0.0 AS ap FROM ap_")
def a08_a09_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    """41-point interpolated average precision per condition and class, from the track match rows."""
    rows = match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf)).where("cls IS NOT NULL")
    ap = average_precision(rows, ["cond", "cls"])
    return ap.select("cond", "cls", "num_gt", "num_tp", "num_fp", _r("ap").alias("ap"))


@query(f"WITH {_ap_sql(_ROWS, 'cond', 4)} SELECT cond, cls, round(ap, 6) + 0.0 AS ap11 FROM ap_")
def a12_eleven_points(spark: SparkSession, sf: str) -> DataFrame:
    """The older 11-point average precision: every fourth of the 41 samples."""
    rows = match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf)).where("cls IS NOT NULL")
    return average_precision(rows, ["cond", "cls"], every=4).select("cond", "cls", _r("ap").alias("ap11"))


@query(f"""WITH {_ap_sql(_ROWS, 'cond')}, o AS (SELECT cls, ap AS base FROM ap_ WHERE cond = 'original' AND ap > 0), r AS (SELECT ap_.cls, regexp_replace(cond, '_(low|medium|high)$', '') AS effect, ap / base AS rb FROM ap_ JOIN o USING (cls) WHERE cond <> 'original')
SELECT cls, effect, count(*) AS n, round(avg(rb), 6) + 0.0 AS mean_rb, round(CASE WHEN count(*) >= 2 THEN avg(rb) - stddev_samp(rb) END, 6) + 0.0 AS cri FROM r GROUP BY ALL""")  # fmt: skip
def x07_j07_precision_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision kept under each effect against the clean condition, per class, and its stability."""
    ap = average_precision(match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf)).where("cls IS NOT NULL"), ["cond", "cls"])
    base = ap.where("cond = 'original' AND ap > 0").select("cls", F.col("ap").alias("base"))
    rb = ap.where("cond <> 'original'").join(base, "cls").select("cls", F.regexp_replace("cond", "_(low|medium|high)$", "").alias("effect"), (F.col("ap") / F.col("base")).alias("rb"))
    return rb.groupBy("cls", "effect").agg(
        F.count("*").alias("n"), _r(F.avg("rb")).alias("mean_rb"), _r(F.when(F.count("*") >= 2, F.avg("rb") - F.stddev_samp("rb"))).alias("cri")
    )


_FAN = _ROWS.replace("rows_ AS (", "all_ AS (") + f""", {d.TG}, t1 AS (SELECT seq, min(road) AS road, min(weather) AS weather FROM tg WHERE seq IS NOT NULL GROUP BY seq),
rows_ AS (SELECT unnest(['all', 'road:' || road, 'weather:' || weather]) AS scene, cls, score, is_tp, is_fp, is_fn FROM all_ LEFT JOIN t1 ON t1.seq = all_.seq WHERE cond = 'original')"""


@query(f"WITH {_ap_sql(_FAN, 'scene')} SELECT scene, cls, num_gt, round(ap, 6) + 0.0 AS ap FROM ap_ WHERE scene IS NOT NULL")
def x09_conditional_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision of the clean run over all sequences and by the road and weather of the sequence."""
    tags = d.tags(spark, sf).where("seq IS NOT NULL").groupBy("seq").agg(F.min("road").alias("road"), F.min("weather").alias("weather"))
    rows = match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf)).where("cls IS NOT NULL AND cond = 'original'").join(tags, "seq", "left")
    scenes = F.array(F.lit("all"), F.concat(F.lit("road:"), "road"), F.concat(F.lit("weather:"), "weather"))
    rows = rows.withColumn("scene", F.explode(scenes)).where("scene IS NOT NULL")
    return average_precision(rows, ["scene", "cls"]).select("scene", "cls", "num_gt", _r("ap").alias("ap"))


@query(f"""WITH {_ROWS}, a AS (SELECT gt_id, seq, cls, bool_or(hit) AS m FROM m WHERE cond = 'original' GROUP BY ALL),
x AS (SELECT b.cond, b.cls, CASE WHEN a.m AND b.hit THEN 's' WHEN a.m THEN 'm' WHEN b.hit THEN 'r' ELSE 'b' END AS t FROM a JOIN m b ON b.gt_id = a.gt_id WHERE b.cond <> 'original'),
n AS (SELECT cond, cls, count(*) AS total, count(*) FILTER (t='s') AS stable, count(*) FILTER (t='m') AS induced_miss, count(*) FILTER (t='r') AS induced_recovery, count(*) FILTER (t='b') AS baseline_failure FROM x GROUP BY ALL)
SELECT *, round(CASE WHEN stable + induced_miss > 0 THEN induced_miss / (stable + induced_miss) END, 6) + 0.0 AS miss_rate, round(CASE WHEN baseline_failure + induced_recovery > 0 THEN induced_recovery / (baseline_failure + induced_recovery) END, 6) + 0.0 AS recovery_rate,
round((induced_miss + induced_recovery) / total, 6) + 0.0 AS churn, round(CASE WHEN stable + induced_miss > 0 THEN (stable + induced_recovery) / (stable + induced_miss) END, 6) + 0.0 AS net_retention FROM n""")  # fmt: skip
def j03_x03_a05_a06_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every clean detection under each condition: counts, rates, churn and net retention."""
    rows = match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf)).where("is_tp OR is_fn")
    rates = transition_rates(rows, ["cls"], clean="original")
    return rates.select("cond", "cls", "total", "stable", "induced_miss", "induced_recovery", "baseline_failure",
                        *[_r(k).alias(k) for k in ("miss_rate", "recovery_rate", "churn", "net_retention")])


@query(f"""WITH {_ROWS}, r AS (SELECT cond, cls, count(*) FILTER (is_tp) / count(*) FILTER (is_tp OR is_fn) AS recall FROM rows_ WHERE cls IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (is_tp OR is_fn) > 0),
o AS (SELECT cls, recall AS base FROM r WHERE cond = 'original'),
b AS (SELECT r.cls, CASE WHEN regexp_matches(cond, '_(low|medium|high)$') THEN regexp_replace(cond, '_(low|medium|high)$', '') ELSE cond END AS effect, CASE WHEN base > 0 THEN recall / base END AS rb FROM r JOIN o USING (cls) WHERE cond <> 'original')
SELECT cls, effect, count(rb) AS n, round(avg(rb), 6) + 0.0 AS mean_rb, round(min(rb), 6) + 0.0 AS min_rb, round(max(rb), 6) + 0.0 AS max_rb, round(CASE WHEN count(rb) >= 2 THEN avg(rb) - stddev_samp(rb) END, 6) + 0.0 AS cri FROM b GROUP BY ALL""")  # fmt: skip
def a16_a17_robustness(spark: SparkSession, sf: str) -> DataFrame:
    """Recall kept under each effect against the clean condition; mean less sample deviation over severities."""
    rows = match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf)).where("cls IS NOT NULL")
    n_gt = F.count(F.when(F.col("is_tp") | F.col("is_fn"), 1))
    recall = rows.groupBy("cond", "cls").agg(F.try_divide(F.count(F.when(F.col("is_tp"), 1)), n_gt).alias("recall")).where("recall IS NOT NULL")
    base = recall.where("cond = 'original'").select("cls", F.col("recall").alias("base"))
    effect = F.regexp_replace("cond", "_(low|medium|high)$", "").alias("effect")
    rb = recall.where("cond <> 'original'").join(base, "cls").select("cls", effect, F.when(F.col("base") > 0, F.col("recall") / F.col("base")).alias("rb"))
    return rb.groupBy("cls", "effect").agg(
        F.count("rb").alias("n"), _r(F.avg("rb")).alias("mean_rb"), _r(F.min("rb")).alias("min_rb"), _r(F.max("rb")).alias("max_rb"),
        _r(F.when(F.count("rb") >= 2, F.avg("rb") - F.stddev_samp("rb"))).alias("cri"),
    )


@query(f"""WITH {GT} SELECT CASE WHEN r >= 0 AND r < 10 THEN '0-10' WHEN r >= 10 AND r < 30 THEN '10-30' WHEN r >= 30 AND r < 60 THEN '30-60' ELSE 'out_of_range' END AS bin, cls, count(*) AS n
FROM (SELECT cls, sqrt(loc_x*loc_x + loc_z*loc_z) AS r FROM gt WHERE cls IS NOT NULL) GROUP BY ALL""")  # fmt: skip
def x04_distance_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by class and half-open distance bin."""
    r = F.sqrt(F.col("loc_x") * F.col("loc_x") + F.col("loc_z") * F.col("loc_z"))
    b = F.lit("out_of_range")
    for lo, hi in ((30, 60), (10, 30), (0, 10)):
        b = F.when((r >= lo) & (r < hi), f"{lo}-{hi}").otherwise(b)
    return d.gt(spark, sf).where("cls IS NOT NULL").groupBy(b.alias("bin"), "cls").agg(F.count("*").alias("n"))


def _aligned(df: DataFrame, p: str, ident: str, keys: list[str], extra: list[str] = ()) -> DataFrame:
    """Axis-aligned BEV rectangle and height interval of a box under prefixed names."""
    c = F.col
    turn = F.abs(F.abs(g.wrapped(c("rot_y"), math.pi)) - math.pi / 2) < math.pi / 4
    dx, dz = F.when(turn, c("w")).otherwise(c("l")), F.when(turn, c("l")).otherwise(c("w"))
    return df.select(
        *keys, c(ident), *extra, (c("loc_x") - dx / 2).alias(f"{p}x0"), (c("loc_x") + dx / 2).alias(f"{p}x1"), (c("loc_z") - dz / 2).alias(f"{p}z0"),
        (c("loc_z") + dz / 2).alias(f"{p}z1"), (c("loc_y") - c("h") / 2).alias(f"{p}y0"), (c("loc_y") + c("h") / 2).alias(f"{p}y1"),
    )


def aligned_iou(p: str, q: str):
    """3D intersection over union of two axis-aligned boxes under prefixed names."""
    c = F.col

    def size(k):
        return (c(f"{k}x1") - c(f"{k}x0")) * (c(f"{k}z1") - c(f"{k}z0")) * (c(f"{k}y1") - c(f"{k}y0"))

    common = F.lit(1.0)
    for a in "xzy":
        common = common * g.overlap(c(f"{p}{a}0"), c(f"{p}{a}1"), c(f"{q}{a}0"), c(f"{q}{a}1"))
    return g.iou(common, size(p), size(q))


_AL = """SELECT {id}, seq, frame, {extra} loc_x - dx/2 AS x0, loc_x + dx/2 AS x1, loc_z - dz/2 AS z0, loc_z + dz/2 AS z1, loc_y - h/2 AS y0, loc_y + h/2 AS y1
FROM (SELECT *, CASE WHEN t THEN w ELSE l END AS dx, CASE WHEN t THEN l ELSE w END AS dz FROM (SELECT *, abs(abs(rot_y - floor(rot_y/pi() + 0.5)*pi()) - pi()/2) < pi()/4 AS t FROM {tab}))"""


@query(f"""WITH {GT}, {PR}, a AS ({_AL.format(id='gt_id', extra='', tab='gt')}), b AS ({_AL.format(id='pred_id', extra='cond,', tab="(SELECT * FROM pr WHERE cond IS NOT NULL)")}),
seen AS (SELECT DISTINCT seq, frame, cond FROM b WHERE seq IS NOT NULL AND frame IS NOT NULL),
j AS (SELECT gt_id, pred_id, cond, greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.z1,b.z1)-greatest(a.z0,b.z0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0) AS i,
 (a.x1-a.x0)*(a.z1-a.z0)*(a.y1-a.y0) AS va, (b.x1-b.x0)*(b.z1-b.z0)*(b.y1-b.y0) AS vb FROM a JOIN b ON a.seq = b.seq AND a.frame = b.frame AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.z0 <= b.z1 AND b.z0 <= a.z1),
k AS (SELECT gt_id, pred_id, cond, round(i/(va+vb-i), 6) + 0.0 AS iou FROM j WHERE i/(va+vb-i) > 0.01),
r AS (SELECT *, row_number() OVER (PARTITION BY gt_id, cond ORDER BY iou DESC, pred_id) AS n FROM k)
SELECT gt.gt_id, seen.cond, r.pred_id, r.iou FROM gt JOIN seen ON seen.seq = gt.seq AND seen.frame = gt.frame LEFT JOIN r ON r.gt_id = gt.gt_id AND r.cond = seen.cond AND n = 1""")  # fmt: skip
def j17_g06_best_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """For every label and condition seen in its frame the detection of the highest axis-aligned 3D overlap above 0.01, or none."""
    keys = ["seq", "frame"]
    preds = d.preds(spark, sf).where("cond IS NOT NULL")
    a = _aligned(d.gt(spark, sf), "a", "gt_id", keys)
    b = _aligned(preds, "b", "pred_id", keys, ["cond"])
    near = overlapping_pairs(a, b, keys, ["ax0", "ax1", "az0", "az1"], ["bx0", "bx1", "bz0", "bz1"], cell=8.0)
    near = near.withColumn("_iou", aligned_iou("a", "b")).where("_iou > 0.01").withColumn("iou", _r("_iou"))
    best = near.groupBy("gt_id", "cond").agg(F.min(F.struct((-F.col("iou")).alias("n"), "pred_id")).alias("m")).select("gt_id", "cond", F.col("m.pred_id"), (-F.col("m.n")).alias("iou"))
    seen = preds.where("seq IS NOT NULL AND frame IS NOT NULL").select(*keys, "cond").distinct()
    return a.select("gt_id", *keys).join(seen, keys).select("gt_id", "cond").join(best, ["gt_id", "cond"], "left")


@query(f"WITH {GT} SELECT gt_id, seq, frame, CAST(row_number() OVER (PARTITION BY seq, frame ORDER BY line_idx, gt_id) - 1 AS INT) AS idx FROM gt WHERE seq IS NOT NULL AND frame IS NOT NULL")
def w01_object_index(spark: SparkSession, sf: str) -> DataFrame:
    """Index of every label within its frame, by line number."""
    df = d.gt(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL")
    return numbered(df, ["seq", "frame"], ["line_idx", "gt_id"], "coalesce(line_idx div 256, -1)", "idx").select("gt_id", "seq", "frame", F.col("idx").cast("int").alias("idx"))


@query(f"""WITH {PR} SELECT seq, frame, CASE WHEN bool_or(cond = 'original') THEN 'original' ELSE min(cond) END AS chosen FROM pr
WHERE seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL GROUP BY ALL""")  # fmt: skip
def w02_preferred_condition(spark: SparkSession, sf: str) -> DataFrame:
    """The condition that stands for a frame: the clean one if there, else the first by name."""
    df = d.preds(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL")
    return df.groupBy("seq", "frame").agg(F.min(F.struct((F.col("cond") != "original").alias("p"), "cond")).alias("m")).select("seq", "frame", F.col("m.cond").alias("chosen"))


@query(f"""WITH {GT}, n AS (SELECT seq, frame, count(*) AS objects FROM gt WHERE seq IS NOT NULL AND frame IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY objects DESC, frame) AS k FROM n) SELECT seq, frame, objects FROM r WHERE k <= 5""")  # fmt: skip
def t01_densest_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The five frames of every sequence with the most labels."""
    n = d.gt(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL").groupBy("seq", "frame").agg(F.count("*").alias("objects"))
    w = Window.partitionBy("seq").orderBy(F.desc("objects"), "frame")
    return n.withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


@query(f"""WITH {GT}, {PR}, seen AS (SELECT DISTINCT seq, frame, cond FROM pr WHERE cond IS NOT NULL AND seq IS NOT NULL AND frame IS NOT NULL),
a AS (SELECT gt.seq, gt.frame, cond, cls, count(*) AS gts FROM gt JOIN seen ON seen.seq = gt.seq AND seen.frame = gt.frame WHERE cls IS NOT NULL GROUP BY ALL),
b AS (SELECT seq, frame, cond, cls, count(*) AS preds FROM pr WHERE cond IS NOT NULL AND cls IS NOT NULL AND seq IS NOT NULL AND frame IS NOT NULL GROUP BY ALL)
SELECT coalesce(a.seq, b.seq) AS seq, coalesce(a.frame, b.frame) AS frame, coalesce(a.cond, b.cond) AS cond, coalesce(a.cls, b.cls) AS cls, coalesce(gts, 0) AS gts, coalesce(preds, 0) AS preds
FROM a FULL JOIN b ON a.seq = b.seq AND a.frame = b.frame AND a.cls = b.cls AND a.cond = b.cond WHERE coalesce(gts, 0) <> coalesce(preds, 0)""")  # fmt: skip
def u07_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Frames, conditions and classes where labels and detections differ in number."""
    keys = ["seq", "frame", "cond", "cls"]
    p = d.preds(spark, sf).where("cond IS NOT NULL AND seq IS NOT NULL AND frame IS NOT NULL")
    seen = p.select("seq", "frame", "cond").distinct()
    a = d.gt(spark, sf).where("cls IS NOT NULL").join(seen, ["seq", "frame"]).groupBy(*keys).agg(F.count("*").alias("gts"))
    b = p.where("cls IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("preds"))
    return a.join(b, keys, "full").na.fill(0, ["gts", "preds"]).where("gts <> preds")


@query(f"""WITH {PR} SELECT pred_id, concat_ws(' ', coalesce(cls, 'unknown'), '0.00 0 0 50 50 150 150', printf('%.4f', h), printf('%.4f', w), printf('%.4f', l), printf('%.4f', loc_x), printf('%.4f', loc_y), printf('%.4f', loc_z), printf('%.4f', rot_y), printf('%.4f', coalesce(score, 0))) AS line FROM pr""")
def k01_k13_kitti_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Detections as lines of a KITTI result file."""
    nums = [F.format_string("%.4f", F.col(c)) for c in ("h", "w", "l", "loc_x", "loc_y", "loc_z", "rot_y")]
    line = F.concat_ws(" ", F.coalesce("cls", F.lit("unknown")), F.lit("0.00 0 0 50 50 150 150"), *nums, F.format_string("%.4f", F.coalesce("score", F.lit(0.0))))
    return d.preds(spark, sf).select("pred_id", line.alias("line"))


@query(f"""SELECT cls, count(*) AS effects, round(avg(mean_rb), 9) + 0.0 AS mean_rb, round(avg(cri), 9) + 0.0 AS mean_cri FROM ({query.sql['a16_a17_robustness']}) GROUP BY cls""")
def a18_mean_robustness(spark: SparkSession, sf: str) -> DataFrame:
    """Robustness of every class averaged over effects; effects without a stability figure do not count in its mean."""
    r = a16_a17_robustness(spark, sf)
    return r.groupBy("cls").agg(F.count("*").alias("effects"), _r(F.avg("mean_rb"), 9).alias("mean_rb"), _r(F.avg("cri"), 9).alias("mean_cri"))


@query(f"WITH {GT} SELECT gt_id, round(l + 0.4, 6) + 0.0 AS l, round(w + 0.4, 6) + 0.0 AS w, round(h + 0.2, 6) + 0.0 AS h FROM gt WHERE cls NOT IN ('ped', 'dontcare')")
def m24_f17_enlarged_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Labels without the dropped classes, their boxes enlarged on all sides."""
    keep = d.gt(spark, sf).where(~F.col("cls").isin("ped", "dontcare"))
    return keep.select("gt_id", *[_r(F.col(k) + e).alias(k) for k, e in (("l", 0.4), ("w", 0.4), ("h", 0.2))])


@query(f"""WITH {GT}, {PR}, a AS ({_AL.format(id='pred_id', extra='score,', tab='pr')}), b AS ({_AL.format(id='gt_id', extra='', tab="(SELECT * FROM gt WHERE ambiguous)")})
SELECT pred_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.seq = b.seq AND a.frame = b.frame AND greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.z1,b.z1)-greatest(a.z0,b.z0),0) > 0.5*(a.x1-a.x0)*(a.z1-a.z0))""")  # fmt: skip
def f16_outside_ignored_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Detections that no ambiguous label covers by more than half in the BEV plane."""
    keys, c = ["seq", "frame"], F.col
    a = _aligned(d.preds(spark, sf), "a", "pred_id", keys)
    b = _aligned(d.gt(spark, sf).where("ambiguous"), "b", "gt_id", keys)
    near = overlapping_pairs(a, b, keys, ["ax0", "ax1", "az0", "az1"], ["bx0", "bx1", "bz0", "bz1"], cell=8.0)
    common = g.overlap(c("ax0"), c("ax1"), c("bx0"), c("bx1")) * g.overlap(c("az0"), c("az1"), c("bz0"), c("bz1"))
    covered = near.where(common > 0.5 * (c("ax1") - c("ax0")) * (c("az1") - c("az0"))).select("pred_id")
    return a.select("pred_id").join(covered, "pred_id", "left_anti")
