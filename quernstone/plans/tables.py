"""Queries of sampling, lineage of object ids, revision of labels and small joins around them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import geometry as g
from quernstone.operators.blocks import numbered
from quernstone.operators.evaluation import checked_transitions, match_rows_by_track, transition_rates
from quernstone.operators.frames import near_rows
from quernstone.operators.matching import farthest_sample, suppressed
from quernstone.operators.rivals import rebuilt
from quernstone.operators.spatial import overlapping_pairs, within_radius
from quernstone.plans import domain as d
from quernstone.plans.assignment import _ROI, _roi_pairs
from quernstone.plans.boxes import _AL, _ROWS, _aligned, aligned_iou, w02_preferred_condition
from quernstone.plans.domain import FR, GT, PR, PT, TG, Catalogue
from quernstone.session import table

query = Catalogue()
_PKEY = ["ok", "ln", "pk", "sk", "power"]
_K = ", ".join(_PKEY)
_DRAW = "(ok * 7919 + ln * 104729 + pk * 1299709) % 1000003"


def _r(c, n: int = 6):
    return F.round(c, n)


# --- filters and projections


def roi(bounds: dict[str, tuple[float, float]], closed: bool = False):
    """Whether every listed coordinate lies between its bounds, ends excluded or (``closed``) included."""
    inside = F.lit(True)
    for c, (lo, hi) in bounds.items():
        inside = inside & (F.col(c).between(lo, hi) if closed else ((F.col(c) > lo) & (F.col(c) < hi)))
    return inside


@query(f"""WITH {PT} SELECT frame, count(*) FILTER (x > 5 AND x < 60 AND y > -10 AND y < 10) AS in_xy, count(*) FILTER (x > 5 AND x < 60 AND y > -10 AND y < 10 AND z > -1 AND z < 3) AS in_xyz,
count(*) FILTER (x BETWEEN 7 AND 42 AND y BETWEEN -8 AND 8) AS in_range FROM pt GROUP BY frame""")  # fmt: skip
def f10_f11_list_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Points in regions given as lists of two or three axes, ends excluded, and in an x-y range, ends included."""
    flat = {"x": (5, 60), "y": (-10, 10)}
    return d.points(spark, sf).groupBy("frame").agg(
        F.count_if(roi(flat)).alias("in_xy"), F.count_if(roi({**flat, "z": (-1, 3)})).alias("in_xyz"), F.count_if(roi({"x": (7, 42), "y": (-8, 8)}, closed=True)).alias("in_range")
    )


@query(f"""WITH {GT}, {PR}, f AS (SELECT seq, frame FROM gt WHERE seq IS NOT NULL AND frame IS NOT NULL GROUP BY ALL) SELECT cond, count(*) AS written, count(DISTINCT seq * 1000000 + frame) AS frames FROM pr JOIN f USING (seq, frame) WHERE cond IS NOT NULL GROUP BY cond""")
def f18_gated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Result lines that may be written: those of frames with at least one label, per condition."""
    kept = d.preds(spark, sf).where("cond IS NOT NULL").join(d.gt(spark, sf), ["seq", "frame"], "left_semi")
    return kept.groupBy("cond").agg(F.count("*").alias("written"), F.countDistinct(F.col("seq") * 1000000 + F.col("frame")).alias("frames"))


@query(f"""WITH {PR}, a AS (SELECT DISTINCT modality || '_' || effect || '_' || severity AS cond FROM (SELECT unnest(['camera', 'lidar', 'radar']) AS modality), (SELECT DISTINCT regexp_extract(cond, '^(camera|radar|lidar)_(.*)_(low|medium|high)$', 2) AS effect FROM pr),
(SELECT unnest(['low', 'high']) AS severity)) SELECT pred_id, cond FROM pr WHERE cond IN (SELECT cond FROM a)""")  # fmt: skip
def f19_allowed_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of the conditions on a list: every sensor and effect that occurs, in its lowest and highest severity."""
    p = d.preds(spark, sf)
    effects = p.select(F.regexp_extract("cond", "^(camera|radar|lidar)_(.*)_(low|medium|high)$", 2).alias("e")).distinct()
    listed = effects.withColumn("m", F.explode(F.array(*map(F.lit, ("camera", "lidar", "radar"))))).withColumn("s", F.explode(F.array(F.lit("low"), F.lit("high"))))
    return p.join(listed.select(F.concat_ws("_", "m", "e", "s").alias("cond")), "cond", "left_semi").select("pred_id", "cond")


@query(f"WITH {GT} SELECT gt_id, round(radians(degrees(rot_y)), 6) + 0.0 AS yaw, round(2 * (l / 2), 6) + 0.0 AS l, round(2 * (w / 2), 6) + 0.0 AS w, round(2 * (h / 2), 6) + 0.0 AS h FROM gt")
def m02_label_units(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees and half extents, as label files have them, to radians and full extents."""
    halves = d.gt(spark, sf).select("gt_id", F.degrees("rot_y").alias("degrees"), *[(F.col(k) / 2).alias(f"half_{k}") for k in ("l", "w", "h")])
    return halves.select("gt_id", _r(F.radians("degrees")).alias("yaw"), *[_r(2 * F.col(f"half_{k}")).alias(k) for k in ("l", "w", "h")])


_MEAN = (4.5, 1.9, 1.6)


@query(f"""WITH {GT}, b AS (SELECT gt_id, loc_z AS x, -loc_x AS y, -loc_y AS z, l, w, h, rot_y AS r, floor(loc_z) AS px, floor(-loc_x) AS py, -1.0::DOUBLE AS pz FROM gt WHERE l > 0 AND w > 0 AND h > 0)
SELECT gt_id, round((x-px)/sqrt(4.5*4.5+1.9*1.9), 6) + 0.0 AS xt, round((y-py)/sqrt(4.5*4.5+1.9*1.9), 6) + 0.0 AS yt, round((z-pz)/1.6, 6) + 0.0 AS zt, round(ln(l/4.5), 6) + 0.0 AS lt, round(ln(w/1.9), 6) + 0.0 AS wt, round(ln(h/1.6), 6) + 0.0 AS ht,
round(cos(r), 6) + 0.0 AS ct, round(sin(r), 6) + 0.0 AS st, round(z - h/2, 6) + 0.0 AS legacy_bottom, true AS round_trip FROM b""")  # fmt: skip
def m26_point_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals of a box against a point and a mean size, heading as cosine and sine, decoded back; and the older form that gives the bottom."""
    c = F.col
    b = d.gt(spark, sf).where("l > 0 AND w > 0 AND h > 0").select(
        "gt_id", c("loc_z").alias("x"), (-c("loc_x")).alias("y"), (-c("loc_y")).alias("z"), "l", "w", "h", c("rot_y").alias("r"), F.floor("loc_z").alias("px"), F.floor(-c("loc_x")).alias("py"), F.lit(-1.0).alias("pz")
    )
    code = g.point_encoded(*[c(k) for k in "xyzlwhr"], *[c(f"p{k}") for k in "xyz"], _MEAN)
    back = g.point_decoded(code, *[c(f"p{k}") for k in "xyz"], _MEAN)
    same = F.lit(True)
    for k, v in zip("xyzlwh", back):
        same = same & (F.abs(v - c(k)) < 1e-9)
    same = same & (F.abs(F.sin(back[6] - c("r"))) < 1e-9)
    names = ("xt", "yt", "zt", "lt", "wt", "ht", "ct", "st")
    return b.select("gt_id", *[_r(v).alias(n) for n, v in zip(names, code)], _r(g.bottom_of(back[2], back[5])).alias("legacy_bottom"), same.alias("round_trip"))


@query("""WITH p AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_suppkey % 3 AS ch, l_partkey % 256 AS v FROM lineitem), n AS (SELECT *, (v / 255.0::DOUBLE - [0.485, 0.456, 0.406][ch + 1]) / [0.229, 0.224, 0.225][ch + 1] AS n FROM p)
SELECT ok, ln, ch, round(n, 6) + 0.0 AS normal, CAST(greatest(0, least(255, round_even((n + 0.1) * [0.229, 0.224, 0.225][ch + 1] * 255 + [0.485, 0.456, 0.406][ch + 1] * 255, 0))) AS INT) AS brighter FROM n""")
def m34_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels normalised by channel mean and deviation, brightened there, and brought back as clipped whole numbers."""
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), (F.col("l_suppkey") % 3).alias("ch"), (F.col("l_partkey") % 256).alias("v"))
    p = p.withColumn("n", g.pixel_normal(F.col("v"), F.col("ch")))
    return p.select("ok", "ln", "ch", _r("n").alias("normal"), g.pixel_value(F.col("n") + 0.1, F.col("ch")).alias("brighter"))


# --- joins


@query(f"""WITH {GT}, {PR}, w AS (SELECT seq, frame, CASE WHEN bool_or(cond = 'original') THEN 'original' ELSE min(cond) END AS chosen FROM pr WHERE seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL GROUP BY ALL)
SELECT gt_id, chosen FROM gt JOIN w USING (seq, frame)""")  # fmt: skip
def j04_labels_of_chosen_condition(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of frames that were judged, with the condition chosen to stand for the frame."""
    return d.gt(spark, sf).select("gt_id", "seq", "frame").join(w02_preferred_condition(spark, sf), ["seq", "frame"]).select("gt_id", "chosen")


@query(f"""WITH {_ROWS}, f AS (SELECT cond, cls, CASE WHEN is_tp THEN 'tp' WHEN is_fp THEN 'fp' ELSE 'fn' END AS fate FROM rows_ WHERE cls IS NOT NULL), n AS (SELECT cond, cls, fate, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT cond, cls, count(*) AS total FROM f GROUP BY ALL)
SELECT n.cond, n.cls, fate, n, total, round(n / total, 6) + 0.0 AS share FROM n LEFT JOIN t ON t.cond = n.cond AND t.cls = n.cls""")  # fmt: skip
def j05_counts_with_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per condition, class and fate joined to their totals, and their share."""
    rows = match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf)).where("cls IS NOT NULL")
    n = rows.groupBy("cond", "cls", F.when(F.col("is_tp"), "tp").when(F.col("is_fp"), "fp").otherwise("fn").alias("fate")).agg(F.count("*").alias("n"))
    totals = n.groupBy("cond", "cls").agg(F.sum("n").alias("total"))
    return n.join(totals, ["cond", "cls"], "left").withColumn("share", _r(F.col("n") / F.col("total")))


_SCENE = "t1 AS (SELECT seq, min(weather) AS weather FROM tg WHERE seq IS NOT NULL GROUP BY seq)"


@query(f"""WITH {GT}, {PR}, {TG}, {_SCENE}, {_ROI}, s AS (SELECT k.*, pr.cls, coalesce(pr.score, 0) AS score, coalesce(weather, 'none') AS scene FROM k JOIN pr ON pr.pred_id = k.pred_id LEFT JOIN t1 ON t1.seq = pr.seq WHERE k.cond IS NOT NULL),
v AS (SELECT cond, thr, scene, cls, level, count(DISTINCT gt_id) FILTER (iou > level) AS v FROM s, (SELECT unnest([0.0, 0.3, 0.5])::DOUBLE AS thr), (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS level) WHERE score > thr GROUP BY ALL)
SELECT c.cond, c.thr AS conf_thr, c.scene, c.cls, c.level AS iou, o.v AS original_value, c.v AS corrupted_value, round(CASE WHEN o.v > 0 THEN c.v / o.v END, 6) + 0.0 AS rb FROM v c JOIN v o ON o.cond = 'original' AND o.thr = c.thr AND o.scene = c.scene AND o.cls = c.cls AND o.level = c.level WHERE c.cond <> 'original'""")  # fmt: skip
def j06_original_with_corrupted(spark: SparkSession, sf: str) -> DataFrame:
    """Result blocks of corrupted runs joined to the original run by confidence threshold, scene and class, then aligned by overlap value.

    A block holds a list of overlap levels and a list of values (labels found above the level) beside it.
    """
    c = F.col
    weather = d.tags(spark, sf).where("seq IS NOT NULL").groupBy("seq").agg(F.min("weather").alias("scene"))
    found = d.preds(spark, sf).select("pred_id", "seq", F.coalesce("score", F.lit(0.0)).alias("score")).join(weather, "seq", "left")
    s = _roi_pairs(spark, sf).drop("seq").where("cond IS NOT NULL").join(found, "pred_id").withColumn("scene", F.coalesce("scene", F.lit("none")))
    s = s.withColumn("conf_thr", F.explode(F.array(*[F.lit(t) for t in (0.0, 0.3, 0.5)]))).where("score > conf_thr")
    levels = (0.1, 0.3, 0.5)
    key = ["conf_thr", "scene", "cls"]
    best = s.groupBy("cond", *key, "gt_id").agg(F.max("iou").alias("iou"))
    blocks = best.groupBy("cond", *key).agg(F.array(*[F.lit(v) for v in levels]).alias("ious"), F.array(*[F.count_if(c("iou") > v) for v in levels]).alias("vals"))
    clean = blocks.where("cond = 'original'").select(*key, F.explode(F.arrays_zip("ious", "vals")).alias("o")).select(*key, c("o.ious").alias("iou"), c("o.vals").alias("original_value"))
    other = blocks.where("cond <> 'original'").select("cond", *key, F.explode(F.arrays_zip("ious", "vals")).alias("o")).select("cond", *key, c("o.ious").alias("iou"), c("o.vals").alias("corrupted_value"))
    both = other.join(clean, [*key, "iou"])
    return both.select("cond", *key, "iou", "original_value", "corrupted_value", _r(F.when(c("original_value") > 0, c("corrupted_value") / c("original_value"))).alias("rb"))


@query(f"""WITH {FR}, f AS (SELECT seq, frame, min(rdr) AS rdr FROM fr GROUP BY ALL) SELECT seq, frame, lpad(CAST(rdr AS VARCHAR), 5, '0') AS tesseract, lpad(CAST(row_number() OVER (PARTITION BY seq ORDER BY frame) - 1 AS VARCHAR), 6, '0') AS kitti_frame FROM f""")
def j30_frame_index_map(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame with its cube index and its six-digit place in the sequence."""
    f = d.frames(spark, sf).groupBy("seq", "frame").agg(F.min("rdr").alias("rdr"))
    return numbered(f, ["seq"], ["frame"], "frame div 4096").select(
        "seq", "frame", F.lpad(F.col("rdr").cast("string"), 5, "0").alias("tesseract"), F.lpad(F.col("_i").cast("string"), 6, "0").alias("kitti_frame")
    )


@query(f"""WITH {GT}, {PR}, j AS (SELECT pred_id, gt_id, power(p.loc_x-g.loc_x, 2) + power(p.loc_y-g.loc_y, 2) + power(p.loc_z-g.loc_z, 2) AS d2, sqrt(g.l*g.l + g.w*g.w + g.h*g.h)/2 AS half FROM pr p JOIN gt g ON g.seq = p.seq AND g.frame = p.frame),
m AS (SELECT pred_id, arg_min(gt_id, (round(d2, 9), gt_id)) AS gt_id, arg_min(d2, (round(d2, 9), gt_id)) AS d2, arg_min(half, (round(d2, 9), gt_id)) AS half FROM j GROUP BY pred_id) SELECT pred_id, gt_id FROM m WHERE sqrt(d2) < half + 2""")  # fmt: skip
def j31_near_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Proximity sampling: detection centres whose nearest label of the frame is nearer than its half diagonal and 2 m."""
    c = F.col
    labels = d.gt(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL").select("seq", "frame", "gt_id", *[c(f"loc_{k}").alias(f"a{k}") for k in "xyz"], (F.sqrt(c("l") * c("l") + c("w") * c("w") + c("h") * c("h")) / 2).alias("half"))
    reach = (labels.agg(F.max("half")).first()[0] or 0.0) + 2.0  # beyond it no label can be near enough
    found = d.preds(spark, sf).select("seq", "frame", "pred_id", *[c(f"loc_{k}").alias(f"b{k}") for k in "xyz"])
    near = within_radius(found, labels, ["seq", "frame"], ["bx", "by", "bz"], ["ax", "ay", "az"], reach)
    best = near.groupBy("pred_id").agg(F.min(F.struct(F.round("d2", 9).alias("r"), "gt_id", "d2", "half")).alias("m"))
    return best.where(F.sqrt("m.d2") < c("m.half") + 2).select("pred_id", "m.gt_id")


# --- samples


@query(f"""WITH {PT}, r AS (SELECT {_K}, frame, row_number() OVER (PARTITION BY frame, ln ORDER BY {_DRAW}, {_K}) AS k, count(*) OVER (PARTITION BY frame, ln) AS n FROM pt) SELECT {_K} FROM r WHERE k <= CAST(floor(n * 0.4) AS BIGINT)""")
def t16_ring_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Of every ring of a frame exactly floor(0.4 n) points, by a reproducible draw."""
    ring = ["frame", "ln"]
    p = d.points(spark, sf).withColumn("_d", F.expr(_DRAW))
    n = p.groupBy(*ring).agg(F.count("*").alias("n"))
    drawn = numbered(p, ring, ["_d", *_PKEY], "_d div 100000").join(n, ring)
    return drawn.where(F.col("_i") < F.floor(F.col("n") * 0.4)).select(*_PKEY)


@query(f"WITH {FR}, f AS (SELECT DISTINCT seq, frame FROM fr) SELECT seq, frame FROM f ORDER BY (seq * 104729 + frame * 7919 + 17) % 1000003, seq, frame LIMIT 50")
def t17_sampled_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty frames of all sequences, by a seeded draw."""
    f = d.frames(spark, sf).select("seq", "frame").distinct()
    return f.orderBy((F.col("seq") * 104729 + F.col("frame") * 7919 + 17) % 1000003, "seq", "frame").limit(50)


@query(f"WITH {FR}, f AS (SELECT DISTINCT seq, frame FROM fr), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY (seq * 104729 + frame * 7919 + 29) % 1000003, frame) AS k FROM f) SELECT seq, frame FROM r WHERE k <= 20")
def t18_capped_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """At most twenty frames of every sequence, by a seeded draw."""
    f = d.frames(spark, sf).select("seq", "frame").distinct()
    w = Window.partitionBy("seq").orderBy((F.col("seq") * 104729 + F.col("frame") * 7919 + 29) % 1000003, "frame")
    return f.withColumn("k", F.row_number().over(w)).where("k <= 20").drop("k")


_STRATA = """st AS (SELECT p.pred_id, p.seq, p.frame, p.cond, CASE WHEN coalesce(m, 0) >= 0.55 THEN 'fg' WHEN coalesce(m, 0) >= 0.1 THEN 'hard' ELSE 'easy' END AS kind FROM pr p LEFT JOIN (SELECT pred_id, max(iou) AS m FROM k GROUP BY pred_id) x ON x.pred_id = p.pred_id WHERE p.seq IS NOT NULL AND p.frame IS NOT NULL AND p.cond IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY seq, frame, cond, kind ORDER BY (pred_id * 7919) % 1000003, pred_id) - 1 AS i FROM st),
n AS (SELECT seq, frame, cond, count(*) FILTER (kind = 'fg') AS fg, count(*) FILTER (kind = 'hard') AS hard, count(*) FILTER (kind = 'easy') AS easy FROM st GROUP BY ALL),
q AS (SELECT *, CASE WHEN fg = 0 THEN 0 WHEN hard + easy = 0 THEN 16 ELSE least(8, fg) END AS qf FROM n), q2 AS (SELECT *, CASE WHEN hard = 0 THEN 0 WHEN easy = 0 THEN 16 - qf ELSE least(CAST(floor((16 - qf) * 0.8) AS BIGINT), hard) END AS qh FROM q),
w AS (SELECT seq, frame, cond, 'fg' AS kind, qf AS quota, fg AS have FROM q2 UNION ALL SELECT seq, frame, cond, 'hard', qh, hard FROM q2 UNION ALL SELECT seq, frame, cond, 'easy', 16 - qf - qh, easy FROM q2 WHERE hard + easy > 0),
z AS (SELECT *, unnest(range(0, quota)) AS slot FROM w WHERE have > 0)"""


@query(f"""WITH {GT}, {PR}, {_ROI}, {_STRATA} SELECT z.seq, z.frame, z.cond, z.kind, CAST(z.slot AS INT) AS slot, r.pred_id FROM z JOIN r ON r.seq = z.seq AND r.frame = z.frame AND r.cond = z.cond AND r.kind = z.kind
AND r.i = CASE WHEN z.kind = 'fg' AND z.quota <= z.have THEN z.slot ELSE (z.slot * 7919 + z.frame * 31) % z.have END""")  # fmt: skip
def t19_region_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen regions of every frame and condition: up to half foreground without repeats, the rest four fifths hard and one fifth easy background, drawn with repeats."""
    c, key = F.col, ["seq", "frame", "cond"]
    best = _roi_pairs(spark, sf).groupBy("pred_id").agg(F.max("iou").alias("m"))
    b = d.preds(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL").select("pred_id", *key).join(best, "pred_id", "left")
    m = F.coalesce("m", F.lit(0.0))
    b = b.withColumn("kind", F.when(m >= 0.55, "fg").when(m >= 0.1, "hard").otherwise("easy")).withColumn("_d", c("pred_id") * 7919 % 1000003)
    n = b.groupBy(*key).agg(*[F.count_if(c("kind") == k).alias(k) for k in ("fg", "hard", "easy")])
    n = n.withColumn("qf", F.when(c("fg") == 0, 0).when(c("hard") + c("easy") == 0, 16).otherwise(F.least(F.lit(8), c("fg"))))
    n = n.withColumn("qh", F.when(c("hard") == 0, 0).when(c("easy") == 0, 16 - c("qf")).otherwise(F.least(F.floor((16 - c("qf")) * 0.8), c("hard"))))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), q.cast("bigint").alias("quota"), c(k).alias("have")) for k, q in (("fg", c("qf")), ("hard", c("qh")), ("easy", F.when(c("hard") + c("easy") > 0, 16 - c("qf") - c("qh")).otherwise(0)))])
    z = n.select(*key, F.explode(kinds).alias("k")).select(*key, "k.*").where("quota > 0 AND have > 0").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), c("quota") - 1)))
    at = F.when((c("kind") == "fg") & (c("quota") <= c("have")), c("slot")).otherwise((c("slot") * 7919 + c("frame") * 31) % c("have"))
    drawn = numbered(b, [*key, "kind"], ["_d", "pred_id"], "_d div 100000")
    return z.withColumn("_i", at).join(drawn, [*key, "kind", "_i"]).select(*key, "kind", c("slot").cast("int").alias("slot"), "pred_id")


@query()
def t15_sector_farthest_points(spark: SparkSession, sf: str) -> DataFrame:
    """Farthest points of every 30 degree sector of a frame's cloud, as many as its share of sixteen, rounded up, allows."""
    sector = F.floor((F.atan2("y", "x") + math.pi) / (2 * math.pi / 12)).alias("sector")
    p = d.points(spark, sf).select("frame", sector, *_PKEY, "x", "y", "z")
    n = p.groupBy("frame", "sector").agg(F.count("*").alias("n"))
    total = n.groupBy("frame").agg(F.sum("n").alias("total"))
    quota = n.join(total, "frame").select("frame", "sector", F.least("n", F.ceil(F.col("n") * 16.0 / F.col("total"))).alias("quota"))
    return farthest_sample(p.join(quota, ["frame", "sector"]), ["frame", "sector"], _PKEY, ["x", "y", "z"], F.col("quota"))


@query()
def t09_t10_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals of every frame and condition: decoded boxes above a score, suppressed class by class, the best eight, and empty places up to eight."""
    c, key = F.col, ["seq", "frame", "cond"]
    p = d.preds(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL AND cond IS NOT NULL")
    diagonal = math.hypot(_MEAN[0], _MEAN[1])  # residuals against a point and a mean size, decoded as a head gives them
    head = p.withColumns({"loc_x": (c("loc_x") / diagonal) * diagonal, "loc_z": (c("loc_z") / diagonal) * diagonal, "l": F.exp(F.log(c("l") / _MEAN[0])) * _MEAN[0], "w": F.exp(F.log(c("w") / _MEAN[1])) * _MEAN[1]})
    kept = suppressed(head.where("score > 0.1"), [*key, "cls"], "pred_id", "score", 0.1)
    best = kept.join(p.select("pred_id", "score"), "pred_id").withColumn("slot", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "pred_id"))).where("slot <= 8")
    places = p.select(*key).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return places.join(best.select(*key, "slot", "pred_id", "score"), [*key, "slot"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


# --- dedup, tables of fates, checks


@query(f"""WITH {PR}, r AS (SELECT pred_id, seq, frame, line_idx, cond, row_number() OVER (PARTITION BY seq, frame, line_idx ORDER BY cond, pred_id) AS k FROM pr WHERE seq IS NOT NULL AND frame IS NOT NULL AND line_idx IS NOT NULL AND cond IS NOT NULL) SELECT seq, frame, line_idx, cond, pred_id FROM r WHERE k = 1""")
def u05_first_condition_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that several conditions repeat: the first condition by name stays."""
    p = d.preds(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL AND line_idx IS NOT NULL AND cond IS NOT NULL")
    return p.groupBy("seq", "frame", "line_idx").agg(F.min(F.struct("cond", "pred_id")).alias("m")).select("seq", "frame", "line_idx", "m.cond", "m.pred_id")


@query(f"WITH {_ROWS} SELECT gt_id, cond, hit AS matched, round(coalesce(score, 0), 6) + 0.0 AS score FROM m")
def x01_match_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every label under every condition seen in its frame, and whether it was found."""
    rows = match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf)).where("is_tp OR is_fn")
    return rows.select("gt_id", "cond", F.col("is_tp").alias("matched"), _r("score").alias("score"))


@query(f"""WITH {_ROWS}, t AS (SELECT cond, cls, seq, is_tp, is_fn FROM rows_ WHERE NOT is_fp) SELECT cond, seq, count(*) FILTER (is_tp) AS found, count(*) FILTER (is_fn) AS missed FROM t GROUP BY ALL""")
def x02_match_table_from_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same from rows of true, false and missed detections: false ones are dropped, the others united and counted per condition and sequence."""
    rows = match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf))
    both = rows.where("is_tp").unionByName(rows.where("is_fn"))
    return both.groupBy("cond", "seq").agg(F.count_if("is_tp").alias("found"), F.count_if("is_fn").alias("missed"))


@query(f"""WITH {GT}, {PR}, a AS (SELECT seq, count(trk_id) AS g FROM gt WHERE seq IS NOT NULL GROUP BY seq), b AS (SELECT seq, count(trk_id) AS p, count(*) FILTER (is_fp IS NOT NULL) AS judged FROM pr WHERE seq IS NOT NULL GROUP BY seq)
SELECT coalesce(a.seq, b.seq) AS seq, CASE WHEN coalesce(g, 0) > 0 AND coalesce(p, 0) > 0 AND coalesce(judged, 0) > 0 THEN 'track' ELSE 'overlap' END AS backend FROM a FULL JOIN b ON a.seq = b.seq""")  # fmt: skip
def x06_backend(spark: SparkSession, sf: str) -> DataFrame:
    """How each sequence can be judged: by track ids if labels and detections have them and detections are judged, else by overlap."""
    a = d.gt(spark, sf).where("seq IS NOT NULL").groupBy("seq").agg(F.count("trk_id").alias("g"))
    b = d.preds(spark, sf).where("seq IS NOT NULL").groupBy("seq").agg(F.count("trk_id").alias("p"), F.count("is_fp").alias("judged"))
    by_track = (F.coalesce("g", F.lit(0)) > 0) & (F.coalesce("p", F.lit(0)) > 0) & (F.coalesce("judged", F.lit(0)) > 0)
    return a.join(b, "seq", "full").select("seq", F.when(by_track, "track").otherwise("overlap").alias("backend"))


@query(f"""WITH {_ROWS}, a AS (SELECT gt_id, bool_or(hit) AS b FROM m WHERE cond = 'original' GROUP BY gt_id), x AS (SELECT m.cond, m.cls, a.b, m.hit FROM a JOIN m ON m.gt_id = a.gt_id WHERE m.cond <> 'original')
SELECT cond, cls, count(*) AS total, count(*) FILTER (b) AS found_before, count(*) FILTER (hit) AS found_after, true AS adds_up FROM x GROUP BY ALL""")  # fmt: skip
def a07_counts_add_up(spark: SparkSession, sf: str) -> DataFrame:
    """Transition counts whose parts are checked to add up to the total; otherwise the query fails."""
    rates = checked_transitions(transition_rates(match_rows_by_track(d.gt(spark, sf), d.preds(spark, sf)).where("is_tp OR is_fn"), ["cls"], clean="original"))
    c = F.col
    return rates.select("cond", "cls", "total", (c("stable") + c("induced_miss")).alias("found_before"), (c("stable") + c("induced_recovery")).alias("found_after"), (c("total") >= 0).alias("adds_up"))


@query(f"""WITH {PR} SELECT cond, count(*) AS n, count(DISTINCT seq) AS seqs, true AS near FROM pr WHERE cond IS NOT NULL GROUP BY cond""")
def a44_approximate_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Exact distinct counts per condition, and whether the sketch and the approximate median stand within their bounds of the exact ones."""
    p = d.preds(spark, sf).where("cond IS NOT NULL")
    n = p.groupBy("cond").agg(
        F.count("*").alias("n"), F.countDistinct("seq").alias("seqs"), F.approx_count_distinct("seq", 0.02).alias("about"), F.percentile_approx("score", 0.5, 10_000).alias("mid"),
    )
    low = p.join(n.select("cond", "mid"), "cond").groupBy("cond").agg(F.avg((F.col("score") <= F.col("mid")).cast("int")).alias("share"))
    near = (F.abs(F.col("about") - F.col("seqs")) <= F.greatest(F.lit(2.0), 0.1 * F.col("seqs"))) & (F.coalesce("share", F.lit(0.5)) >= 0.49)
    return n.join(low, "cond").select("cond", "n", "seqs", near.alias("near"))


@query(f"""WITH {GT}, {PR}, a AS ({_AL.format(id='gt_id', extra='', tab='gt')}), b AS ({_AL.format(id='pred_id', extra='is_fp, trk_id,', tab="pr")}),
j AS (SELECT gt_id, pred_id, is_fp, trk_id, greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.z1,b.z1)-greatest(a.z0,b.z0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0) AS i,
 (a.x1-a.x0)*(a.z1-a.z0)*(a.y1-a.y0) AS va, (b.x1-b.x0)*(b.z1-b.z0)*(b.y1-b.y0) AS vb FROM a JOIN b ON a.seq = b.seq AND a.frame = b.frame),
k AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY round(i/(va+vb-i), 6) DESC, pred_id) AS n FROM j WHERE i/(va+vb-i) > 0.01)
SELECT gt.gt_id, CASE WHEN k.gt_id IS NULL THEN 'R' WHEN k.is_fp THEN 'L' ELSE 'R' END AS available, k.trk_id AS revised_track FROM gt LEFT JOIN k ON k.gt_id = gt.gt_id AND n = 1""")  # fmt: skip
def x10_revised_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the new version take visibility and track of the old box (here: detections) they overlap most, above 0.01; without one they stay visible."""
    keys = ["seq", "frame"]
    a = _aligned(d.gt(spark, sf), "a", "gt_id", keys)
    b = _aligned(d.preds(spark, sf), "b", "pred_id", keys, ["is_fp", "trk_id"])
    near = overlapping_pairs(a, b, keys, ["ax0", "ax1", "az0", "az1"], ["bx0", "bx1", "bz0", "bz1"], 8.0).withColumn("iou", aligned_iou("a", "b")).where("iou > 0.01")
    best = near.groupBy("gt_id").agg(F.min(F.struct((-_r("iou")).alias("n"), "pred_id", "is_fp", "trk_id")).alias("m"))
    out = a.select("gt_id").join(best, "gt_id", "left")
    return out.select("gt_id", F.when(F.coalesce("m.is_fp", F.lit(False)), "L").otherwise("R").alias("available"), F.col("m.trk_id").alias("revised_track"))


@query()
def j12_x12_rebuilt_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Object ids rebuilt in two stages.

    A: labels in line order each take the first free record of their frame and class that agrees in seven rounded dimensions
    within 5 mm; a label with a further free one is ambiguous. B: detections, best scores first, take the free label of
    their class of the largest rotated BEV overlap strictly above 0.5 and with it the rebuilt track; the others are false.
    """
    c, dims, keys = F.col, ["h", "w", "l", "loc_x", "loc_y", "loc_z", "rot_y"], ["seq", "frame", "cls"]
    known = "seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL"
    base = d.gt(spark, sf, once=False).where(known).select("gt_id", "line_idx", *keys, *dims, "trk_id")
    found = d.preds(spark, sf, once=False).where(known).where("cond IS NOT NULL")
    found = found.select("pred_id", *keys, "cond", F.coalesce("score", F.lit(0.0)).alias("score"), "line_idx", "loc_x", "loc_z", "l", "w", "rot_y")
    lines = {"a" + k: F.round(k, 2) for k in dims}
    records = {"b" + k: F.round(c(k) + c("_id") % 2 * 0.001, 2) for k in dims}
    out = rebuilt(base, found, dims, records, lines)
    return out.select("pred_id", "cond", "gt_id", "track", "ambiguous", c("gt_id").isNull().alias("is_false"))


# --- grids and outliers


@query(f"""WITH {PT}, j AS (SELECT a.ok, a.ln, a.pk, a.sk, a.frame, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist, row_number() OVER (PARTITION BY a.frame, a.ok, a.ln, a.pk, a.sk ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.ok, b.ln, b.pk, b.sk) AS k
FROM pt a JOIN pt b ON a.frame = b.frame AND NOT (a.ok = b.ok AND a.ln = b.ln AND a.pk = b.pk AND a.sk = b.sk) AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 400),
m AS (SELECT frame, ok, ln, pk, sk, avg(dist) AS d FROM j WHERE k <= 5 GROUP BY ALL), s AS (SELECT frame, avg(d) + 2 * stddev_samp(d) AS lim FROM m GROUP BY frame)
SELECT m.frame, count(*) AS judged, count(*) FILTER (round(d, 9) <= round(lim, 9)) AS kept FROM m JOIN s ON s.frame = m.frame GROUP BY m.frame""")  # fmt: skip
def r09_statistical_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Points kept by the statistical filter: mean distance of the five nearest points at most two deviations above the frame's mean."""
    key = ["ok", "ln", "pk", "sk"]
    near = near_rows(d.framed_points(spark, sf, *key, "x", "y", "z"), "frame", key, ["x", "y", "z"], 20.0, 5, [], closed=True, others=True)
    m = near.select("frame", (F.aggregate("near", F.lit(0.0), lambda s, b: s + F.sqrt(b["d2"])) / F.size("near")).alias("d"))
    of = m.groupBy("frame").agg((F.avg("d") + 2 * F.stddev_samp("d")).alias("lim"), F.collect_list("d").alias("_d"))  # a frame is one scan
    return of.select("frame", F.size("_d").cast("bigint").alias("judged"), F.size(F.filter("_d", lambda v: F.round(v, 9) <= F.round("lim", 9))).cast("bigint").alias("kept"))


@query(f"""WITH {PT}, f AS (SELECT DISTINCT frame FROM pt), r AS (SELECT frame, u, v, dep FROM f, (SELECT unnest(range(0, 4)) AS u), (SELECT unnest(range(0, 3)) AS v), (SELECT unnest([5, 20, 60]) AS dep))
SELECT frame, CAST(u AS INT) AS u, CAST(v AS INT) AS v, CAST(dep AS DOUBLE) AS dep, round(dep + 0.1 * (frame % 7), 6) + 0.0 AS x, round(-((u * 400 + 40) - 640) * dep / 800.0, 6) + 0.0 AS y, round(-((v * 300 + 60) - 360) * dep / 820.0, 6) + 0.0 AS z FROM r""")  # fmt: skip
def g17_camera_frustum(spark: SparkSession, sf: str) -> DataFrame:
    """Camera frustum of every frame: image cells at several depths taken back through the intrinsics and the frame's own shift into the sensor's frame."""
    c = F.col
    grid = d.points(spark, sf).select("frame").distinct()
    for n, values in (("u", range(4)), ("v", range(3)), ("dep", (5.0, 20.0, 60.0))):
        grid = grid.withColumn(n, F.explode(F.array(*map(F.lit, values))))
    x, y, z = g.back_projected(c("u") * 400 + 40, c("v") * 300 + 60, c("dep"), 800.0, 820.0, 640.0, 360.0)
    return grid.select("frame", "u", "v", "dep", _r(x + 0.1 * (c("frame") % 7)).alias("x"), _r(y).alias("y"), _r(z).alias("z"))


@query(f"""WITH {PT}, s AS (SELECT frame, ok, ln, pk, sk, CAST(power AS DECIMAL(18,2)) AS p, CAST(floor(x / 10) AS BIGINT) AS vx, CAST(floor((y + 16) / 8) AS BIGINT) AS vy FROM pt)
SELECT frame, vx, vy, count(*) AS n, CAST(sum(p) AS DOUBLE) AS power FROM s GROUP BY ALL""")  # fmt: skip
def a30_interval_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of intervals: running sums along the sorted cells, the last of each interval less the last of the one before."""
    c, cell = F.col, ["vx", "vy"]
    s = d.points(spark, sf).select("frame", *_PKEY, F.floor(c("x") / 10).alias("vx"), F.floor((c("y") + 16) / 8).alias("vy"), c("power").cast("decimal(18,2)").alias("p"))
    run = Window.partitionBy("frame").orderBy(*cell, *_PKEY).rowsBetween(Window.unboundedPreceding, 0)  # a frame is one scan
    last = s.withColumn("_sum", F.sum("p").over(run)).withColumn("_no", F.count("*").over(run)).groupBy("frame", *cell).agg(F.max_by("_sum", "_no").alias("_sum"), F.max("_no").alias("_no"))
    before = Window.partitionBy("frame").orderBy(*cell)
    zero = F.lit(0).cast("decimal(28,2)")
    return last.select("frame", *cell, (c("_no") - F.coalesce(F.lag("_no").over(before), F.lit(0))).alias("n"), (c("_sum") - F.coalesce(F.lag("_sum").over(before), zero)).cast("double").alias("power"))
