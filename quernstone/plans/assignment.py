"""Queries that assign anchors, regions and labels, count recall, and compare box overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import geometry as g
from quernstone.operators.blocks import running_sums
from quernstone.operators.matching import bev, bev_candidates, greedy_pairs
from quernstone.operators.spatial import overlapping_pairs, within_radius
from quernstone.plans import domain as d
from quernstone.plans.boxes import _AL, _aligned, aligned_iou
from quernstone.plans.domain import GT, PR, Catalogue

query = Catalogue()


def _r(c, n: int = 6):
    return F.round(c, n)


# --- anchors: a grid of boxes of several sizes every 2 m, enumerated around the labels they can touch

_STEP = 2.0
_SIZES = ((4.5, 1.9), (8.0, 2.5), (0.8, 0.8))  # length, width
_AL_, _AW_ = _SIZES[0]


def _anchor_sql(x0: str, x1: str, z0: str, z1: str, kinds: str) -> str:
    return f"""a AS (SELECT gt_id, seq, frame, loc_x, loc_z, l, w, kind, al, aw FROM gt, {kinds} WHERE seq IS NOT NULL AND frame IS NOT NULL AND isfinite(loc_x) AND isfinite(loc_z) AND isfinite(l) AND isfinite(w)),
b0 AS (SELECT *, CAST(unnest(range(CAST({x0} AS BIGINT), CAST({x1} AS BIGINT) + 1)) AS BIGINT) AS ix FROM a),
b AS (SELECT *, CAST(unnest(range(CAST({z0} AS BIGINT), CAST({z1} AS BIGINT) + 1)) AS BIGINT) AS iz FROM b0),
c AS (SELECT *, (ix + 0.5) * {_STEP} AS cx, (iz + 0.5) * {_STEP} AS cz FROM b),
i AS (SELECT *, greatest(least(loc_x + w/2, cx + aw/2) - greatest(loc_x - w/2, cx - aw/2), 0) * greatest(least(loc_z + l/2, cz + al/2) - greatest(loc_z - l/2, cz - al/2), 0) AS common FROM c),
p AS (SELECT gt_id, seq, frame, kind, ix, iz, cx, cz, loc_x, loc_z, l, w, round(common / (l*w + al*aw - common), 9) AS iou, round((cx-loc_x)*(cx-loc_x) + (cz-loc_z)*(cz-loc_z), 9) AS d2 FROM i)"""


_KINDS = "(VALUES " + ", ".join(f"({i}, {al}, {aw})" for i, (al, aw) in enumerate(_SIZES)) + ") k(kind, al, aw)"
_TOUCH_SQL = _anchor_sql(*[f"floor(({v} {sign} {size}/2 {sign} {a}/2) / {_STEP}{off})" for v, size, a in (("loc_x", "w", "aw"), ("loc_z", "l", "al")) for sign, off in (("-", " - 0.5"), ("+", ""))], _KINDS)
_NEAR_SQL = _anchor_sql(*[f"floor({v} / {_STEP}) {off}" for v in ("loc_x", "loc_z") for off in ("- 2", "+ 2")], f"(VALUES (0, {_AL_}, {_AW_})) k(kind, al, aw)")


def _anchor_pairs(spark: SparkSession, sf: str, touching: bool) -> DataFrame:
    """Labels with grid anchors, their unrotated BEV overlap and squared distance.

    ``touching``: all anchors of every size that a label's own extent can touch; otherwise the 5 by 5 anchors of the first
    size around its centre, among which its nine nearest always are.
    """
    c = F.col
    finite = [F.abs(c(k)) < F.lit(float("inf")) for k in ("loc_x", "loc_z", "l", "w")]
    gt = d.gt(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL").where(finite[0] & finite[1] & finite[2] & finite[3])
    kinds = _SIZES if touching else _SIZES[:1]
    gt = gt.select("gt_id", "seq", "frame", "loc_x", "loc_z", "l", "w", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(al).alias("al"), F.lit(aw).alias("aw")) for i, (al, aw) in enumerate(kinds)])).alias("k"))
    gt = gt.select("gt_id", "seq", "frame", "loc_x", "loc_z", "l", "w", "k.*")
    for i, v, size, a in (("ix", "loc_x", "w", "aw"), ("iz", "loc_z", "l", "al")):
        if touching:
            half = c(size) / 2 + c(a) / 2
            span = F.sequence(F.floor((c(v) - half) / _STEP - 0.5), F.floor((c(v) + half) / _STEP))
        else:
            span = F.sequence(F.floor(c(v) / _STEP) - 2, F.floor(c(v) / _STEP) + 2)
        gt = gt.withColumn(i, F.explode(span))
    p = gt.withColumn("cx", (c("ix") + 0.5) * _STEP).withColumn("cz", (c("iz") + 0.5) * _STEP)
    common = g.overlap(c("loc_x") - c("w") / 2, c("loc_x") + c("w") / 2, c("cx") - c("aw") / 2, c("cx") + c("aw") / 2) * g.overlap(
        c("loc_z") - c("l") / 2, c("loc_z") + c("l") / 2, c("cz") - c("al") / 2, c("cz") + c("al") / 2
    )
    d2 = (c("cx") - c("loc_x")) * (c("cx") - c("loc_x")) + (c("cz") - c("loc_z")) * (c("cz") - c("loc_z"))
    return p.withColumn("iou", _r(g.iou(common, c("l") * c("w"), c("al") * c("aw")), 9)).withColumn("d2", _r(d2, 9))


@query(f"""WITH {GT}, {_TOUCH_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY seq, frame, kind, ix, iz ORDER BY iou DESC, gt_id) AS ka, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, kind, ix, iz) AS kg FROM p WHERE iou > 0)
SELECT seq, frame, CAST(kind AS INT) AS kind, ix, iz, CASE WHEN count(*) FILTER (kg = 1) > 0 THEN min(gt_id) FILTER (kg = 1) ELSE max(gt_id) FILTER (ka = 1) END AS gt_id,
CASE WHEN count(*) FILTER (kg = 1) > 0 OR max(iou) >= 0.6 THEN 1 WHEN max(iou) < 0.45 THEN 0 ELSE -1 END AS label FROM m GROUP BY ALL""")  # fmt: skip
def j25_g18_anchor_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors that touch a label: positive from 0.6 overlap or as a label's best, negative below 0.45, else ignored."""
    m = _anchor_pairs(spark, sf, touching=True).where("iou > 0")
    m = m.withColumn("ka", F.row_number().over(Window.partitionBy("seq", "frame", "kind", "ix", "iz").orderBy(F.desc("iou"), "gt_id")))
    m = m.withColumn("kg", F.row_number().over(Window.partitionBy("gt_id").orderBy(F.desc("iou"), "kind", "ix", "iz")))
    forced = F.min(F.when(F.col("kg") == 1, F.col("gt_id")))
    return m.groupBy("seq", "frame", "kind", "ix", "iz").agg(
        F.coalesce(forced, F.max(F.when(F.col("ka") == 1, F.col("gt_id")))).alias("gt_id"),
        F.when(forced.isNotNull() | (F.max("iou") >= 0.6), 1).when(F.max("iou") < 0.45, 0).otherwise(-1).alias("label"),
    )


@query(f"""WITH {GT}, {_NEAR_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY d2, ix, iz) AS k FROM p),
t AS (SELECT gt_id, round(avg(iou) + stddev_samp(iou), 9) AS thr FROM k WHERE k <= 9 GROUP BY gt_id)
SELECT k.gt_id, count(*) AS candidates, count(*) FILTER (iou >= thr AND abs(cx - loc_x) <= w/2 AND abs(cz - loc_z) <= l/2) AS positives, round(max(thr), 6) + 0.0 AS thr FROM k JOIN t ON t.gt_id = k.gt_id WHERE k <= 9 GROUP BY k.gt_id""")  # fmt: skip
def j26_adaptive_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Adaptive anchor selection: of a label's nine nearest anchors those above mean + deviation whose centre it holds."""
    c = F.col
    w = Window.partitionBy("gt_id").orderBy("d2", "ix", "iz")
    k = _anchor_pairs(spark, sf, touching=False).withColumn("k", F.row_number().over(w)).where("k <= 9")
    thr = k.groupBy("gt_id").agg(_r(F.avg("iou") + F.stddev_samp("iou"), 9).alias("thr"))
    good = (c("iou") >= c("thr")) & (F.abs(c("cx") - c("loc_x")) <= c("w") / 2) & (F.abs(c("cz") - c("loc_z")) <= c("l") / 2)
    return k.join(thr, "gt_id").groupBy("gt_id").agg(F.count("*").alias("candidates"), F.count_if(good).alias("positives"), _r(F.max("thr")).alias("thr"))


_ROI = f"""a AS ({_AL.format(id='pred_id', extra='cls, cond,', tab='pr')}), b AS ({_AL.format(id='gt_id', extra='cls,', tab='gt')}),
j AS (SELECT pred_id, gt_id, cond, greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0)*greatest(least(a.z1,b.z1)-greatest(a.z0,b.z0),0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0) AS i,
 (a.x1-a.x0)*(a.z1-a.z0)*(a.y1-a.y0) AS va, (b.x1-b.x0)*(b.z1-b.z0)*(b.y1-b.y0) AS vb FROM a JOIN b ON a.seq = b.seq AND a.frame = b.frame AND a.cls = b.cls AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.z0 <= b.z1 AND b.z0 <= a.z1),
k AS (SELECT pred_id, gt_id, cond, round(i/(va+vb-i), 6) AS iou FROM j)"""


def _roi_pairs(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["seq", "frame", "cls"]
    a = _aligned(d.preds(spark, sf), "a", "pred_id", keys, ["cond"])
    b = _aligned(d.gt(spark, sf), "b", "gt_id", keys)
    return overlapping_pairs(a, b, keys, ["ax0", "ax1", "az0", "az1"], ["bx0", "bx1", "bz0", "bz1"], 8.0).withColumn("iou", _r(aligned_iou("a", "b")))


@query(f"""WITH {GT}, {PR}, {_ROI}, r AS (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY iou DESC, gt_id) AS n FROM k WHERE iou > 0)
SELECT p.pred_id, r.gt_id, coalesce(r.iou, 0) AS iou, CASE WHEN r.iou >= 0.55 THEN 'foreground' WHEN r.iou >= 0.1 THEN 'hard' ELSE 'easy' END AS kind FROM pr p LEFT JOIN r ON r.pred_id = p.pred_id AND n = 1""")  # fmt: skip
def j28_t19_region_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Detections with the label of their class they overlap most, and whether that makes them foreground."""
    best = _roi_pairs(spark, sf).where("iou > 0").groupBy("pred_id").agg(F.min(F.struct((-F.col("iou")).alias("n"), "gt_id")).alias("m"))
    all_ = d.preds(spark, sf).select("pred_id").join(best, "pred_id", "left")
    iou = F.coalesce(-F.col("m.n"), F.lit(0.0))
    return all_.select("pred_id", "m.gt_id", iou.alias("iou"), F.when(iou >= 0.55, "foreground").when(iou >= 0.1, "hard").otherwise("easy").alias("kind"))


@query(f"""WITH {GT}, {PR}, {_ROI}, m AS (SELECT gt_id, cond, max(iou) AS iou FROM k WHERE cond IS NOT NULL GROUP BY ALL)
SELECT cond, t AS threshold, (SELECT count(*) FROM gt) AS labels, count(*) FILTER (iou > t) AS recalled FROM m, (SELECT unnest([0.1, 0.3, 0.5, 0.7])::DOUBLE AS t) GROUP BY ALL""")  # fmt: skip
def a20_recall_by_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Labels recalled under every condition by detections of their class above each overlap threshold."""
    best = _roi_pairs(spark, sf).where("cond IS NOT NULL").groupBy("gt_id", "cond").agg(F.max("iou").alias("iou"))
    t = F.explode(F.array(*[F.lit(v) for v in (0.1, 0.3, 0.5, 0.7)]))
    hits = best.withColumn("threshold", t).groupBy("cond", "threshold").agg(F.count_if(F.col("iou") > F.col("threshold")).alias("recalled"))
    return hits.select("cond", "threshold", d.gt(spark, sf).agg(F.count("*")).scalar().alias("labels"), "recalled")


@query(f"""WITH {GT}, {PR}, {_ROI}, e AS (SELECT j.*, va + vb - i AS u FROM j), f AS (SELECT a.pred_id, b.gt_id, (greatest(a.x1,b.x1)-least(a.x0,b.x0))*(greatest(a.z1,b.z1)-least(a.z0,b.z0))*(greatest(a.y1,b.y1)-least(a.y0,b.y0)) AS hull,
 power((a.x0+a.x1-b.x0-b.x1)/2, 2) + power((a.z0+a.z1-b.z0-b.z1)/2, 2) + power((a.y0+a.y1-b.y0-b.y1)/2, 2) AS c2,
 power(greatest(a.x1,b.x1)-least(a.x0,b.x0), 2) + power(greatest(a.z1,b.z1)-least(a.z0,b.z0), 2) + power(greatest(a.y1,b.y1)-least(a.y0,b.y0), 2) AS d2 FROM a JOIN b ON a.seq = b.seq AND a.frame = b.frame AND a.cls = b.cls)
SELECT e.pred_id, e.gt_id, round(i/u - (hull - u)/hull, 6) + 0.0 AS giou, round(i/u - c2/d2, 6) + 0.0 AS diou FROM e JOIN f ON f.pred_id = e.pred_id AND f.gt_id = e.gt_id""")  # fmt: skip
def g08_generalised_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Generalised and distance overlap of touching detections and labels of one class, axis-aligned."""
    c = F.col
    hull, c2, d2, common, va, vb = F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for k in "xzy":
        lo, hi = F.least(c(f"a{k}0"), c(f"b{k}0")), F.greatest(c(f"a{k}1"), c(f"b{k}1"))
        gap = (c(f"a{k}0") + c(f"a{k}1") - c(f"b{k}0") - c(f"b{k}1")) / 2
        hull, d2, c2 = hull * (hi - lo), d2 + (hi - lo) * (hi - lo), c2 + gap * gap
        common = common * g.overlap(c(f"a{k}0"), c(f"a{k}1"), c(f"b{k}0"), c(f"b{k}1"))
        va, vb = va * (c(f"a{k}1") - c(f"a{k}0")), vb * (c(f"b{k}1") - c(f"b{k}0"))
    union = va + vb - common
    return _roi_pairs(spark, sf).select("pred_id", "gt_id", _r(common / union - (hull - union) / hull).alias("giou"), _r(common / union - c2 / d2).alias("diou"))


@query()
def j15_score_driven_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Labels in line order each take the free detection of the highest score that overlaps them by more than 0.3."""
    keys = ["seq", "frame", "cls"]
    known = "seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL"
    a = bev(d.gt(spark, sf).where(known), "a", "gt_id", keys, [F.col("line_idx")])
    b = bev(d.preds(spark, sf).where(known).where("cond IS NOT NULL"), "b", "pred_id", keys, [F.col("cond"), F.coalesce("score", F.lit(0.0)).alias("score")])
    pairs = bev_candidates(a, b, keys).where("iou > 0.3")
    return greedy_pairs(pairs, [*keys, "cond"], "gt_id", "pred_id", [F.asc("line_idx")], [F.desc("score")]).select("gt_id", "pred_id", "cond")


_LBL = "lb AS (SELECT gt_id AS lid, seq, frame, cls, round(h, 2) + (gt_id % 3) * 0.001 AS h, w, l, loc_x + (gt_id % 2) * 0.001 AS loc_x, loc_y, loc_z, rot_y, trk_id FROM gt)"


@query(f"""WITH {GT}, {_LBL}, j AS (SELECT g.gt_id, lb.lid, lb.trk_id FROM gt g JOIN lb ON g.seq = lb.seq AND g.frame = lb.frame AND g.cls = lb.cls AND abs(g.h - lb.h) < 0.005 AND abs(g.w - lb.w) < 0.005
AND abs(g.l - lb.l) < 0.005 AND abs(g.loc_x - lb.loc_x) < 0.005 AND abs(g.loc_y - lb.loc_y) < 0.005 AND abs(g.loc_z - lb.loc_z) < 0.005 AND abs(g.rot_y - lb.rot_y) < 0.005)
SELECT gt.gt_id, count(lid) AS candidates, min(lid) AS first_candidate, count(lid) > 1 AS ambiguous FROM gt LEFT JOIN j ON j.gt_id = gt.gt_id GROUP BY ALL""")  # fmt: skip
def j12_tolerance_join(spark: SparkSession, sf: str) -> DataFrame:
    """Labels rejoined to slightly shifted copies of themselves by seven dimensions within 5 mm, with an ambiguity flag."""
    dims = ["h", "w", "l", "loc_x", "loc_y", "loc_z", "rot_y"]
    keys = ["seq", "frame", "cls"]
    base = d.gt(spark, sf)
    a = base.select("gt_id", *keys, *[F.col(k).alias("a" + k) for k in dims])
    b = base.withColumn("h", F.round("h", 2) + F.col("gt_id") % 3 * 0.001).withColumn("loc_x", F.col("loc_x") + F.col("gt_id") % 2 * 0.001)
    b = b.select(F.col("gt_id").alias("lid"), *keys, *[F.col(k).alias("b" + k) for k in dims])
    near = within_radius(a, b, keys, ["aloc_x", "aloc_z"], ["bloc_x", "bloc_z"], 0.0075)
    for k in dims:
        near = near.where(F.abs(F.col("a" + k) - F.col("b" + k)) < 0.005)
    n = near.groupBy("gt_id").agg(F.count("*").alias("candidates"), F.min("lid").alias("first_candidate"))
    return base.select("gt_id").join(n, "gt_id", "left").select(
        "gt_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), "first_candidate", (F.coalesce("candidates", F.lit(0)) > 1).alias("ambiguous")
    )


@query(f"""WITH {GT}, c AS (SELECT gt_id, seq, frame, cls, CAST(floor(loc_x) AS BIGINT) + dx AS cx, CAST(floor(loc_z) AS BIGINT) + dz AS cz, exp(-(power(CAST(floor(loc_x) AS BIGINT) + dx + 0.5 - loc_x, 2) + power(CAST(floor(loc_z) AS BIGINT) + dz + 0.5 - loc_z, 2)) / 2) AS v
FROM gt, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dz) WHERE seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL)
SELECT seq, frame, cls, cx, cz, round(max(v), 6) + 0.0 AS heat FROM c GROUP BY ALL""")  # fmt: skip
def g15_heat_map(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussian heat map of the labels of every frame and class on a 1 m grid; where objects overlap the maximum stays."""
    c = F.col
    near = F.array(*[F.lit(i) for i in range(-2, 3)])
    p = d.gt(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL")
    p = p.withColumn("dx", F.explode(near)).withColumn("dz", F.explode(near)).withColumn("cx", F.floor("loc_x") + c("dx")).withColumn("cz", F.floor("loc_z") + c("dz"))
    v = F.exp(-(F.pow(c("cx") + 0.5 - c("loc_x"), 2) + F.pow(c("cz") + 0.5 - c("loc_z"), 2)) / 2)
    return p.groupBy("seq", "frame", "cls", "cx", "cz").agg(_r(F.max(v)).alias("heat"))


@query(f"""WITH {PR}, k AS (SELECT *, row_number() OVER (PARTITION BY seq, frame, cond, cls ORDER BY score DESC, pred_id) AS a FROM pr WHERE score IS NOT NULL AND seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL AND cls IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY seq, frame, cond ORDER BY score DESC, pred_id) AS b FROM k WHERE a <= 4) SELECT pred_id, CAST(b AS INT) AS place FROM m WHERE b <= 6""")  # fmt: skip
def t03_t04_two_stage_top(spark: SparkSession, sf: str) -> DataFrame:
    """The six best of the four best detections of each class, per frame and condition."""
    p = d.preds(spark, sf).where("score IS NOT NULL AND seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL AND cls IS NOT NULL")
    order = (F.desc("score"), F.asc("pred_id"))
    k = p.withColumn("a", F.row_number().over(Window.partitionBy("seq", "frame", "cond", "cls").orderBy(*order))).where("a <= 4")
    return k.withColumn("place", F.row_number().over(Window.partitionBy("seq", "frame", "cond").orderBy(*order))).where("place <= 6").select("pred_id", "place")


@query(f"""WITH {PR}, k AS (SELECT cond, count(*) AS n, round(avg(score), 6) + 0.0 AS mean_score FROM pr WHERE cond IS NOT NULL GROUP BY cond), o AS (SELECT n AS base FROM k WHERE cond = 'original'),
c AS (SELECT cond, cls, count(*) AS m FROM pr WHERE cond IS NOT NULL AND cls IS NOT NULL GROUP BY ALL), t AS (SELECT cond, arg_max(cls, (m, cls)) AS top_class FROM c GROUP BY cond)
SELECT k.cond, n, mean_score, n - base AS delta, top_class FROM k JOIN t ON t.cond = k.cond, o""")  # fmt: skip
def a19_condition_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Detections, mean score and change against the clean run per condition, with the most frequent class."""
    p = d.preds(spark, sf).where("cond IS NOT NULL")
    k = p.groupBy("cond").agg(F.count("*").alias("n"), _r(F.avg("score")).alias("mean_score"))
    base = k.where("cond = 'original'").agg(F.max("n")).scalar()
    top = p.where("cls IS NOT NULL").groupBy("cond", "cls").agg(F.count("*").alias("m")).groupBy("cond").agg(F.max_by("cls", F.struct("m", "cls")).alias("top_class"))
    return k.join(top, "cond").select("cond", "n", "mean_score", (F.col("n") - base).alias("delta"), "top_class")


@query(f"""WITH {GT}, {PR} SELECT 'gt' AS kind, seq, frame, NULL::VARCHAR AS cond, cls, gt_id AS id, NULL::DOUBLE AS score FROM gt UNION ALL BY NAME SELECT 'pred' AS kind, seq, frame, cond, cls, pred_id AS id, score FROM pr""")
def u01_u02_fact_union(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and detections in one table; columns that one side lacks are null."""
    a = d.gt(spark, sf).select(F.lit("gt").alias("kind"), "seq", "frame", "cls", F.col("gt_id").alias("id"))
    b = d.preds(spark, sf).select(F.lit("pred").alias("kind"), "seq", "frame", "cond", "cls", F.col("pred_id").alias("id"), "score")
    return a.unionByName(b, allowMissingColumns=True)


@query(f"""WITH {PR}, c AS (SELECT DISTINCT seq, frame, cond FROM pr WHERE seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL) SELECT seq, count(*) AS frame_conditions, count(DISTINCT cond) AS conditions FROM c GROUP BY seq""")
def u04_a39_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct frames by condition and exact numbers of conditions per sequence."""
    c = d.preds(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL").select("seq", "frame", "cond").distinct()
    return c.groupBy("seq").agg(F.count("*").alias("frame_conditions"), F.countDistinct("cond").alias("conditions"))


@query(f"""WITH {GT} SELECT gt_id FROM gt WHERE (gt_id * 7919 + 17) % 1000 < 100""")
def t16_t18_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A reproducible tenth of the labels."""
    return d.gt(spark, sf).where((F.col("gt_id") * 7919 + 17) % 1000 < 100).select("gt_id")


@query(f"""WITH {GT} SELECT seq, frame, count(*) AS boxes, max(count(*)) OVER (PARTITION BY seq) AS padded, CAST(sum(count(*)) OVER (PARTITION BY seq ORDER BY frame ROWS UNBOUNDED PRECEDING) - count(*) AS BIGINT) AS start
FROM gt WHERE seq IS NOT NULL AND frame IS NOT NULL GROUP BY seq, frame""")  # fmt: skip
def a36_ragged_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Ragged batches of a sequence: boxes per frame, start offset and padded size."""
    n = d.gt(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL").groupBy("seq", "frame").agg(F.count("*").alias("boxes"))
    widest = n.groupBy("seq").agg(F.max("boxes").alias("padded"))
    upto = running_sums(n, ["seq"], ["frame"], "frame div 4096", {"upto": "boxes"})
    return upto.join(widest, "seq").select("seq", "frame", "boxes", "padded", (F.col("upto") - F.col("boxes")).alias("start"))


@query(f"""WITH {GT}, e AS (SELECT gt_id, unnest([0, 1, 2]) AS level, h * 25 AS height, CASE WHEN ambiguous THEN 1 ELSE 0 END AS occluded, (gt_id % 10) / 20.0::DOUBLE AS truncated FROM gt)
SELECT level, count(*) FILTER (occluded <= level AND truncated <= [0.15, 0.3, 0.5][level + 1] AND height > [40, 25, 25][level + 1]) AS counted, count(*) AS labels FROM e GROUP BY level""")  # fmt: skip
def x08_difficulty_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that count at each difficulty level by height, occlusion and truncation."""
    e = d.gt(spark, sf).select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(t).alias("t"), F.lit(m).alias("m")) for i, (t, m) in enumerate(((0.15, 40), (0.3, 25), (0.5, 25)))])).alias("e"),
        (F.col("h") * 25).alias("height"), F.coalesce(F.col("ambiguous").cast("int"), F.lit(0)).alias("occluded"), (F.col("gt_id") % 10 / 20.0).alias("truncated"),
    )
    counts = (F.col("occluded") <= F.col("e.level")) & (F.col("truncated") <= F.col("e.t")) & (F.col("height") > F.col("e.m"))
    return e.groupBy("e.level").agg(F.count_if(counts).alias("counted"), F.count("*").alias("labels"))
