"""Camera, range, polygon and assignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import geometry as g
from quernstone.operators.blocks import numbered
from quernstone.operators.matching import chained, suppressed
from quernstone.operators.radar import interpolated
from quernstone.operators.rivals import nearest_assignment
from quernstone.plans import domain as d
from quernstone.plans.domain import CE, GT, PR, PT, Catalogue
from quernstone.session import table

query = Catalogue()
_KEY = ["ok", "ln", "pk", "sk", "power"]
_K = ", ".join(_KEY)


def _r(c, n: int = 6):
    return F.round(c, n)


_M = g.camera_matrix(800.0, 820.0, 640.0, 360.0, g.extrinsic(-90.0, 1.5, -89.0, 0.1, -0.4, 0.3))


def _dot(m: list[float], x: str, y: str, z: str) -> str:
    return f"({m[0]!r}*({x}) + {m[1]!r}*({y}) + {m[2]!r}*({z}) + {m[3]!r})"


_U, _V, _D = (_dot(m, "x", "y", "z") for m in _M)


@query(f"WITH {PT} SELECT {_K}, round({_U}/{_D}, 5) + 0.0::DOUBLE AS px, round({_V}/{_D}, 5) + 0.0::DOUBLE AS py FROM pt WHERE {_D} > 0.5 AND {_U}/{_D} BETWEEN 0 AND 1279 AND {_V}/{_D} BETWEEN 0 AND 719")
def m19_m20_f20_points_on_image(spark: SparkSession, sf: str) -> DataFrame:
    """Points projected through intrinsics and an extrinsic of fixed-axis angles, those in front and on the image."""
    u, v, dep = g.projected(F.col("x"), F.col("y"), F.col("z"), _M)
    return d.points(spark, sf).where((dep > 0.5) & u.between(0, 1279) & v.between(0, 719)).select(*_KEY, F.round(u, 5).alias("px"), F.round(v, 5).alias("py"))


_C5, _S5 = repr(0.9961946980917455), repr(0.08715574274765817)


@query(f"""WITH {PT}, a AS (SELECT {_K}, 704 - (pk % 1280) * 0.55::DOUBLE AS u, (sk % 720) * 0.55::DOUBLE - 140 AS v FROM pt)
SELECT {_K}, round({_C5}::DOUBLE*(u - 352) + {_S5}::DOUBLE*(v - 128) + 352, 6) + 0.0 AS u, round({_C5}::DOUBLE*(v - 128) - {_S5}::DOUBLE*(u - 352) + 128, 6) + 0.0 AS v FROM a""")  # fmt: skip
def m21_image_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels after resize, crop, mirror and a rotation of five degrees."""
    u, v = g.image_transformed((F.col("pk") % 1280).cast("double"), (F.col("sk") % 720).cast("double"), 0.55, (0.0, 140.0), 704.0, True, 5.0, (352.0, 128.0))
    return d.points(spark, sf).select(*_KEY, _r(u).alias("u"), _r(v).alias("v"))


_CORNERS = """c AS (SELECT gt_id, loc_z + sx*l/2*cos(rot_y) - sy*w/2*sin(rot_y) AS x, -loc_x + sx*l/2*sin(rot_y) + sy*w/2*cos(rot_y) AS y, -loc_y + sz*h/2 AS z
FROM gt, (SELECT unnest([1, -1]) AS sx), (SELECT unnest([1, -1]) AS sy), (SELECT unnest([1, -1]) AS sz))"""


def _corners(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return d.gt(spark, sf).select("gt_id", g.box_corners(c("loc_z"), -c("loc_x"), -c("loc_y"), c("l"), c("w"), c("h"), c("rot_y")).alias("corners"))


@query(f"""WITH {GT}, {_CORNERS}, q AS (SELECT gt_id, {_U} AS u, {_V} AS v, {_D} AS dep FROM c)
SELECT gt_id, round(greatest(0, min(u/dep)), 4) + 0.0 AS x0, round(least(1279, max(u/dep)), 4) + 0.0 AS x1, round(greatest(0, min(v/dep)), 4) + 0.0 AS y0, round(least(719, max(v/dep)), 4) + 0.0 AS y1 FROM q GROUP BY gt_id HAVING min(dep) > 0""")  # fmt: skip
def m23_image_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Image box of every label all of whose corners lie in front of the camera, clipped to the image."""
    def seen(p):
        u, v, dep = g.projected(p["x"], p["y"], p["z"], _M)
        return F.struct(u.alias("u"), v.alias("v"), dep.alias("dep"))

    s = _corners(spark, sf).withColumn("s", F.transform("corners", seen)).where(F.array_min("s.dep") > 0)
    return s.select(
        "gt_id", F.round(F.greatest(F.lit(0.0), F.array_min("s.u")), 4).alias("x0"), F.round(F.least(F.lit(1279.0), F.array_max("s.u")), 4).alias("x1"),
        F.round(F.greatest(F.lit(0.0), F.array_min("s.v")), 4).alias("y0"), F.round(F.least(F.lit(719.0), F.array_max("s.v")), 4).alias("y1"),
    )


@query(f"WITH {GT}, {_CORNERS} SELECT gt_id, count(*) FILTER (x BETWEEN 0 AND 60 AND y BETWEEN -8 AND 8) AS inside FROM c GROUP BY gt_id HAVING count(*) FILTER (x BETWEEN 0 AND 60 AND y BETWEEN -8 AND 8) >= 4")
def f12_boxes_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with at least four corners inside the range."""
    inside = F.size(F.filter("corners", lambda p: p["x"].between(0, 60) & p["y"].between(-8, 8))).cast("bigint")
    return _corners(spark, sf).select("gt_id", inside.alias("inside")).where("inside >= 4")


@query("""SELECT event_type, count(*) AS n, round(sum(value * CAST(json_extract(props, '$.k') AS BIGINT)) / sum(CAST(json_extract(props, '$.k') AS BIGINT)), 6) + 0.0 AS weighted_mean FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL""")
def m32_a38_weighted_means(spark: SparkSession, sf: str) -> DataFrame:
    """Running-average meter: values weighted by the count in a JSON field."""
    k = F.from_json("props", "k bigint")["k"]
    e = table(spark, sf, "events").withColumn("k", k).where("k IS NOT NULL")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), _r(F.sum(F.col("value") * F.col("k")) / F.sum("k")).alias("weighted_mean"))


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS line FROM events")
def k05_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON texts."""
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("line"))


_POLY = [(5.0, -9.0), (40.0, -12.0), (62.0, 1.0), (30.0, 4.0), (45.0, 13.0), (8.0, 10.0)]
_CROSS = " + ".join(
    f"CAST(y > {min(y1, y2)} AND y <= {max(y1, y2)} AND x <= (y - ({y1})) * {x2 - x1} / {y2 - y1} + {x1} AS INT)" for (x1, y1), (x2, y2) in zip(_POLY, _POLY[1:] + _POLY[:1])
)


@query(f"WITH {PT} SELECT frame, count(*) FILTER (({_CROSS}) % 2 = 1) AS inside, count(*) AS n FROM pt GROUP BY frame")
def g11_points_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """Points inside a polygon that is not convex, per frame."""
    return d.points(spark, sf).groupBy("frame").agg(F.count_if(g.in_polygon(F.col("x"), F.col("y"), _POLY)).alias("inside"), F.count("*").alias("n"))


@query(f"""WITH {CE}, cube AS (SELECT frame, ri, ai, ei, avg(p) AS p FROM ce GROUP BY ALL), w AS (SELECT DISTINCT CAST(floor(l_orderkey / 256) AS BIGINT) AS frame, l_partkey AS k FROM lineitem),
spots AS (SELECT frame, k, (k * 7 % 300) / 10.37::DOUBLE AS x, (k * 11 % 140) / 10.37::DOUBLE AS y, 1 + (k * 13 % 50) / 9.91::DOUBLE AS z FROM w),
c AS (SELECT frame, k, CAST(floor(x) AS INT) + dx AS ri, CAST(floor(y) AS INT) + dy AS ai, CAST(floor(z) AS INT) + dz AS ei, abs(1 - dx - (x - floor(x))) * abs(1 - dy - (y - floor(y))) * abs(1 - dz - (z - floor(z))) AS wt
FROM spots, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz))
SELECT c.frame, k, round(sum(wt * coalesce(p, 0)), 3) + 0.0 AS p FROM c LEFT JOIN cube ON cube.frame = c.frame AND cube.ri = c.ri AND cube.ai = c.ai AND cube.ei = c.ei GROUP BY c.frame, k""")  # fmt: skip
def g13_trilinear(spark: SparkSession, sf: str) -> DataFrame:
    """Trilinear samples of a frame's power cube at the position of every row."""
    k = F.col("k")
    cube = d.cells(spark, sf).groupBy("frame", "ri", "ai", "ei").agg(F.avg("p").alias("p"))
    at = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 256).alias("frame"), F.col("l_partkey").alias("k")).distinct()
    at = at.select("frame", "k", (k * 7 % 300 / 10.37).alias("x"), (k * 11 % 140 / 10.37).alias("y"), (1 + k * 13 % 50 / 9.91).alias("z"))
    return interpolated(cube, at, ["ri", "ai", "ei"], ["x", "y", "z"], ["p"], ["k"], ["frame"]).select("frame", "k", F.round("p", 3).alias("p"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE k = 1""")
def u05_u06_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Of repeated keys the latest record stays."""
    last = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(last.alias("m")).select("o_custkey", "m.*")


@query(f"""WITH {PT}, s AS (SELECT frame, ok, ln, pk, sk, power, CAST(unnest(range(0, 4)) AS INT) AS part FROM pt) SELECT {_K}, part, pk % 64 * 4 + part AS fine, round(0.1 + (pk % 64) * 0.25 + part / 4.0 * 0.25, 6) + 0.0 AS metre FROM s""")
def m37_supersampled_axis(spark: SparkSession, sf: str) -> DataFrame:
    """Range cells of all points split into four."""
    s = d.points(spark, sf).select(*_KEY, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    return s.select(*_KEY, "part", (F.col("pk") % 64 * 4 + F.col("part")).alias("fine"), _r(0.1 + F.col("pk") % 64 * 0.25 + F.col("part") / 4.0 * 0.25).alias("metre"))


def _known(spark: SparkSession, sf: str, once: bool = True) -> DataFrame:
    return d.preds(spark, sf, once).where("seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL AND cond IS NOT NULL")


@query()
def t06_aligned_nms(spark: SparkSession, sf: str) -> DataFrame:
    """Detections left by axis-aligned suppression in every frame, condition and class."""
    return suppressed(_known(spark, sf, once=False), ["seq", "frame", "cond", "cls"], "pred_id", "score", 0.1, by="aligned").select("pred_id")


@query()
def t08_circle_nms(spark: SparkSession, sf: str) -> DataFrame:
    """Detections left by circle suppression (squared centre distance of at most 4)."""
    return suppressed(_known(spark, sf, once=False), ["seq", "frame", "cond", "cls"], "pred_id", "score", 4.0, by="circle").select("pred_id")


@query()
def j27_cheapest_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and detections of a frame and condition assigned at least total distance, pairs within 10 m and one class."""
    keys = ["seq", "frame", "cls"]
    found = _known(spark, sf, once=False).select(*keys, "cond", "pred_id", "loc_x", "loc_z")
    gt = d.gt(spark, sf, once=False).where("seq IS NOT NULL AND frame IS NOT NULL AND cls IS NOT NULL").select(*keys, "gt_id", "loc_x", "loc_z")
    return nearest_assignment(gt, found, 10.0, 1000.0).select("gt_id", "cond", "pred_id", _r("cost").alias("cost"))


@query()
def w12_q07_object_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of a track that overlap the last one kept of it in the BEV plane."""
    c = F.col
    gt = d.gt(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL AND trk_id IS NOT NULL")
    boxes = gt.select(
        "seq", "trk_id", "frame", "gt_id", (c("loc_x") - c("l") / 2).alias("x0"), (c("loc_x") + c("l") / 2).alias("x1"), (c("loc_z") - c("l") / 2).alias("y0"), (c("loc_z") + c("l") / 2).alias("y1")
    )
    return chained(boxes, ["seq", "trk_id"], ["frame", "gt_id"], 0.01).select("gt_id", "seq", "trk_id", "frame")


@query(f"""WITH {d.FR}, f AS (SELECT DISTINCT seq, frame FROM fr), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame) AS k FROM f) SELECT seq, frame FROM r WHERE k <= 10""")
def t02_first_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten frames of every sequence."""
    f = d.frames(spark, sf).select("seq", "frame").distinct()
    return f.withColumn("k", F.row_number().over(Window.partitionBy("seq").orderBy("frame"))).where("k <= 10").drop("k")


@query(f"WITH {PT} SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY (ok * 7919 + ln * 104729 + pk * 1299709) % 1000003, {_K}) AS INT) AS place, ok, ln, pk, sk FROM pt")
def t21_shuffled_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of every frame in a reproducible shuffled order."""
    draw = (F.col("ok") * 7919 + F.col("ln") * 104729 + F.col("pk") * 1299709) % 1000003
    p = numbered(d.points(spark, sf).withColumn("draw", draw), ["frame"], ["draw", *_KEY], "draw div 100000")
    return p.select("frame", (F.col("_i") + 1).cast("int").alias("place"), "ok", "ln", "pk", "sk")
