"""Queries over radar points and cubes derived from the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import geometry as g
from quernstone.operators import corruption as n
from quernstone.operators.radar import above_quantile, ca_cfar, framed_ca_cfar, framed_os_cfar, framed_sidelobe_filter, interpolated, offsets_around
from quernstone.plans import domain as d
from quernstone.plans.domain import CE, PT, Catalogue
from quernstone.session import table

query = Catalogue()


def _r(c, n: int = 6):
    return F.round(c, n)


def _total(c: str, places: int = 2):
    """Sum of a money column in exact decimals, as a double."""
    return F.sum(F.col(c).cast(f"decimal(18,{places})")).cast("double")


@query(f"WITH {PT} SELECT frame, count(*) AS n, CAST(sum(CAST(power AS DECIMAL(18,2))) AS DOUBLE) AS power FROM pt WHERE x > 5 AND x < 60 AND y > -10 AND y < 10 AND z > -2 AND z < 4 GROUP BY frame")
def f01_point_roi(spark: SparkSession, sf: str) -> DataFrame:
    """Points strictly inside the region of interest, per frame."""
    p = d.points(spark, sf).where("x > 5 AND x < 60 AND y > -10 AND y < 10 AND z > -2 AND z < 4")
    return p.groupBy("frame").agg(F.count("*").alias("n"), _total("power").alias("power"))


@query(f"""WITH {PT}, v AS (SELECT *, sqrt(x*x + y*y + z*z) AS rng FROM pt WHERE x > 0 AND x < 72 AND y > -16 AND y < 16 AND z > -2 AND z < 6 AND degrees(atan2(y, x)) BETWEEN -50 AND 50),
b AS (SELECT *, CAST(floor(rng / 10) AS BIGINT) AS bin FROM v), q AS (SELECT bin, quantile_cont(power, 0.9) AS q FROM b GROUP BY bin)
SELECT bin, flag, count(*) AS n, round(CAST(sum(CAST(power AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) + 0.0 AS mean_power, max(power) AS max_power FROM b JOIN q USING (bin) WHERE power > q GROUP BY ALL""")  # fmt: skip
def range_bin_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: points in ROI and field of view, the strongest tenth of each range bin, by bin and class."""
    p = d.points(spark, sf).where("x > 0 AND x < 72 AND y > -16 AND y < 16 AND z > -2 AND z < 6")
    p = p.where(g.azimuth(F.col("x"), F.col("y")).between(-50, 50))
    rng, _, _ = g.xyz_to_polar(F.col("x"), F.col("y"), F.col("z"))
    p = p.select("flag", "power", F.floor(rng / 10).alias("bin"))
    return above_quantile(p, ["bin"], "power", 0.1, bounded=False).groupBy("bin", "flag").agg(
        F.count("*").alias("n"), F.round(_total("power") / F.count("*"), 4).alias("mean_power"), F.max("power").alias("max_power")
    )


@query(f"WITH {PT} SELECT count(*) AS n, count(*) FILTER (abs(x - 30) > 5 OR abs(y) > 2) AS kept FROM pt")
def f08_self_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Points kept when returns of the vehicle itself are removed."""
    return d.points(spark, sf).agg(F.count("*").alias("n"), F.count_if((F.abs(F.col("x") - 30) > 5) | (F.abs("y") > 2)).alias("kept"))


@query(f"""WITH {PT}, ax AS (SELECT ri AS i, ri * 0.46 + 0.1 AS v FROM (SELECT DISTINCT pk % 32 AS ri FROM pt)),
b AS (SELECT min_by(i, (abs(v - 3.0), i)) AS lo, min_by(i, (abs(v - 9.0), i)) AS hi FROM ax) SELECT pk % 32 AS ri, count(*) AS n FROM pt, b WHERE pk % 32 BETWEEN lo AND hi GROUP BY ALL""")  # fmt: skip
def f09_axis_roi(spark: SparkSession, sf: str) -> DataFrame:
    """Cells between the axis indices nearest to two bounds, both included; ties to the lower index."""
    p = d.points(spark, sf).withColumn("ri", F.col("pk") % 32)
    axis = p.select("ri").distinct().withColumn("v", F.col("ri") * 0.46 + 0.1)
    lo, hi = (axis.agg(F.min_by("ri", F.struct(F.abs(F.col("v") - b), F.col("ri")))).scalar() for b in (3.0, 9.0))
    return p.where(F.col("ri").between(lo, hi)).groupBy("ri").agg(F.count("*").alias("n"))


@query(f"""WITH {PT} SELECT ok, ln, pk, sk, round(sqrt(x*x + y*y + z*z), 6) + 0.0 AS rng, round(atan2(y, x), 6) + 0.0 AS az, round(asin(z / sqrt(x*x + y*y + z*z)), 6) + 0.0 AS el,
CAST(greatest(0, least(106, round_even((degrees(atan2(y, x)) + 53) / 1.0, 0))) AS INT) AS az_index FROM pt""")  # fmt: skip
def m04_m05_polar(spark: SparkSession, sf: str) -> DataFrame:
    """Polar coordinates of every point and its azimuth cell."""
    rng, az, el = g.xyz_to_polar(F.col("x"), F.col("y"), F.col("z"))
    return d.points(spark, sf).select("ok", "ln", "pk", "sk", _r(rng).alias("rng"), _r(az).alias("az"), _r(el).alias("el"), g.quantized(F.degrees(az), -53, 1.0, 107).alias("az_index"))


@query(f"""WITH {CE} SELECT frame, di, ri, ai, ei, round((0.46*ri + 1) * cos(-radians(ei*2 - 7)) * cos(-radians(ai*6 - 48)), 6) + 0.0 AS x, round((0.46*ri + 1) * cos(-radians(ei*2 - 7)) * sin(-radians(ai*6 - 48)), 6) + 0.0 AS y,
round((0.46*ri + 1) * sin(-radians(ei*2 - 7)), 6) + 0.0 AS z, round(10 * log10(p), 6) + 0.0 AS db, round(p * power(0.46*ri + 1, 2.2) / 2e6, 4) + 0.0 AS compensated FROM ce""")  # fmt: skip
def m03_m11_m13_cells_in_space(spark: SparkSession, sf: str) -> DataFrame:
    """Cell centres in metres, power in decibels and range-compensated power."""
    rng = F.lit(0.46) * F.col("ri") + 1
    x, y, z = g.polar_to_xyz(rng, F.radians(F.col("ai") * 6 - 48), F.radians(F.col("ei") * 2 - 7))
    return d.cells(spark, sf).select("frame", "di", "ri", "ai", "ei", _r(x).alias("x"), _r(y).alias("y"), _r(z).alias("z"), _r(g.decibel(F.col("p"))).alias("db"),
                                     F.round(F.col("p") * F.pow(rng, F.lit(2.2)) / 2e6, 4).alias("compensated"))


@query(f"""WITH {PT} SELECT frame, CAST(ceil((x - 0) / 5.0) AS INT) - 1 AS up, CAST(greatest(0, least(13, floor(x / 5.0))) AS INT) AS down, CAST(trunc((y + 16) / 0.5) AS INT) AS pixel,
count(*) AS n FROM pt GROUP BY ALL""")  # fmt: skip
def m07_m08_m10_voxel_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Voxel indices by rounding up, by rounding down with clamping, and raster indices by truncation."""
    p = d.points(spark, sf).select("frame", g.voxel_ceil(F.col("x"), 0, 5.0).alias("up"), g.voxel_floor(F.col("x"), 0, 5.0, 14).alias("down"), g.pixel_index(F.col("y"), -16, 0.5).alias("pixel"))
    return p.groupBy("frame", "up", "down", "pixel").agg(F.count("*").alias("n"))


_DOP = f"""SELECT frame, ri, ai, ei, round(avg(p), 6) + 0.0 AS mean_power, round(sum(p * (di * 0.5 - 1.75)) / sum(p), 6) + 0.0 AS expected, max_by(di, (p, -di)) AS strongest,
CAST(floor(sum(p * di) / sum(p)) AS INT) AS expected_index FROM ce WHERE di > 0 GROUP BY ALL"""


@query(f"WITH {CE} {_DOP}")
def a21_a24_doppler(spark: SparkSession, sf: str) -> DataFrame:
    """Mean power, expected and strongest Doppler of every polar cell; Doppler bin 0 is dropped."""
    p, di = F.col("p"), F.col("di")
    return d.cells(spark, sf).where("di > 0").groupBy("frame", "ri", "ai", "ei").agg(
        _r(F.avg("p")).alias("mean_power"), _r(F.sum(p * (di * 0.5 - 1.75)) / F.sum("p")).alias("expected"), F.max_by("di", F.struct(p, -di)).alias("strongest"),
        F.floor(F.sum(p * di) / F.sum("p")).cast("int").alias("expected_index"),
    )


@query(f"WITH {CE} SELECT frame, ri, ai, round(avg(nullif(CASE WHEN di = 3 THEN -1 ELSE p END, -1)), 6) + 0.0 AS mean_power, count(*) AS cells FROM ce GROUP BY ALL")
def a25_r11_bev_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Range-azimuth mean over known cells; -1 is unknown."""
    p = F.when(F.col("di") == 3, -1.0).otherwise(F.col("p"))
    return d.cells(spark, sf).groupBy("frame", "ri", "ai").agg(_r(F.avg(F.nullif(p, F.lit(-1.0)))).alias("mean_power"), F.count("*").alias("cells"))


@query(f"WITH {CE}, q AS (SELECT frame, quantile_cont(p, 0.95) AS q FROM ce GROUP BY frame) SELECT ce.frame, di, ri, ai, ei, p FROM ce JOIN q ON q.frame = ce.frame WHERE p > q")
def t11_r06_top_power(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest twentieth of the cells of every frame."""
    return above_quantile(d.cells(spark, sf), ["frame"], "p", 0.05)


@query(f"WITH {CE}, q AS (SELECT frame, ri, quantile_cont(p, 0.9) AS q FROM ce GROUP BY ALL) SELECT ce.frame, di, ce.ri, ai, ei, p FROM ce JOIN q ON q.frame = ce.frame AND q.ri = ce.ri WHERE p > q")
def t12_r08_top_power_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest tenth of the cells of every range bin of a frame."""
    return above_quantile(d.cells(spark, sf), ["frame", "ri"], "p", 0.1).select("frame", "di", "ri", "ai", "ei", "p")


@query(f"WITH {PT}, q AS (SELECT quantile_cont(power, 0.99) AS q FROM pt) SELECT ok, ln, pk, sk, power FROM pt, q WHERE power > q")
def t13_top_of_cloud(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest hundredth of the whole cloud of all frames."""
    return above_quantile(d.points(spark, sf), [], "power", 0.01, bounded=False).select("ok", "ln", "pk", "sk", "power")


_CUBE = f"{CE}, cube AS (SELECT frame, ri, ai, ei, avg(p) AS p FROM ce GROUP BY ALL), marked AS (SELECT * REPLACE (CASE WHEN (ri * 7 + ai) % 13 = 0 THEN -1 ELSE p END AS p) FROM cube)"
_AX, _SIZES, _GUARD, _TRAIN = ["ri", "ai", "ei"], [32, 16, 8], (1, 1, 0), (1, 1, 1)
_OFF = ", ".join(map(str, offsets_around(_GUARD, _TRAIN)))
_N = len(offsets_around(_GUARD, _TRAIN))
_ALPHA = repr(_N * (0.05 ** (-1.0 / _N) - 1))


def _cube(spark: SparkSession, sf: str) -> DataFrame:
    return d.cells(spark, sf).groupBy("frame", *_AX).agg(F.avg("p").alias("p"))


def _marked(cube: DataFrame) -> DataFrame:
    return cube.withColumn("p", F.when((F.col("ri") * 7 + F.col("ai")) % 13 == 0, -1.0).otherwise(F.col("p")))


def _refl(c: str, s: int) -> str:
    return f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} >= {s} THEN {2 * (s - 1)} - ({c}) ELSE {c} END"


@query(f"""WITH {_CUBE}, l AS (SELECT frame, coalesce(sum(p) FILTER (p <> -1), 0) / count(*) AS l FROM marked GROUP BY frame), c AS (SELECT m.*, CASE WHEN p = -1 THEN l ELSE p END AS t FROM marked m JOIN l ON l.frame = m.frame),
o AS (SELECT * FROM (VALUES {_OFF}) v(dr, da, de)), asked AS MATERIALIZED (SELECT frame, ri, ai, ei, {_refl('ri + dr', 32)} AS ur, {_refl('ai + da', 16)} AS ua, {_refl('ei + de', 8)} AS ue FROM c CROSS JOIN o),
m AS (SELECT q.frame, q.ri, q.ai, q.ei, sum(u.t) / {_N} AS mean FROM asked q JOIN c u ON u.frame = q.frame AND u.ri = q.ur AND u.ai = q.ua AND u.ei = q.ue GROUP BY ALL)
SELECT c.frame, c.ri, c.ai, c.ei, round(coalesce(mean, 0), 6) + 0.0 AS mean, p <> -1 AND t > coalesce(mean, 0) * {_ALPHA} AS detected FROM c LEFT JOIN m ON m.frame = c.frame AND m.ri = c.ri AND m.ai = c.ai AND m.ei = c.ei""")  # fmt: skip
def r01_ca_cfar_mirror(spark: SparkSession, sf: str) -> DataFrame:
    """Cell-averaging CFAR in the (range, azimuth, elevation) cube of every frame, edges mirrored, unknown cells at the cube's mean."""
    return ca_cfar(_marked(_cube(spark, sf)), _AX, _SIZES, "p", _GUARD, _TRAIN, 0.05, "mirror", ["frame"], -1.0).select("frame", *_AX, _r("mean").alias("mean"), "detected")


@query(f"""WITH {_CUBE}, o AS (SELECT * FROM (VALUES {_OFF}) v(dr, da, de)), m AS (SELECT c.frame, c.ri, c.ai, c.ei, sum(coalesce(t.p, 0)) / {_N} AS mean FROM cube c CROSS JOIN o
LEFT JOIN cube t ON t.frame = c.frame AND t.ri = c.ri + dr AND t.ai = c.ai + da AND t.ei = c.ei + de GROUP BY ALL)
SELECT c.frame, c.ri, c.ai, c.ei, round(mean, 6) + 0.0 AS mean, p > mean * {_ALPHA} AS detected FROM cube c JOIN m ON m.frame = c.frame AND m.ri = c.ri AND m.ai = c.ai AND m.ei = c.ei""")  # fmt: skip
def r02_ca_cfar_zero(spark: SparkSession, sf: str) -> DataFrame:
    """The same with zeros beyond the edges and no unknown cells."""
    return framed_ca_cfar(d.framed_cube(spark, sf).where("frame IS NOT NULL").dropna(subset=_AX), "frame", _AX, "p", _GUARD, _TRAIN, 0.05).select("frame", *_AX, _r("mean").alias("mean"), "detected")


@query(f"""WITH {_CUBE}, o AS (SELECT * FROM (VALUES {_OFF}) v(dr, da, de)), m AS (SELECT c.frame, c.ri, c.ai, c.ei, quantile_cont(t.p, 0.75) AS level FROM marked c CROSS JOIN o
JOIN marked t ON t.frame = c.frame AND t.ri = c.ri + dr AND t.ai = c.ai + da AND t.ei = c.ei + de AND t.p <> -1 GROUP BY ALL)
SELECT c.frame, c.ri, c.ai, c.ei, round(level, 6) + 0.0 AS level, coalesce(c.ri BETWEEN 2 AND 29 AND c.ai BETWEEN 2 AND 13 AND c.ei BETWEEN 1 AND 6 AND p <> -1 AND p > level, false) AS detected
FROM marked c LEFT JOIN m ON m.frame = c.frame AND m.ri = c.ri AND m.ai = c.ai AND m.ei = c.ei""")  # fmt: skip
def r03_os_cfar(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered-statistic CFAR in the cube of every frame: the local quantile leaves out the guard and unknown cells."""
    return framed_os_cfar(_marked(d.framed_cube(spark, sf)), "frame", _AX, _SIZES, "p", _GUARD, _TRAIN, 0.75).select("frame", *_AX, _r("level").alias("level"), "detected")


@query(f"""WITH {_CUBE}, o AS (SELECT * FROM (VALUES {_OFF}) v(dr, da, de)), m AS (SELECT c.frame, c.ri, c.ai, c.ei, any_value(c.p) AS p, sum(coalesce(t.p, 0)) / {_N} AS mean FROM cube c CROSS JOIN o
LEFT JOIN cube t ON t.frame = c.frame AND t.ri = c.ri + dr AND t.ai = c.ai + da AND t.ei = c.ei + de GROUP BY ALL), pts AS (SELECT frame, ri, ai, ei, p * (20 - 2 * abs(ei - 2)) AS w FROM m WHERE p > mean * {_ALPHA}),
ra AS (SELECT frame, ri, ai, sum(w) AS w FROM pts GROUP BY ALL), fullrow AS (SELECT frame, ri, unnest(range(0, 16)) AS ai FROM (SELECT DISTINCT frame, ri FROM ra)),
q AS (SELECT f.frame, f.ri, quantile_cont(coalesce(w, 0), 0.9) AS q FROM fullrow f LEFT JOIN ra ON ra.frame = f.frame AND ra.ri = f.ri AND ra.ai = f.ai GROUP BY ALL),
k AS (SELECT ra.frame, ra.ri, ra.ai FROM ra JOIN q ON q.frame = ra.frame AND q.ri = ra.ri WHERE q > 0 AND w > q)
SELECT frame, ri, ai, ei, CAST(EXISTS (SELECT 1 FROM k WHERE k.frame = pts.frame AND k.ri = pts.ri AND k.ai = pts.ai) AS INT) AS kept_os,
CAST(EXISTS (SELECT 1 FROM k WHERE k.frame = pts.frame AND k.ri BETWEEN pts.ri - 2 AND pts.ri + 2 AND k.ai BETWEEN pts.ai - 1 AND pts.ai + 1) AS INT) AS kept_padded FROM pts""")  # fmt: skip
def r04_sidelobe_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Two-stage sidelobe filter of every frame: CA-CFAR, height-weighted range-azimuth sums, quantile per range row, widened cells."""
    return framed_sidelobe_filter(d.framed_cube(spark, sf), "frame", _SIZES, "p", 20 - 2 * F.abs(F.col("ei") - 2), _GUARD, _TRAIN, 0.05, 0.1, (2, 1))


#: Axis, its cell, the two coordinates of its lines, and its size.
_LINES = {
    "range": ("pk % 32", "ok % 16", "ln", 32),
    "x": ("floor(x / 2.2)", "floor((y + 16) / 8)", "ln", 33),
    "y": ("floor(y + 16)", "floor(x / 20)", "ln", 32),
    "z": ("ln", "floor(x / 20)", "floor((y + 16) / 8)", 8),
}
_ALPHA4 = repr(4 * (0.05**-0.25 - 1))
_LINE_SQL = " UNION ALL ".join(
    f"SELECT '{axis}' AS axis, CAST(floor(ok / 256) AS BIGINT) AS frame, CAST({a} AS INT) AS a, CAST({b} AS INT) AS b, CAST({i} AS INT) AS i, CAST(sum(CAST(power AS DECIMAL(18,2))) AS DOUBLE) AS p FROM pt GROUP BY ALL"
    for axis, (i, a, b, _) in _LINES.items()
)


@query(f"""WITH {PT}, c AS ({_LINE_SQL}), o AS (SELECT unnest([-3, -2, 2, 3]) AS s), m AS (SELECT c.axis, c.frame, c.a, c.b, c.i, any_value(c.p) AS p, sum(coalesce(t.p, 0)) / 4 AS mean
FROM c CROSS JOIN o LEFT JOIN c t ON t.axis = c.axis AND t.frame = c.frame AND t.a = c.a AND t.b = c.b AND t.i = c.i + s GROUP BY ALL)
SELECT axis, frame, a, b, i, round(mean, 4) + 0.0 AS mean, p > mean * {_ALPHA4} AS detected FROM m""")  # fmt: skip
def r05_w14_range_cfar(spark: SparkSession, sf: str) -> DataFrame:
    """One-dimensional CFAR along range, x, y and z of every frame: two training cells behind one guard cell on both sides, zeros beyond the ends."""
    out = None
    for axis, (i, a, b, size) in _LINES.items():
        line = d.points(spark, sf).selectExpr("cast(floor(ok / 256) as bigint) frame", f"cast({a} as int) a", f"cast({b} as int) b", f"cast({i} as int) i", "power")
        line = line.groupBy("frame", "a", "b", "i").agg(_total("power").alias("p"))
        found = ca_cfar(line, ["i"], [size], "p", (1,), (2,), 0.05, "zero", ["frame", "a", "b"])
        found = found.select(F.lit(axis).alias("axis"), "frame", "a", "b", "i", F.round("mean", 4).alias("mean"), "detected")
        out = found if out is None else out.unionByName(found)
    return out


_RA = f"{CE}, ra AS (SELECT frame, ri, ai, avg(p) AS p FROM ce GROUP BY ALL)"


@query(f"""WITH {_RA}, m AS (SELECT a.frame, a.ri, a.ai, max(b.p) AS top FROM ra a JOIN ra b ON a.frame = b.frame AND abs(a.ri - b.ri) <= 1 AND abs(a.ai - b.ai) <= 1 GROUP BY ALL)
SELECT ra.frame, ra.ri, ra.ai, round(p, 6) + 0.0 AS p FROM ra JOIN m ON m.frame = ra.frame AND m.ri = ra.ri AND m.ai = ra.ai WHERE p = top""")  # fmt: skip
def w13_local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that are the maximum of their 3 by 3 neighbourhood in their frame."""
    ra = d.cells(spark, sf).groupBy("frame", "ri", "ai").agg(F.avg("p").alias("p"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    top = ra.withColumn("s", F.explode(steps)).groupBy("frame", (F.col("ri") + F.col("s.i")).alias("ri"), (F.col("ai") + F.col("s.j")).alias("ai")).agg(F.max("p").alias("top"))
    return ra.join(top, ["frame", "ri", "ai"]).where("p = top").select("frame", "ri", "ai", _r("p").alias("p"))


@query(f"WITH {PT} SELECT frame, pk % 16 AS ai, ln AS ei, round(min(sqrt(x*x + y*y + z*z)), 6) + 0.0 AS first_return, round(max(sqrt(x*x + y*y + z*z)), 6) + 0.0 AS last_return FROM pt GROUP BY ALL")
def w09_r10_first_returns(spark: SparkSession, sf: str) -> DataFrame:
    """First and last return along every ray."""
    rng, _, _ = g.xyz_to_polar(F.col("x"), F.col("y"), F.col("z"))
    return d.points(spark, sf).groupBy("frame", (F.col("pk") % 16).alias("ai"), F.col("ln").alias("ei")).agg(_r(F.min(rng)).alias("first_return"), _r(F.max(rng)).alias("last_return"))


@query(f"WITH {PT}, {CE} SELECT ok, ln, pk, sk, coalesce(c.p, -1) AS cell_power FROM pt LEFT JOIN ce c ON c.frame = floor(ok / 256) AND c.di = pt.sk % 8 AND c.ri = (pt.pk + 1) % 32 AND c.ai = pt.ok % 16 AND c.ei = pt.ln")
def j24_cell_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Power of the neighbouring polar cell of every sparse point, -1 if unknown."""
    p = d.points(spark, sf).selectExpr("ok", "ln", "pk", "sk", "cast(floor(ok / 256) as bigint) frame", "cast(sk % 8 as int) di", "cast((pk + 1) % 32 as int) ri", "cast(ok % 16 as int) ai", "cast(ln as int) ei")
    return p.join(d.cells(spark, sf), ["frame", "di", "ri", "ai", "ei"], "left").select("ok", "ln", "pk", "sk", F.coalesce("p", F.lit(-1.0)).alias("cell_power"))


_VOX = "CAST(floor(x / 10) AS BIGINT) AS vx, CAST(floor((y + 16) / 8) AS BIGINT) AS vy"
_ORD = "ok, ln, pk, sk, power"


@query(f"""WITH {PT}, r AS (SELECT *, {_VOX}, row_number() OVER (PARTITION BY frame, floor(x / 10), floor((y + 16) / 8) ORDER BY {_ORD}) AS k FROM pt)
SELECT frame, vx, vy, count(*) AS n, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(power), 4) + 0.0 AS power, max(power) AS max_power FROM r WHERE k <= 4 GROUP BY ALL""")  # fmt: skip
def a26_a28_voxel_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and maximum of the first four points of every voxel, in the order of the points' keys."""
    p = d.points(spark, sf).withColumn("vx", F.floor(F.col("x") / 10)).withColumn("vy", F.floor((F.col("y") + 16) / 8))
    w = Window.partitionBy("frame", "vx", "vy").orderBy("ok", "ln", "pk", "sk", "power")
    return p.withColumn("k", F.row_number().over(w)).where("k <= 4").groupBy("frame", "vx", "vy").agg(
        F.count("*").alias("n"), _r(F.avg("x")).alias("x"), _r(F.avg("y")).alias("y"), F.round(F.avg("power"), 4).alias("power"), F.max("power").alias("max_power")
    )


@query(f"WITH {PT} SELECT frame, {_VOX}, CAST(sum(CAST(power AS DECIMAL(18,2))) AS DOUBLE) AS power FROM pt GROUP BY ALL")
def a29_a30_bev_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the power of every BEV cell."""
    p = d.points(spark, sf).withColumn("vx", F.floor(F.col("x") / 10)).withColumn("vy", F.floor((F.col("y") + 16) / 8))
    return p.groupBy("frame", "vx", "vy").agg(_total("power").alias("power"))


@query(f"WITH {PT} SELECT CASE WHEN power < 1000 THEN 0 WHEN power >= 100000 THEN 101 ELSE CAST(floor((power - 1000) / 990) AS BIGINT) + 1 END AS bucket, count(*) AS n FROM pt GROUP BY ALL")
def a37_power_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of power in 100 equal buckets."""
    b = F.when(F.col("power") < 1000, 0).when(F.col("power") >= 100000, 101).otherwise(F.floor((F.col("power") - 1000) / 990) + 1)
    return d.points(spark, sf).groupBy(b.cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {PT} SELECT frame, CAST(pk % 64 AS BIGINT) AS u, CAST(trunc((z + 2) * 4) AS BIGINT) AS v, arg_max(x, ({_ORD})) AS depth FROM pt GROUP BY ALL")
def a43_depth_map(spark: SparkSession, sf: str) -> DataFrame:
    """Depth raster in which the last point in key order wins."""
    order = F.struct("ok", "ln", "pk", "sk", "power")
    return d.points(spark, sf).groupBy("frame", (F.col("pk") % 64).alias("u"), ((F.col("z") + 2) * 4).cast("bigint").alias("v")).agg(F.max_by("x", order).alias("depth"))


@query(f"""WITH {CE}, ra AS (SELECT frame, ri, ai, avg(p) AS p, CAST(count(*) AS DOUBLE) AS hits FROM ce GROUP BY ALL), w AS (SELECT DISTINCT CAST(floor(l_orderkey / 256) AS BIGINT) AS frame, l_partkey AS k FROM lineitem),
s AS (SELECT frame, k, (k * 7 % 300) / 10.37::DOUBLE AS x, (k * 11 % 140) / 10.37::DOUBLE AS y FROM w),
c AS (SELECT frame, k, CAST(floor(x) AS INT) + dx AS ri, CAST(floor(y) AS INT) + dy AS ai, abs(1 - dx - (x - floor(x))) * abs(1 - dy - (y - floor(y))) AS wt FROM s, (VALUES (0,0),(0,1),(1,0),(1,1)) v(dx, dy))
SELECT c.frame, c.k, round(sum(wt * coalesce(ra.p, 0)), 4) + 0.0 AS p, round(sum(wt * coalesce(ra.hits, 0)), 6) + 0.0 AS hits FROM c LEFT JOIN ra ON ra.frame = c.frame AND ra.ri = c.ri AND ra.ai = c.ai GROUP BY c.frame, c.k""")  # fmt: skip
def g12_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    """Bilinear samples of the features of a frame's range-azimuth map at the position of every row."""
    ra = d.cells(spark, sf).groupBy("frame", "ri", "ai").agg(F.avg("p").alias("p"), F.count("*").cast("double").alias("hits"))
    k = F.col("k")
    at = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 256).alias("frame"), F.col("l_partkey").alias("k")).distinct()
    at = at.select("frame", "k", (k * 7 % 300 / 10.37).alias("x"), (k * 11 % 140 / 10.37).alias("y"))
    return interpolated(ra, at, ["ri", "ai"], ["x", "y"], ["p", "hits"], ["k"], ["frame"]).select("frame", "k", F.round("p", 4).alias("p"), _r("hits").alias("hits"))


@query(f"""WITH {PT} SELECT ok, ln, pk, sk, round(power * exp(-0.02 * greatest(sqrt(x*x + y*y + z*z) - 10, 0)), 4) + 0.0 AS attenuated, greatest(2000, least(50000, power)) AS saturated,
NOT (degrees(atan2(y, x)) BETWEEN -20 AND 20) AS seen, NOT (sqrt(x*x + y*y + z*z) BETWEEN 20 AND 40) AS in_range, (ok * 8 + ln) % 3 = 0 AS strided,
round(cos(0.05) * (x + 0.3) - sin(0.05) * (y - 0.2), 6) + 0.0 AS drift_x, round(sin(0.05) * (x + 0.3) + cos(0.05) * (y - 0.2), 6) + 0.0 AS drift_y FROM pt""")  # fmt: skip
def n18_n28_corruptions(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic corruptions of points: attenuation, saturation, occlusion, range drop-out, stride, calibration drift."""
    p = d.points(spark, sf)
    dx, dy = n.calibration_drift(F.col("x"), F.col("y"), 0.3, -0.2, 0.05)
    return p.select(
        "ok", "ln", "pk", "sk", F.round(n.range_attenuation(F.col("power"), F.col("x"), F.col("y"), F.col("z"), 0.02, 10.0), 4).alias("attenuated"),
        n.saturation(F.col("power"), 2000.0, 50000.0).alias("saturated"), (~n.in_sector(F.col("x"), F.col("y"), -20, 20)).alias("seen"),
        (~n.in_range(F.col("x"), F.col("y"), F.col("z"), 20, 40)).alias("in_range"), ((F.col("ok") * 8 + F.col("ln")) % 3 == 0).alias("strided"),
        _r(dx).alias("drift_x"), _r(dy).alias("drift_y"),
    )


@query(f"""WITH {PT}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (ok * 7919 + ln * 104729 + pk * 1299709) % 1000003, {_ORD}) AS k, count(*) OVER (PARTITION BY frame) AS n FROM pt)
SELECT frame, n, count(*) FILTER (k <= CAST(floor(n * 0.3) AS BIGINT)) AS zeroed, CAST(sum(CASE WHEN k <= CAST(floor(n * 0.3) AS BIGINT) THEN 0 ELSE CAST(power AS DECIMAL(18,2)) END) AS DOUBLE) AS power FROM r GROUP BY ALL""")  # fmt: skip
def n08_partial_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly the floor of 0.3 n points of every frame set to zero, rows kept, chosen by a reproducible order."""
    draw = (F.col("ok") * 7919 + F.col("ln") * 104729 + F.col("pk") * 1299709) % 1000003
    lost = n.partial_loss(d.points(spark, sf), ["frame"], 0.3, draw, ["ok", "ln", "pk", "sk", "power"], ["power"])
    return lost.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("lost").alias("zeroed"), _total("power").alias("power"))
