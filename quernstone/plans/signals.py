"""Further point, voxel and pose queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import geometry as g
from quernstone.operators.blocks import bounded_window, numbered, running_sums
from quernstone.operators.frames import near_rows
from quernstone.operators.radar import above_quantile
from quernstone.operators.ranking import global_rank
from quernstone.operators.spatial import within_radius
from quernstone.plans import domain as d
from quernstone.plans.domain import CE, PT, Catalogue
from quernstone.plans.series import _MINUTES, _ODO, _odometry
from quernstone.session import table

query = Catalogue()
_KEY = ["ok", "ln", "pk", "sk", "power"]
_K = ", ".join(_KEY)


def _r(c, n: int = 6):
    return F.round(c, n)


def _money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query(f"""WITH {PT} SELECT {_K}, round((CAST(floor(x / 0.4) AS BIGINT) + 0.5) * 0.4::DOUBLE, 6) + 0.0 AS cx, round(power / 1e5, 9) AS normal, round(power * (20 - 2 * abs(z)), 4) + 0.0 AS weighted,
round(x * cos(0.3) - y * sin(0.3), 6) + 0.0 AS rx, round(x * sin(0.3) + y * cos(0.3), 6) + 0.0 AS ry, round(0.1::DOUBLE + (pk % 64) * 0.25::DOUBLE + 0.125, 6) + 0.0 AS metre FROM pt""")  # fmt: skip
def m06_m09_m12_m14_m16_projections(spark: SparkSession, sf: str) -> DataFrame:
    """Voxel centres, normalised and height-weighted power, rotated points and positions of half-shifted indices."""
    c = F.col
    rx, ry = g.rotated(c("x"), c("y"), F.lit(0.3))
    return d.points(spark, sf).select(
        *_KEY, _r(g.voxel_centre(F.floor(c("x") / 0.4), 0.0, 0.4)).alias("cx"), F.round(c("power") / 1e5, 9).alias("normal"), F.round(c("power") * (20 - 2 * F.abs("z")), 4).alias("weighted"),
        _r(rx).alias("rx"), _r(ry).alias("ry"), _r(g.index_to_metre(c("pk") % 64, 0.1, 0.25, 1)).alias("metre"),
    )


@query("""SELECT o_orderkey, o_custkey, lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS frame_id, string_split('seq_' || o_custkey || '_' || lower(o_orderstatus), '_')[2] AS part,
strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS written, CAST(epoch_us(o_orderdate) AS BIGINT) AS micros FROM orders""")
def m30_m31_ids_and_times(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-padded ids, parts of a tag, and times as text and as microseconds."""
    tag = F.concat(F.lit("seq_"), F.col("o_custkey").cast("string"), F.lit("_"), F.lower("o_orderstatus"))
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0").alias("frame_id"), F.split(tag, "_")[1].alias("part"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("written"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("micros"),
    )


@query(f"""WITH {PT} SELECT frame, CAST(floor(x / 6) AS BIGINT) AS vx, CAST(floor(y / 6) AS BIGINT) AS vy, CAST(floor(z / 3) AS BIGINT) AS vz, count(*) AS n, round(avg(x), 6) + 0.0 AS mx, round(avg(y), 6) + 0.0 AS my,
round(avg(z), 6) + 0.0 AS mz, round(avg(doppler), 6) + 0.0 AS md FROM pt GROUP BY ALL""")  # fmt: skip
def a27_a34_voxel_features(spark: SparkSession, sf: str) -> DataFrame:
    """Mean features of every voxel of every frame."""
    c = F.col
    vox = [F.floor(c(a) / s).alias(f"v{a}") for a, s in (("x", 6), ("y", 6), ("z", 3))]
    return d.points(spark, sf).groupBy("frame", *vox).agg(F.count("*").alias("n"), *[_r(F.avg(a)).alias(f"m{b}") for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("doppler", "d"))])


@query(f"""WITH {PT}, a AS (SELECT * FROM pt), j AS (SELECT a.ok, a.ln, a.pk, a.sk, a.frame, b.power, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2, b.ok AS bok, b.ln AS bln, b.pk AS bpk, b.sk AS bsk
FROM a JOIN pt b ON b.frame = a.frame AND NOT (a.ok = b.ok AND a.ln = b.ln AND a.pk = b.pk AND a.sk = b.sk)), r AS (SELECT *, row_number() OVER (PARTITION BY frame, ok, ln, pk, sk ORDER BY d2, bok, bln, bpk, bsk) AS k FROM j WHERE d2 <= 64)
SELECT ok, ln, pk, sk, round(sum(power / (sqrt(d2) + 1e-8)) / sum(1 / (sqrt(d2) + 1e-8)), 2) AS power FROM r WHERE k <= 3 GROUP BY frame, ok, ln, pk, sk""")  # fmt: skip
def a35_inverse_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Power interpolated at every point from the three nearest other points within 8 m, weighted by inverse distance."""
    key = ["ok", "ln", "pk", "sk"]
    p = d.framed_points(spark, sf, *key, "x", "y", "z", "power")
    near = near_rows(p, "frame", key, ["x", "y", "z"], 8.0, 3, ["power"], closed=True, others=True)

    def total(value):
        return F.aggregate("near", F.lit(0.0), lambda s, b: s + value(b))

    inv = lambda b: 1 / (F.sqrt(b["d2"]) + 1e-8)
    return near.select(*key, F.round(total(lambda b: b["power"] * inv(b)) / total(inv), 2).alias("power"))


@query(f"""WITH {PT}, v AS (SELECT *, CAST(floor(x/7) AS BIGINT) AS vx, CAST(floor(y/4) AS BIGINT) AS vy FROM pt), n AS (SELECT frame, vx, vy, count(*) AS n FROM v GROUP BY ALL)
SELECT a.frame, a.vx, a.vy, CAST(sum(b.n) AS BIGINT) AS around, count(*) AS voxels FROM n a JOIN n b ON a.frame = b.frame AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 GROUP BY ALL""")  # fmt: skip
def j22_voxel_neighbourhoods(spark: SparkSession, sf: str) -> DataFrame:
    """Points and filled voxels in the 3 by 3 neighbourhood of every voxel."""
    c = F.col
    n = d.points(spark, sf).groupBy("frame", F.floor(c("x") / 7).alias("vx"), F.floor(c("y") / 4).alias("vy")).agg(F.count("*").alias("n"))
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    give = n.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).groupBy("frame", (c("vx") + c("i")).alias("vx"), (c("vy") + c("j")).alias("vy"))
    return give.agg(F.sum("n").alias("around"), F.count("*").alias("voxels")).join(n.select("frame", "vx", "vy"), ["frame", "vx", "vy"])


@query(f"""WITH {PT}, a AS (SELECT * FROM pt), j AS (SELECT a.ok, a.ln, a.pk, a.sk, a.power, a.frame, count(*) AS n FROM a JOIN pt b ON a.frame = b.frame AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) < 16 GROUP BY ALL)
SELECT frame, count(*) AS points, count(*) FILTER (n >= 3) AS kept FROM j GROUP BY frame""")  # fmt: skip
def r09_radius_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Points kept by the radius filter: at least three points within 4 m, itself included."""
    p, c = d.points(spark, sf), F.col
    a = p.select("frame", *_KEY, c("x").alias("ax"), c("y").alias("ay"))
    near = within_radius(a, p.select("frame", c("x").alias("bx"), c("y").alias("by")), ["frame"], ["ax", "ay"], ["bx", "by"], 4.0)
    return near.groupBy("frame", *_KEY).agg(F.count("*").alias("n")).groupBy("frame").agg(F.count("*").alias("points"), F.count_if(c("n") >= 3).alias("kept"))


@query(f"""WITH {CE}, q AS (SELECT frame, quantile_cont(p / 1e6, 0.9) AS q FROM ce GROUP BY frame) SELECT ce.frame, di, ri, ai, ei, round(1 + 0.46::DOUBLE * ri + 0.23, 6) AS rng, round(p / 1e6, 9) AS power FROM ce JOIN q ON q.frame = ce.frame WHERE p / 1e6 > q""")
def r07_sparse_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse cube of every frame: power normalised, the strongest tenth kept, indices to metres at half cells."""
    cells = d.cells(spark, sf).withColumn("power", F.col("p") / 1e6)
    return above_quantile(cells, ["frame"], "power", 0.1).select("frame", "di", "ri", "ai", "ei", _r(g.index_to_metre(F.col("ri"), 1.0, 0.46, 1)).alias("rng"), F.round("power", 9).alias("power"))


@query(f"""WITH {PT}, b AS (SELECT frame, x AS cx, y AS cy, (ok % 628) / 100.0::DOUBLE AS yaw FROM pt),
c AS (SELECT frame, CAST(floor(cx - 2.5) AS BIGINT) + i AS gx, CAST(floor(cy - 2.5) AS BIGINT) + j AS gy, cx, cy, yaw FROM b, (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(range(0, 6)) AS j))
SELECT frame, gx, gy, true AS occupied FROM c WHERE abs(cos(yaw)*(gx + 0.5 - cx) + sin(yaw)*(gy + 0.5 - cy)) <= 2 AND abs(-sin(yaw)*(gx + 0.5 - cx) + cos(yaw)*(gy + 0.5 - cy)) <= 1 GROUP BY ALL""")  # fmt: skip
def a41_occupancy_raster(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a 1 m raster whose centre lies in a turned box of 4 m by 2 m around a point."""
    c = F.col
    b = d.points(spark, sf).select("frame", c("x").alias("cx"), c("y").alias("cy"), (c("ok") % 628 / 100.0).alias("yaw"))
    six = F.sequence(F.lit(0), F.lit(5))
    b = b.withColumn("i", F.explode(six)).withColumn("j", F.explode(six)).withColumn("gx", F.floor(c("cx") - 2.5) + c("i")).withColumn("gy", F.floor(c("cy") - 2.5) + c("j"))
    u, v = g.rotated(c("gx") + 0.5 - c("cx"), c("gy") + 0.5 - c("cy"), -c("yaw"))
    return b.where((F.abs(u) <= 2) & (F.abs(v) <= 1)).groupBy("frame", "gx", "gy").agg(F.lit(True).alias("occupied"))


@query(f"""WITH {CE}, o AS (SELECT DISTINCT CAST(floor(l_orderkey / 256) AS BIGINT) AS frame, l_partkey % 28 + 2 AS r0, l_orderkey % 12 + 2 AS a0 FROM lineitem)
SELECT ce.frame, CAST(r0 AS INT) AS r0, CAST(a0 AS INT) AS a0, count(*) AS cells, CAST(sum(CAST(p AS DECIMAL(18,2))) AS DOUBLE) AS power FROM o JOIN ce ON ce.frame = o.frame AND ri BETWEEN r0 - 1 AND r0 + 1 AND ai BETWEEN a0 - 1 AND a0 + 1 WHERE di <> 3 GROUP BY ALL""")
def a42_object_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Known cells and their power in the index window around every object centre of a frame."""
    c = F.col
    o = table(spark, sf, "lineitem").select(F.floor(c("l_orderkey") / 256).alias("frame"), (c("l_partkey") % 28 + 2).cast("int").alias("r0"), (c("l_orderkey") % 12 + 2).cast("int").alias("a0")).distinct()
    o = o.withColumn("ri", F.explode(F.sequence(c("r0") - 1, c("r0") + 1))).withColumn("ai", F.explode(F.sequence(c("a0") - 1, c("a0") + 1)))
    return d.cells(spark, sf).where("di <> 3").join(o, ["frame", "ri", "ai"]).groupBy("frame", "r0", "a0").agg(F.count("*").alias("cells"), _money("p").alias("power"))


@query(f"""WITH {PT} SELECT {_K}, CAST(row_number() OVER (PARTITION BY frame, flag ORDER BY {_K}) - 1 AS INT) AS idx FROM pt""")
def w10_in_group_index(spark: SparkSession, sf: str) -> DataFrame:
    """Index of every point within its frame and class, by key."""
    return numbered(d.points(spark, sf), ["frame", "flag"], _KEY, "ok", "idx").select(*_KEY, F.col("idx").cast("int").alias("idx"))


@query(f"""WITH {_ODO}, s AS (SELECT odo_id, seq, t, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, ((odo_id * 37) % 11 - 5) / 1000.0::DOUBLE AS turn FROM ok WINDOW w AS (PARTITION BY seq ORDER BY t, odo_id)),
h AS (SELECT *, sum(turn) OVER (PARTITION BY seq ORDER BY t, odo_id ROWS UNBOUNDED PRECEDING) AS yaw FROM s)
SELECT odo_id, round(yaw, 6) + 0.0 AS yaw, round(sum(coalesce(dx, 0) * cos(yaw) - coalesce(dy, 0) * sin(yaw)) OVER w, 4) + 0.0 AS gx, round(sum(coalesce(dx, 0) * sin(yaw) + coalesce(dy, 0) * cos(yaw)) OVER w, 4) + 0.0 AS gy
FROM h WINDOW w AS (PARTITION BY seq ORDER BY t, odo_id ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def w11_q06_planar_poses(spark: SparkSession, sf: str) -> DataFrame:
    """Planar poses composed along every sequence: turns add up, steps are turned into the world and add up."""
    c, order = F.col, ["t", "odo_id"]
    steps = {f"d{a}": lambda w, a=a: F.coalesce(c(a) - F.lag(a).over(w), F.lit(0.0)) for a in "xy"}
    s = bounded_window(_odometry(spark, sf), ["seq"], order, _MINUTES, 1, steps).withColumn("turn", (c("odo_id") * 37 % 11 - 5) / 1000.0)
    s = running_sums(s, ["seq"], order, _MINUTES, {"yaw": "turn"})
    sx, sy = g.rotated(c("dx"), c("dy"), c("yaw"))
    s = running_sums(s.withColumn("sx", sx).withColumn("sy", sy), ["seq"], order, _MINUTES, {"gx": "sx", "gy": "sy"})
    return s.select("odo_id", _r("yaw").alias("yaw"), F.round("gx", 4).alias("gx"), F.round("gy", 4).alias("gy"))


@query(f"""WITH {_ODO}, p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag((odo_id * 7 % 628) / 100.0::DOUBLE) OVER w AS pa, (odo_id * 7 % 628) / 100.0::DOUBLE AS a FROM ok WINDOW w AS (PARTITION BY seq ORDER BY t, odo_id))
SELECT odo_id, round(cos((a - pa) / 2), 6) + 0.0 AS qw, round(sin((a - pa) / 2), 6) + 0.0 AS qz, round(cos(pa) * (x - px) + sin(pa) * (y - py), 6) + 0.0 AS tx, round(-sin(pa) * (x - px) + cos(pa) * (y - py), 6) + 0.0 AS ty FROM p WHERE px IS NOT NULL""")  # fmt: skip
def m27_relative_poses(spark: SparkSession, sf: str) -> DataFrame:
    """Relative pose between neighbouring readings: quaternion about the vertical axis and translation."""
    c = F.col
    before = {f"p{k}": lambda w, k=k: F.lag(k).over(w) for k in "xya"}
    p = _odometry(spark, sf).withColumn("a", c("odo_id") * 7 % 628 / 100.0)
    p = bounded_window(p, ["seq"], ["t", "odo_id"], _MINUTES, 1, before).where("px IS NOT NULL")
    tx, ty = g.rotated(c("x") - c("px"), c("y") - c("py"), -c("pa"))
    half = (c("a") - c("pa")) / 2
    return p.select("odo_id", _r(F.cos(half)).alias("qw"), _r(F.sin(half)).alias("qz"), _r(tx).alias("tx"), _r(ty).alias("ty"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(v) AS f, generate_subscripts(v, 1) AS i FROM e)
SELECT label, CAST(i AS INT) AS i, round(avg(f), 6) + 0.0 AS mean, round(max(f), 6) + 0.0 AS top FROM x GROUP BY ALL""")
def a04_a40_feature_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and maximum of every feature dimension per class."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("p", "f"))
    return e.groupBy("label", (F.col("p") + 1).alias("i")).agg(_r(F.avg(F.col("f").cast("double"))).alias("mean"), _r(F.max(F.col("f").cast("double"))).alias("top"))


_SIDES = {"modality": ("camera", "lidar", "radar"), "effect": ("noise", "loss", "shift"), "severity": ("low", "medium", "high")}


@query("""WITH c AS (SELECT DISTINCT event_type AS effect FROM events), m AS (SELECT unnest(['camera', 'lidar', 'radar']) AS modality), s AS (SELECT unnest(['low', 'medium', 'high']) AS severity, unnest([0.1, 0.3, 0.5])::DOUBLE AS share)
SELECT modality || '_' || effect || '_' || severity AS name, modality, effect, severity, share FROM c, m, s""")
def k11_n29_condition_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every modality, effect (the event types) and severity with the severity's share."""
    ladder = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(v).alias("share")) for s, v in zip(_SIDES["severity"], (0.1, 0.3, 0.5))])
    c = table(spark, sf, "events").select(F.col("event_type").alias("effect")).distinct()
    c = c.withColumn("modality", F.explode(F.array(*[F.lit(m) for m in _SIDES["modality"]]))).withColumn("s", F.explode(ladder))
    return c.select(F.concat_ws("_", "modality", "effect", "s.severity").alias("name"), "modality", "effect", "s.severity", "s.share")


@query(f"""WITH {PT}, v AS (SELECT *, CAST(floor((degrees(atan2(y, x)) + 90) / 30) AS BIGINT) AS sector FROM pt), c AS (SELECT frame, sector, count(*) AS n FROM v GROUP BY frame, sector), n AS (SELECT *, sum(n) OVER (PARTITION BY frame) AS total FROM c)
SELECT frame, sector, n, CAST(ceil(n * 16.0 / total) AS BIGINT) AS quota FROM n""")  # fmt: skip
def t15_sector_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Points of every 30 degree sector and its share of sixteen samples, rounded up."""
    sector = F.floor((g.azimuth(F.col("x"), F.col("y")) + 90) / 30).alias("sector")
    n = d.points(spark, sf).groupBy("frame", sector).agg(F.count("*").alias("n"))
    return n.withColumn("quota", F.ceil(F.col("n") * F.lit(16.0) / F.sum("n").over(Window.partitionBy("frame"))))


@query(f"""WITH {PT}, k AS (SELECT DISTINCT frame, dense_rank() OVER (ORDER BY frame) AS r FROM pt) SELECT frame FROM k WHERE r % 4 = 1""")
def t20_stride(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth frame in order."""
    frames = d.points(spark, sf).select("frame").distinct()
    return global_rank(frames, [F.asc("frame")], "r").where("r % 4 = 0").select("frame")


@query(f"""WITH {PT}, ax AS (SELECT CAST(i AS INT) AS i, 1.0 + 2.5 * i AS lo, 1.0 + 2.5 * (i + 1) AS hi FROM (SELECT unnest(range(0, 31)) AS i))
SELECT {_K}, i, round((sqrt(x*x + y*y) - lo) / (hi - lo), 6) + 0.0 AS part FROM pt LEFT JOIN ax ON lo < sqrt(x*x + y*y) AND sqrt(x*x + y*y) <= hi""")  # fmt: skip
def g14_bracketing_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The axis interval (low, high] that holds every point's range, and where in it the point lies; null outside."""
    rng = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    i = (F.ceil((rng - 1.0) / 2.5) - 1).cast("int")
    kept = F.when((i >= 0) & (i < 31), i)
    return d.points(spark, sf).select(*_KEY, kept.alias("i"), _r((rng - (1.0 + kept * 2.5)) / 2.5).alias("part"))


@query(f"""WITH {PT} SELECT {_K}, round(atan2(y, x) - floor(atan2(y, x) / (2*pi()) + 0.5) * 2*pi(), 6) + 0.0 AS wrapped, round((1 + cos(atan2(y, x) - 0.5)) / 2, 6) + 0.0 AS similarity FROM pt""")
def m17_a14_angles(spark: SparkSession, sf: str) -> DataFrame:
    """Angles wrapped into one turn and orientation similarity against a fixed heading."""
    a = F.atan2("y", "x")
    return d.points(spark, sf).select(*_KEY, _r(g.wrapped(a, 2 * math.pi)).alias("wrapped"), _r((1 + F.cos(a - 0.5)) / 2).alias("similarity"))
