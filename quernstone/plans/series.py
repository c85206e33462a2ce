"""Queries over frames, clocks, odometry and events: ordered windows, as-of joins, splits and held values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from quernstone.functions.keys import set_clock, whole_number
from quernstone.operators.blocks import bounded_window
from quernstone.operators.timeseries import hold_last, linear_clock_join, nearest_any, quarter_split
from quernstone.plans import domain as d
from quernstone.plans.domain import FR, TG, Catalogue, _n
from quernstone.session import table

query = Catalogue()
#: Buckets along the order of frames, odometry readings and instants (see operators.blocks).
_FRAMES, _MINUTES = "frame div 4096", "t div 60000000"


def _r(c, n: int = 6):
    return F.round(c, n)


_FIRST = "f1 AS (SELECT seq, frame, min(ldr64) AS ldr64, min(rdr) AS rdr, min(camf) AS camf FROM fr GROUP BY ALL)"


def _one_per_frame(spark: SparkSession, sf: str) -> DataFrame:
    return d.frames(spark, sf).groupBy("seq", "frame").agg(F.min("ldr64").alias("ldr64"), F.min("rdr").alias("rdr"), F.min("camf").alias("camf"))


@query(f"""WITH {FR}, {_FIRST}, r AS (SELECT seq, frame, row_number() OVER (PARTITION BY seq ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY seq) AS n FROM f1)
SELECT seq, frame, CASE WHEN i < n // 4 THEN 'train' WHEN i < n // 2 THEN 'test' WHEN i < (3 * n) // 4 THEN 'train' ELSE 'test' END AS split FROM r""")  # fmt: skip
def w07_quarter_split(spark: SparkSession, sf: str) -> DataFrame:
    """Train and test by consecutive quarters of every sequence."""
    return quarter_split(_one_per_frame(spark, sf), "seq", "frame", _FRAMES).select("seq", "frame", "split")


@query(f"""WITH {FR}, {_FIRST}, r AS (SELECT seq, frame, row_number() OVER (PARTITION BY seq ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY seq) AS n FROM f1),
s AS (SELECT seq, frame, CASE WHEN i < n // 4 OR (i >= n // 2 AND i < (3 * n) // 4) THEN 'train' ELSE 'test' END AS split FROM r)
SELECT split, count(*) AS frames, count(DISTINCT s.seq) AS seqs FROM s GROUP BY split""")  # fmt: skip
def f07_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Frames and sequences of each split."""
    s = quarter_split(_one_per_frame(spark, sf), "seq", "frame", _FRAMES)
    return s.groupBy("split").agg(F.count("*").alias("frames"), F.countDistinct("seq").alias("seqs"))


@query(f"""WITH {FR}, {_FIRST}, r AS (SELECT seq, frame, frame - row_number() OVER (PARTITION BY seq ORDER BY frame) AS run FROM f1),
k AS (SELECT seq, frame, list(frame) OVER (PARTITION BY seq, run ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS nxt FROM r)
SELECT seq, frame, nxt[1] AS next1, nxt[2] AS next2, nxt[3] AS next3 FROM k WHERE len(nxt) = 3""")  # fmt: skip
def w05_following_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame with the three that follow it, within unbroken runs of frame numbers."""
    f = _one_per_frame(spark, sf).select("seq", "frame")
    # every frame tells the three before it; one that hears of itself and three others has an unbroken run ahead
    told = f.select("seq", F.explode(F.sequence(F.col("frame") - 3, F.col("frame"))).alias("frame"), F.col("frame").alias("by"))
    full = told.groupBy("seq", "frame").agg(F.count("*").alias("n"), F.bool_or(F.col("by") == F.col("frame")).alias("own")).where("n = 4 AND own")
    return full.select("seq", "frame", *[(F.col("frame") + i).alias(f"next{i}") for i in (1, 2, 3)])


@query(f"""WITH {FR}, {_FIRST} SELECT seq, frame, lag(frame, 1) OVER w AS prev1, lag(frame, 2) OVER w AS prev2, CAST(least(2, row_number() OVER w - 1) AS INT) AS depth
FROM f1 WINDOW w AS (PARTITION BY seq ORDER BY frame)""")  # fmt: skip
def w06_past_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame with the two before it and how many there are."""
    looks = {"prev1": lambda w: F.lag("frame", 1).over(w), "prev2": lambda w: F.lag("frame", 2).over(w)}
    f = bounded_window(_one_per_frame(spark, sf).select("seq", "frame"), ["seq"], ["frame"], _FRAMES, 2, looks)
    depth = F.col("prev1").isNotNull().cast("int") + F.col("prev2").isNotNull().cast("int")
    return f.select("seq", "frame", "prev1", "prev2", depth.alias("depth"))


@query(f"""WITH {FR}, {_FIRST}, k AS (SELECT DISTINCT seq, rdr FROM f1 WHERE rdr IS NOT NULL), l AS (SELECT seq, ldr64, min(frame) AS frame FROM f1 WHERE ldr64 IS NOT NULL GROUP BY ALL),
m AS (SELECT seq, rdr, CAST(trunc(-34 + rdr * 1.0::DOUBLE) AS BIGINT) AS ldr64 FROM k)
SELECT m.seq, m.rdr, CASE WHEN m.ldr64 >= 0 THEN l.ldr64 END AS ldr64, CASE WHEN m.ldr64 >= 0 THEN l.frame END AS frame FROM m LEFT JOIN l ON l.seq = m.seq AND l.ldr64 = m.ldr64""")  # fmt: skip
def j10_linear_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Radar index to lidar index by a linear clock; null if negative or absent."""
    f = _one_per_frame(spark, sf)
    lidar = f.where("ldr64 IS NOT NULL").groupBy("seq", "ldr64").agg(F.min("frame").alias("frame"))
    return linear_clock_join(f.where("rdr IS NOT NULL").select("seq", "rdr").distinct(), lidar, "seq", "rdr", "ldr64", offset=-34.0, rate=1.0)


@query(f"""WITH {FR}, {_FIRST}, r AS (SELECT DISTINCT seq, rdr FROM f1), l AS (SELECT DISTINCT seq, ldr64 FROM f1)
SELECT l.seq, l.ldr64, r.rdr FROM l JOIN r ON r.seq = l.seq AND r.rdr = l.ldr64 + 34""")  # fmt: skip
def j11_fixed_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of radar and lidar indices a fixed number apart, both present."""
    f = _one_per_frame(spark, sf)
    r = f.where("rdr IS NOT NULL").select("seq", "rdr").distinct()
    return f.where("ldr64 IS NOT NULL").select("seq", "ldr64").distinct().withColumn("rdr", F.col("ldr64") + 34).join(r, ["seq", "rdr"]).select("seq", "ldr64", "rdr")


_CLOCK = "CASE WHEN {c} > 0 AND NOT isnan({c}) AND NOT isinf({c}) THEN CAST(round({c} * 1000000) AS BIGINT) END"


@query(f"""WITH l AS (SELECT DISTINCT {_n('seq')} AS seq, {_CLOCK.format(c='timestamp_pc')} AS t FROM lidar_frames),
c AS (SELECT {_n('seq')} AS seq, {_CLOCK.format(c='timestamp_img')} AS u, min(image_id) AS image_id FROM camera_frames GROUP BY 1, 2),
b AS (SELECT l.seq, l.t, c.u, c.image_id FROM l ASOF JOIN (SELECT * FROM c WHERE seq IS NOT NULL AND u IS NOT NULL) c ON c.seq = l.seq AND l.t >= c.u WHERE l.t IS NOT NULL),
a AS (SELECT l.seq, l.t, c.u, c.image_id FROM l ASOF JOIN (SELECT * FROM c WHERE seq IS NOT NULL AND u IS NOT NULL) c ON c.seq = l.seq AND l.t <= c.u WHERE l.t IS NOT NULL),
u AS (SELECT *, row_number() OVER (PARTITION BY seq, t ORDER BY abs(t - u), image_id) AS k FROM (SELECT * FROM a UNION SELECT * FROM b))
SELECT seq, t, image_id, abs(t - u) AS gap FROM u WHERE k = 1""")  # fmt: skip
def j09_nearest_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Every lidar instant with the camera image nearest in time, however far."""
    def side(name: str, time: str) -> DataFrame:
        micros = F.round(set_clock(F.col(time)) * 1_000_000).cast("bigint")
        return table(spark, sf, name).withColumn("k", whole_number(F.col("seq"))).withColumn("t", micros)

    return nearest_any(side("lidar_frames", "timestamp_pc").select("k", "t"), side("camera_frames", "timestamp_img").select("k", "t", "image_id"), "k", "t", "image_id", _MINUTES).select(
        F.col("k").alias("seq"), "t", "image_id", "gap"
    )


_ODO = f"""od AS (SELECT DISTINCT ON (odo_id) odo_id, {_n('seq')} AS seq, timestamp AS t, local_x AS x, local_y AS y FROM seq_local WHERE odo_id IS NOT NULL),
ok AS (SELECT * FROM od WHERE seq IS NOT NULL AND t BETWEEN 1514764800000000 AND 4102444800000000 AND abs(x) < 50000 AND abs(y) < 50000)"""


def _odometry(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "seq_local").where("odo_id IS NOT NULL").dropDuplicates(["odo_id"])
    df = df.select("odo_id", whole_number(F.col("seq")).alias("seq"), F.col("timestamp").alias("t"), F.col("local_x").alias("x"), F.col("local_y").alias("y"))
    return df.where("seq IS NOT NULL AND t BETWEEN 1514764800000000 AND 4102444800000000 AND abs(x) < 50000 AND abs(y) < 50000 AND NOT isnan(x) AND NOT isnan(y)")


@query(f"""WITH {_ODO} SELECT odo_id, round(avg(x) OVER w, 6) + 0.0 AS mean_x, round(avg(y) OVER w, 6) + 0.0 AS mean_y FROM ok
WINDOW w AS (PARTITION BY seq ORDER BY t, odo_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")  # fmt: skip
def w08_moving_average(spark: SparkSession, sf: str) -> DataFrame:
    """Centred moving average of the path, shorter at the ends."""
    means = {f"mean_{a}": lambda w, a=a: _r(F.avg(a).over(w.rowsBetween(-2, 2))) for a in "xy"}
    return bounded_window(_odometry(spark, sf), ["seq"], ["t", "odo_id"], _MINUTES, 2, means).select("odo_id", "mean_x", "mean_y")


@query(f"""WITH {_ODO}, s AS (SELECT seq, t, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM ok WINDOW w AS (PARTITION BY seq ORDER BY t, odo_id))
SELECT seq, count(*) AS readings, round(sum(step), 3) + 0.0 AS length, max(t) - min(t) AS micros FROM s GROUP BY seq""")  # fmt: skip
def q06_path_length(spark: SparkSession, sf: str) -> DataFrame:
    """Readings, length and duration of every sequence's path."""
    def step(w: WindowSpec) -> Column:
        return F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))

    return bounded_window(_odometry(spark, sf), ["seq"], ["t", "odo_id"], _MINUTES, 1, {"step": step}).groupBy("seq").agg(
        F.count("*").alias("readings"), F.round(F.sum("step"), 3).alias("length"), (F.max("t") - F.min("t")).alias("micros")
    )


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS held, coalesce(v, 0) AS zeroed, v IS NULL AS blacked_out FROM e""")
def q01_q02_last_frame_hold(spark: SparkSession, sf: str) -> DataFrame:
    """Blacked-out readings under the policies hold-last, zero and empty."""
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return hold_last(e, ["user_id"], ["ts", "event_id"], "v", "held", "date_trunc('DAY', ts)").select("event_id", "held", F.coalesce("v", F.lit(0.0)).alias("zeroed"), F.col("v").isNull().alias("blacked_out"))


@query(f"""WITH {TG}, x AS (SELECT unnest(['all', 'road:' || road, 'time:' || capture_time, 'weather:' || weather]) AS cond, seq FROM tg)
SELECT cond, count(*) AS frames, count(DISTINCT seq) AS seqs FROM x WHERE cond IS NOT NULL GROUP BY cond""")  # fmt: skip
def k02_a45_condition_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Frames per condition, every frame counted under all, its road, its time and its weather."""
    parts = F.array(F.lit("all"), *[F.concat(F.lit(f"{n}:"), F.col(c)) for n, c in (("road", "road"), ("time", "capture_time"), ("weather", "weather"))])
    x = d.tags(spark, sf).select("seq", F.explode(parts).alias("cond")).where("cond IS NOT NULL")
    return x.groupBy("cond").agg(F.count("*").alias("frames"), F.countDistinct("seq").alias("seqs"))


@query(f"""WITH {TG} SELECT road, capture_time, weather, CAST(grouping(road) * 4 + grouping(capture_time) * 2 + grouping(weather) AS BIGINT) AS level, count(*) AS frames FROM tg
GROUP BY GROUPING SETS ((), (road), (capture_time), (weather), (road, weather))""")  # fmt: skip
def a45_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Frames by grouping sets of the tags."""
    t, c = d.tags(spark, sf), F.col
    return t.groupingSets([[], [c("road")], [c("capture_time")], [c("weather")], [c("road"), c("weather")]], "road", "capture_time", "weather").agg(
        F.grouping_id().alias("level"), F.count("*").alias("frames")
    )


@query(f"""WITH {FR}, {TG}, {_FIRST}, t AS (SELECT seq, frame, min(road) AS road, min(weather) AS weather FROM tg GROUP BY ALL)
SELECT f1.seq, f1.frame, road, weather, t.seq IS NOT NULL AS described, camf IS NOT NULL AS has_camera FROM f1 LEFT JOIN t ON t.seq = f1.seq AND t.frame = f1.frame""")  # fmt: skip
def j08_j29_frame_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their description and flags for what exists."""
    t = d.tags(spark, sf).where("seq IS NOT NULL AND frame IS NOT NULL").groupBy("seq", "frame").agg(F.min("road").alias("road"), F.min("weather").alias("weather"), F.lit(True).alias("described"))
    return _one_per_frame(spark, sf).join(t, ["seq", "frame"], "left").select("seq", "frame", "road", "weather", F.coalesce("described", F.lit(False)).alias("described"), F.col("camf").isNotNull().alias("has_camera"))


@query(f"""WITH {TG}, n AS (SELECT seq, road, count(*) AS n FROM tg WHERE road IS NOT NULL AND seq IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY n DESC, road) AS k FROM n)
SELECT seq, road, n FROM r WHERE k = 1""")  # fmt: skip
def d16_sequence_road(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent road type of every sequence."""
    n = d.tags(spark, sf).where("road IS NOT NULL AND seq IS NOT NULL").groupBy("seq", "road").agg(F.count("*").alias("n"))
    return n.groupBy("seq").agg(F.min(F.struct((-F.col("n")).alias("m"), "road")).alias("b")).select("seq", F.col("b.road"), (-F.col("b.m")).alias("n"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_value FROM events GROUP BY ALL""")
def q10_tumbling_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour and type; streaming twin: quernstone.streaming.windows.tumbling_counts."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), _r(F.avg("value")).alias("mean_value")).select(
        F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "mean_value"
    )


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY user_id, k""")
def q10_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of every user: events less than six hours apart."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(
        F.col("w.start").cast("timestamp_ntz").alias("started"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    ).drop("w")
