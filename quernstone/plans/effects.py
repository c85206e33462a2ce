"""Queries of corruptions: every effect of the registry over the whole cloud, with draws that SQL makes too."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.geometry import pixel_normal
from quernstone.operators import corruption as n
from quernstone.plans import domain as d
from quernstone.plans.domain import FR, PT, Catalogue

query = Catalogue()
_KEY = ["ok", "ln", "pk", "sk"]
_AXES = ["x", "y", "z"]


def _r(c, places: int = 5):
    return F.round(c, places)


def _u(seed: int, effect: str, keys: str = "ok || '|' || ln || '|' || pk || '|' || sk") -> str:
    return f"(CAST('0x' || substr(md5('{seed}|{effect}|' || {keys}), 1, 12) AS BIGINT) / {2**48}.0::DOUBLE)"


def _n(seed: int, effect: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_u(seed, effect + ':a')})) * cos(2 * pi() * {_u(seed, effect + ':b')}))"


def _at(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*_KEY, *[_r(c).alias(c) for c in columns])


def _sql(*columns: str) -> str:
    return "ok, ln, pk, sk, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in columns)


_PT = f"WITH {PT}"


@query(f"{_PT}, e AS (SELECT * REPLACE (x + {_n(7, 'noise:x')} * 0.1 AS x, y + {_n(7, 'noise:y')} * 0.1 AS y, z + {_n(7, 'noise:z')} * 0.05 AS z) FROM pt) SELECT {_sql('x', 'y', 'z')} FROM e")
def n05_n24_position_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Normal noise on the position of every point, its own for height."""
    return _at(n.corrupt(d.points(spark, sf), [("gaussian_noise", {"keys": _KEY, "columns": {"x": 0.1, "y": 0.1, "z": 0.05}, "seed": 7})]), *_AXES)


@query(f"{_PT}, e AS (SELECT * REPLACE (greatest(2000, power + {_n(8, 'noise:power')} * 500) AS power) FROM pt) SELECT {_sql('power')} FROM e")
def n16_power_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Normal noise on power, never below a least one."""
    return _at(n.corrupt(d.points(spark, sf), [("gaussian_noise", {"keys": _KEY, "columns": {"power": 500.0}, "seed": 8, "low": 2000.0})]), "power")


@query(f"{_PT}, p AS (SELECT ok, ln, pk, sk, ((pk % 256) / 255.0::DOUBLE - [0.485, 0.456, 0.406][sk % 3 + 1]) / [0.229, 0.224, 0.225][sk % 3 + 1] AS pixel FROM pt), e AS (SELECT ok, ln, pk, sk, pixel + {_n(9, 'noise:pixel')} * (25 / 255.0::DOUBLE / 0.226) AS pixel FROM p) SELECT {_sql('pixel')} FROM e")
def n05_camera_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Noise of 25 grey values on normalised pixels: its deviation is divided by the range and the mean channel deviation."""
    p = d.points(spark, sf).select(*_KEY, pixel_normal(F.col("pk") % 256, F.col("sk") % 3).alias("pixel"))
    return _at(n.corrupt(p, [("gaussian_noise", {"keys": _KEY, "columns": {"pixel": 25 / 255 / 0.226}, "seed": 9})]), "pixel")


@query(f"{_PT} SELECT ok, ln, pk, sk FROM pt WHERE {_u(3, 'dropout')} >= 0.3")
def n17_dropout(spark: SparkSession, sf: str) -> DataFrame:
    """Points that a drop-out of three tenths leaves."""
    return n.corrupt(d.points(spark, sf), [("dropout", {"keys": _KEY, "rate": 0.3, "seed": 3})]).select(*_KEY)


_SHIFT = ", ".join(f"{_n(4, f'shift:{a}')} AS d{a}" for a in "xyz")


@query(f"{_PT}, s AS (SELECT *, {_SHIFT} FROM pt), e AS (SELECT ok, ln, pk, sk, {', '.join(f'{a} + d{a} * CASE WHEN sqrt(dx*dx + dy*dy + dz*dz) > 1.5 THEN 1.5 / sqrt(dx*dx + dy*dy + dz*dz) ELSE 1 END AS {a}' for a in 'xyz')} FROM s) SELECT {_sql('x', 'y', 'z')} FROM e")
def n04_induced_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """Points moved by a normal vector of one metre's deviation, shortened to 1.5 m where longer."""
    return _at(n.corrupt(d.points(spark, sf), [("induced_shifts", {"keys": _KEY, "axes": _AXES, "sigma": 1.0, "seed": 4, "radius": 1.5})]), *_AXES)


@query(f"""{_PT} SELECT ok, ln, pk, sk, round(doppler + {_n(5, 'noise:doppler')} * 0.1, 5) + 0.0 AS noisy, 0.0::DOUBLE AS zeroed, round(CASE WHEN {_u(5, 'doppler')} < 0.3 THEN 0 ELSE doppler END, 5) + 0.0 AS masked FROM pt""")
def n19_doppler_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Doppler under its three corruptions: noise, all zero, a masked share."""
    p = d.points(spark, sf)
    for mode, name in (("gaussian", "noisy"), ("zero", "zeroed"), ("mask", "masked")):
        p = p.withColumn("_kept", F.col("doppler"))
        p = n.corrupt(p, [("doppler_corruption", {"keys": _KEY, "column": "doppler", "mode": mode, "seed": 5})]).withColumnRenamed("doppler", name).withColumnRenamed("_kept", "doppler")
    return _at(p, "noisy", "zeroed", "masked")


@query(f"""{_PT}, g AS (SELECT frame, x, power, false AS ghost FROM pt UNION ALL SELECT frame, 0 + {_u(6, 'ghost:x')} * 70, power, true FROM pt WHERE {_u(6, 'ghost')} < 0.05)
SELECT frame, count(*) AS points, count(*) FILTER (ghost) AS ghosts, round(sum(CASE WHEN ghost THEN x END), 4) + 0.0 AS ghost_x, CAST(sum(CAST(power AS DECIMAL(18,2))) AS DOUBLE) AS power FROM g GROUP BY frame""")
def n20_ghost_points(spark: SparkSession, sf: str) -> DataFrame:
    """Ghost points: a twentieth of the points appended again at random places, power drawn from that of all."""
    g = n.corrupt(d.points(spark, sf), [("ghost_points", {"keys": _KEY, "share": 0.05, "seed": 6, "box": {"x": (0.0, 70.0), "y": (-16.0, 16.0)}})])
    return g.groupBy("frame").agg(
        F.count("*").alias("points"), F.count_if("ghost").alias("ghosts"), F.round(F.sum(F.when(F.col("ghost"), F.col("x"))), 4).alias("ghost_x"), F.sum(F.col("power").cast("decimal(18,2)")).cast("double").alias("power")
    )


@query(f"{_PT}, e AS (SELECT ok, ln, pk, sk, sqrt(x*x + y*y) AS r, atan2(y, x) + {_n(2, 'azimuth')} * {math.radians(1.5)!r} AS a FROM pt), f AS (SELECT ok, ln, pk, sk, r * cos(a) AS x, r * sin(a) AS y FROM e) SELECT {_sql('x', 'y')} FROM f")
def n21_azimuth_jitter(spark: SparkSession, sf: str) -> DataFrame:
    """Points turned about the sensor by normal angles."""
    return _at(n.corrupt(d.points(spark, sf), [("jittered", {"keys": _KEY, "x": "x", "y": "y", "degrees": 1.5, "seed": 2})]), "x", "y")


@query(f"""{_PT} SELECT frame, count(*) AS n, count(*) AS nulls, 0.0::DOUBLE AS zero_power FROM pt GROUP BY frame""")
def n11_n14_complete_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Clouds lost completely: absent (null) and present but empty (zero) stay two states; all rows remain."""
    p = d.points(spark, sf)
    absent = n.corrupt(p, [("complete_loss", {"columns": ["power", "x"]})]).groupBy("frame").agg(F.count("*").alias("n"), F.count_if(F.col("power").isNull() & F.col("x").isNull()).alias("nulls"))
    zero = n.corrupt(p, [("complete_loss", {"columns": ["power", "x"], "zero": True})]).groupBy("frame").agg((F.sum("power") + F.sum("x")).alias("zero_power"))
    return absent.join(zero, "frame")


_F1 = "f1 AS (SELECT seq, frame FROM fr GROUP BY ALL)"


@query(f"""WITH {FR}, {_F1} SELECT seq, frame, frame % 10 = 9 AS every_tenth, frame IN (0, 7, 13) AS listed, {_u(11, 'frame', "seq || '|' || frame")} < 0.3 AS random_third FROM f1""")
def q04_frame_deletion(spark: SparkSession, sf: str) -> DataFrame:
    """Frames deleted by interval, by list and by a draw; the decision is asked again after the rows are dropped and must be the same."""
    f = d.frames(spark, sf).select("seq", "frame").distinct()
    c, keys = F.col, [F.col("seq"), F.col("frame")]
    how = {"every_tenth": {"every": 10}, "listed": {"listed": (0, 7, 13)}, "random_third": {"probability": 0.3, "keys": keys}}
    out = f
    for name, by in how.items():
        kept = n.corrupt(f, [("frame_deletion", {"frame": c("frame"), "seed": 11, **by})]).withColumn("_kept", F.lit(True))
        asked = n.deleted(c("frame"), 11, **by)
        flag = F.when(asked == c("_kept").isNull(), asked).otherwise(F.raise_error(F.lit("a deletion was decided twice")).cast("boolean"))
        out = out.join(kept, ["seq", "frame"], "left").withColumn(name, flag).drop("_kept")
    return out


@query(f"""{_PT}, e AS (SELECT *, round(greatest(2000, least(50000, power * exp(-0.02 * greatest(sqrt(x*x + y*y + z*z) - 10, 0)))), 4) AS damped FROM pt WHERE NOT (degrees(atan2(y, x)) BETWEEN -20 AND -5) AND NOT (sqrt(x*x + y*y + z*z) BETWEEN 20 AND 25))
SELECT frame, count(*) AS kept, round(sum(damped), 2) + 0.0 AS power, round(sum(cos(0.05) * (x + 0.3) - sin(0.05) * (y - 0.2)), 4) + 0.0 AS drifted_x, 5 AS effects, 21 AS first_seed FROM e WHERE (ok * 8 + ln) % 2 = 0 AND {_u(21, 'dropout')} >= 0.1 GROUP BY frame""")
def n30_chain_with_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A chain of effects from a configuration, with the seed and list of effects beside every row."""
    config = {
        "seed": 21,
        "effects": [
            {"type": "dropout", "keys": _KEY, "rate": 0.1},
            {"type": "sector_loss", "x": "x", "y": "y", "low": -20.0, "high": -5.0},
            {"type": "range_dropout", "axes": _AXES, "low": 20.0, "high": 25.0},
            {"type": "attenuated", "axes": _AXES, "power": "power", "rate": 0.02, "start": 10.0},
            {"type": "saturated", "power": "power", "low": 2000.0, "high": 50000.0},
        ],
    }
    out = n.corrupt(d.points(spark, sf), n.steps_of(config), audit="audit")
    out = n.corrupt(out, [("strided", {"index": F.col("ok") * 8 + F.col("ln"), "step": 2}), ("drifted", {"x": "x", "y": "y", "dx": 0.3, "dy": -0.2, "yaw": 0.05})])
    return out.groupBy("frame").agg(
        F.count("*").alias("kept"), F.round(F.sum(F.round("power", 4)), 2).alias("power"), F.round(F.sum("x"), 4).alias("drifted_x"), F.max(F.size("audit")).alias("effects"), F.max(F.col("audit")[0]["seed"]).cast("int").alias("first_seed")
    )


@query()
def m33_sub_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-seeds of every frame: the stable 64-bit digest of "state|effect|offset", cut to 32 bits."""
    f = d.frames(spark, sf).select("seq", "frame").distinct()
    return f.withColumn("sub_seed", n.blake_seed(F.concat_ws("|", F.col("seq").cast("string"), F.lit("dropout"), F.col("frame").cast("string"))))
