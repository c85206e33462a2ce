"""Reproducible corruptions: a registry of DataFrame -> DataFrame effects whose draws are hashes, not generators."""

from __future__ import annotations

import hashlib
import inspect
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.blocks import numbered


def uniform(seed: int, effect: str, *keys: Column) -> Column:
    """A draw in [0, 1) that depends only on seed, effect and keys: the same in any partitioning, process and engine.

    The first 48 bits of the MD5 of "seed|effect|key|..." as a share of 2**48.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(effect), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(2**48)


def normal(seed: int, effect: str, *keys: Column) -> Column:
    """A standard normal draw from two uniform ones (Box-Muller)."""
    a, b = uniform(seed, effect + ":a", *keys), uniform(seed, effect + ":b", *keys)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)


@F.pandas_udf(T.LongType())
def blake_seed(text: pd.Series) -> pd.Series:
    """Sub-seed of a text: the low 32 bits of its 64-bit BLAKE2b digest, big-endian."""
    return text.map(lambda t: int.from_bytes(hashlib.blake2b(t.encode("utf-8"), digest_size=8).digest(), "big") & 0xFFFFFFFF if t is not None else None).astype("Int64")


def range_attenuation(power: Column, x: Column, y: Column, z: Column, rate: float, start: float) -> Column:
    """Power damped by exp(-rate * metres beyond ``start``)."""
    return power * F.exp(-rate * F.greatest(F.sqrt(x * x + y * y + z * z) - start, F.lit(0.0)))


def saturation(power: Column, low: float, high: float) -> Column:
    """Power clipped to a band."""
    return F.greatest(F.lit(low), F.least(F.lit(high), power))


def in_sector(x: Column, y: Column, low: float, high: float) -> Column:
    """Whether the azimuth in degrees lies in a sector, ends included."""
    return F.degrees(F.atan2(y, x)).between(low, high)


def in_range(x: Column, y: Column, z: Column, low: float, high: float) -> Column:
    """Whether the range lies between two bounds, ends included."""
    return F.sqrt(x * x + y * y + z * z).between(low, high)


def calibration_drift(x: Column, y: Column, dx: float, dy: float, yaw: float) -> tuple[Column, Column]:
    """Coordinates translated first and then turned."""
    u, v = x + dx, y + dy
    return math.cos(yaw) * u - math.sin(yaw) * v, math.sin(yaw) * u + math.cos(yaw) * v


def partial_loss(df: DataFrame, by: Sequence[str], share: float, draw: Column, ties: Sequence[str], columns: Sequence[str], step: int = 1000) -> DataFrame:
    """Set ``columns`` of exactly floor(n * share) rows of every group to 0 and mark them ``lost``; all rows stay.

    The rows of the least ``draw`` (a whole number, ties broken by ``ties``) are lost. Places are counted bucket by
    bucket of ``step`` values of the draw, so a group of any size is many tasks.
    """
    n = df.groupBy(*by).agg(F.count("*").alias("_all"))
    drawn = numbered(df.withColumn("_draw", draw), list(by), ["_draw", *ties], f"_draw div {step}", "_k").join(n, list(by))
    drawn = drawn.withColumn("lost", F.col("_k") < F.floor(F.col("_all") * share)).drop("_draw", "_k", "_all")
    return drawn.withColumns({c: F.when(F.col("lost"), F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def gaussian_noise(df: DataFrame, keys: Sequence[str], columns: dict[str, float], seed: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Add normal noise of the given deviation to each column, clipped to ``low`` and ``high`` where given."""
    ks = [F.col(k) for k in keys]

    def noisy(c: str, s: float) -> Column:
        v = F.col(c) + normal(seed, f"noise:{c}", *ks) * s
        v = v if low is None else F.greatest(F.lit(low), v)
        return v if high is None else F.least(F.lit(high), v)

    return df.withColumns({c: noisy(c, s) for c, s in columns.items()})


def induced_shifts(df: DataFrame, keys: Sequence[str], axes: Sequence[str], sigma: float, seed: int, radius: float | None = None, flat: bool = False) -> DataFrame:
    """Move every point by a normal (``flat``: uniform in plus or minus ``sigma``) vector, shortened to ``radius`` if longer."""
    ks = [F.col(k) for k in keys]
    steps = {a: (2 * uniform(seed, f"shift:{a}", *ks) - 1) * sigma if flat else normal(seed, f"shift:{a}", *ks) * sigma for a in axes}
    moved = df.withColumns({f"_d{a}": v for a, v in steps.items()})
    long = F.sqrt(sum((F.col(f"_d{a}") * F.col(f"_d{a}") for a in axes[1:]), F.col(f"_d{axes[0]}") * F.col(f"_d{axes[0]}")))
    scale = F.lit(1.0) if radius is None else F.when(long > radius, radius / long).otherwise(1.0)
    moved = moved.withColumn("_scale", scale)
    return moved.withColumns({a: F.col(a) + F.col(f"_d{a}") * F.col("_scale") for a in axes}).drop("_scale", *[f"_d{a}" for a in axes])


def doppler_corruption(df: DataFrame, keys: Sequence[str], column: str, mode: str, seed: int, sigma: float = 0.1, share: float = 0.3) -> DataFrame:
    """Spoil the Doppler: ``gaussian`` noise, ``zero`` for all, or ``mask`` a share with 0."""
    if mode == "gaussian":
        return gaussian_noise(df, keys, {column: sigma}, seed)
    if mode == "zero":
        return df.withColumn(column, F.lit(0.0))
    if mode == "mask":
        return df.withColumn(column, F.when(uniform(seed, "doppler", *[F.col(k) for k in keys]) < share, 0.0).otherwise(F.col(column)))
    raise ValueError(f"unknown mode {mode!r}: gaussian, zero or mask")


def jittered(df: DataFrame, keys: Sequence[str], x: str, y: str, degrees: float, seed: int) -> DataFrame:
    """Every point turned about the sensor by a normal angle."""
    jx, jy = azimuth_jitter(F.col(x), F.col(y), math.radians(degrees), seed, *[F.col(k) for k in keys])
    return df.withColumns({x: jx, y: jy})


def sector_loss(df: DataFrame, x: str, y: str, low: float, high: float, invert: bool = False) -> DataFrame:
    """Drop the points of an azimuth sector (``invert``: all others)."""
    inside = in_sector(F.col(x), F.col(y), low, high)
    return df.where(inside if invert else ~inside)


def range_dropout(df: DataFrame, axes: Sequence[str], low: float, high: float) -> DataFrame:
    """Drop the points between two ranges, ends included."""
    return df.where(~in_range(*[F.col(a) for a in axes], low, high))


def attenuated(df: DataFrame, axes: Sequence[str], power: str, rate: float, start: float = 0.0) -> DataFrame:
    """Power damped with range."""
    return df.withColumn(power, range_attenuation(F.col(power), *[F.col(a) for a in axes], rate, start))


def saturated(df: DataFrame, power: str, low: float, high: float) -> DataFrame:
    """Power clipped to a band."""
    return df.withColumn(power, saturation(F.col(power), low, high))


def strided(df: DataFrame, index: Column, step: int) -> DataFrame:
    """Every ``step``-th point by its index."""
    return df.where(index % step == 0)


def drifted(df: DataFrame, x: str, y: str, dx: float, dy: float, yaw: float) -> DataFrame:
    """Points seen through a calibration that is moved and then turned."""
    nx, ny = calibration_drift(F.col(x), F.col(y), dx, dy, yaw)
    return df.withColumns({x: nx, y: ny})


def dropout(df: DataFrame, keys: Sequence[str], rate: float, seed: int) -> DataFrame:
    """Drop every row with the given probability."""
    return df.where(uniform(seed, "dropout", *[F.col(k) for k in keys]) >= rate)


def deleted(frame: Column, seed: int = 0, *, every: int = 0, listed: Sequence[int] = (), probability: float = 0.0, keys: Sequence[Column] = (), draw: Column | None = None) -> Column:
    """Whether a frame is deleted: every n-th, a listed one, or with a probability.

    The decision is a function of seed and keys (or of a given ``draw`` in [0, 1)), so whoever asks gets the same one, before,
    while and after the rows are dropped, and nothing need be remembered.
    """
    gone = F.lit(False)
    if every:
        gone = gone | (frame % every == every - 1)
    if listed:
        gone = gone | frame.isin(list(listed))
    if probability:
        gone = gone | ((uniform(seed, "frame", *(keys or [frame])) if draw is None else draw) < probability)
    return F.coalesce(gone, F.lit(False))


def frame_deletion(df: DataFrame, frame: Column, seed: int = 0, **how) -> DataFrame:
    """Drop all rows of deleted frames (see :func:`deleted`)."""
    return df.where(~deleted(frame, seed, **how))


def complete_loss(df: DataFrame, columns: Sequence[str], zero: bool = False) -> DataFrame:
    """Blank the sensor columns: null (absent) or zero (present but empty); the two states stay distinct."""
    return df.withColumns({c: F.lit(0.0 if zero else None).cast(df.schema[c].dataType) for c in columns})


def ghost_points(df: DataFrame, keys: Sequence[str], share: float, seed: int, box: dict[str, tuple[float, float]]) -> DataFrame:
    """Append a copy of a share of the points, moved to random places of a box; their power is thereby drawn from that of all."""
    ks = [F.col(k) for k in keys]
    ghosts = df.where(uniform(seed, "ghost", *ks) < share)
    ghosts = ghosts.withColumns({c: lo + uniform(seed, f"ghost:{c}", *ks) * (hi - lo) for c, (lo, hi) in box.items()})
    return df.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))


def azimuth_jitter(x: Column, y: Column, sigma: float, seed: int, *keys: Column) -> tuple[Column, Column]:
    """A point turned about the sensor by a normal angle (radians)."""
    r, a = F.sqrt(x * x + y * y), F.atan2(y, x) + normal(seed, "azimuth", *keys) * sigma
    return r * F.cos(a), r * F.sin(a)


#: Effects by name; unknown names are an error (see :func:`corrupt`).
EFFECTS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        gaussian_noise, dropout, frame_deletion, partial_loss, complete_loss, ghost_points, induced_shifts, doppler_corruption, jittered,
        sector_loss, range_dropout, attenuated, saturated, strided, drifted,
    )
}


def corrupt(df: DataFrame, steps: Sequence[tuple[str, dict]], audit: str | None = None) -> DataFrame:
    """Apply effects in the given order; ``audit`` adds a column of that name with the seed and name of every effect."""
    notes = []
    for name, params in steps:
        if name not in EFFECTS:
            raise ValueError(f"unknown effect {name!r}; known: {', '.join(sorted(EFFECTS))}")
        df = EFFECTS[name](df, **params)
        notes.append(F.struct(F.lit(name).alias("effect"), F.lit(params.get("seed")).cast("bigint").alias("seed")))
    return df.withColumn(audit, F.array(*notes)) if audit else df


def steps_of(config: dict) -> list[tuple[str, dict]]:
    """Effect steps of a noise configuration {"seed": n, "effects": [{"type": name, parameters ...}, ...]}; the seed holds for all that draw."""
    out = []
    for i, entry in enumerate(config.get("effects", ())):
        params = {k: v for k, v in entry.items() if k != "type"}
        if "seed" in inspect.signature(EFFECTS[entry["type"]]).parameters:
            params.setdefault("seed", config.get("seed", 0) + i)
        out.append((entry["type"], params))
    return out
