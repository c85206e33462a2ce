"""Implausible readings per source: out of range, off the path, or hanging."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.keys import whole_number
from quernstone.operators import path_residuals as pr
from quernstone.operators.blocks import blocked, numbered
from quernstone.session import write_stage

#: 2018-01-01 and 2101-01-01 in UTC microseconds; fixed values of the problem statement.
FIRST_TIME, END_TIME = 1_514_764_800_000_000, 4_133_980_800_000_000
FARTHEST = 50_000.0  # metres from the start


def implausible_readings(
    readings: DataFrame,
    id_col: str = "odo_id",
    source: str = "seq",
    time: str = "timestamp",
    coords: Sequence[str] = ("local_x", "local_y", "local_z"),
    *,
    times: float = 10.0,
    longest: int = 3,
    still_width: float = 0.001,
    still_least: int = 8,
    period: int = 0,
    alpha: float = 0.001,
    block: int = 2048,
    halo: int = 64,
) -> DataFrame:
    """(id, source_no, out_of_range, off_path, hanging) of every reading flagged by at least one check.

    * ``out_of_range``: a coordinate is NaN, infinite or farther than 50 km, or the time is null or outside 2018-2100.
    * ``off_path``: robust seasonal-trend decomposition per source. Trend: a local parabola through the sound
      readings around a run of one to ``longest`` readings. Season: medians by phase of ``period`` readings, where they
      stand out from the scatter (0: none). A run is flagged if all its remainders exceed ``times`` the source's usual
      scatter and the generalised extreme studentised deviate limit among all readings of the source.
    * ``hanging``: at least ``still_least`` readings in a row within ``still_width`` of the first, without the first.

    Scale: a source is numbered in time order by counts per minute (a minute that holds more than a thousandth of all
    rows, as of a stuck clock, by instant and id), cut into blocks of ``block`` readings and each block is sent with ``halo``
    readings of its neighbours, so a source holding a third of all rows is many tasks. The usual scatter of a source
    comes from a mergeable quantile sketch over all its readings. Whatever a block's halo shows is judged alike in every
    block; only where readings creep by at most twice ``still_width`` a step through a whole halo, the anchor of a hang is
    the halo's first reading.

    Defined results: repeated ids count once; null ids are left out; a null coordinate is no reading; a null source
    takes only the range check; equal times are ordered by id; an empty table gives an empty result; other columns
    of the input are never read.
    """
    names = [f"_v{i}" for i in range(len(coords))]
    base = (
        readings.select(
            F.col(id_col).alias("_id"),
            whole_number(F.col(source)).alias("_src"),
            F.col(time).cast("bigint").alias("_t"),
            *[F.col(c).cast("double").alias(n) for c, n in zip(coords, names)],
        )
        .where(F.col("_id").isNotNull())
        .dropDuplicates(["_id"])
    )
    timed_ok = F.col("_t").isNotNull() & (F.col("_t") >= FIRST_TIME) & (F.col("_t") < END_TIME)

    def sane(n):  # null (no reading) stays null
        return ~F.isnan(n) & (F.abs(n) <= FARTHEST)

    out_of_range = ~timed_ok
    for n in names:
        out_of_range = out_of_range | F.coalesce(~sane(n), F.lit(False))
    base = base.withColumn("_range", out_of_range)
    ranged = base.where("_range").select("_id", "_src", F.lit(0).alias("_why"))

    timed = base.where(timed_ok & F.col("_src").isNotNull()).select("_id", "_src", "_t", *[F.when(sane(n), F.col(n)).alias(n) for n in names])
    placed = numbered(timed, ["_src"], ["_t", "_id"], "_t div 60000000", finer=["_t", "_id div 100000"])
    blocks = write_stage(blocked(placed, "_i", block, halo), "spikes")

    order = Window.partitionBy("_src", "_b").orderBy("_i")
    t0, t1 = F.lag("_t").over(order), F.lead("_t").over(order)
    part = F.try_divide(F.col("_t") - t0, t1 - t0)
    bends = [F.abs(F.col(n) - F.lag(n).over(order) - part * (F.lead(n).over(order) - F.lag(n).over(order))).alias(n) for n in names]
    scatter = (
        blocks.select("_src", "_core", *bends)
        .where("_core")
        .groupBy("_src")
        # median |bend| of normal noise s is 0.6745 * sqrt(1.5) * s
        .agg(
            F.count("*").alias("_all"),
            *[(F.percentile_approx(F.when(F.col(n) > 0, F.col(n)), 0.5, 10_000) / (0.6745 * 1.5**0.5)).alias(f"_s{n}") for n in names],
        )
    )

    def look(g: pa.Table) -> pa.Table:
        g = g.sort_by("_i")
        if not g.num_rows:
            return g.select(["_id", "_src"]).append_column("_why", pa.array([], pa.int32()))
        core = g.column("_core").to_numpy()
        t, place = g.column("_t").to_numpy(), g.column("_i").to_numpy()
        t = (t - t[0]) / 1e6
        values = [g.column(n).to_numpy().astype(float) for n in names]  # null: NaN
        still = np.zeros(len(t), dtype=bool)
        for v in values:
            still |= pr.still_runs(v, still_width, still_least)
        off = np.zeros(len(t), dtype=bool)
        for n, v in zip(names, values):
            at = np.flatnonzero(~still & np.isfinite(v))
            sigma = g.column(f"_s{n}")[0].as_py() or 0.0
            if len(at) and sigma > 0:
                v = v[at] - pr.season_of(v[at], place[at] % max(period, 1), period)
                off[at] |= pr.spikes(t[at], v, sigma, times, longest, alpha, g.column("_all")[0].as_py())
        found = [(np.flatnonzero(core & m), w) for m, w in ((off, 1), (still, 2))]
        rows = g.select(["_id", "_src"]).take(pa.array(np.concatenate([at for at, _ in found])))
        return rows.append_column("_why", pa.array(np.repeat(np.array([w for _, w in found], np.int32), [len(at) for at, _ in found])))

    kind = base.schema["_id"].dataType.simpleString()
    judged = (
        blocks.join(scatter, "_src").groupBy("_src", "_b").applyInArrow(look, f"_id {kind}, _src bigint, _why int")
    )
    return (
        ranged.unionByName(judged)
        .groupBy(F.col("_id").alias(id_col))
        .agg(
            F.first("_src", ignorenulls=True).alias("source_no"),
            *[F.max(F.col("_why") == w).alias(n) for w, n in enumerate(("out_of_range", "off_path", "hanging"))],
        )
    )
