"""Queries of the general problems (problem 4) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.operators.spikes import implausible_readings
from quernstone.session import table


#: Readings come ten times a second; a season is looked for over one second.
PERIOD = 10


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible reading of the local odometry."""
    return implausible_readings(table(spark, sf_dir, "seq_local"), period=PERIOD).select("odo_id")


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings with the checks that flagged them."""
    return implausible_readings(table(spark, sf_dir, "seq_local"), period=PERIOD)


QUERIES = {"p4_found": p4_found, "p4_flags": p4_flags}
