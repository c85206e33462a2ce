"""Reading rules of the domain tables: numbers written in text, clocks that are not set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(c: Column) -> Column:
    """The first whole number written in a text ("seq_21", " 0021", "21.0" -> 21); null if there is none."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint")


def trimmed(c: Column) -> Column:
    """The text without blanks, tabs and line ends at both ends."""
    return F.btrim(c, F.lit(" \t\r\n"))


def exact_seconds(c: Column) -> Column:
    """Epoch seconds written as text in any notation, as an exact decimal; null, blank, zero or unreadable: null."""
    d = trimmed(c).try_cast("decimal(38,18)")
    return F.when(d > 0, d)


def set_clock(c: Column) -> Column:
    """A clock reading in seconds, or null if it is not set (null, NaN, infinite, zero or negative)."""
    return F.when(~F.isnan(c) & (c > 0) & (c < F.lit(float("inf"))), c)
