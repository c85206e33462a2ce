"""Structured Streaming twins of the ordered operators: an extension, the batch operators define the results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window and key; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sliding_counts(events: DataFrame, time: str, key: str, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    """Rows per sliding window and key."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, step), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Rows per session and key: rows less than ``gap`` apart."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def hold_last(readings: DataFrame, key: str, order: str, ident: str, value: str) -> DataFrame:
    """(ident, held): the last known value of the key so far, null before the first; state is one value per key.

    Rows of a key are taken in ``order`` within each micro-batch, and batches in arrival order.
    """
    kind = {f.name: f.dataType.simpleString() for f in readings.schema.fields}

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([order, ident], kind="stable")
        held = []
        for v in rows[value]:
            last = last if pd.isna(v) else float(v)
            held.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({ident: rows[ident].to_numpy(), "held": pd.Series(held, dtype="float64")})

    return readings.groupBy(key).applyInPandasWithState(step, f"{ident} {kind[ident]}, held double", "last double", "append", GroupStateTimeout.NoTimeout)


def deleted_frames(frames: DataFrame, frame: str, every: int) -> DataFrame:
    """A stream without every n-th frame; needs no state."""
    return frames.where(F.col(frame) % every != every - 1)
