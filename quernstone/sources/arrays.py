"""Dense array files as long tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def npy_cells(spark: SparkSession, path: str, axes: list[str], value: str = "value", missing: float | None = None) -> DataFrame:
    """One row per cell of ``.npy`` files: path, an index per axis and the value; cells equal to ``missing`` are left out.

    A file is one array of one frame (some hundred megabytes at most) and is opened in one task; files of another
    number of axes are an error that names the file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != len(axes):
                    raise ValueError(f"{name} has {a.ndim} axes, not {len(axes)}")
                flat = a.astype(np.float64).ravel()
                for start in range(0, len(flat), 1_000_000):
                    part = flat[start : start + 1_000_000]
                    at = np.arange(start, start + len(part))
                    keep = np.ones(len(part), dtype=bool) if missing is None else part != missing
                    index = np.unravel_index(at[keep], a.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * int(keep.sum()), pa.string()), *[pa.array(i.astype(np.int32)) for i in index], pa.array(part[keep])], ["path", *axes, value])

    return files.mapInArrow(cells, f"path string, {', '.join(f'{x} int' for x in axes)}, {value} double")


def axis_table(spark: SparkSession, name: str, values: list[float], degrees: bool = False) -> DataFrame:
    """A physical axis as a small table of index and value, degrees turned into radians."""
    df = spark.createDataFrame(list(enumerate(map(float, values))), f"{name}_idx int, {name} double")
    return df.withColumn(name, F.radians(name)) if degrees else df


def binary_cloud(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, values) of binary clouds of 32-bit numbers: the values of a point by field name. A file is one frame."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head, _, body = content.partition(b"DATA binary\n")
                fields = next(line.split()[1:] for line in head.decode("ascii").splitlines() if line.startswith("FIELDS"))
                values = np.frombuffer(body, dtype="<f4").reshape(-1, len(fields)).astype(float)
                maps = pa.array([list(zip(fields, row)) for row in values.tolist()], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(np.arange(len(values), dtype=np.int32)), maps], ["path", "ordinal", "values"])

    return files.mapInArrow(points, "path string, ordinal int, values map<string,double>")


def cube_view(cells: DataFrame, axes: list[str], flip: dict[str, int], roi: dict[str, tuple[int, int]], value: str, unknown: float = -1.0, decibels: bool = True) -> DataFrame:
    """(axes, value, db, filled) of the known cells inside index bounds (ends included).

    ``flip`` turns an axis of the given size over first; ``db`` is 10 log10 of the value (0 at least if not ``decibels``), null
    where it is not positive; ``filled`` counts the known cells along the last axis.
    """
    out = cells.where(F.col(value) != unknown).withColumns({a: size - 1 - F.col(a) for a, size in flip.items()})
    for a, (lo, hi) in roi.items():
        out = out.where(F.col(a).between(lo, hi))
    db = F.when(F.col(value) > 0, 10 * F.log10(value)) if decibels else F.greatest(F.col(value), F.lit(0.0))
    columns = [c for c in cells.columns if c not in axes and c != value]
    n = out.groupBy(*columns, *axes[:-1]).agg(F.count("*").alias("filled"))
    return out.withColumn("db", db).join(n, [*columns, *axes[:-1]])


def doppler_view(cells: DataFrame, value: str, sentinel: float, stand_in: float, offset: float, roi: dict[str, tuple[int, int]]) -> DataFrame:
    """Cells inside index bounds with their Doppler value: the sentinel replaced, then shifted by an offset."""
    for a, (lo, hi) in roi.items():
        cells = cells.where(F.col(a).between(lo, hi))
    return cells.withColumn(value, F.when(F.col(value) == sentinel, stand_in).otherwise(F.col(value)) + offset)
