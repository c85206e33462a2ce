"""Writers: partitioned fact tables, merged text, reports."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_facts(df: DataFrame, path: str, by: str = "seq") -> None:
    """Parquet fact table partitioned by sequence.

    Rows are gathered by sequence before the write; AQE cuts the partition of a large sequence and joins small ones,
    so that a sequence with a third of all rows is many tasks.
    """
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_fan_out(df: DataFrame, path: str, conditions: list[str], line: str) -> None:
    """One text row per condition of a record: ``all`` and each of the given columns, in one partitioned write."""
    arms = F.array(F.lit("all"), *[F.col(c) for c in conditions])
    out = df.select(F.explode(arms).alias("condition"), F.col(line).alias("value")).where("condition IS NOT NULL")
    out.write.mode("overwrite").partitionBy("condition").text(path)


def merge_small_files(spark, source: str, target: str, files: int) -> int:
    """Merge many text files into ``files`` ones; refuses to shrink a table that is already there.

    The new copy is written beside the target and its rows are counted. The old table is then moved aside, the new one
    moved in and the old one deleted; if the second move fails the old table is moved back, and an old table left aside
    by a broken run is put back first. So at every moment one of the two is whole.
    """
    name = target.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, old, here = path(name + "._stage"), path(name + "._old"), path(name)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(here):
            fs.delete(old, True)
        elif not fs.rename(old, here):
            raise OSError(f"cannot put back {name} from an earlier run")
    spark.read.text(source).coalesce(files).write.mode("overwrite").text(name + "._stage")
    rows = spark.read.text(name + "._stage").count()
    if fs.exists(here):
        before = spark.read.text(name).count()
        if rows < before:
            raise ValueError(f"refusing to shrink {target} from {before} to {rows} rows")
        if not fs.rename(here, old):
            raise OSError(f"cannot move {name} aside")
    if not fs.rename(new, here):
        if fs.exists(old):
            fs.rename(old, here)
        raise OSError(f"cannot move the merged files to {name}")
    fs.delete(old, True)
    return rows


def write_summary(df: DataFrame, path: str) -> None:
    """CSV with a header; null and NaN are empty."""
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    clean.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    """Every row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write one file per row (relative path, binary content) under ``root``, any file system the tasks reach; returns how many.

    A file is first written beside its place and then moved there, so that a task that is repeated leaves no half file.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder, _, stem = f"{base.rstrip('/')}/{name}".rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/.{stem}.part") as out:
                    out.write(data or b"")
                store.move(f"{folder}/.{stem}.part", f"{folder}/{stem}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select(path, content).mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def text_files(lines: DataFrame, path: Column, order: Sequence[str], line: str, head: Column | None = None) -> DataFrame:
    """(path, content) of text files from lines in ``order``, with an optional head; a file is one frame's or sequence's."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line))), lambda r: r[line]), "\n")
    files = lines.groupBy(path.alias("path"), (head if head is not None else F.lit("")).alias("_head")).agg(body.alias("_body"))
    return files.select("path", F.concat("_head", "_body", F.lit("\n")).cast("binary").alias("content"))


def array_files(cells: DataFrame, frame: str, axes: Sequence[str], shape: Sequence[int], value: str, empty: float = -1.0) -> DataFrame:
    """(path, content) of one ``.npy`` array a frame from its cells; cells without a row hold ``empty``."""

    def build(t: pa.Table) -> pa.Table:
        a = np.full(tuple(shape), empty, dtype=np.float64)
        a[tuple(t.column(x).to_numpy() for x in axes)] = t.column(value).to_numpy()
        out = io.BytesIO()
        np.save(out, a)
        return pa.table({"path": [f"cube_{t.column(frame)[0].as_py():06d}.npy"], "content": pa.array([out.getvalue()], pa.binary())})

    return cells.select(frame, *axes, value).groupBy(frame).applyInArrow(build, "path string, content binary")


def binary_clouds(points: DataFrame, frame: str, columns: Sequence[str]) -> DataFrame:
    """(path, content) of one binary cloud a frame: a text header, then the columns as 32-bit numbers point by point."""

    def build(t: pa.Table) -> pa.Table:
        values = np.column_stack([t.column(c).to_numpy() for c in columns]).astype("<f4")
        n, k = values.shape
        head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(columns)}\nSIZE {' '.join('4' * k)}\nTYPE {' '.join('F' * k)}\nCOUNT {' '.join('1' * k)}\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
        return pa.table({"path": [f"cloud_{t.column(frame)[0].as_py():06d}.pcd"], "content": pa.array([head.encode() + values.tobytes()], pa.binary())})

    return points.select(frame, *columns).groupBy(frame).applyInArrow(build, "path string, content binary")


def write_split_lists(df: DataFrame, path: str, split: str = "split", seq: str = "seq", label: str = "label") -> None:
    """Split lists: a folder per split with lines "sequence,label file"."""
    df.select(F.col(split).alias("split"), F.concat_ws(",", F.col(seq).cast("string"), label).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_tags(df: DataFrame, path: str, seq: str = "seq") -> None:
    """Tag files: a folder per sequence with a headed CSV of its frames' tags."""
    df.write.mode("overwrite").partitionBy(seq).option("header", True).csv(path)
