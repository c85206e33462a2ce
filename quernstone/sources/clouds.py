"""ASCII clouds in archives: one archive a sequence, as the data set is handed out, one file a frame in it.

A file of its own for every frame takes a block of disk, a place in the listing and a part of a task, whatever it holds;
an archive takes these once for hundreds of frames. The files in it are the same texts, and they are read by the same rules
as by :func:`text.ascii_cloud` and :func:`text.headed_cloud`. Archives are tar.gz, since a zip compresses each file alone,
which takes half as much again of small ones. An archive is one task's work and at most 2 GB.
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from quernstone.operators.frames import by_frame, changes

FIELDS = ("x", "y", "z", "intensity", "t", "reflectivity", "ring", "ambient", "range")
#: Lines before the first point.
HEAD = 13
_DATA, _NAMES, _WORD = re.compile(rb"^DATA\b[^\n]*(?:\n|\Z)", re.M), re.compile(rb"^FIELDS\b([^\n]*)", re.M), re.compile(r"\s+", re.ASCII)


def head(points: int) -> bytes:
    """The header of a cloud of so many points; the fields behind the fourth are written as 0."""
    n = len(FIELDS)
    return f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(FIELDS)}\nSIZE{' 4' * n}\nTYPE{' F' * n}\nCOUNT{' 1' * n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\n# a\n# b\nWIDTH {points}\nPOINTS {points}\nDATA ascii\n".encode()


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Rounded to so many decimals, halves away from zero, as SQL does; 0 for -0."""
    scaled = np.abs(values) * 10.0**digits
    whole = np.trunc(scaled)
    with np.errstate(invalid="ignore"):
        out = np.copysign(whole + (scaled - whole >= 0.5), values) / 10.0**digits
    return np.where(np.isfinite(out), out, values) + 0.0


def rounded_column(values: pa.Array, digits: int) -> pa.Array:
    """As :func:`rounded`; null stays null."""
    mask = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    return pa.array(rounded(values.fill_null(0.0).to_numpy(zero_copy_only=False), digits), mask=mask)


def numerals(values: pa.Array, digits: int | None) -> pa.Array:
    """Numbers as texts, rounded to so many decimals or in full (None), in as few letters as give them back. Each distinct number is written once."""
    coded = values.dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False)
    texts = [repr(v) for v in (known if digits is None else rounded(known, digits)).tolist()]
    return pa.array(texts, pa.string()).take(coded.indices).fill_null("null")


def _archive(files: Iterator[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, body in files:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return gzip.compress(out.getbuffer(), 4, mtime=0)


def ascii_archives(points: DataFrame, seq: str, frame: str, order: Sequence[Column], columns: Mapping[str, int | None], stem: str) -> DataFrame:
    """(path, content) of one archive a sequence with an ASCII cloud a frame, its points in ``order``.

    ``columns`` are the first fields, each with its decimals; the other fields are 0. A file is named ``stem`` and its frame, or
    "none". ``points`` are dealt by ``seq``, which is not null and the same for all points of a frame.
    """
    rest = " ".join("0" * (len(FIELDS) - len(columns))) + "\n"

    def clouds(rows: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        starts = np.append(np.flatnonzero(changes(rows, [frame])), rows.num_rows)
        frames = rows.column(frame).take(pa.array(starts[:-1])).to_pylist()
        lines = pc.binary_join_element_wise(*[numerals(rows.column(c), d) for c, d in columns.items()], rest, " ")
        ends, text = np.frombuffer(lines.buffers()[1], np.int32, rows.num_rows + 1)[starts].tolist(), memoryview(lines.buffers()[2])
        for k, at in enumerate(frames):
            yield f"{stem}{'none' if at is None else f'{at:06d}'}.pcd", b"".join([head(int(starts[k + 1] - starts[k])), text[ends[k] : ends[k + 1]]])

    def pack(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        starts = np.append(np.flatnonzero(changes(rows, [seq])), rows.num_rows).tolist()
        for a, b in zip(starts, starts[1:]):
            one = rows.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([pa.array([f"{one.column(seq)[0]}.tar.gz"]), pa.array([_archive(clouds(one))], pa.binary())], ["path", "content"])

    return by_frame(points, seq, [frame, *order], pack, "path string, content binary", [seq, frame, *columns])


def archived(spark: SparkSession, path: str, work: Callable[[list[str], list[bytes]], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """``work`` on names and contents of the files of every archive in a folder."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path).select("content")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(gzip.decompress(content.as_py()))) as t:
                    files = [i for i in t if i.isfile()]
                    yield work([i.name for i in files], [t.extractfile(i).read() for i in files])

    return archives.mapInArrow(each, schema)


def frame_of(name: str) -> int | None:
    """The number at the end of a file's stem; null if there is none."""
    found = re.search(r"_(-?\d+)\.[^./]*$", name)
    return int(found[1]) if found else None


def fixed_points(files: Sequence[bytes], keep: Sequence[str], skip: int = HEAD, fields: Sequence[str] = FIELDS) -> pa.Table:
    """(file, ordinal, the fields to keep) of clouds with a header of fixed length; ``file`` is the place in ``files``."""
    cut = [f.split(b"\n", skip) for f in files]
    return _points(np.arange(len(files)), [c[skip] if len(c) > skip else b"" for c in cut], fields, keep)


def headed_points(files: Sequence[bytes], keep: Sequence[str]) -> pa.Table:
    """(file, ordinal, the fields to keep) of clouds whose header names the fields; a field it doesn't name is null."""
    alike: dict[bytes, tuple[list[int], list[bytes]]] = {}
    for i, f in enumerate(files):
        data, names = _DATA.search(f), _NAMES.search(f)
        if data and names:
            at, bodies = alike.setdefault(names[1], ([], []))
            at.append(i)
            bodies.append(f[data.end() :])
    parts = [_points(np.array(at), bodies, names.decode().split(), keep) for names, (at, bodies) in alike.items()]
    return pa.concat_tables(parts or [_points(np.arange(0), [], keep, keep)]).combine_chunks()


def joined(a: pa.Table, b: pa.Table) -> pa.Table:
    """Rows of the same file and ordinal, side by side."""
    keys = ["file", "ordinal"]
    if a.select(keys).equals(b.select(keys)):
        for c in b.column_names[2:]:
            a = a.append_column(c, b.column(c))
        return a
    return a.join(b, keys, join_type="inner", use_threads=False).combine_chunks()


def _points(at: np.ndarray, bodies: list[bytes], fields: Sequence[str], keep: Sequence[str]) -> pa.Table:
    """Points of texts of the same fields, parsed together if every line has all fields, apart by one blank, else word by word."""
    text = b"".join([b if not b or b.endswith(b"\n") else b + b"\n" for b in bodies])
    plain = text and not (text.startswith(b"\n") or b"\n\n" in text or b"\r" in text) and len(text) < 2**31 - 1 and set(keep) <= set(fields)
    if plain:
        counts = np.array([b.count(b"\n") + (b[-1:] not in (b"", b"\n")) for b in bodies])
        try:
            table = csv.read_csv(
                pa.BufferReader(text), csv.ReadOptions(use_threads=False, block_size=len(text) + 1, column_names=list(fields)), csv.ParseOptions(delimiter=" ", quote_char=False),
                csv.ConvertOptions(check_utf8=False, include_columns=list(keep), column_types={c: pa.float64() for c in keep}, null_values=["null"]),
            )
        except (pa.ArrowInvalid, pa.ArrowKeyError):
            table = None
        if table is not None and table.num_rows == counts.sum():
            first = np.cumsum(counts) - counts
            ordinal = (np.arange(table.num_rows) - np.repeat(first, counts)).astype(np.int32)
            return pa.table([np.repeat(at, counts), ordinal, *table.combine_chunks().columns], ["file", "ordinal", *keep])
    rows = [(i, n, *_fields(line, fields, keep)) for i, b in zip(at.tolist(), bodies) for n, line in enumerate(re.split("\r?\n", b.decode("utf-8", "replace"))) if line]
    types = [pa.int64(), pa.int32(), *[pa.float64()] * len(keep)]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], ["file", "ordinal", *keep])


def _fields(line: str, fields: Sequence[str], keep: Sequence[str]) -> list[float | None]:
    words = dict(zip(fields, _WORD.split(line.strip(" "))))
    return [_number(words.get(k, "")) for k in keep]


def _number(word: str) -> float | None:
    try:
        return None if "_" in word else float(word)
    except ValueError:
        return None
