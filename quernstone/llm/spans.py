"""Long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import write_stage

#: Odd multipliers of the two window hashes and of the mixing step; fixed values.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the bases and of their inverses modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.down = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> None:
        if len(self.up[0]) < n:
            for i, base in enumerate(_BASES):
                for rows, b in ((self.up, base), (self.down, pow(base, -1, 2**64))):
                    steps = np.full(n, b, dtype=np.uint64)
                    steps[0] = 1
                    rows[i] = np.multiply.accumulate(steps)


_powers = _Powers()


class _Hashes:
    """Hashes of any stretch of an array of code points: sums of code * base**place, moved to place 0."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        _powers.upto(n + 1)
        c = _mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        self.sums = [np.concatenate(([np.uint64(0)], np.cumsum(c * _powers.up[i][:n], dtype=np.uint64))) for i in (0, 1)]

    def of(self, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        s = self.sums[base]
        return (s[end] - s[start]) * _powers.down[base][start]

    def windows(self, width: int, base: int) -> np.ndarray:
        s = self.sums[base]
        n = len(s) - width
        return (s[width:] - s[:n]) * _powers.down[base][:n]


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pieces(texts: list[str], width: int, most: int) -> Iterator[tuple[int, int, str]]:
    """(text number, start, piece): texts whole, or in overlapping pieces of ``most`` windows, each window in one piece."""
    for i, t in enumerate(texts):
        for start in range(0, len(t) - width + 1, most):
            yield i, start, t if len(t) <= most else t[start : start + most + width - 1]


def super_kmers(texts: list[str], width: int, least: int, longest: int) -> tuple[np.ndarray, ...]:
    """Cut all windows of ``width`` code points into runs sharing a minimiser.

    The minimiser of a window is the least hash of its stretches of ``least`` code points. Returns text number,
    first window, number of windows (at most ``longest``), minimiser and two hashes of the packed string, each window
    in exactly one run. Every text has at least ``width`` code points.
    """
    codes = _codes(texts)
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    h = _Hashes(codes)
    low = _mix(h.windows(least, 0))
    span, step = width - least + 1, 1
    while 2 * step <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < span:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
    first = np.cumsum(size) - size
    count = size - width + 1  # windows of each text
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    text = np.repeat(np.arange(len(texts)), count)
    mini = low[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (mini[1:] != mini[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    starts = np.flatnonzero(place % longest == 0)
    run = np.diff(np.append(starts, len(at)))
    a = at[starts]
    return text[starts], a - first[text[starts]], run, mini[starts].astype(np.int64), *(h.of(a, a + run + width - 1, i).astype(np.int64) for i in (0, 1))


def _group_bounds(packed: list[str], lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort all windows of the packed strings; (string, window, shared) in order of position.

    Windows are sorted by one hash, told apart by a second one and compared letter by letter: where a pair continues
    the pair one letter before, its last letter decides. A window is shared if the strings holding it name more than
    one record.
    """
    codes = _codes(packed)
    size = np.fromiter((len(t) for t in packed), dtype=np.int64, count=len(packed))
    first, count = np.cumsum(size) - size, size - width + 1
    string = np.repeat(np.arange(len(packed)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = first[string] + place
    h = _Hashes(codes)
    one, two = h.windows(width, 0)[at], h.windows(width, 1)[at]
    order = np.lexsort((np.arange(len(at)), one))
    a, b = order[:-1], order[1:]
    same = (one[a] == one[b]) & (two[a] == two[b])
    # letter by letter: of each equal pair (a, b), sorted by b, the pair before it may already be compared
    pa_, pb = a[same], b[same]
    by = np.argsort(pb, kind="stable")
    pa_, pb = pa_[by], pb[by]
    chained = np.zeros(len(pb), dtype=bool)
    chained[1:] = (pb[1:] == pb[:-1] + 1) & (pa_[1:] == pa_[:-1] + 1) & (string[pb[1:]] == string[pb[:-1]]) & (string[pa_[1:]] == string[pa_[:-1]])
    equal = codes[at[pa_] + width - 1] == codes[at[pb] + width - 1]
    heads = np.flatnonzero(~chained)
    for part in (heads[i : i + 20_000] for i in range(0, len(heads), 20_000)):
        span = np.arange(width)[None, :]
        equal[part] = (codes[at[pa_[part]][:, None] + span] == codes[at[pb[part]][:, None] + span]).all(axis=1)
    if not equal.all():
        raise RuntimeError("two different windows share 128 bits of hash")
    new = np.ones(len(order), dtype=bool)
    new[1:] = ~same
    starts = np.flatnonzero(new)
    shared = np.minimum.reduceat(lo[string[order]], starts) < np.maximum.reduceat(hi[string[order]], starts)
    out = np.empty(len(order), dtype=bool)
    out[order] = np.repeat(shared, np.diff(np.append(starts, len(order))))
    return string, place, out


def shared_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    width: int = 200,
    *,
    least: int = 32,
    longest: int = 256,
    crowd: int = 4000,
) -> DataFrame:
    """(id, n_chars, shared_chars, shared_permille, n_spans) of every text: how much stands verbatim in another one.

    A span is a stretch of at least ``width`` code points that stands in the text of another id. Super-k-mer
    partitioning: consecutive windows with the same minimiser travel as one packed string to the minimiser's bucket.

    1. One narrow pass over the texts writes every packed string's place, minimiser and 128-bit name, without letters.
    2. A bucket whose strings all come from one record shares nothing; it is left out before any letter travels. Of the
       others every packed string is cut from its text and sent off. Equal strings are merged on the way, keeping the least
       and greatest id, so a passage copied into a third of all records is one row per map task. Strings of two ids
       are shared whole; buckets with several strings, several ids and at least one string of a single id are sorted.
    3. Sorting a bucket brings equal windows together, and their letters are compared. A bucket of more than ``crowd``
       strings is split by the name of the window: windows named by one record alone fall away, and the letters of all
       others are compared in Spark's aggregation, so that no task holds a large bucket.
    4. Shared stretches go back to all places of their string and are merged per record.

    Names only bring candidates together. In every path all letters are compared, and two different stretches of one
    name are an error, never a result.

    Defined results: nothing is normalised; null and short texts have 0 shared; ids (integers) repeated in several rows
    are the same record, which shares nothing with itself and shows its most shared text; null ids are left out; an empty table gives an empty result; other
    columns are never read.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.col("_id").isNotNull())
    kind = src.schema["_id"].dataType.simpleString()
    key = ["_z", "_h1", "_h2", "_run"]
    keys = "_z bigint, _h1 bigint, _h2 bigint, _run int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, chars = [], 0
            for piece in _pieces(batch.column(2).to_pylist(), width, 1_000_000):
                held.append(piece)
                chars += len(piece[2])
                if chars >= 1_000_000:
                    yield packed_strings(batch, held)
                    held, chars = [], 0
            if held:
                yield packed_strings(batch, held)

    def packed_strings(batch: pa.RecordBatch, pieces: list[tuple[int, int, str]]) -> pa.RecordBatch:
        piece, first, run, mini, h1, h2 = super_kmers([t for _, _, t in pieces], width, least, longest)
        row, base = (np.array([p[i] for p in pieces])[piece] for i in (0, 1))
        ids = [batch.column(i).take(pa.array(row)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*ids, *map(pa.array, (mini, h1, h2, run.astype(np.int32), (base + first).astype(np.int32)))], ["_id", "_v", *key, "_at"])

    # _v tells apart the texts of an id that stands in several rows
    long_enough = src.where(F.char_length("_text") >= width).select("_id", F.xxhash64("_text").alias("_v"), "_text")
    places = write_stage(long_enough.mapInArrow(cut, f"_id {kind}, _v bigint, {keys}, _at int"), "places")
    live = places.groupBy("_z").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where("_lo < _hi").select("_z")
    asked = (
        places.join(live, "_z", "left_semi")
        .groupBy("_id", "_v")
        .agg(F.collect_list(F.struct(*key, "_at")).alias("_ask"))  # of one text: bounded by it
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts, lists = part.column(1).to_pylist(), part.column(2)
                own = pa.array(np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy())))
                flat = lists.flatten()
                packed = [texts[r][a : a + n + width - 1] for r, a, n in zip(own.to_pylist(), flat.field("_at").to_pylist(), flat.field("_run").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), *(flat.field(k) for k in key), pa.array(packed, pa.string())], ["_id", *key, "_packed"])

    cut_out = long_enough.join(asked, ["_id", "_v"]).select("_id", "_text", "_ask").mapInArrow(fetch, f"_id {kind}, {keys}, _packed string")
    by_letters = cut_out.groupBy(*key, "_packed").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    strings = write_stage(by_letters, "strings")
    one_name = strings.groupBy(*key).agg(F.count("*").alias("_same"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    names = one_name.withColumn("_same", F.when(F.col("_same") == 1, 1).otherwise(F.raise_error(F.lit("two different strings share 128 bits of name"))))
    buckets = names.groupBy("_z").agg(
        F.sum("_same").alias("_n"), F.min("_lo").alias("_blo"), F.max("_hi").alias("_bhi"), F.bool_or(F.col("_lo") == F.col("_hi")).alias("_single")
    )
    open_ = write_stage(buckets.where("_n > 1 AND _blo < _bhi AND _single").select("_z", "_n"), "buckets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            strings_ = t.column("_packed").to_pylist()
            string, place, shared = _group_bounds(strings_, t.column("_lo").to_numpy(), t.column("_hi").to_numpy(), width)
            edge = np.ones(len(string), dtype=bool)
            edge[1:] = (shared[1:] != shared[:-1]) | (string[1:] != string[:-1])
            starts = np.flatnonzero(edge)
            ends = np.append(starts[1:], len(string)) - 1
            keep = shared[starts]
            starts, ends = starts[keep], ends[keep]
            if len(starts):
                own = pa.array(string[starts])
                t = t.select(key).combine_chunks().take(own)
                yield from t.append_column("_from", pa.array(place[starts].astype(np.int32))).append_column("_to", pa.array(place[ends].astype(np.int32))).to_batches()

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 4000:
                continue
            t = pa.Table.from_batches(held)
            z = t.column("_z").to_numpy()
            last = int(np.flatnonzero(z != z[-1])[-1]) + 1 if (z != z[-1]).any() else 0
            done = 0
            while done < last:  # whole buckets, some 4000 strings at a time
                end = last if last - done <= 4000 else int(np.searchsorted(z[done:last], z[done + 4000 - 1], side="right")) + done
                yield from flush(t.slice(done, end - done))
                done = end
            held, rows = [b for b in t.slice(last).to_batches() if b.num_rows], t.num_rows - last
        if rows:
            yield from flush(pa.Table.from_batches(held))

    found = f"{keys}, _from int, _to int"
    counted = strings.join(open_.where(F.col("_n") <= crowd), "_z", "left_semi").select(*key, "_lo", "_hi", "_packed").repartition("_z").sortWithinPartitions("_z").mapInArrow(count, found)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                strings_ = part.column(part.schema.get_field_index("_packed")).to_pylist()
                codes = _codes(strings_)
                size = np.fromiter((len(t) for t in strings_), dtype=np.int64, count=len(strings_))
                windows = size - width + 1
                row = np.repeat(np.arange(len(strings_)), windows)
                place = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
                pos = (np.cumsum(size) - size)[row] + place
                h = _Hashes(codes)
                own = pa.array(row)
                cols_ = [part.column(part.schema.get_field_index(k)).take(own) for k in (*key, "_lo", "_hi")]
                yield pa.RecordBatch.from_arrays([*cols_, *(pa.array(h.windows(width, i)[pos].astype(np.int64)) for i in (0, 1)), pa.array(place.astype(np.int32))], [*key, "_lo", "_hi", "_w1", "_w2", "_place"])

    whole = names.where("_same = 1 AND _lo < _hi").select(*key, F.lit(0).alias("_from"), (F.col("_run") - 1).alias("_to"))
    # crowded buckets: names of windows first, then the letters of those that two records name
    window = ["_z", "_w1", "_w2"]
    crowded = write_stage(strings.join(open_.where(F.col("_n") > crowd), "_z", "left_semi").select(*key, "_lo", "_hi", "_packed"), "crowded")
    named = crowded.mapInArrow(spread, f"{keys}, _lo {kind}, _hi {kind}, _w1 bigint, _w2 bigint, _place int")
    twice = named.groupBy(*window).agg(F.min("_lo").alias("_l"), F.max("_hi").alias("_h")).where("_l < _h").select(*window)
    met = named.join(twice, window, "left_semi").join(crowded.select(*key, "_packed"), key)
    letters = met.select(*window, F.substring("_packed", F.col("_place") + 1, F.lit(width)).alias("_w"))
    differ = letters.groupBy(*window).agg(F.min("_w").alias("_a"), F.max("_w").alias("_b"))
    proven = differ.where(F.when(F.col("_a") == F.col("_b"), F.lit(True)).otherwise(F.raise_error(F.lit("two different windows share 128 bits of name")).cast("boolean")))
    split = met.join(proven.select(*window), window, "left_semi").select(*key, F.col("_place").alias("_from"), F.col("_place").alias("_to"))
    shared = whole.unionByName(counted).unionByName(split)
    ranges = (
        places.join(shared, key)
        .select("_id", "_v", (F.col("_at") + F.col("_from")).alias("_s"), (F.col("_at") + F.col("_to") + width).alias("_e"))
        .groupBy("_id", "_v")
        .agg(F.sort_array(F.collect_list(F.struct("_s", "_e"))).alias("_r"))  # of one text: bounded by it
    )
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("spans"), F.lit(-1).alias("end"))
    merged = F.aggregate(
        "_r",
        start,
        lambda acc, r: F.struct(
            (acc["chars"] + F.greatest(F.lit(0), r["_e"] - F.greatest(r["_s"], acc["end"]))).alias("chars"),
            (acc["spans"] + F.when(r["_s"] > acc["end"], 1).otherwise(0)).alias("spans"),
            F.greatest(acc["end"], r["_e"]).alias("end"),
        ),
    )
    most = ranges.select("_id", merged.alias("_m")).groupBy("_id").agg(F.max(F.struct("_m.chars", "_m.spans")).alias("_m"))
    sizes = src.groupBy("_id").agg(F.coalesce(F.max(F.char_length("_text")), F.lit(0)).alias("n_chars"))
    return sizes.join(most, "_id", "left").select(
        F.col("_id").alias(id_col),
        "n_chars",
        F.coalesce("_m.chars", F.lit(0)).alias("shared_chars"),
        F.coalesce(F.expr("_m.chars * 1000 div n_chars"), F.lit(0)).cast("int").alias("shared_permille"),
        F.coalesce("_m.spans", F.lit(0)).alias("n_spans"),
    )
