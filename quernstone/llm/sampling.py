"""Samples with target category proportions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import write_stage


def slot_of(priority: Column, slots: int) -> Column:
    """The slot of a 64-bit priority: equal ranges of the signed 64-bit numbers, in order."""
    return F.floor((priority.cast("double") / 2.0**63 + 1.0) * (slots / 2)).cast("int")


def tagged(rows: DataFrame, id_col: str, fields: list[str], aliases: DataFrame) -> DataFrame:
    """(_id, one tag per field) of the rows all of whose fields have a tag; ids count once.

    A field's tag is what ``aliases`` (field_name, alias, tag) gives for its letters a-z in lower case. The alias
    table is a fixed small dictionary; an ordinary join lets Spark choose by its size.
    """
    out = rows.select(F.col(id_col).alias("_id"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)])
    out = out.where(F.col("_id").isNotNull()).dropDuplicates(["_id"])
    for i, f in enumerate(fields):
        words = (
            aliases.where(F.col("field_name") == f)
            .groupBy(F.col("alias").alias(f"_k{i}"))
            .agg(F.min("tag").alias(f"_tag{i}"))
        )
        key = F.regexp_replace(F.lower(f"_f{i}"), "[^a-z]", "")
        out = out.withColumn(f"_k{i}", key).join(words, f"_k{i}")
    return out.select("_id", *[F.col(f"_tag{i}").alias(f) for i, f in enumerate(fields)])


def reservoirs(rows: DataFrame, fields: list[str], most: str) -> DataFrame:
    """(fields, _id, _p, _n): of every task and category the ``most`` rows of least priority ``_p``, and one row (null id)
    with the number ``_n`` of rows met.

    Reservoirs of two tasks merge by union and counts by addition: the least rows of the union are those of all rows. Rows
    of categories whose ``most`` is null are counted alone. A task holds at most twice its reservoirs and one batch.
    """
    kind = rows.schema["_id"].dataType.simpleString()
    k = len(fields)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # category: number met, bound, ids, priorities
        for batch in batches:
            codes = [c.dictionary_encode() for c in batch.columns[:k]]
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for c in codes:
                code = code * (len(c.dictionary) + 1) + c.indices.to_numpy()
            for own in np.split(np.argsort(code, kind="stable"), np.flatnonzero(np.diff(np.sort(code))) + 1):
                if not len(own):
                    continue
                name = tuple(c[int(own[0])].as_py() for c in codes)
                r = held.setdefault(name, [0, batch.column(k + 2)[int(own[0])].as_py(), batch.column(k).slice(0, 0), np.empty(0, np.int64)])
                r[0] += len(own)
                if r[1] is not None:
                    r[2] = pa.concat_arrays([r[2], batch.column(k).take(pa.array(own))])
                    r[3] = np.concatenate([r[3], batch.column(k + 1).to_numpy()[own]])
                    if len(r[3]) > 2 * r[1] + 1000:
                        trim(r)
        for name, r in held.items():
            trim(r)
            n = len(r[3])
            columns = [pa.array([v] * (n + 1), c.type) for v, c in zip(name, batch.columns)]
            ids = pa.concat_arrays([r[2], pa.nulls(1, r[2].type)])
            counts = pa.array([None] * n + [r[0]], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(np.append(r[3], 0)), counts], [*fields, "_id", "_p", "_n"])

    def trim(r: list) -> None:
        if r[1] is not None and len(r[3]) > r[1]:
            least = np.argsort(r[3], kind="stable")[: r[1]]
            last = r[3][least[-1]] if len(least) else None
            least = least if last is None else np.flatnonzero(r[3] <= last)  # all of one priority stay or go together
            r[2], r[3] = r[2].take(pa.array(least)), r[3][least]

    shape = ", ".join(f"`{f}` string" for f in fields)
    return rows.select(*fields, "_id", "_p", F.col(most).cast("bigint")).mapInArrow(fill, f"{shape}, _id {kind}, _p bigint, _n bigint")


def sample_by_targets(
    rows: DataFrame,
    id_col: str,
    fields: list[str],
    aliases: DataFrame,
    targets: DataFrame,
    *,
    fraction: int = 4,
    slots: int = 1024,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(sample, report): a sample whose category shares are those of ``targets``.

    ``targets`` has the fields, share_permille and min_rows. With n = usable rows div ``fraction``, a category's
    quota is the larger of min_rows and share_permille * n div 1000.

    One pass tags the rows and gives each a priority, the hash of its id and the seed. Every task keeps a reservoir per
    target category (:func:`reservoirs`) of the rows of least priority, as many as the category could at most be asked for
    if every row of the table were usable, and counts all others. When the merged counts give the quotas, the union
    of the reservoirs is trimmed uniformly to them: its rows fall into ``slots`` ranges of priority, ranges wholly below the
    quota are kept, only the range on the boundary is ranked (a 1/``slots`` part of its category), so no category, however
    large, is gathered in one task.

    sample: (id, fields); report: (fields, share_permille, min_rows, usable, quota, taken, exhausted). An exhausted
    category has fewer usable rows than its quota and is taken whole.

    Defined results: ids count once, a null id is left out; a row with an unknown or null field is not usable; a
    category without rows is exhausted unless its quota is 0; target categories listed more than once keep their
    largest share and minimum; empty tables give n = 0 and an empty sample; other columns are never read.
    """
    goals = targets.groupBy(*fields).agg(F.max("share_permille").alias("share_permille"), F.max("min_rows").alias("min_rows"))
    tagged_ = tagged(rows, id_col, fields, aliases).withColumn("_p", F.xxhash64(F.lit(seed), "_id"))
    ever = rows.agg(F.count("*").alias("_all")).select(F.expr(f"_all div {fraction}")).scalar()
    bound = F.greatest(F.col("min_rows").cast("bigint"), F.expr("(share_permille * _ever) div 1000"))
    bounds = goals.withColumn("_ever", ever).select(*fields, bound.alias("_most"))
    stage = write_stage(reservoirs(tagged_.join(bounds, fields, "left"), fields, "_most"), "reservoirs")
    met = stage.where("_n IS NOT NULL").groupBy(*fields).agg(F.sum("_n").alias("usable"))
    usable = stage.where("_n IS NULL").select(*fields, "_id", "_p", slot_of(F.col("_p"), slots).alias("_s"))
    counts = usable.groupBy(*fields, "_s").agg(F.count("*").alias("_n"))  # at most categories * slots rows
    n = met.agg(F.coalesce(F.sum("usable"), F.lit(0)).alias("_all")).select(F.expr(f"_all div {fraction}"))
    quota = F.greatest(F.col("min_rows").cast("bigint"), F.expr("(share_permille * _total) div 1000"))
    asked = goals.withColumn("_total", n.scalar()).join(met, fields, "left").withColumn("usable", F.coalesce("usable", F.lit(0)).cast("bigint")).withColumn("quota", quota)
    upto = Window.partitionBy(*fields).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    left = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .join(asked.select(*fields, "quota"), fields)
        .withColumn("_left", F.col("quota") - F.col("_before"))
        .where("_left > 0")
        .select(*fields, "_s", F.col("_n"), "_left")
    )
    cut = usable.join(left, [*fields, "_s"])
    whole = cut.where("_n <= _left").select("_id", *fields)
    place = F.row_number().over(Window.partitionBy(*fields, "_s").orderBy("_p", "_id"))
    edge = cut.where("_n > _left").withColumn("_k", place).where("_k <= _left").select("_id", *fields)
    sample = write_stage(whole.unionByName(edge), "sample")
    taken = sample.groupBy(*fields).agg(F.count("*").alias("taken"))
    report = (
        asked.join(taken, fields, "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
        .withColumn("exhausted", F.col("taken") < F.col("quota"))
        .select(*fields, "share_permille", "min_rows", "usable", "quota", "taken", "exhausted")
    )
    return sample.withColumnRenamed("_id", id_col), report
