"""Frequency of every distinct term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.keys import trimmed, whole_number


def term_frequencies(
    rows: DataFrame,
    id_col: str,
    record: str,
    fields: list[str],
    *,
    least_rows: int = 5,
    most_tenths: int = 6,
) -> DataFrame:
    """(field_name, term, n_rows, n_records, mark) of every distinct term of ``fields``.

    Vertical layout: a term's records are a bitmap of record numbers, kept as (word number, 64-bit word) and only
    where a word is not zero, which is its compression. Words are built by a partial ``bit_or`` beside the row
    counter, merge by union, and the record frequency is the words' bit count. A term in a third of all rows is
    spread over its words, and every row of the aggregation has fixed size.

    A term is the value without outer blanks, tabs and line ends, in lower case; null and empty are no terms. mark:
    ``rare`` below ``least_rows`` rows, else ``common`` if 10 * n_records > ``most_tenths`` * records of the table, else
    null. Defined results: ids count once, null ids are left out; rows with a null record count as rows only; an
    empty table gives an empty result; other columns are never read.
    """
    base = (
        rows.select(
            F.col(id_col).alias("_id"), whole_number(F.col(record)).alias("_rec"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)]
        )
        .where(F.col("_id").isNotNull())
        .dropDuplicates(["_id"])
    )
    word = F.shiftright("_rec", 6).alias("_word")
    bit = F.expr("shiftleft(1L, cast(_rec & 63 as int))")
    all_records = base.where("_rec IS NOT NULL").groupBy(word).agg(F.bit_or(bit).alias("_bits")).agg(
        F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0))
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field_name"), F.lower(trimmed(F.col(f"_f{i}"))).alias("term")) for i, f in enumerate(fields)])
    )
    words = (
        base.select("_rec", pairs.alias("_t"))
        .select("_rec", "_t.*")
        .where("term <> ''")
        .groupBy("field_name", "term", word)
        .agg(F.bit_or(bit).alias("_bits"), F.count("*").alias("_n"))
    )
    return (
        words.groupBy("field_name", "term")
        .agg(F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)).alias("n_records"))
        .select(
            "field_name",
            "term",
            "n_rows",
            "n_records",
            F.when(F.col("n_rows") < least_rows, "rare").when(F.col("n_records") * 10 > all_records.scalar() * most_tenths, "common").alias("mark"),
        )
    )
