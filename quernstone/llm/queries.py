"""Queries of the training-data problems over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.keys import exact_seconds, whole_number
from quernstone.llm import sql
from quernstone.llm.bpe import token_ids
from quernstone.llm.mixing import mix_sources
from quernstone.llm.nearest import nearest_in_time
from quernstone.llm.sampling import sample_by_targets
from quernstone.llm.spans import shared_spans
from quernstone.llm.splits import grouped_splits
from quernstone.llm.terms import term_frequencies
from quernstone.llm.topn import top_per_group
from quernstone.session import corpus, table


def p1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ground-truth row with its recording group and its split."""
    ties = table(spark, sf_dir, "frame_meta").select(whole_number(F.col("seq")).alias("e"), exact_seconds(F.col("tstamp")).alias("k"))
    gt = table(spark, sf_dir, "gt_lines").select("gt_id", whole_number(F.col("seq")).alias("e"))
    return grouped_splits(gt, "gt_id", "e", ties, "e", "k", table(spark, sf_dir, "split_targets"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sequences that are tied to another sequence."""
    return p1_split(spark, sf_dir).where("group_size > 1 AND split IS NOT NULL").select("gt_id", F.col("group_entity").alias("group_seq"))


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sample_by_targets(
        table(spark, sf_dir, "frame_desc"),
        "desc_id",
        ["road_type", "climate"],
        table(spark, sf_dir, "tag_alias"),
        table(spark, sf_dir, "sample_targets"),
    )


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled frames."""
    return _sample(spark, sf_dir)[0]


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota and rows taken of every target category."""
    return _sample(spark, sf_dir)[1]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories whose target could not be met."""
    return _sample(spark, sf_dir)[1].where("exhausted").select("road_type", "climate")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the three fields with its rows, sequences and mark."""
    gt = term_frequencies(table(spark, sf_dir, "gt_lines"), "gt_id", "seq", ["cls_kw"])
    desc = term_frequencies(table(spark, sf_dir, "frame_desc"), "desc_id", "seq", ["road_type", "climate"])
    return gt.unionByName(desc)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return p3_terms(spark, sf_dir).where("mark IS NOT NULL").select("field_name", "term", "mark")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lidar scan with its camera image, or none."""
    return nearest_in_time(
        table(spark, sf_dir, "lidar_frames"), "scan_id", "timestamp_pc", table(spark, sf_dir, "camera_frames"), "image_id", "timestamp_img"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs alone."""
    return p5_pairs(spark, sf_dir).where("image_id IS NOT NULL").select("scan_id", "image_id")


def p6_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best detections of every sequence, frame and condition with their places."""
    return top_per_group(
        table(spark, sf_dir, "pred_lines"),
        "pred_id",
        [whole_number(F.col("seq")), whole_number(F.col("frame")), F.lower(F.trim("condition"))],
        F.col("score"),
        F.col("line_idx"),
        3,
        keep=F.coalesce(F.col("cls_kw") != "dummy", F.lit(True)),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their ids."""
    return p6_top(spark, sf_dir).select("pred_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return token_ids(corpus(spark, sf_dir, "documents", "doc_id", "text"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(corpus(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "site"), table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mixed corpus."""
    return _mix(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and real share of every source."""
    return _mix(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their target."""
    return _mix(spark, sf_dir)[1].where("exhausted").select("source")


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands verbatim in another one, in spans of at least 200 code points."""
    return shared_spans(corpus(spark, sf_dir, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share such a span."""
    return p9_spans(spark, sf_dir).where("shared_chars > 0").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_split, p2_found, p2_sample, p2_report, p3_found, p3_terms, p5_found, p5_pairs, p6_found, p6_top, p7_ids, p8_found, p8_mix, p8_report, p9_found, p9_spans)}
SQL = sql.SQL
