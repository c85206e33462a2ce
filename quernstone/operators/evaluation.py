"""Match rows, average precision and transitions as relational operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.matching import greedy_pairs
from quernstone.session import write_stage


def match_rows_by_track(gt: DataFrame, preds: DataFrame) -> DataFrame:
    """(seq, frame, cond, gt_id, pred_id, cls, score, is_tp, is_fp, is_fn): fates of labels and false detections.

    Every label with a track is judged under every condition seen in its frame: it is hit if a detection that is no
    false positive names its track, with the best score of those. Detections marked as false positives stand alone.
    A (frame, condition) without detections judges nothing. Labels sharing a track in a frame count once.
    """
    keys = ["seq", "frame"]
    p = preds.where("seq IS NOT NULL AND frame IS NOT NULL AND cond IS NOT NULL")
    one = (
        gt.where("trk_id IS NOT NULL AND seq IS NOT NULL AND frame IS NOT NULL")
        .groupBy(*keys, "trk_id")
        .agg(F.min(F.struct("gt_id", "cls")).alias("o"))
        .select(*keys, "trk_id", "o.gt_id", "o.cls")
    )
    seen = p.select(*keys, "cond").distinct()
    best = (
        p.where("trk_id IS NOT NULL AND NOT is_fp")
        .groupBy(*keys, "cond", "trk_id")
        .agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
        .withColumn("hit", F.lit(True))
    )
    fates = one.join(seen, keys).join(best, [*keys, "cond", "trk_id"], "left")
    hit = F.coalesce("hit", F.lit(False))
    labels = fates.select(
        *keys, "cond", "gt_id", F.lit(None).cast("bigint").alias("pred_id"), "cls", F.coalesce("score", F.lit(0.0)).alias("score"),
        hit.alias("is_tp"), F.lit(False).alias("is_fp"), (~hit).alias("is_fn"),
    )
    false_ = p.where("is_fp").select(
        *keys, "cond", F.lit(None).cast("bigint").alias("gt_id"), "pred_id", "cls", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.lit(False).alias("is_tp"), F.lit(True).alias("is_fp"), F.lit(False).alias("is_fn"),
    )
    return labels.unionByName(false_)


def _earliest(k: Column, points: int) -> Column:
    return F.greatest(F.lit(0), F.ceil((k * F.col("num_gt") * 2 / F.lit(points - 1) - 3) / 2))


def recall_picks(n: DataFrame, by: Sequence[str], points: int = 41) -> DataFrame:
    """(by, i): which true detections (0: best score) are recall samples, from (by, num_gt, num_tp).

    The k-th threshold is the true detection number i_k = max(i_(k-1) + 1, ceil((k n / (points - 1) * 2 - 3) / 2)), in closed
    form, and the last true detection always is one.
    """
    k = F.col("_k")
    upto = Window.partitionBy(*by).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)  # ``points`` rows
    first = _earliest(k, points)
    every = n.where("num_tp > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    i = F.least(k + F.max(first - k).over(upto), F.col("num_tp") - 1)
    return every.withColumn("i", i).select(*by, "i").distinct()


def average_precision(rows: DataFrame, by: Sequence[str], points: int = 41, every: int = 1) -> DataFrame:
    """(by, num_gt, num_tp, num_fp, ap): interpolated average precision of match rows; groups without labels are left out.

    The match rows are summed once per group and distinct score and that small table is written, so that nothing behind it
    sees single detections or computes the matches again. The recall samples are :func:`recall_picks`. Precision at a
    threshold is over all detections of at least its score, its envelope the running maximum from the right. ``every``
    keeps each n-th sample only (41 points with every fourth is the older 11-point form).
    """
    by = list(by)
    count = {c: F.count(F.when(F.col(c), 1)).alias(n) for c, n in (("is_tp", "tp"), ("is_fp", "fp"), ("is_fn", "fn"))}
    scores = write_stage(rows.groupBy(*by, F.when(F.col("is_tp") | F.col("is_fp"), F.col("score")).alias("score")).agg(*count.values()), "scores")
    n = scores.groupBy(*by).agg(F.sum(F.col("tp") + F.col("fn")).alias("num_gt"), F.sum("tp").alias("num_tp"), F.sum("fp").alias("num_fp")).where("num_gt > 0")
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = scores.where("tp + fp > 0").select(*by, "tp", F.sum("tp").over(down).alias("ctp"), F.sum("fp").over(down).alias("cfp")).where("tp > 0")
    # each pick falls into the one score step whose true detections hold number i
    at = recall_picks(n, by, points).join(steps, by).where((F.col("i") < F.col("ctp")) & (F.col("i") >= F.col("ctp") - F.col("tp")))
    right = Window.partitionBy(*by).orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    envelope = at.withColumn("p", F.max(F.col("ctp") / (F.col("ctp") + F.col("cfp"))).over(right))
    kept = envelope.withColumn("j", F.row_number().over(Window.partitionBy(*by).orderBy("i")) - 1).where(F.col("j") % every == 0)
    ap = kept.groupBy(*by).agg((F.sum("p") / ((points - 1) // every + 1) * 100).alias("ap"))
    return n.join(ap, by, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


#: Difficulty levels: greatest occlusion, greatest truncation, least height in pixels; fixed values of the benchmark.
DIFFICULTIES = ((0, 0.15, 40.0), (1, 0.3, 25.0), (2, 0.5, 25.0))


def _ignored(occluded: Column, truncated: Column, height: Column, most_occluded: Column, most_truncated: Column, least_height: Column) -> tuple[Column, Column]:
    """Whether a difficulty ignores a label, and a detection."""
    height = F.coalesce(height, F.lit(0.0))
    return (occluded > most_occluded) | (truncated > most_truncated) | (height <= least_height), height < least_height


def ignored_bits(occluded: Column, truncated: Column, height: Column) -> dict[str, Column]:
    """``off_label``, ``off_found``: a bit for each difficulty that ignores a label, and a detection."""
    each = [[F.when(off, 1 << i).otherwise(0) for off in _ignored(occluded, truncated, height, *map(F.lit, limits))] for i, limits in enumerate(DIFFICULTIES)]
    return {k: reduce(Column.bitwiseOR, bits) for k, bits in zip(("off_label", "off_found"), zip(*each))}


def graded_precision(labels: DataFrame, found: DataFrame, pairs: DataFrame, by: Sequence[str], frame: Sequence[str], levels: dict[str, Sequence[float]], points: int = 41) -> DataFrame:
    """(by, difficulty, metric, level, num_gt, ap, ap11, aos): average precision by difficulty, overlap metric and least overlap.

    ``labels``: by, frame, gt_id, occluded, truncated, height; ``found``: by, frame, pred_id, score, height; ``pairs``: by,
    frame, metric, gt_id, pred_id, overlap, the label's order ``g_line``, the detection's order ``p_line`` and ``turn``, the
    difference of their observation angles. Labels beyond a difficulty and detections lower than its least height are
    ignored: they count neither way, but may be matched.

    First pass: labels in order take the free detection of the highest score that overlaps them by more than the level; the
    scores of true ones give the thresholds (:func:`recall_picks`). Second pass at each threshold: labels take the free
    counted detection of the largest overlap, else the first ignored one; what is left over is false. Precision and
    orientation similarity are made to fall along recall and averaged over ``points`` (``ap11``: every fourth).
    """
    by, frame = list(by), list(frame)
    c = F.col
    grade = F.explode(F.array(*[F.struct(F.lit(i).alias("difficulty"), F.lit(o).alias("_occ"), F.lit(t).alias("_trunc"), F.lit(h).alias("_least")) for i, (o, t, h) in enumerate(DIFFICULTIES)]))
    off_label, off_found = _ignored(c("occluded"), c("truncated"), c("height"), c("_occ"), c("_trunc"), c("_least"))
    graded = labels.select("*", grade.alias("_g")).select("*", "_g.*").select(*by, *frame, "gt_id", "difficulty", off_label.cast("int").alias("_ig"))
    graded_found = found.select("*", grade.alias("_g")).select("*", "_g.*").select(*by, *frame, "pred_id", "score", "difficulty", off_found.cast("int").alias("_id"))
    wanted = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(v)).alias("level")) for m, vs in levels.items() for v in vs]))
    met = pairs.withColumn("_w", wanted).where("metric = _w.metric AND overlap > _w.level").withColumn("level", c("_w.level")).drop("_w")
    met = write_stage(met.join(graded, [*by, *frame, "gt_id"]).join(graded_found, [*by, *frame, "pred_id", "difficulty"]), "graded")

    keys = [*by, "difficulty", "metric", "level"]
    one = greedy_pairs(met, [*keys, *frame], "gt_id", "pred_id", [c("g_line")], [F.desc("score"), c("p_line")]).where("_ig = 0 AND _id = 0")
    scores = one.groupBy(*keys, "score").agg(F.count("*").alias("tp"))
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = scores.withColumn("ctp", F.sum("tp").over(down))
    n_gt = graded.where("_ig = 0").groupBy(*by, "difficulty").agg(F.count("*").alias("num_gt"))
    n = steps.groupBy(*keys).agg(F.sum("tp").alias("num_tp")).join(n_gt, [*by, "difficulty"])
    at = recall_picks(n, keys, points).join(steps, keys).where("i < ctp AND i >= ctp - tp").select(*keys, "i", c("score").alias("thr"))
    at = write_stage(at, "thresholds")  # at most ``points`` rows of each key

    # samples of one threshold have the same matches, which are made once
    two = greedy_pairs(met.join(at.select(*keys, "thr").distinct(), keys).where("score >= thr"), [*keys, "thr", *frame], "gt_id", "pred_id", [c("g_line")], [c("_id"), F.when(c("_id") == 0, -c("overlap")), c("p_line")])
    true = (c("_ig") == 0) & (c("_id") == 0)
    hits = two.groupBy(*keys, "thr").agg(F.count_if(true).alias("tp"), F.count_if(c("_id") == 0).alias("used"), F.sum(F.when(true, (1 + F.cos("turn")) / 2)).alias("alike")).join(at, [*keys, "thr"]).drop("thr")
    # detections of at least each threshold: counted by the number of thresholds they reach, then summed from the lowest
    reached = at.groupBy(*keys).agg(F.collect_list("thr").alias("_thr"))
    per_score = graded_found.where("_id = 0").groupBy(*by, "difficulty", "score").agg(F.count("*").alias("_n"))
    parts = per_score.join(reached, [*by, "difficulty"]).groupBy(*keys, F.size(F.filter("_thr", lambda t: t <= c("score"))).alias("_below")).agg(F.sum("_n").alias("_n"))
    low = Window.partitionBy(*keys).orderBy(F.desc("i"))
    ranked = at.withColumn("_need", F.row_number().over(low))
    enough = ranked.join(parts, keys).where("_below >= _need").groupBy(*keys, "i").agg(F.sum("_n").alias("enough"))
    line = hits.join(enough, [*keys, "i"]).withColumn("_all", c("tp") + c("enough") - c("used"))
    right = Window.partitionBy(*keys).orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("i")) - 1
    line = line.select(*keys, F.max(F.try_divide("tp", "_all")).over(right).alias("p"), F.max(F.try_divide("alike", "_all")).over(right).alias("o"), place.alias("j"))
    ap = line.groupBy(*keys).agg(
        (F.sum("p") / points * 100).alias("ap"), (F.sum(F.when(c("j") % 4 == 0, c("p"))) / ((points - 1) // 4 + 1) * 100).alias("ap11"), (F.sum("o") / points * 100).alias("aos")
    )
    every = n_gt.withColumn("_w", wanted).select(*by, "difficulty", "_w.*", "num_gt")
    return every.join(ap, keys, "left").na.fill(0.0, ["ap", "ap11", "aos"])


def equal_scores_precision(counts: DataFrame, points: int = 41) -> DataFrame:
    """``counts`` with ``ap`` as of :func:`graded_precision` where all detections have one score: every recall sample has the one precision.

    ``counts``: num_gt, counted, first, tp, used, as of :func:`quernstone.operators.rivals.own_counts`. How many different samples there are is
    counted along the row, without a row for each.
    """
    c = F.col
    start = F.struct(F.lit(0).cast("bigint").alias("lead"), F.lit(0).alias("n"))

    def step(state: Column, k: Column) -> Column:
        lead = F.greatest(state["lead"], _earliest(k, points) - k)
        return F.struct(lead.alias("lead"), (state["n"] + (k + lead < c("first") - 1).cast("int")).alias("n"))

    # samples rise by one at least up to the last true detection, which is one
    samples = F.aggregate(F.sequence(F.lit(0), F.lit(points - 1)), start, step, lambda state: state["n"] + 1)
    ap = samples * F.try_divide("tp", c("tp") + c("counted") - c("used")) / points * 100
    return counts.withColumn("ap", F.coalesce(F.when(c("first") > 0, ap), F.lit(0.0)))


def transition_rates(rows: DataFrame, by: Sequence[str], clean: str) -> DataFrame:
    """Counts of stable, missed, recovered and never found labels per condition against ``clean``, and their rates.

    Only labels judged under both conditions count. Rates with an empty denominator are null.
    """
    base = rows.where(F.col("cond") == clean).groupBy("gt_id").agg(F.bool_or("is_tp").alias("before"))
    both = rows.where(F.col("cond") != clean).select("gt_id", "cond", *by, F.col("is_tp").alias("after")).join(base, "gt_id")
    kind = F.when(F.col("before"), F.when(F.col("after"), "stable").otherwise("induced_miss")).otherwise(F.when(F.col("after"), "induced_recovery").otherwise("baseline_failure"))
    names = ["stable", "induced_miss", "induced_recovery", "baseline_failure"]
    n = both.withColumn("t", kind).groupBy("cond", *by).pivot("t", names).count().na.fill(0, names)
    kept, lost = F.col("stable"), F.col("induced_miss")
    return (
        n.withColumn("total", sum((F.col(k) for k in names[1:]), F.col(names[0])))
        .withColumn("miss_rate", F.try_divide(lost, kept + lost))
        .withColumn("recovery_rate", F.try_divide(F.col("induced_recovery"), F.col("baseline_failure") + F.col("induced_recovery")))
        .withColumn("churn", F.try_divide(lost + F.col("induced_recovery"), F.col("total")))
        .withColumn("net_retention", F.try_divide(kept + F.col("induced_recovery"), kept + lost))
    )


def checked_transitions(rates: DataFrame) -> DataFrame:
    """The rates of :func:`transition_rates` unchanged; a row whose four counts do not add up to its total is an error."""
    parts = F.col("stable") + F.col("induced_miss") + F.col("induced_recovery") + F.col("baseline_failure")
    return rates.withColumn("total", F.when(parts == F.col("total"), F.col("total")).otherwise(F.raise_error(F.lit("transition counts do not add up")).cast("bigint")))
