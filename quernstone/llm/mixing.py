"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.bpe import RANKS, token_counts
from quernstone.llm.sampling import slot_of
from quernstone.session import write_stage


def share_out(children: DataFrame, parent: list[str], budget: str, weight: str, cap: str, out: str) -> DataFrame:
    """Add ``out``: each child's part of its parent's ``budget``, by weight and never above its cap.

    Children fill up in the order of cap / weight; what the full ones cannot take goes to the others by weight. The
    part is exact in closed form: running sums tell which children are full, the rest share what is left.
    """
    ratio = F.col(cap) / F.col(weight)
    upto = Window.partitionBy(*parent).orderBy("_ratio", "_leaf").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*parent)
    full = (
        children.withColumn("_ratio", F.when(F.col(weight) > 0, ratio).otherwise(F.lit(0.0)))
        .withColumn("_cap_upto", F.sum(cap).over(upto))
        .withColumn("_weight_after", F.sum(weight).over(whole) - F.sum(weight).over(upto))
        .withColumn("_full", F.col("_cap_upto") + F.col("_ratio") * F.col("_weight_after") <= F.col(budget) * (1 + 1e-12))
    )
    open_weight = F.sum(F.when(~F.col("_full"), F.col(weight))).over(whole)
    left = F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col(cap))).over(whole), F.lit(0.0))
    part = F.when(F.col("_full"), F.col(cap)).otherwise(F.least(F.col(cap), F.greatest(left, F.lit(0.0)) * F.col(weight) / open_weight))
    return full.withColumn(out, part).drop("_ratio", "_cap_upto", "_weight_after", "_full")


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    language: str = "lang",
    site: str = "site",
    *,
    slots: int = 1024,
    seed: int = 29,
    ranks: str = RANKS,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report): how often each document is used so that every source has its target share of the tokens.

    ``targets``: source, weight_permille, max_repeats. The mixed corpus has as many tokens as all documents of the
    listed sources. The weights go down a tree domain - language - source: the domain is the last label of the site,
    the language the part of ``lang`` before "-" (``und`` if null), and a leaf is what a source has there; a source's
    weight is propagated to its leaves by their tokens. Budgets are shared out from the root (:func:`share_out`) under
    the cap max_repeats * tokens, so what a leaf cannot give is taken over by its siblings of the same language, then
    by the domain's other languages, then by other domains.

    A leaf's budget is spent in epochs: whole passes over its documents, then the token-prefix of one more pass in
    the seeded order of that epoch. The order is a hash cut into ``slots`` ranges with summed tokens; only the slot in
    which the budget ends is ordered, so a leaf holding a third of all rows is never gathered. The prefix stops before
    the document that would exceed the budget.

    mix: (id, source, repeats >= 1). report: one row per target source with its tokens, target, tokens taken, shares in
    permille and whether it is exhausted (max_repeats * tokens < its target).

    Defined results: a source counts in lower case without outer blanks; unlisted and null sources do not take part;
    null and empty texts have no tokens and are used in whole passes only; ids count once, null ids are left out; a
    listed source without documents is exhausted; repeated target rows keep their largest values; without documents
    every count is 0 and nothing is exhausted; other columns are never read.
    """
    goals = targets.groupBy(F.lower(F.trim("source")).alias("_src")).agg(
        F.max("weight_permille").alias("weight_permille"), F.max("max_repeats").alias("max_repeats")
    )
    lang = F.coalesce(F.nullif(F.lower(F.split(F.trim(language), "[-_]")[0]), F.lit("")), F.lit("und"))
    domain = F.coalesce(F.nullif(F.lower(F.element_at(F.split(F.trim(site), "[.]"), -1)), F.lit("")), F.lit("none"))
    listed = docs.select(
        F.col(id_col).alias("_id"), F.lower(F.trim(source)).alias("_src"), lang.alias("_lang"), domain.alias("_dom"), F.col(text).alias("_text")
    ).join(goals.select("_src"), "_src", "left_semi")
    counted = token_counts(listed.where("_id IS NOT NULL"), "_text", "_n", ranks)
    sized = write_stage(counted.dropDuplicates(["_id"]).withColumn("_leaf", F.concat_ws("\t", "_dom", "_lang", "_src")), "mix")

    # leaves, budgets and ends are small summaries: written once, so that later plans know how small they are
    leaves = write_stage(sized.groupBy("_leaf", "_dom", "_lang", "_src").agg(F.sum("_n").cast("double").alias("_tokens")), "mix-leaves")
    per_source = leaves.groupBy("_src").agg(F.sum("_tokens").alias("_have"))
    total = leaves.agg(F.coalesce(F.sum("_tokens"), F.lit(0.0)))
    tree = (
        leaves.where("_tokens > 0")
        .join(per_source, "_src")
        .join(goals, "_src")
        .withColumn("_total", total.scalar())
        .withColumn("_w", F.col("weight_permille") * F.col("_tokens") / F.col("_have"))
        .withColumn("_cap", F.col("max_repeats") * F.col("_tokens"))
        .where("_w > 0 AND _cap > 0")
    )
    # weight of a source without documents stays with the root and is shared by all domains
    node = tree
    budget, parent = "_total", []
    for level, out in (("_dom", "_b1"), ("_lang", "_b2")):
        keys = [*parent, level]
        level_rows = node.groupBy(*keys).agg(F.sum("_w").alias("_lw"), F.sum("_cap").alias("_lcap"), F.first(budget).alias(budget))
        level_rows = level_rows.withColumn("_leaf", F.concat_ws("\t", *keys))
        shared = share_out(level_rows, parent or ["_root"], budget, "_lw", "_lcap", out) if parent else share_out(
            level_rows.withColumn("_root", F.lit(0)), ["_root"], budget, "_lw", "_lcap", out
        )
        node = node.join(shared.select(*keys, out), keys)
        budget, parent = out, keys
    budgets = share_out(node, parent, budget, "_w", "_cap", "_budget").select(
        "_leaf",
        "_src",
        (F.col("_budget") >= F.col("_cap") * (1 - 1e-12)).alias("_used_up"),
        F.floor(F.col("_budget") / F.col("_tokens") + 1e-9).cast("int").alias("_full"),
        (F.col("_budget") - F.floor(F.col("_budget") / F.col("_tokens") + 1e-9) * F.col("_tokens")).alias("_rest"),
    )
    budgets = write_stage(budgets.withColumn("_rest", F.greatest(F.floor(F.col("_rest") + 1e-6), F.lit(0)).cast("bigint")), "mix-budgets")
    used_up = budgets.groupBy("_src").agg(F.bool_and("_used_up").alias("_used_up"))
    budgets = budgets.drop("_src", "_used_up")
    order = F.xxhash64(F.lit(seed), "_full", "_id")
    placed = sized.join(budgets, "_leaf").withColumn("_p", order).withColumn("_s", slot_of(F.col("_p"), slots))
    sums = placed.groupBy("_leaf", "_s").agg(F.sum("_n").alias("_sn"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy("_leaf").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    left = sums.select("_leaf", "_s", "_sn", (F.col("_rest") - F.coalesce(F.sum("_sn").over(upto), F.lit(0))).alias("_left"))
    # one row per leaf: the slot in which its budget ends and what is left of the budget there
    ends = write_stage(left.where("_sn > _left").groupBy("_leaf").agg(F.min(F.struct("_s", "_left")).alias("_end")), "mix-ends")
    both = placed.join(ends, "_leaf", "left").withColumn("_at_end", F.coalesce(F.col("_s") == F.col("_end._s"), F.lit(False)))
    inside = Window.partitionBy("_leaf", "_s").orderBy("_p", "_id").rowsBetween(Window.unboundedPreceding, 0)
    easy = both.where("NOT _at_end").withColumn("_more", F.coalesce(F.col("_s") < F.col("_end._s"), F.lit(True)).cast("int"))
    edge = both.where("_at_end").withColumn("_more", (F.sum("_n").over(inside) <= F.col("_end._left")).cast("int"))
    used = easy.unionByName(edge).withColumn("_more", F.when(F.col("_n") > 0, F.col("_more")).otherwise(0))
    mix = write_stage(used.withColumn("repeats", F.col("_full") + F.col("_more")).where("repeats > 0").select("_id", "_src", "_n", "repeats"), "mix-used")

    taken = mix.groupBy("_src").agg(F.sum(F.col("_n") * F.col("repeats")).alias("_taken"))
    all_taken = taken.agg(F.coalesce(F.sum("_taken"), F.lit(0)))
    report = (
        goals.join(per_source, "_src", "left")
        .join(taken, "_src", "left")
        .join(used_up, "_src", "left")
        .withColumn("_total", total.scalar())
        .withColumn("_all", all_taken.scalar())
        .select(
            F.col("_src").alias("source"),
            "weight_permille",
            "max_repeats",
            F.coalesce("_have", F.lit(0.0)).cast("bigint").alias("tokens"),
            (F.col("weight_permille") * F.col("_total") / 1000).alias("target_tokens"),
            F.coalesce("_taken", F.lit(0)).alias("taken_tokens"),
            F.try_divide(F.coalesce("_taken", F.lit(0)) * 1000.0, F.col("_all")).alias("taken_permille"),
            # all its leaves are at their cap, and the cap is what keeps it below its target
            (F.coalesce("_used_up", F.lit(True)) & (F.col("max_repeats") * F.coalesce("_have", F.lit(0.0)) * 1000 < F.col("weight_permille") * F.col("_total"))).alias("exhausted"),
        )
    )
    return mix.select(F.col("_id").alias(id_col), F.col("_src").alias("source"), "repeats"), report
