"""Splits that keep related records together."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.components import connected_components, star_edges
from quernstone.session import write_stage


def differenced(tuples: np.ndarray) -> np.ndarray:
    """Final slot of every slot of every tuple (rows), by largest differencing.

    The two tuples of the widest spread are combined, the heaviest slot of one with the lightest of the other, until one
    is left; so extreme weights cancel. Ties go by row.
    """
    sums = {i: row for i, row in enumerate(tuples)}
    heap = [(float(row.min() - row.max()), i) for i, row in sums.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        down, up = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        new = len(tuples) + len(made)
        sums[new] = sums.pop(a)[down] + sums.pop(b)[up]
        made.append((new, a, down, b, up))
        heapq.heappush(heap, (float(sums[new].min() - sums[new].max()), new))
    slots = tuples.shape[1]
    place = {i: np.arange(slots) for i in sums}
    for new, a, down, b, up in reversed(made):
        at = place.pop(new)
        for part, order in ((a, down), (b, up)):
            place[part] = np.empty(slots, dtype=np.int64)
            place[part][order] = at
    return np.array([place[i] for i in range(len(tuples))], dtype=np.int64).reshape(len(tuples), slots)


def balanced_bins(weights: DataFrame, node: str, weight: str, bins: int, *, cell_rows: int = 100_000, fan: int = 500) -> DataFrame:
    """(node, bin, weight) by largest differencing into ``bins`` nearly equal bins.

    The nodes are dealt by hash into cells of about ``cell_rows``. A cell deals its nodes, heaviest first, into tuples of
    ``bins`` slots and combines them to one (:func:`differenced`). What leaves a cell is its one tuple; ``fan`` of those
    are combined likewise, level by level, until one is left: a thousand million nodes take three levels. A node keeps
    its slot through small joins. Ties go by node. An empty input gives an empty result.
    """
    rows = write_stage(weights.select(F.col(node).alias("_node"), F.col(weight).cast("double").alias("_w")), "weights")
    cells = max(1, math.ceil(rows.count() / cell_rows))

    def deal(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_w", "descending"), ("_node", "ascending")])
        w = np.zeros(-(-max(t.num_rows, 1) // bins) * bins)
        w[: t.num_rows] = t.column("_w").to_numpy()
        return t.append_column("_slot", pa.array(differenced(w.reshape(-1, bins)).ravel()[: t.num_rows].astype(np.int32)))

    def combine(t: pa.Table) -> pa.Table:
        cell, slot = t.column("_cell").to_numpy(), t.column("_slot").to_numpy()
        names, row = np.unique(cell, return_inverse=True)
        w = np.zeros((len(names), bins))
        w[row, slot] = t.column("_w").to_numpy()
        return t.select(["_cell", "_slot", "_up"]).append_column("_to", pa.array(differenced(w)[row, slot].astype(np.int32)))

    kind = rows.schema["_node"].dataType.simpleString()
    celled = rows.withColumn("_cell", F.pmod(F.xxhash64("_node"), F.lit(cells)))
    members = write_stage(celled.groupBy("_cell").applyInArrow(deal, f"_node {kind}, _w double, _cell bigint, _slot int"), "slots")
    while cells > 1:
        sums = members.groupBy("_cell", "_slot").agg(F.sum("_w").alias("_w")).withColumn("_up", F.floor(F.col("_cell") / fan))
        moved = sums.groupBy("_up").applyInArrow(combine, "_cell bigint, _slot int, _up bigint, _to int")
        members = write_stage(members.join(moved, ["_cell", "_slot"]).select("_node", "_w", F.col("_up").alias("_cell"), F.col("_to").alias("_slot")), "slots")
        cells = math.ceil(cells / fan)
    return members.select(F.col("_node").alias(node), F.col("_slot").alias("bin"), F.col("_w").alias(weight))


def deal_bins(loads: list[tuple[int, float]], targets: list[tuple[str, float]]) -> dict[int, str]:
    """Give whole bins to splits: heaviest bin first, each to the split farthest below its target."""
    total = sum(w for _, w in loads)
    share = sum(t for _, t in targets) or 1.0
    want = {name: total * t / share for name, t in targets}
    out = {}
    for b, w in sorted(loads, key=lambda x: (-x[1], x[0])):
        name = min(want, key=lambda s: (-want[s], s))
        out[b] = name
        want[name] -= w
    return out


def grouped_splits(
    records: DataFrame,
    id_col: str,
    entity: str,
    ties: DataFrame,
    tie_entity: str,
    tie_key: str,
    targets: DataFrame,
    split_col: str = "split_name",
    share_col: str = "share_permille",
    *,
    bins: int = 100,
    loose: int = 64,
) -> DataFrame:
    """(id, entity_no, group_entity, group_size, split) of every record, related records in one split.

    Entities that share a key in ``ties`` (entity, key) are tied, and ties carry on: the groups are connected
    components, found without listing pairs. A group weighs its records. The groups go into ``bins`` equal bins by
    largest differencing (:func:`balanced_bins`); whole bins are then dealt to the splits by target share. Only the
    at most ``bins`` bin weights and the small table of targets reach the driver.

    Defined results: ids count once, a null id is left out; an entity without ties is its own group; a record with a
    null entity belongs to no group and is dealt with ``loose`` hash cells, its group columns null; null keys tie
    nothing; a record table without rows gives an empty result; other columns are never read.
    """
    rec = (
        records.select(F.col(id_col).alias("_id"), F.col(entity).alias("_e"))
        .where(F.col("_id").isNotNull())
        .dropDuplicates(["_id"])
    )
    comp = connected_components(star_edges(ties, tie_entity, tie_key))
    sizes = comp.groupBy("component").agg(F.count("*").alias("_size"))
    # one row per entity: its group and the group's size
    group_of = write_stage(comp.join(sizes, "component").select(F.col("node").alias("_e"), F.col("component").alias("_g"), "_size"), "groups")
    per_entity = rec.groupBy("_e").agg(F.count("*").alias("_n"))
    loads = (
        per_entity.where("_e IS NOT NULL")
        .join(group_of, "_e", "left")
        .groupBy(F.coalesce("_g", "_e").cast("string").alias("_group"))
        .agg(F.sum("_n").alias("_n"))
    )
    cell = F.concat(F.lit("loose "), F.pmod(F.xxhash64("_id"), F.lit(loose)).cast("string"))
    loose_loads = rec.where("_e IS NULL").groupBy(cell.alias("_group")).agg(F.count("*").alias("_n"))
    placed = balanced_bins(loads.unionByName(loose_loads), "_group", "_n", bins)
    weights = [(r[0], r[1]) for r in placed.groupBy("bin").agg(F.sum("_n")).collect()]  # at most `bins` rows
    wanted = [(r[0], float(r[1])) for r in targets.select(split_col, share_col).where(f"{share_col} > 0").collect()]
    dealt = deal_bins(weights, wanted) if wanted else {}
    spark = records.sparkSession
    dealt_df = spark.createDataFrame(list(dealt.items()), "bin int, split string")
    split_of = placed.join(F.broadcast(dealt_df), "bin", "left").select("_group", "split")
    tagged = rec.join(group_of, "_e", "left").withColumn(
        "_group", F.when(F.col("_e").isNull(), cell).otherwise(F.coalesce("_g", "_e").cast("string"))
    )
    return tagged.join(split_of, "_group", "left").select(
        F.col("_id").alias(id_col),
        F.col("_e").alias("entity_no"),
        F.coalesce("_g", "_e").alias("group_entity"),
        F.when(F.col("_e").isNotNull(), F.coalesce("_size", F.lit(1))).alias("group_size"),
        "split",
    )
