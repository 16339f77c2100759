"""Iterative graph operators: components of a mask, one-to-one nearest matching, hierarchy walks.

Every round is a Spark job over the whole edge table, and its result goes to the shared
checkpoint folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tilescape.session import cut


def label_components(cells: DataFrame, axes: Sequence[str], tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Add `component`, the smallest run (row, start) of the cell's face-connected component.

    Cells are first compressed to runs along the last axis; runs touching along another
    axis become edges, and the edges are contracted until only roots remain.
    """
    tile, axes = list(tile), list(axes)
    run_axis, others = axes[-1], axes[:-1]
    along = Window.partitionBy(*tile, *others).orderBy(run_axis)
    fresh = F.coalesce(F.lag(run_axis).over(along) != F.col(run_axis) - 1, F.lit(True))
    runs = (cells.withColumn("_fresh", fresh)
            .withColumn("_start", F.last(F.when(F.col("_fresh"), F.col(run_axis)), True).over(
                along.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("node", F.struct(*others, F.col("_start").alias("start")))
            .drop("_fresh", "_start"))
    runs = cut(runs)

    edges = None
    for axis in others:
        rest = [a for a in axes if a != axis]
        w = Window.partitionBy(*tile, *rest).orderBy(axis)
        pairs = (runs.select(*tile, F.col("node").alias("a"), F.lag("node").over(w).alias("b"),
                             (F.col(axis) - F.lag(axis).over(w)).alias("_step"))
                 .filter(F.col("_step") == 1).select(*tile, "a", "b"))
        edges = pairs if edges is None else edges.unionByName(pairs)
    edges = edges.distinct()
    edges = cut(edges.unionByName(edges.select(*tile, F.col("b").alias("a"), F.col("a").alias("b"))))

    # Contract: hook every node to its smallest neighbour, shorten the pointers, and keep only
    # the edges between different roots. Edges shrink every round until none is left.
    steps = []
    while not edges.isEmpty():
        parent = edges.groupBy(*tile, F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root"))
        for _ in range(2):
            up = parent.select(*tile, F.col("node").alias("root"), F.col("root").alias("_up"))
            parent = parent.join(up, [*tile, "root"]).select(*tile, "node", F.col("_up").alias("root"))
        parent = cut(parent)
        steps.append(parent)
        end = lambda c: parent.select(*tile, F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        edges = cut(edges.join(end("a"), [*tile, "a"]).join(end("b"), [*tile, "b"])
                    .filter(F.col("_a") != F.col("_b"))
                    .select(*tile, F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())

    labelled = runs.withColumn("component", F.col("node")).drop("node")
    for parent in steps:
        moved = parent.select(*tile, F.col("node").alias("component"), F.col("root").alias("_root"))
        labelled = (labelled.join(moved, [*tile, "component"], "left")
                    .withColumn("component", F.coalesce("_root", "component")).drop("_root"))
    return labelled


def component_stats(cells: DataFrame, value: str, tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Area, highest, lowest and range per component."""
    return (cells.groupBy(*tile, "component")
            .agg(F.count(F.lit(1)).alias("area"), F.max(value).alias("top"), F.min(value).alias("low"),
                 (F.max(value) - F.min(value)).alias("span")))


#: Candidate pairs of one component that a task settles in one pass; larger components go on by rounds.
COMPONENT_PAIRS = 1_000_000
#: Rounds of proposals between two splits into components.
PROPOSAL_ROUNDS = 2


def _linked_seekers(pairs: DataFrame, seeker: str, target: str) -> DataFrame:
    """(seeker, `_component`): the lowest seeker linked to it through shared targets.

    Nodes hook to their smallest neighbour, pointers are doubled until they end, and roots
    are contracted. Every step at least halves the nodes, and a chain takes a logarithmic
    number of doublings.
    """
    lowest = pairs.groupBy(target).agg(F.min(seeker).alias("b"))
    edges = cut(pairs.select(F.col(seeker).alias("a"), target).join(lowest, target).filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    labels = pairs.select(seeker, F.col(seeker).alias("_component")).distinct()
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent, moved = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root"))), True
        while moved:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            jumped = cut(parent.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")))
            parent, moved = jumped.drop("_moved"), not jumped.filter("_moved").isEmpty()
        end = lambda c: parent.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        labels = (labels.join(parent.select(F.col("node").alias("_component"), "root"), "_component", "left")
                  .select(seeker, F.coalesce("root", "_component").alias("_component")))
        edges = cut(edges.join(end("a"), "a").join(end("b"), "b").filter(F.col("_a") != F.col("_b"))
                    .select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    return cut(labels)


def _claimed(pairs: DataFrame, seeker: str, target: str, distance: str) -> DataFrame:
    """Pairs won when seekers claim in order. Components do not share targets; a task holds the claims of one at a time."""
    def claim(batches):
        import pyarrow as pa

        component, served, taken = None, None, set()
        for batch in batches:
            won = []
            for own, who, what in zip(*(batch.column(c).to_pylist() for c in ("_component", seeker, target))):
                if own != component:
                    component, served, taken = own, None, set()
                wins = who != served and what not in taken
                if wins:
                    served = who
                    taken.add(what)
                won.append(wins)
            yield batch.filter(pa.array(won, pa.bool_()))

    ordered = pairs.repartition("_component").sortWithinPartitions("_component", seeker, distance, target)
    return ordered.mapInArrow(claim, ordered.schema)


def match_nearest_once(candidates: DataFrame, seeker: str, target: str, distance: str, keep: Sequence[str] = ()) -> DataFrame:
    """One-to-one matching equal to letting seekers pick, in order, their nearest free target.

    In a round every seeker proposes to its nearest remaining target, a target holds its
    lowest seeker, and pairs that can no longer win are dropped. After a few rounds the
    pairs left are split into components of seekers that share targets, and each is settled
    in one pass in seeker order. So a chain of claims does not cost a round for each of its
    links; only components of over COMPONENT_PAIRS pairs go on by rounds. Equal distances
    prefer the lower target. `candidates` holds the pairs within range, each once; ids are
    not null.
    """
    pairs, settled = cut(candidates.select(seeker, target, distance, *keep)), []
    columns = pairs.columns
    while True:
        for _ in range(PROPOSAL_ROUNDS):
            best = F.min(F.struct(F.col(distance), F.col(target)))
            proposals = pairs.groupBy(seeker).agg(best.alias("_b")).select(seeker, F.col(f"_b.{target}").alias(target), F.lit(True).alias("_best"))
            holders = proposals.groupBy(target).agg(F.min(seeker).alias("_holder"))
            judged = cut(pairs.join(holders, target, "left").join(proposals, [seeker, target], "left")
                         .withColumn("_lost", F.coalesce(F.col(seeker) > F.col("_holder"), F.lit(False))))
            if judged.filter("_lost").isEmpty():
                settled.append(judged.filter("_best").select(*columns))
                return _union(settled)
            pairs = judged.filter("not _lost").select(*columns)
        linked = cut(pairs.join(_linked_seekers(pairs, seeker, target), seeker))
        large = linked.groupBy("_component").count().filter(F.col("count") > COMPONENT_PAIRS).drop("count")
        settled.append(cut(_claimed(linked.join(large, "_component", "left_anti"), seeker, target, distance).select(*columns)))
        pairs = cut(linked.join(large, "_component", "left_semi").select(*columns))
        if pairs.isEmpty():
            return _union(settled)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def walk_hierarchy(entries: DataFrame, root, box, max_depth: int = 32) -> DataFrame:
    """Octree keys with points whose cell touches `box`, walking nested hierarchy chunks.

    `entries(chunk, node_key, n_points)`: a positive count is data, 0 is nothing, a negative
    count continues in the chunk named by the key. `box` = (min_x, min_y, max_x, max_y).
    One join per nesting level; the frontier only carries chunk names.
    """
    from tilescape.functions.geo import boxes_touch_xy, octree_bounds

    parts = F.split("node_key", "-")
    number = lambda i: F.get(parts, i).cast("bigint")
    window = F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(box, ("min_x", "min_y", "max_x", "max_y"))])
    near = (entries.withColumns({"d": number(0), "nx": number(1), "ny": number(2), "nz": number(3)})
            .filter((F.col("d") <= max_depth) & (F.col("n_points") != 0))
            .filter(boxes_touch_xy(octree_bounds("d", "nx", "ny", "nz", root), window)))
    near = cut(near.select("chunk", "node_key", "d", "n_points"))
    frontier, found = near.filter(F.col("chunk") == "0-0-0-0"), None
    for _ in range(max_depth + 1):
        here = frontier.filter(F.col("n_points") > 0).select("node_key", "d", "n_points")
        found = here if found is None else found.unionByName(here)
        nested = frontier.filter(F.col("n_points") < 0).select(F.col("node_key").alias("chunk")).distinct()
        frontier = cut(near.join(nested, "chunk", "left_semi"))
        if frontier.isEmpty():
            break
    return found
