"""Exact nearest-k joins by bounds from a pyramid of counts.

Items are counted in nested square cells; a cell is divided into 16 until it holds few items.
Probes are grouped by a grid about as fine as the items are dense. From the top cell down, each
group keeps the cells that can hold one of the k nearest items of its probes: the counts give an
upper bound of the k-th distance, and cells beyond it go. The number of steps is the height of
the pyramid, whatever the distances are. Where a group is so wide for its surroundings (far
from all items, or next to a dense cluster) that many items remain, its probes go down one by
one. Only the items of the last cells are joined with the group's probes, so the pairs per probe are a bounded multiple of k.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tilescape.session import cut

#: Levels of the pyramid, and the halvings of each side from one level to the next.
DEPTH, HALVINGS = 12, 2
#: Items of a cell that is not divided further; a group with more than WIDE items and WIDE_PER_K per k goes down by single probes.
ITEMS_PER_CELL, WIDE, WIDE_PER_K = 64, 1500, 32
_CELL = ["_cls", "_level", "_ix", "_iy"]


class Frame(NamedTuple):
    """The square that the pyramid divides."""
    x: float
    y: float
    size: float


def _frame(points: DataFrame) -> Frame | None:
    """The square around all points; None if there are none."""
    row = points.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")).first()
    if row["x0"] is None:
        return None
    return Frame(row["x0"], row["y0"], max(row["x1"] - row["x0"], row["y1"] - row["y0"]) or 1.0)


def pyramid(points: DataFrame, frame: Frame, few: int) -> tuple[DataFrame, DataFrame]:
    """(points with their last cell, cells): `points` has _cls, _x, _y; cells have _cls, _level, _ix, _iy, n and leaf.

    A cell is last (leaf) if it holds at most `few` points or cannot be divided. Cells below one are left out.
    """
    most = (1 << (DEPTH * HALVINGS)) - 1
    at = lambda c, low: F.greatest(F.lit(0), F.least(F.lit(most), F.floor((F.col(c) - low) / frame.size * (most + 1)))).cast("bigint")
    coded = points.withColumns({"_cx": at("_x", frame.x), "_cy": at("_y", frame.y)})
    finest = ["_cls", "_cx", "_cy"]
    cells = cut(coded.groupBy(*finest).agg(F.count(F.lit(1)).alias("n")))
    above = lambda c: F.expr(f"shiftright({c}, {HALVINGS} * ({DEPTH} - _level))")
    levels = cells.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))).withColumns({"_ix": above("_cx"), "_iy": above("_cy")})
    counts = cut(levels.groupBy(*_CELL).agg(F.sum("n").alias("n")))
    leaf = (F.col("n") <= few) | (F.col("_level") == DEPTH)
    first = (levels.select(*finest, "_level", "_ix", "_iy").join(counts.filter(leaf), _CELL)
             .groupBy(*finest).agg(F.min(F.struct("_level", "_ix", "_iy")).alias("_leaf")))
    placed = coded.join(first, finest).withColumns({c: F.col(f"_leaf.{c}") for c in _CELL[1:]}).drop("_leaf", "_cx", "_cy")
    large = counts.filter(F.col("n") > few).select("_cls", (F.col("_level") + 1).alias("_level"), F.col("_ix").alias("_ux"), F.col("_iy").alias("_uy"))
    below = counts.withColumns({"_ux": F.shiftright("_ix", HALVINGS), "_uy": F.shiftright("_iy", HALVINGS)})
    kept = below.join(large, ["_cls", "_level", "_ux", "_uy"], "left_semi").unionByName(below.filter("_level = 0"))
    return placed, kept.select(*_CELL, "_ux", "_uy", "n", leaf.alias("leaf"))


def _groups(probes: DataFrame) -> DataFrame:
    """(_group, box of its probes, least and greatest scale)."""
    return probes.groupBy("_group").agg(*[f(c).alias(f"_{n}{c[1:]}") for c in ("_x", "_y", "_scale") for n, f in (("min", F.min), ("max", F.max))])


_BOX = ["_minx", "_maxx", "_miny", "_maxy", "_minscale", "_maxscale"]


def candidate_cells(groups: DataFrame, cells: DataFrame, frame: Frame, height: int, k: int, slack: float, limits: Mapping[Any, float]) -> DataFrame:
    """(_group, _cls, _level, _ix, _iy, n): last cells that can hold one of the k nearest items of a group's probe, per class within its limit."""
    pad = slack + frame.size * 1e-9
    keys = ["_group", *_BOX, "_cls", "_limit"]
    classes = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(r)).alias("r")) for c, r in limits.items()])
    start = groups.select("_group", *_BOX, F.explode(classes).alias("_e")).select("_group", *_BOX, F.col("_e.c").alias("_cls"), F.col("_e.r").alias("_limit"))
    kids = cells.select("_cls", (F.col("_level") - 1).alias("_ul"), "_ux", "_uy", *[F.col(c).alias("_k" + c.lstrip("_")) for c in (*_CELL[1:], "n", "leaf")])
    kept = start.withColumns({"_level": F.lit(-1), "_ix": F.lit(0).cast("bigint"), "_iy": F.lit(0).cast("bigint"), "n": F.lit(0).cast("bigint"), "leaf": F.lit(False)})
    for _ in range(height + 1):
        # A last cell stays as it is: it looks for the parts of a cell that does not exist.
        asked = kept.withColumns({"_ul": F.when(F.col("leaf"), DEPTH + 1).otherwise(F.col("_level")), "_ux": F.col("_ix"), "_uy": F.col("_iy")})
        met = asked.join(kids, ["_cls", "_ul", "_ux", "_uy"], "left").filter("leaf or _kn is not null")
        new = lambda c: F.when(F.col("leaf"), F.col(c)).otherwise(F.col("_k" + c.lstrip("_"))).alias(c)
        found = met.select(*keys, *[new(c) for c in (*_CELL[1:], "n", "leaf")])
        width = F.lit(frame.size) / F.pow(F.lit(2.0), F.col("_level") * HALVINGS)
        low = {"x": frame.x + F.col("_ix") * width, "y": frame.y + F.col("_iy") * width}
        gap = lambda a: F.greatest(F.lit(0.0), low[a] - F.col(f"_max{a}"), F.col(f"_min{a}") - low[a] - width)
        far = lambda a: F.greatest(F.abs(low[a] + width - F.col(f"_min{a}")), F.abs(F.col(f"_max{a}") - low[a]))
        near, most = F.hypot(F.col("_minscale") * gap("x"), gap("y")) - pad, F.hypot(F.col("_maxscale") * far("x"), far("y")) + pad
        one = F.struct(most.alias("most"), near.alias("near"), "n", *_CELL[1:], "leaf")
        lists = found.select(*keys, one.alias("_c")).groupBy(*keys).agg(F.array_sort(F.collect_list("_c")).alias("_l"))
        bound = F.aggregate("_l", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(math.inf).alias("d")),
                            lambda s, c: F.when(s["n"] < k, F.struct((s["n"] + c["n"]).alias("n"), c["most"].alias("d"))).otherwise(s))
        bounded = lists.select(*keys, "_l", bound.alias("_b"))
        reach = bounded.select(*keys, "_l", F.least("_limit", F.when(F.col("_b.n") < k, F.lit(math.inf)).otherwise(F.col("_b.d"))).alias("_u"))
        kept = reach.select(*keys, F.explode(F.filter("_l", lambda c: c["near"] <= F.col("_u"))).alias("_c")).select(*keys, "_c._level", "_c._ix", "_c._iy", "_c.n", "_c.leaf")
    return kept.select("_group", *_CELL, "n")


def candidate_pairs(probes: DataFrame, items: DataFrame, k: int, xy: Sequence[str], item_xy: Sequence[str], scale: Column | None = None, slack: float = 0.0,
                    kind: str | None = None, limits: Mapping[Any, float] | None = None) -> DataFrame:
    """Pairs of probes and items that include, for each probe, all of its k nearest items; columns of both sides, which must differ.

    Distance is hypot(scale * dx, dy), where `scale` (1 by default) is an expression over the probe. An item's
    true distance may be less than that of its point by up to `slack`. With `kind`, items come in
    classes and the k nearest of each class of `limits` are kept as far as its limit. Probes and items without a position pair with nothing.
    """
    limits = {0: math.inf} if limits is None else limits
    cls = F.lit(0) if kind is None else F.col(kind)
    stuff = items.withColumns({"_x": F.col(item_xy[0]).cast("double"), "_y": F.col(item_xy[1]).cast("double"), "_cls": cls}).filter("_x is not null and _y is not null")
    seekers = probes.withColumns({"_x": F.col(xy[0]).cast("double"), "_y": F.col(xy[1]).cast("double"), "_scale": F.lit(1.0) if scale is None else scale})
    seekers = seekers.filter("_x is not null and _y is not null")
    frame = _frame(stuff)
    if frame is None:
        return probes.join(items, F.lit(False))
    placed, cells = pyramid(stuff, frame, ITEMS_PER_CELL)
    cells = cut(cells)
    known = cells.filter("leaf").agg(F.max("_level").alias("height"), (F.sum(F.col("_level") * F.col("n")) / F.sum("n")).alias("usual")).first()
    grid = frame.size / float(1 << (HALVINGS * round(known["usual"])))
    # Hashes may put two groups into one: its box grows, the result stays.
    square = lambda a, low: F.floor((F.col(a) - low) / grid)
    grouped = seekers.withColumn("_group", F.xxhash64(square("_x", frame.x), square("_y", frame.y)))
    # Groups are few rows with much work each: dealt to a fixed number of tasks, as by bytes they would end in one.
    parts = max(int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")), probes.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda s: cut(_groups(s)).repartition(parts, "_group")
    down = lambda s: cut(candidate_cells(dealt(s), cells, frame, known["height"], k, slack, limits))
    wanted = down(grouped)
    wide = wanted.groupBy("_group").agg(F.sum("n").alias("n")).filter(F.col("n") > max(WIDE, WIDE_PER_K * k)).select("_group")
    if not wide.isEmpty():
        single = grouped.join(wide, "_group", "left_semi").withColumn("_group", F.xxhash64("_x", "_y", "_scale"))
        grouped = cut(grouped.join(wide, "_group", "left_anti").unionByName(single))
        wanted = wanted.join(wide, "_group", "left_anti").unionByName(down(single))
    near = wanted.drop("n").join(placed.drop("_x", "_y"), _CELL).drop(*_CELL)
    return grouped.drop("_x", "_y", "_scale").join(near, "_group").drop("_group")


def nearest_points(probes: DataFrame, items: DataFrame, probe_id: str, item_id: str, k: int, xy: Sequence[str], item_xy: Sequence[str], kind: str | None = None,
                   limits: Mapping[Any, float] | None = None, rank: str = "rank") -> DataFrame:
    """The k nearest items per probe with `d2` and `rank`; equal distances take the lower item id. Columns of both sides must differ.

    With `kind` and `limits`, items farther than their class's limit (closed) do not count. Of items
    at one point only the k lowest ids of a class can be among the nearest, so no more are joined.
    """
    here = [*item_xy, *([kind] if kind else [])]
    few = items.withColumn("_same", F.row_number().over(Window.partitionBy(*here).orderBy(item_id))).filter(F.col("_same") <= k).drop("_same")
    pairs = candidate_pairs(probes, few, k, xy, item_xy, kind=kind, limits=limits)
    dx, dz = F.col(item_xy[0]) - F.col(xy[0]), F.col(item_xy[1]) - F.col(xy[1])
    near = pairs.withColumn("d2", dx * dx + dz * dz)
    if limits is not None:
        reach = F.lit(None).cast("double")
        for c, r in limits.items():
            reach = F.when(F.col(kind) == F.lit(c), F.lit(float(r))).otherwise(reach)
        near = near.filter(F.col("d2") <= reach * reach)
    w = Window.partitionBy(probe_id).orderBy("d2", item_id)
    return near.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
