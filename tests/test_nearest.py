"""Nearest-k joins against all pairs, and the pairs they join."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilescape.operators import lines, nearest, places


def table(spark, rows, name):
    return spark.createDataFrame(rows, f"{name}_id bigint, {name}_x double, {name}_y double, tier int")


def plain_nearest(probes, items, k, limits=None):
    out = []
    for p, px, py, _ in probes:
        if px is None or py is None:
            continue
        near = [((x - px) * (x - px) + (y - py) * (y - py), i) for i, x, y, t in items if x is not None and y is not None]
        near = [(d, i) for d, i in near if limits is None or d <= limits[items[i][3]] ** 2]
        out += [(p, i, d, r + 1) for r, (d, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def points(rnd, n, kind):
    spots = {"spread": lambda: (rnd.uniform(-500, 900), rnd.uniform(0, 700)), "cluster": lambda: (rnd.gauss(100, 1e-3), rnd.gauss(50, 1e-3)),
             "grid": lambda: (float(rnd.randrange(6)), float(rnd.randrange(6))), "one": lambda: (7.0, -3.0), "row": lambda: (rnd.uniform(0, 1e6), 5.0)}
    return [(i, *spots[kind](), rnd.randrange(1, 4)) for i in range(n)]


@pytest.mark.parametrize("item_kind, probe_kind", [("spread", "spread"), ("cluster", "spread"), ("grid", "grid"), ("one", "spread"), ("row", "cluster"), ("spread", "one")])
@pytest.mark.parametrize("k", [1, 7])
def test_nearest_points(spark, item_kind, probe_kind, k):
    rnd = random.Random(k)
    items, probes = points(rnd, 300, item_kind) + [(900, None, 1.0, 1)], points(rnd, 60, probe_kind) + [(901, 2.0, None, 1)]
    got = nearest.nearest_points(table(spark, probes, "p"), table(spark, items, "i").drop("tier"), "p_id", "i_id", k, ("p_x", "p_y"), ("i_x", "i_y"))
    assert sorted(tuple(r) for r in got.select("p_id", "i_id", "d2", "rank").collect()) == plain_nearest(probes, items, k)


def test_limits_by_class(spark):
    rnd = random.Random(9)
    items, probes, limits = points(rnd, 400, "spread"), points(rnd, 80, "spread"), {1: 200.0, 2: 60.0, 3: 0.0}
    got = nearest.nearest_points(table(spark, probes, "p").drop("tier"), table(spark, items, "i"), "p_id", "i_id", 9, ("p_x", "p_y"), ("i_x", "i_y"), "tier", limits)
    assert sorted(tuple(r) for r in got.select("p_id", "i_id", "d2", "rank").collect()) == plain_nearest(probes, items, 9, limits)


def test_few_and_no_items(spark):
    probes = table(spark, [(1, 0.0, 0.0, 1), (2, 5.0, 5.0, 1)], "p").drop("tier")
    two = table(spark, [(5, 1.0, 1.0, 1), (4, 1.0, 1.0, 1)], "i")
    got = nearest.nearest_points(probes, two, "p_id", "i_id", 9, ("p_x", "p_y"), ("i_x", "i_y"))
    assert sorted((r.p_id, r.rank, r.i_id) for r in got.collect()) == [(1, 1, 4), (1, 2, 5), (2, 1, 4), (2, 2, 5)]
    assert nearest.nearest_points(probes, two.limit(0), "p_id", "i_id", 9, ("p_x", "p_y"), ("i_x", "i_y")).count() == 0
    assert nearest.nearest_points(probes.limit(0), two, "p_id", "i_id", 9, ("p_x", "p_y"), ("i_x", "i_y")).count() == 0


@pytest.mark.parametrize("where", ["dense", "far", "copies"])
def test_pairs_stay_few(spark, where):
    """Next to a dense cluster, far from everything and among copies of one place, a probe meets about k items."""
    rnd = random.Random(2)
    spot = {"dense": lambda i: (rnd.gauss(0, 1), rnd.gauss(0, 1)), "far": lambda i: (rnd.uniform(0, 10), rnd.uniform(0, 10)), "copies": lambda i: (float(i % 3), 0.0)}[where]
    items = [(i, *spot(i), 1) for i in range(20_000)] + ([(99_999, 5e5, 5e5, 1)] if where == "dense" else [])
    probes = [(i, 1e5 + i, 30.0 * i, 1) if where == "far" else (i, i / 40, 0.1, 1) for i in range(50)]
    few, k = table(spark, items, "i").drop("tier"), 8
    got = nearest.nearest_points(table(spark, probes, "p"), few, "p_id", "i_id", k, ("p_x", "p_y"), ("i_x", "i_y"))
    assert sorted(tuple(r) for r in got.select("p_id", "i_id", "d2", "rank").collect()) == plain_nearest(probes, items, k)
    if where != "copies":
        pairs = nearest.candidate_pairs(table(spark, probes, "p"), few, k, ("p_x", "p_y"), ("i_x", "i_y")).count()
        assert pairs < len(probes) * 100 * k


def test_roads_far_and_near(spark):
    rnd = random.Random(3)
    paths = [(i, [(rnd.uniform(-1, 1), rnd.uniform(40, 41)) for _ in range(rnd.randrange(2, 5))]) for i in range(25)] + [(77, [(-1.0, 40.0), (1.0, 41.0)])]
    roads = spark.createDataFrame(paths, "road_id bigint, path array<struct<lon: double, lat: double>>")
    spots = [(i, rnd.uniform(-1, 1), rnd.uniform(40, 41)) for i in range(30)] + [(100, 120.0, -35.0), (101, -170.0, 80.0)]
    nodes = spark.createDataFrame(spots, "node_id bigint, lon double, lat double")

    def plain(lon, lat):
        best = []
        for road, path in paths:
            for (ax, ay), (bx, by) in zip(path, path[1:]):
                vx, vy = bx - ax, by - ay
                t = max(0.0, min(1.0, ((lon - ax) * vx + (lat - ay) * vy) / (vx * vx + vy * vy)))
                best.append(math.hypot((ax + t * vx - lon) * math.cos(math.radians(lat)), ay + t * vy - lat))
        return min(best)

    got = {r.node_id: r.distance for r in lines.nearest_road_bearing(nodes, roads, "node_id", "road_id").collect()}
    for i, lon, lat in spots:
        assert got[i] == pytest.approx(plain(lon, lat), rel=1e-9)
    none = lines.nearest_road_bearing(nodes, roads.limit(0), "node_id", "road_id").collect()
    assert {(r.bearing, r.distance) for r in none} == {(0.0, None)} and len(none) == 32


def test_nearest_pins_by_tier(spark):
    rnd = random.Random(6)
    pins = [(i, rnd.uniform(0, 3000), rnd.uniform(0, 3000), rnd.choice([1, 2, 3, 9])) for i in range(300)]
    probes = [(i, rnd.uniform(0, 3000), rnd.uniform(0, 3000)) for i in range(40)]
    df = spark.createDataFrame(pins, "pin_id bigint, x double, z double, tier int")
    at = spark.createDataFrame(probes, "seq bigint, x double, z double")
    joined = places.nearest_k(places.pins_in_range(at, df, "seq"), ["seq"], ["d2", "pin_id"], 20)
    got = places.nearest_pins(at, df, "seq", "pin_id", k=20)
    pick = lambda d: sorted(tuple(r) for r in d.select("seq", "pin_id", "rank", F.round("d2", 6)).collect())
    assert pick(got) == pick(joined)
