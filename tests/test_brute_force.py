"""Operators without SQL twins, and focal operators on dense grids, against plain Python on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilescape.functions.rings import ring_of
from tilescape.operators import collision, footprints, graph, lines, raster, trees, voxels


# -- Components ---------------------------------------------------------------

def flood(cells, steps):
    cells, out = set(cells), {}
    for start in sorted(cells):
        if start in out:
            continue
        stack, n = [start], start
        out[start] = n
        while stack:
            c = stack.pop()
            for s in steps:
                t = tuple(a + b for a, b in zip(c, s))
                if t in cells and t not in out:
                    out[t] = n
                    stack.append(t)
    return out


@pytest.mark.parametrize("seed,share", [(1, 0.45), (2, 0.6), (3, 0.75)])
def test_components_2d(spark, seed, share):
    rnd = random.Random(seed)
    cells = [(y, x) for y in range(24) for x in range(24) if rnd.random() < share]
    # A spiral is the worst case for label spreading.
    cells += [(40 + r, c) for r in range(0, 12, 2) for c in range(20)] + [(40 + r, 19 if r % 4 == 1 else 0) for r in range(1, 11, 2)]
    df = spark.createDataFrame([(1, y, x) for y, x in set(cells)], "tx bigint, cy bigint, cx bigint")
    got = {(r.cy, r.cx): (r.component.cy, r.component.start) for r in graph.label_components(df, ["cy", "cx"]).collect()}
    want = flood(cells, [(0, 1), (0, -1), (1, 0), (-1, 0)])
    assert set(got) == set(want)
    groups = {}
    for c, n in want.items():
        groups.setdefault(n, set()).add(got[c])
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_small_voxel_components_are_dropped(spark):
    rnd = random.Random(5)
    cells = {(x, z, y) for x in range(9) for z in range(9) for y in range(9) if rnd.random() < 0.3}
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    label = flood(cells, steps)
    size = {n: sum(1 for v in label.values() if v == n) for n in set(label.values())}
    df = spark.createDataFrame([(1, x, y, z, 3) for x, z, y in cells], "tx bigint, ix bigint, iy bigint, iz bigint, tag int")
    got = {(r.ix, r.iz, r.iy) for r in voxels.drop_small_components(df, 5).collect()}
    assert got == {c for c in cells if size[label[c]] >= 5}


# -- Matching -----------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_match_equals_sequential_claims(spark, seed):
    rnd = random.Random(seed)
    seekers = [(i, rnd.randrange(400), rnd.randrange(400)) for i in range(80)]
    targets = [(i, rnd.randrange(400), rnd.randrange(400)) for i in range(60)]
    taken, want = set(), {}
    for fid, x, y in seekers:
        near = sorted(((x - tx) ** 2 + (y - ty) ** 2, t) for t, tx, ty in targets if t not in taken and (x - tx) ** 2 + (y - ty) ** 2 < 3600)
        if near:
            want[fid] = near[0][1]
            taken.add(near[0][1])
    schema = "{} bigint, x bigint, y bigint"
    f = spark.createDataFrame(seekers, schema.format("fid")).withColumn("tx", F.lit(1))
    r = spark.createDataFrame(targets, schema.format("rec")).withColumn("tx", F.lit(1))
    got = {row.fid: row.rec for row in footprints.match_records(f, r, "fid", "rec", 60, 100).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_match_of_chains_and_of_large_components(spark, monkeypatch, limit):
    """A chain of claims, a crowd around few targets and pairs of equal distance, settled by components or by rounds."""
    monkeypatch.setattr(graph, "COMPONENT_PAIRS", limit)
    rnd, n = random.Random(8), 10_000 if limit > 40 else 30
    rows = [(i, t, d) for i in range(n) for t, d in ((i - 1, 1.0), (i, 2.0)) if t >= 0]
    rows += [(n + rnd.randrange(60), n + rnd.randrange(15), float(rnd.randrange(3))) for _ in range(400)]
    rows = list({r[:2]: r for r in rows}.values())
    taken, want = set(), {}
    for who, what, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if who not in want and what not in taken:
            want[who] = what
            taken.add(what)
    df = spark.createDataFrame(rows, "fid long, rec long, d double").repartition(8)
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda d, plain=graph.cut: cuts.append(1) or plain(d))
    assert {r.fid: r.rec for r in graph.match_nearest_once(df, "fid", "rec", "d").collect()} == want
    assert limit <= 40 or len(cuts) < 60
    assert graph.match_nearest_once(df.limit(0), "fid", "rec", "d").count() == 0


# -- Focal windows on a sparse grid -------------------------------------------

def test_focal_matches_dense_windows(spark):
    rnd = random.Random(7)
    n = 20
    grid = {(x, y): rnd.randrange(1, 50) for x in range(n) for y in range(n) if rnd.random() < 0.8}
    df = spark.createDataFrame([(1, x, y, v) for (x, y), v in grid.items()], "tx bigint, cx bigint, cy bigint, chm bigint")
    got = {(r.cx, r.cy): (r.hi, r.lo) for r in raster.focal(df, "chm", n, n, {"hi": ("max", 3), "lo": ("min", 1)}).collect()}
    window = lambda x, y, r: [grid.get((i, j), 0) for i in range(max(0, x - r), min(n, x + r + 1)) for j in range(max(0, y - r), min(n, y + r + 1))]
    assert got == {(x, y): (max(window(x, y, 3)), min(window(x, y, 1))) for x, y in grid}


def test_full_trees_with_mask(spark):
    rnd = random.Random(11)
    n = 30
    rows = [(1, x, y, rnd.randrange(300, 900)) for x in range(n) for y in range(n)]
    df = spark.createDataFrame(rows, "tx bigint, cx bigint, cy bigint, chm bigint")
    rules = trees.TreeRules(min_height=300, max_height=3500, small_area=10 ** 6, plateau_span=100, floor_share=0.3)
    mask = spark.createDataFrame([(1, x, y) for x in range(15) for y in range(n)], "tx bigint, cx bigint, cy bigint")
    grid = {(x, y): v for _, x, y, v in rows}
    window = lambda x, y, r: [grid[i, j] if (i, j) in grid else 0 for i in range(max(0, x - r), min(n, x + r + 1)) for j in range(max(0, y - r), min(n, y + r + 1))]
    want = {}
    for (x, y), h in grid.items():
        if x < 15 or h != max(window(x, y, 3)) or min(window(x, y, 2)) < 0.3 * h or max(window(x, y, 2)) - min(window(x, y, 2)) < 100:
            continue
        radius = 10
        for r in range(1, 11):
            ring = [grid[i, j] for i in range(max(0, x - r), min(n, x + r + 1)) for j in range(max(0, y - r), min(n, y + r + 1))
                    if r - 0.5 <= math.hypot(i - x, j - y) < r + 0.5]
            if sum(ring) / len(ring) < 0.5 * h:
                radius = r
                break
        want[x, y] = max(1.5, radius)
    got = {(r.cx, r.cy): r.crown_r for r in trees.extract_trees(df, n, n, mask, rules).collect()}
    assert got == want and want


# -- Swept spheres ------------------------------------------------------------

def inside(x, z, ring):
    odd = False
    for (x0, z0), (x1, z1) in zip(ring, ring[1:] + ring[:1]):
        if (z0 > z) != (z1 > z) and x < (x1 - x0) * (z - z0) / (z1 - z0) + x0:
            odd = not odd
    return odd


def first_contact(sweep, prism):
    """Earliest t of a sphere against a prism without holes; None when it passes."""
    fx, fy, fz, tx, ty, tz, r = sweep
    ring, base, top = prism
    xs, zs = [p[0] for p in ring], [p[1] for p in ring]
    if max(fx, tx) + r < min(xs) or min(fx, tx) - r > max(xs) or max(fz, tz) + r < min(zs) or min(fz, tz) - r > max(zs):
        return None
    if max(fy, ty) + r < base or min(fy, ty) - r > top:
        return None
    if base - r <= fy <= top + r and inside(fx, fz, ring):
        return 0.0
    dx, dy, dz = tx - fx, ty - fy, tz - fz
    times = []
    if fy > top and dy < 0:
        t = (top + r - fy) / dy
        if 0 < t < 1 and inside(fx + t * dx, fz + t * dz, ring):
            times.append(t)
    for (ax, az), (bx, bz) in zip(ring, ring[1:] + ring[:1]):
        ex, ez = bx - ax, bz - az
        n = math.hypot(ex, ez)
        wx, wz = -ez / n, ex / n
        gap, speed = (fx - ax) * wx + (fz - az) * wz, dx * wx + dz * wz
        if speed >= 0 or gap <= 0:
            continue
        if gap < r:
            k = ((fx - ax) * ex + (fz - az) * ez) / n ** 2
            if 0 <= k <= 1 and fy + r >= base and fy - r <= top:
                times.append(0.0)
            continue
        t = (r - gap) / speed
        if not 0 <= t < 1:
            continue
        k = ((fx + t * dx - ax) * ex + (fz + t * dz - az) * ez) / n ** 2
        y = fy + t * dy
        if 0 <= k <= 1:
            if y + r >= base and y - r <= top:
                times.append(t)
            continue
        lx, lz = (ax, az) if k < 0 else (bx, bz)
        a, b, c = dx * dx + dz * dz, 2 * ((fx - lx) * dx + (fz - lz) * dz), (fx - lx) ** 2 + (fz - lz) ** 2 - r * r
        if a >= 1e-10 and b * b - 4 * a * c >= 0:
            t = (-b - math.sqrt(b * b - 4 * a * c)) / (2 * a)
            y = fy + t * dy
            if 0 <= t < 1 and y + r >= base and y - r <= top:
                times.append(t)
    return min(times) if times else None


def test_swept_spheres(spark):
    rnd = random.Random(3)
    boxes = [(i, rnd.randrange(80), rnd.randrange(80), 4 + rnd.randrange(12), 4 + rnd.randrange(12), rnd.randrange(5), 10 + rnd.randrange(20)) for i in range(25)]
    sweeps = [(i, *[float(rnd.randrange(100)) + 0.25, float(rnd.randrange(40)), float(rnd.randrange(100)) + 0.75],
               *[float(rnd.randrange(100)), float(rnd.randrange(40)), float(rnd.randrange(100))], 1.5) for i in range(200)]
    # Wound so that walls face outwards.
    ring = lambda x, z, w, h: [(x, z + h), (x + w, z + h), (x + w, z), (x, z)]
    want = {}
    for i, *s in sweeps:
        hits = [t for t in (first_contact(s, (ring(x, z, w, h), lo, hi)) for _, x, z, w, h, lo, hi in boxes) if t is not None]
        if hits:
            want[i] = round(min(hits), 6)
    p = spark.createDataFrame(boxes, "fid bigint, x bigint, z bigint, w bigint, h bigint, base bigint, top bigint").withColumn("tile", F.lit(1))
    x, z, w, h = (F.col(c) for c in "xzwh")
    outer = ring_of((x, z + h), (x + w, z + h), (x + w, z), (x, z))
    p = p.select("tile", "fid", outer.alias("outer"), F.array().cast(f"array<array<struct<x: double, y: double>>>").alias("holes"), "base", "top")
    s = spark.createDataFrame(sweeps, "id bigint, fx double, fy double, fz double, tx double, ty double, tz double, r double").withColumn("tile", F.lit(1))
    got = {row.id: round(row.t, 6) for row in collision.sweep_spheres(s, "id", p, None, 20.0).collect()}
    assert got == want and len(want) > 50


def test_sweep_starting_inside_leaves_by_the_shortest_way(spark):
    x = lambda v: F.lit(float(v))
    p = spark.range(1).select(F.lit(1).alias("tile"), F.lit(7).alias("fid"), ring_of((x(0), x(10)), (x(10), x(10)), (x(10), x(0)), (x(0), x(0))).alias("outer"),
                              F.array().cast("array<array<struct<x: double, y: double>>>").alias("holes"), F.lit(0).alias("base"), F.lit(50).alias("top"))
    s = spark.createDataFrame([(1, 8.0, 20.0, 5.0, 5.0, 20.0, 5.0, 1.0, 1)], "id bigint, fx double, fy double, fz double, tx double, ty double, tz double, r double, tile int")
    hit = collision.sweep_spheres(s, "id", p, None, 20.0).collect()[0]
    assert (hit.t, hit.solid, hit.nx, hit.ny, hit.nz) == (0.0, 7, 1.0, 0.0, 0.0)
    assert hit.px == pytest.approx(8 + 2 + 1 + 0.02)


def test_sweep_hits_deck_from_above_and_side(spark):
    deck = spark.createDataFrame([(1, 9, 0.0, 0.0, 20.0, 0.0, 10.0, 8.0)], "tile int, deck_id bigint, a0 double, a1 double, b0 double, b1 double, top double, bottom double")
    deck = deck.select("tile", "deck_id", *lines.oriented_box(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"), 3.0), "top", "bottom")
    none = spark.createDataFrame([], "tile int, fid bigint, outer array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>, base double, top double")
    s = spark.createDataFrame([(1, 10.0, 21.0, 0.0, 10.0, 1.0, 0.0, 1.0, 1), (2, 10.0, 9.0, 14.0, 10.0, 9.0, -6.0, 1.0, 1), (3, 10.0, 30.0, 0.0, 10.0, 20.0, 0.0, 1.0, 1)],
                              "id bigint, fx double, fy double, fz double, tx double, ty double, tz double, r double, tile int")
    got = {r.id: r for r in collision.sweep_spheres(s, "id", none, deck, 20.0).collect()}
    assert set(got) == {1, 2}
    assert got[1].t == pytest.approx(0.5) and (got[1].nx, got[1].ny, got[1].nz) == (0.0, 1.0, 0.0) and got[1].py == pytest.approx(10.0)
    assert got[2].t == pytest.approx(0.5) and got[2].nz == pytest.approx(1.0) and got[2].pz == pytest.approx(3.0)


# -- Property checks ----------------------------------------------------------

def test_quantisation_assigns_the_nearest_centroid(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(rnd.randrange(256), rnd.randrange(256), rnd.randrange(256)) for _ in range(400)], "r bigint, g bigint, b bigint")
    out = voxels.quantise(df, 8).collect()
    centres = {r.centroid: (r.qr, r.qg, r.qb) for r in out}
    assert len(centres) <= 8 and sum(r.n for r in out) == 400
    for r in out:
        d = lambda c: sum((a - b) ** 2 for a, b in zip((r.r, r.g, r.b), c))
        assert math.sqrt(d(centres[r.centroid])) <= min(math.sqrt(d(c)) for c in centres.values()) + 2  # centroids are floored


def test_clip_keeps_pieces_inside_and_length(spark):
    rnd = random.Random(4)
    paths = [(i, [(float(rnd.randrange(-50, 150)), float(rnd.randrange(-50, 150))) for _ in range(6)]) for i in range(40)]
    df = spark.createDataFrame(paths, "id bigint, path array<struct<x: double, y: double>>").select("id", "path", lines.clip_to_box("path", 100.0).alias("pieces"))
    for row in df.collect():
        total = sum(math.dist(a, b) for p in row.pieces for a, b in zip(p, p[1:]))
        steps, kept = 400, 0.0
        for a, b in zip(row.path, row.path[1:]):
            n = sum(0 <= a[0] + (b[0] - a[0]) * (k + 0.5) / steps <= 100 and 0 <= a[1] + (b[1] - a[1]) * (k + 0.5) / steps <= 100 for k in range(steps))
            kept += math.dist(a, b) * n / steps
        assert all(-1e-9 <= v <= 100 + 1e-9 for p in row.pieces for q in p for v in q)
        assert total == pytest.approx(kept, abs=3.0)


def test_nearest_fill_is_nearest(spark):
    rnd = random.Random(9)
    n = 16
    known = {(x, y): rnd.randrange(100) for x in range(n) for y in range(n) if rnd.random() < 0.06}
    df = spark.createDataFrame([(1, x, y, v) for (x, y), v in known.items()], "tx bigint, cx bigint, cy bigint, dem bigint")
    for r in raster.fill_nearest(raster.dense_grid(df, n, n), n).collect():
        if (r.cx, r.cy) not in known:
            d2, cy, cx = min(((x - r.cx) ** 2 + (y - r.cy) ** 2, y, x) for x, y in known)
            assert (r.fill_d2, r.dem) == (d2, known[cx, cy])


@pytest.mark.parametrize("n,reach", [(9, 4), (40, 10)])
def test_crown_rings_near_edges_and_in_sparse_tiles(spark, n, reach):
    rnd = random.Random(n)
    grid = {(t, x, y): rnd.randrange(1, 900) for t in (1, 2) for x in range(n) for y in range(n) if rnd.random() < (0.7 if t == 1 else 0.05)}
    stems = [(t, x, y, h) for (t, x, y), h in grid.items() if rnd.random() < 0.3] + [(1, 0, 0, 5000), (3, 4, 4, 10)]
    stems = list({s[:3]: s for s in stems}.values())
    schema = "tx bigint, cx bigint, cy bigint, chm bigint"
    cells = spark.createDataFrame([(*k, v) for k, v in grid.items()], schema)
    rules = trees.TreeRules(crown_max=reach)
    got = {(r.tx, r.cx, r.cy): r.crown_r for r in trees.with_crowns(spark.createDataFrame(stems, schema), cells, n, n, rules).collect()}
    want = {}
    for t, x, y, h in stems:
        want[t, x, y] = float(reach)
        for ring in range(1, reach + 1):
            near = [grid.get((t, x + dx, y + dy), 0) for r, dx, dy in trees.ring_offsets(reach) if r == ring and 0 <= x + dx < n and 0 <= y + dy < n]
            if near and sum(near) / len(near) < h * rules.crown_share:
                want[t, x, y] = max(rules.crown_min, float(ring))
                break
    assert got == want


def test_surface_fill_equals_repeated_maxima(spark):
    rnd = random.Random(6)
    n = 24
    grid = {(x, z): rnd.randrange(1, 30) for x in range(n) for z in range(n) if rnd.random() < 0.03}
    cur = dict(grid)
    for _ in range(8):
        new = dict(cur)
        for x in range(n):
            for z in range(n):
                near = [cur[i, j] for i in range(x - 1, x + 2) for j in range(z - 1, z + 2) if (i, j) in cur]
                if (x, z) not in cur and near:
                    new[x, z] = max(near)
        cur = new
    df = spark.createDataFrame([(1, x, z, v) for (x, z), v in grid.items()], "tx bigint, ix bigint, iz bigint, gy bigint")
    got = {(r.ix, r.iz): r.gy for r in voxels.fill_surface(df, n, n).collect()}
    assert got == {(x, z): cur.get((x, z), 0) for x in range(n) for z in range(n)}


# -- Rasters ------------------------------------------------------------------

def test_equal_probes_are_sampled_each(spark):
    pixels = spark.createDataFrame([(0, 0, x, y, 10.0) for x in range(4) for y in range(4)], "tx long, ty long, px long, py long, value double")
    probes = spark.createDataFrame([(1, 0.4, 0.4), (1, 0.4, 0.4), (2, 3.5, 0.5)], "p long, fx double, fy double")
    got = sorted(tuple(r) for r in raster.sample_bilinear(probes, pixels, "fx", "fy", 4).select("p", "elev", "elev_covered").collect())
    assert got == [(1, 10.0, True), (1, 10.0, True), (2, 0.0, False)]
    flat = lambda df: df.withColumn("surface", F.lit(3.0))
    xz = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "x double, z double")
    assert [tuple(r) for r in raster.surface_normal(xz, flat, "x", "z").select("ny").collect()] == [(1.0,), (1.0,)]


def test_gaps_take_the_nearest_ground(spark):
    rnd = random.Random(3)
    cells = [(t, x, y, rnd.randrange(100) if rnd.random() < 0.2 else None) for t in range(3) for x in range(12) for y in range(12) if rnd.random() < 0.6 and t < 2 or t == 2 and x == y]
    cells = [(t, x, y, None if t == 2 else z) for t, x, y, z in cells]
    got = {tuple(r)[:3]: r.dem for r in raster.fill_gaps(spark.createDataFrame(cells, "tx long, cx long, cy long, dem long"), 12).collect()}
    for t, x, y, z in cells:
        known = [((a - x) ** 2 + (b - y) ** 2, b, a, v) for u, a, b, v in cells if u == t and v is not None]
        assert got[t, x, y] == (z if z is not None else min(known)[3] if known else None)


def test_grid_cells_come_from_many_tasks(spark):
    cells = spark.createDataFrame([(1, 2, 3, 4)], "tx long, cx long, cy long, dem long")
    parts = raster.every_cell(cells, 64, 64).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 4 and sum(r["count"] for r in parts) == 4096


def test_voxels_without_a_pixel_keep_their_colour(spark):
    v = spark.createDataFrame([(1, 0, 5, 0, 3), (1, 0, 4, 0, 3), (1, 1, 2, 0, 1)], "tx long, ix long, iy long, iz long, tag int")
    image = spark.createDataFrame([(1, 1, 0, 10, 20, 30)], "tx long, ix long, iz long, r long, g long, b long")
    got = {(r.ix, r.iy): (r.r, r.g, r.b) for r in voxels.colour_voxels(v, image).collect()}
    assert len(got) == 3 and got[0, 5] == (196, 148, 108) and got[0, 4] == (220, 196, 168)


def test_distance_transform_equals_all_pairs():
    """Ties, single known cells, flat and narrow tiles."""
    import numpy as np
    from tilescape.operators.distance import nearest_known
    rnd = np.random.default_rng(8)
    for n in range(250):
        ny, nx = rnd.integers(1, 14, 2)
        known = rnd.random((ny, nx)) < rnd.choice([0.03, 0.2, 0.6, 1.0])
        found = nearest_known(known)
        cells = [(int(y), int(x)) for y, x in zip(*np.nonzero(known))]
        assert (found is None) == (not cells)
        for y in range(ny if cells else 0):
            for x in range(nx):
                want = min(((y - r) ** 2 + (x - c) ** 2, r, c) for r, c in cells)
                assert (found[2][y, x], found[0][y, x], found[1][y, x]) == want


def test_distance_transform_costs_the_same_for_one_known_cell():
    import time
    import numpy as np
    from tilescape.operators.distance import nearest_known
    took = []
    for known in (np.ones((600, 600), dtype=bool), np.zeros((600, 600), dtype=bool)):
        known[300, 300] = True
        start = time.perf_counter()
        nearest_known(known)
        took.append(time.perf_counter() - start)
    assert took[1] < 2 * took[0] < 20


def test_filled_values_keep_their_type(spark):
    df = spark.createDataFrame([("a", 0, 0, 2 ** 62 + 1, "x"), ("a", 3, 0, None, "y"), ("b", 1, 1, None, None)], "tx string, cx long, cy long, dem long, more string")
    got = sorted(map(tuple, raster.fill_gaps(df, 4).collect()))
    assert got == [("a", 0, 0, 2 ** 62 + 1, "x"), ("a", 3, 0, 2 ** 62 + 1, "y"), ("b", 1, 1, None, None)]
    assert raster.fill_gaps(df.limit(0), 4).count() == 0


def test_path_cells_are_those_near_the_path(spark):
    """No cell near the path is missed, and a long diagonal has as many cells as it is long."""
    from tilescape.operators import cells
    rnd = random.Random(12)
    rows = [(i, *[rnd.uniform(-50, 50) for _ in range(4)], rnd.choice([0.0, 0.3, 4.0])) for i in range(60)] + [(90, 3.0, 3.0, 3.0, 3.0, 1.0), (91, 0.0, -7.0, 0.0, 9.0, 0.5), (92, -9.0, 2.0, 9.0, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double, r double")
    got = {}
    for r in cells.with_path_cells(df, ("x0", "y0"), ("x1", "y1"), 5, F.col("r")).collect():
        assert (r[cells.CELL_X], r[cells.CELL_Y]) not in got.setdefault(r.id, set())
        got[r.id].add((r[cells.CELL_X], r[cells.CELL_Y]))
    for i, x0, y0, x1, y1, r in rows:
        for k in range(401):
            x, y = x0 + (x1 - x0) * k / 400, y0 + (y1 - y0) * k / 400
            assert {(math.floor((x + a) / 5), math.floor((y + b) / 5)) for a in (-r, 0, r) for b in (-r, 0, r)} <= got[i]
    long = spark.createDataFrame([(1, 0.0, 0.0, 1000.0 * n, 1000.0 * n, 1.0) for n in (1, 10)], "id long, x0 double, y0 double, x1 double, y1 double, r double")
    n = [r["count"] for r in cells.with_path_cells(long, ("x0", "y0"), ("x1", "y1"), 10, 1.0).groupBy("x1").count().orderBy("x1").collect()]
    assert n[0] < 500 and n[1] < 11 * n[0]
