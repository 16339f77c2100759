"""Semantic voxels: points to a sparse grid, repairs, colours, faces.

Every grid is keyed (`tile`); coordinates are ix east, iy up, iz north. Windows run along
one voxel column or one row of a slab and are bounded by the grid's extent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tilescape.functions._base import clamp, whole
from tilescape.session import by_keys, cut

from . import footprints, graph
from .percentiles import percentiles

# Semantic tags, class codes, thresholds in metres and voxels.
TAG_GROUND, TAG_VEG, TAG_BUILDING, TAG_BRIDGE, TAG_WATER = 1, 2, 3, 4, 5
CLASS_TAG = {6: TAG_BUILDING, 17: TAG_BRIDGE, 3: TAG_VEG, 4: TAG_VEG, 5: TAG_VEG, 9: TAG_WATER}
UNCLASSIFIED, GROUND, WATER = 1, 2, 9
STRUCTURE_MIN_M, STRUCTURE_MAX_M, WATER_DEPTH_M, HEADROOM_M = 2.0, 320.0, 2.0, 20.0
MIN_COMPONENT, FILL_REACH = 20, 8
TAG_COLOUR = {TAG_GROUND: (168, 138, 96), TAG_VEG: (74, 116, 74), TAG_BUILDING: (220, 196, 168), TAG_BRIDGE: (168, 90, 66), TAG_WATER: (78, 118, 154)}
ROOF_TINT, WALL_DARKEN, TOP_BLEND, ROOF_BLEND, GROUND_BLEND = (196, 148, 108), 0.88, 0.70, 0.35, 0.6
PALETTE_SIZE = 56
TILE = ("tx",)


def _long(v) -> Column:
    return F.lit(v).cast("bigint")


def vertical_range(points: DataFrame, voxel: float, z="z", unit: float = 1.0, tile: Sequence[str] = TILE) -> DataFrame:
    """Origin and height of each grid from the 1st and 99.9th height percentiles.

    Heights are counted first; the percentiles are found by radix refinement.
    """
    hist = cut(points.groupBy(*tile, F.col(z).alias("h")).agg(F.count(F.lit(1)).alias("n")))
    p = percentiles(hist, list(tile), {"p_low": 0.01, "p_top": 0.999})
    rows = p.select(*tile, (F.col("p_low") - 2 * voxel).alias("origin"), F.col("p_top").alias("_top"))
    return rows.select(*tile, "origin", (F.ceil((F.col("_top") + HEADROOM_M * unit - F.col("origin")) / voxel) + 4).cast("bigint").alias("ny"))


def with_voxel(points: DataFrame, ranges: DataFrame, voxel: float, nx: int, nz: int, x="x", y="y", z="z", tile: Sequence[str] = TILE) -> DataFrame:
    """Add ix, iy, iz, clipped into the grid."""
    index = lambda c, n: clamp(whole(F.col(c) / voxel), _long(0), _long(n - 1))
    return (points.join(ranges, list(tile))
            .withColumns({"ix": index(x, nx), "iz": index(y, nz), "iy": clamp(whole((F.col(z) - F.col("origin")) / voxel), _long(0), F.col("ny") - 1)}))


def ground_surface(points: DataFrame, cls="cls", tile: Sequence[str] = TILE) -> DataFrame:
    """Highest ground index per column."""
    return points.filter(F.col(cls) == GROUND).groupBy(*tile, "ix", "iz").agg(F.max("iy").alias("gy"))


def fill_surface(surface: DataFrame, nx: int, nz: int, reach: int = FILL_REACH, tile: Sequence[str] = TILE) -> DataFrame:
    """Dense ground surface. An empty column takes the highest of its nearest ring of known columns.

    These are repeated 3 x 3 maxima, one tile at a time (its nx * nz columns, numpy): a column filled
    in round d sees exactly the known columns at Chebyshev distance d. Beyond `reach` the surface is 0.
    """
    tile = list(tile)
    rows = surface.select(*tile, *[F.col(c).cast("bigint").alias(c) for c in ("ix", "iz", "gy")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def fill(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = table.filter(pc.is_valid(table["gy"]))
        ix, iz, gy = (known[c].to_numpy() for c in ("ix", "iz", "gy"))
        here, none = (ix >= 0) & (ix < nx) & (iz >= 0) & (iz < nz), np.iinfo(np.int64).min
        out = np.full((nx, nz), none, dtype=np.int64)
        out[ix[here], iz[here]] = gy[here]
        wide = out
        for _ in range(reach):
            if (out != none).all():
                break
            wide = np.pad(wide, 1, constant_values=none)
            wide = np.maximum(np.maximum(wide[:-2], wide[1:-1]), wide[2:])
            wide = np.maximum(np.maximum(wide[:, :-2], wide[:, 1:-1]), wide[:, 2:])
            out = np.where(out == none, wide, out)
        x, z = np.divmod(np.arange(nx * nz, dtype=np.int64), nz)
        columns = [pa.repeat(table[c][0], nx * nz) for c in tile] + [pa.array(v) for v in (x, z, np.where(out == none, 0, out).ravel())]
        return pa.Table.from_arrays(columns, names=[*tile, "ix", "iz", "gy"])

    return rows.groupBy(*tile).applyInArrow(fill, schema)


def ground_crust(surface: DataFrame, tile: Sequence[str] = TILE) -> DataFrame:
    """The surface voxel and the one below it."""
    both = F.explode(F.array_distinct(F.array("gy", F.greatest(_long(0), F.col("gy") - 1))))
    return surface.select(*tile, "ix", both.alias("iy"), "iz", F.lit(TAG_GROUND).alias("tag"))


def class_voxels(points: DataFrame, cls="cls", tile: Sequence[str] = TILE) -> DataFrame:
    """Tags straight from point classes."""
    from tilescape.functions.classify import lookup
    tag = lookup(CLASS_TAG, F.col(cls).cast("int"))
    return points.filter(F.col(cls).isin(*CLASS_TAG)).select(*tile, "ix", "iy", "iz", tag.alias("tag"))


def structure_voxels(points: DataFrame, surface: DataFrame, voxel: float, unit: float = 1.0, cls="cls", tile: Sequence[str] = TILE, parts: int | None = None) -> DataFrame:
    """Unclassified points well above the ground surface become building voxels. With `parts`, columns are dealt to so many tasks."""
    tile = list(tile)
    high = points.filter(F.col(cls) == UNCLASSIFIED).select(*tile, "ix", "iy", "iz")
    high = (high.repartition(parts, *tile, "ix", "iz") if parts else high).distinct()
    above = F.col("iy") - F.col("gy") > int(STRUCTURE_MIN_M * unit / voxel)
    return high.join(by_keys(surface), [*tile, "ix", "iz"]).filter(above).select(*tile, "ix", "iy", "iz", F.lit(TAG_BUILDING).alias("tag"))


def merge_tags(parts: Sequence[DataFrame], tile: Sequence[str] = TILE, tasks: int | None = None) -> DataFrame:
    """One tag per voxel: the numerically highest wins. With `tasks`, voxel columns are dealt to so many tasks before they are merged."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.repartition(tasks, *tile, "ix", "iz") if tasks else every
    return every.groupBy(*tile, "ix", "iy", "iz").agg(F.max("tag").alias("tag"))


def column_tops(voxels: DataFrame, surface: DataFrame, ranges: DataFrame, voxel: float, unit: float = 1.0, tile: Sequence[str] = TILE) -> DataFrame:
    """Highest building voxel under the ceiling with another at most three below it."""
    tile = list(tile)
    w = Window.partitionBy(*tile, "ix", "iz").orderBy("iy")
    b = voxels.filter(F.col("tag") == TAG_BUILDING).select(*tile, "ix", "iz", "iy", (F.col("iy") - F.lag("iy").over(w)).alias("_gap"))
    b = b.join(by_keys(surface), [*tile, "ix", "iz"]).join(ranges, tile)
    ceiling = F.least(F.col("ny") - 1, F.col("gy") + int(STRUCTURE_MAX_M * unit / voxel))
    return (b.filter((F.col("_gap") <= 3) & (F.col("iy") <= ceiling) & (F.col("iy") > F.col("gy")))
            .groupBy(*tile, "ix", "iz", "gy").agg(F.max("iy").alias("top")))


def infill(voxels: DataFrame, tops: DataFrame, tile: Sequence[str] = TILE) -> DataFrame:
    """Fill empty voxels from above the ground to the column top."""
    tile = list(tile)
    slab = tops.select(*tile, "ix", F.explode(F.sequence(F.col("gy") + 1, F.col("top"))).alias("iy"), "iz")
    fresh = slab.join(by_keys(voxels.select(*tile, "ix", "iy", "iz")), [*tile, "ix", "iy", "iz"], "left_anti").withColumn("tag", F.lit(TAG_BUILDING))
    return voxels.unionByName(fresh)


def water_levels(points: DataFrame, cls="cls", tile: Sequence[str] = TILE) -> DataFrame:
    """Median index of water returns, rounded half to even, from index counts."""
    hist = points.filter(F.col(cls) == WATER).groupBy(*tile, F.col("iy").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    mid = percentiles(cut(hist), list(tile), {"mid": 0.5})
    return mid.select(*tile, F.bround("mid", 0).cast("bigint").alias("sea"))


def flood(voxels: DataFrame, surface: DataFrame, levels: DataFrame, voxel: float, unit: float = 1.0, tile: Sequence[str] = TILE) -> DataFrame:
    """Water slab in low columns without structure, then in empty columns at the shore."""
    tile = list(tile)
    depth = int(-(-WATER_DEPTH_M * unit // voxel))
    # A written surface is a small file with a row per column, which Spark would send to every task in place of the levels.
    cols = surface.join(by_keys(levels), tile).withColumn("lo", F.greatest(_long(0), F.col("sea") - depth)).filter(F.col("gy") <= F.col("sea") + 1)
    inside = voxels.select(*tile, "ix", "iz", "iy", "tag").join(by_keys(cols), [*tile, "ix", "iz"])
    structure = F.col("tag").isin(TAG_VEG, TAG_BUILDING, TAG_BRIDGE) & (F.col("iy") > F.col("gy")) & (F.col("iy") <= F.col("sea"))
    facts = inside.groupBy(*tile, "ix", "iz").agg(F.max(structure).alias("_built"), F.max(F.col("iy").between(F.col("lo"), F.col("sea"))).alias("_any"))
    wet = (cols.join(by_keys(facts), [*tile, "ix", "iz"], "left")
           .filter(((F.col("gy") < F.col("sea")) & ~F.coalesce("_built", F.lit(False))) | ~F.coalesce("_any", F.lit(False))))
    slab = wet.select(*tile, "ix", F.explode(F.sequence("lo", "sea")).alias("iy"), "iz", F.lit(TAG_WATER).alias("tag"))
    return voxels.join(by_keys(slab), [*tile, "ix", "iy", "iz"], "left_anti").unionByName(slab)


def drop_small_components(voxels: DataFrame, minimum: int = MIN_COMPONENT, tile: Sequence[str] = TILE) -> DataFrame:
    """Remove structure components smaller than the minimum."""
    tile = list(tile)
    parts = graph.label_components(voxels.filter(F.col("tag").isin(TAG_VEG, TAG_BUILDING, TAG_BRIDGE)).select(*tile, "ix", "iz", "iy"), ["ix", "iz", "iy"], tile)
    tiny = parts.groupBy(*tile, "component").count().filter(F.col("count") < minimum)
    gone = parts.join(tiny, [*tile, "component"], "left_semi").select(*tile, "ix", "iy", "iz")
    return voxels.join(gone, [*tile, "ix", "iy", "iz"], "left_anti")


def tag_counts(voxels: DataFrame, grid_cells: Column, tile: Sequence[str] = TILE) -> DataFrame:
    """Voxels per tag and their share of the grid."""
    return voxels.groupBy(*tile, "tag").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / grid_cells)


# -- Colours ------------------------------------------------------------------

def colour_voxels(voxels: DataFrame, imagery: DataFrame, tile: Sequence[str] = TILE) -> DataFrame:
    """r, g, b per voxel: tag colours tinted by the image pixel (r, g, b per ix, iz) of the column.

    A column without a pixel keeps the tag colours, and a building's top gets the roof tint.
    """
    from tilescape.functions.classify import lookup
    tile = list(tile)
    tops = voxels.groupBy(*tile, "ix", "iz").agg(F.max("iy").alias("_top"))
    looks = tops.join(by_keys(imagery.withColumnsRenamed({c: f"_{c}" for c in "rgb"})), [*tile, "ix", "iz"], "left")
    v = voxels.join(by_keys(looks), [*tile, "ix", "iz"])
    top, tag = F.col("iy") == F.col("_top"), F.col("tag")

    def channel(i: int, name: str) -> Column:
        image = F.col(f"_{name}").cast("double")
        base = lookup({t: float(rgb[i]) for t, rgb in TAG_COLOUR.items()}, tag)
        mix = lambda a, b, t: F.floor(a * (1 - t) + b * t)
        blended = mix(base, image, TOP_BLEND)
        current = F.when(top & (tag != TAG_WATER), blended).otherwise(base)
        roof = mix(blended, F.lit(float(ROOF_TINT[i])), ROOF_BLEND)
        out = (F.when(tag == TAG_BUILDING, F.when(top, roof).otherwise(F.floor(image * WALL_DARKEN)))
               .when(tag == TAG_GROUND, mix(current, image, GROUND_BLEND)).otherwise(current))
        bare = F.when(top & (tag == TAG_BUILDING), F.lit(float(ROOF_TINT[i]))).otherwise(base)
        return F.when(F.col("_r").isNull(), bare).otherwise(out).cast("bigint").alias(name)

    return v.select(*tile, "ix", "iy", "iz", "tag", *[channel(i, n) for i, n in enumerate("rgb")])


def quantise(colours: DataFrame, k: int = PALETTE_SIZE, seed: int = 0) -> DataFrame:
    """Map every distinct colour to one of k centroids (k-means on counted colours).

    Counting first replaces sampling: at most 2^24 weighted rows however many pixels there are.
    `excess` is how much farther (squared) the colour's own centroid is than its nearest one.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import VectorAssembler

    counted = colours.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    vectors = VectorAssembler(inputCols=["r", "g", "b"], outputCol="v").transform(counted.withColumn("w", F.col("n").cast("double")))
    model = KMeans(k=k, seed=seed, featuresCol="v", weightCol="w", predictionCol="centroid").fit(vectors)
    centres = F.array(*[F.array(*[F.lit(float(c)) for c in centre]) for centre in model.clusterCenters()])
    picked = F.get(centres, F.col("centroid"))
    square = lambda c: (c[0] - F.col("r")) * (c[0] - F.col("r")) + (c[1] - F.col("g")) * (c[1] - F.col("g")) + (c[2] - F.col("b")) * (c[2] - F.col("b"))
    excess = (square(picked) - F.array_min(F.transform(centres, square))).alias("excess")
    return model.transform(vectors).select("r", "g", "b", "n", "centroid", excess, *[whole(picked[i]).alias(f"q{c}") for i, c in enumerate("rgb")])


# -- Faces --------------------------------------------------------------------

# Fixed values: (axis, u axis, v axis) per face direction.
FACE_AXES = (("x", "iy", "iz"), ("y", "ix", "iz"), ("z", "ix", "iy"))
CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))


def exposed_faces(voxels: DataFrame, key: str = "tag", tile: Sequence[str] = TILE, parts: int | None = None) -> DataFrame:
    """Faces with nothing on the other side: axis, sign, slab, u, v, key.

    Both sides of a shared face fall on one plane position; a position claimed once is
    exposed. One partial aggregate instead of six self joins. With `parts`, tiles (bounded by their
    grid) are dealt to so many tasks, and voxels are shuffled in place of their six faces.
    """
    voxels = voxels.repartition(parts, *tile) if parts else voxels
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("sign"), (F.col(f"i{a}") + (1 if s > 0 else 0)).alias("plane"),
                               F.col(f"i{a}").alias("slab"), F.col(u).alias("u"), F.col(v).alias("v")) for a, u, v in FACE_AXES for s in (1, -1)])
    faces = voxels.select(*tile, F.col(key).alias("key"), F.explode(sides).alias("f")).select(*tile, "key", "f.*")
    return (faces.groupBy(*tile, "axis", "plane", "u", "v")
            .agg(F.count(F.lit(1)).alias("_n"), F.max("sign").alias("sign"), F.max("slab").alias("slab"), F.max("key").alias("key"))
            .filter(F.col("_n") == 1).select(*tile, "axis", "sign", "slab", "u", "v", "key"))


def merge_runs(faces: DataFrame, tile: Sequence[str] = TILE) -> DataFrame:
    """Adjacent equal faces along v become runs [v0, v1)."""
    by = [*tile, "axis", "sign", "slab", "u", "key"]
    w = Window.partitionBy(*by).orderBy("v")
    runs = faces.withColumn("_r", F.col("v") - F.row_number().over(w))
    return runs.groupBy(*by, "_r").agg(F.min("v").alias("v0"), (F.max("v") + 1).alias("v1")).drop("_r")


def merge_rectangles(runs: DataFrame, tile: Sequence[str] = TILE) -> DataFrame:
    """Equal runs in neighbouring rows become rectangles [u0, u1) x [v0, v1)."""
    by = [*tile, "axis", "sign", "slab", "v0", "v1", "key"]
    w = Window.partitionBy(*by).orderBy("u")
    rows = runs.withColumn("_r", F.col("u") - F.row_number().over(w))
    return rows.groupBy(*by, "_r").agg(F.min("u").alias("u0"), (F.max("u") + 1).alias("u1")).drop("_r")


def solid_planes(voxels: DataFrame, tile: Sequence[str] = TILE) -> DataFrame:
    """One row per axis and plane of voxels: `solid` maps (u, v / 64) to the 64 voxels along v as bits.

    A plane is bounded by the tile: its width times its height, in words of 64.
    """
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"i{a}").cast("bigint").alias("plane"), F.col(u).cast("bigint").alias("u"),
                               F.col(v).cast("bigint").alias("v")) for a, u, v in FACE_AXES])
    cells = voxels.select(*tile, F.explode(sides).alias("s")).select(*tile, "s.*").withColumn("_bit", F.expr("shiftleft(1L, cast(v & 63 as int))"))
    words = cells.groupBy(*tile, "axis", "plane", "u", F.shiftright("v", 6).alias("w")).agg(F.bit_or("_bit").alias("bits"))
    entry = F.struct(F.struct("u", "w"), "bits")
    return words.groupBy(*tile, "axis", "plane").agg(F.map_from_entries(F.collect_list(entry)).alias("solid"))


def corner_shades(rectangles: DataFrame, voxels: DataFrame, tile: Sequence[str] = TILE) -> DataFrame:
    """Shade code 0..3 per rectangle corner: 3 minus the solid ones of three outward neighbours.

    A rectangle meets the plane of voxels in front of it once, as one row; its twelve neighbours are looked up there.
    """
    tile = list(tile)
    ident = [*tile, "axis", "sign", "slab", "u0", "v0", "u1", "v1", "key"]

    def solid(u: Column, v: Column) -> Column:
        word = F.try_element_at("solid", F.struct(u.cast("bigint").alias("u"), F.shiftright(v.cast("bigint"), 6).alias("w")))
        return F.coalesce(F.getbit(word, v.cast("bigint").bitwiseAND(F.lit(63)).cast("int")).cast("int"), F.lit(0))

    shades = []
    for n, (du, dv) in enumerate(CORNERS):
        cu, cv = F.col("u1" if du else "u0"), F.col("v1" if dv else "v0")
        taken = [solid(cu + su * (2 * du - 1), cv + sv * (2 * dv - 1)) for su, sv in ((1, 0), (0, 1), (1, 1))]
        shades.append(F.struct(F.lit(n).alias("corner"), (3 - taken[0] - taken[1] - taken[2]).cast("int").alias("shade")))
    faced = rectangles.select(*ident, (F.col("slab") + F.col("sign")).cast("bigint").alias("plane"))
    met = faced.join(by_keys(solid_planes(voxels, tile)), [*tile, "axis", "plane"], "left")
    return met.select(*ident, F.explode(F.array(*shades)).alias("_s")).select(*ident, "_s.corner", "_s.shade")
