"""Sparse rasters: one row per cell, keyed by tile and cell.

Aggregations reduce points to cells before anything else happens, so a tile that
holds a large share of the points still leaves at most nx * ny rows. Windows run
along one row or column of a tile and are bounded by the tile's width.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tilescape.functions._base import ColumnLike, clamp, col, num, whole
from tilescape.functions import geo
from tilescape.session import by_keys

from .distance import nearest_known

# Point classes.
GROUND, WATER, BRIDGE, NOISE = 2, 9, 17, (7, 18)


# -- Points to cells ----------------------------------------------------------

def point_role(cls: ColumnLike) -> Column:
    """ground / water / bridge / above."""
    c = col(cls)
    return (F.when(c == GROUND, "ground").when(c == WATER, "water").when(c == BRIDGE, "bridge").otherwise("above"))


def drop_noise(points: DataFrame, cls="cls") -> DataFrame:
    return points.filter(~F.col(cls).isin(*NOISE))


def with_raster_cell(points: DataFrame, nx: int, ny: int, size, x="x", y="y") -> DataFrame:
    """Column cx grows east, row cy grows south; edge points are clipped into the tile."""
    top = lambda n: F.lit(n - 1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return points.withColumns({
        "cx": clamp(whole(col(x) / num(size)), zero, top(nx)),
        "cy": clamp(top(ny) - whole(col(y) / num(size)), zero, top(ny)),
    })


def elevation_cells(points: DataFrame, nx: int, ny: int, size, tile: Sequence[str] = ("tx",),
                    x="x", y="y", z="z", cls="cls") -> DataFrame:
    """Lowest ground (dem) and highest above-ground return (dsm) per cell, in one pass."""
    role = point_role(cls)
    return (with_raster_cell(drop_noise(points, cls), nx, ny, size, x, y)
            .groupBy(*tile, "cx", "cy")
            .agg(F.min(F.when(role == "ground", F.col(z))).alias("dem"),
                 F.max(F.when(role == "above", F.col(z))).alias("dsm")))


def canopy_cells(cells: DataFrame, dem="dem", dsm="dsm") -> DataFrame:
    """Height of the surface above ground, never negative; no surface return means ground."""
    dem, dsm = F.col(dem), F.col(dsm)
    return cells.withColumn("chm", F.greatest(F.coalesce(dsm, dem) - dem, F.lit(0).cast("bigint")))


def every_cell(tiles: DataFrame, nx: int, ny: int, tile: Sequence[str] = ("tx",), x: str = "cx", y: str = "cy") -> DataFrame:
    """All cells of the given tiles. Columns are dealt out before rows are added, so one tile's cells come from many tasks."""
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.select(*tile).distinct().withColumn(x, span(nx)).repartition(parts, *tile, x).withColumn(y, span(ny))


def dense_grid(cells: DataFrame, nx: int, ny: int, tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Every cell of every tile that occurs, present cells keeping their values."""
    return by_keys(every_cell(cells, nx, ny, tile)).join(cells, [*tile, "cx", "cy"], "left")


def _filled(cells: DataFrame, value: str, tile: Sequence[str], distance: str | None = None) -> DataFrame:
    """`cells` with NULL values replaced by the nearest known cell's, one tile at a time (at most its nx * ny cells)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields) + (f", {distance} bigint" if distance else "")

    def fill(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        x, y = (table[c].to_numpy().astype(np.int64) for c in ("cx", "cy"))
        known = ~np.asarray(pc.is_null(table[value]))
        mask, order = np.zeros((y.max() + 1, x.max() + 1), dtype=bool), np.zeros((y.max() + 1, x.max() + 1), dtype=np.int64)
        mask[y[known], x[known]], order[y[known], x[known]] = True, np.flatnonzero(known)
        found = nearest_known(mask)
        d2 = pa.nulls(len(x), pa.int64())
        if found is not None:
            row, column, square = (f[y, x] for f in found)
            table = table.set_column(table.schema.get_field_index(value), table.schema.field(value), table[value].take(pa.array(np.where(known, np.arange(len(x)), order[row, column]))))
            d2 = pa.array(square, mask=known)
        return table.append_column(distance, d2) if distance else table

    return cells.groupBy(*tile).applyInArrow(fill, schema)


def fill_gaps(cells: DataFrame, nx: int, value="dem", tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Replace NULL values of a sparse raster by the nearest known cell's (Euclidean, exact; ties to the lowest row, then column).

    NULL stays where a tile has no known cell. See `distance.nearest_known`.
    """
    return _filled(cells, value, tile)


def fill_nearest(grid: DataFrame, nx: int, value="dem", tile: Sequence[str] = ("tx",)) -> DataFrame:
    """The same for a dense grid, with `fill_d2`, the squared distance in cells (NULL for known cells and for tiles that know none)."""
    return _filled(grid, value, tile, "fill_d2")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smooth_grid(grid: DataFrame, nx: int, ny: int, value="dem", sigma: float = 0.6,
                tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Separable Gaussian with reflected edges: one window per axis."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2

    def one_axis(df: DataFrame, axis: str, other: str, n: int) -> DataFrame:
        w = Window.partitionBy(*tile, other).orderBy(axis)
        shift = lambda k: F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w)
        out = None
        for k, weight in zip(range(-radius, radius + 1), weights):
            picked = shift(k) if k else F.col(value)
            for i in range(min(radius, n)):
                if k < 0 and i + k < 0:                      # reflect below 0
                    picked = F.when(F.col(axis) == i, shift((-1 - (i + k)) - i)).otherwise(picked)
                if k > 0 and (n - 1 - i) + k >= n:            # reflect above n - 1
                    j = n - 1 - i
                    picked = F.when(F.col(axis) == j, shift((2 * n - 1 - (j + k)) - j)).otherwise(picked)
            term = picked * weight
            out = term if out is None else out + term
        return df.withColumn("_smooth", out).withColumn(value, F.col("_smooth")).drop("_smooth")

    return one_axis(one_axis(grid, "cy", "cx", ny), "cx", "cy", nx)


def smooth_tiles(cells: DataFrame, nx: int, ny: int, value="dem", sigma: float = 0.6, tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Every cell of every tile that occurs, gaps filled from the nearest known cell, then smoothed as by `smooth_grid`.

    One shuffle by tile and one pass over each (at most its nx * ny cells); no cells are made to be joined.
    """
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    cells = cells.select(*tile, "cx", "cy", F.col(value).cast("double").alias(value))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)

    def smooth(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        x, y = (table[c].to_numpy().astype(np.int64) for c in ("cx", "cy"))
        known = ~np.asarray(pc.is_null(table[value]))
        grid, mask = np.zeros((ny, nx)), np.zeros((ny, nx), dtype=bool)
        grid[y[known], x[known]], mask[y[known], x[known]] = table[value].to_numpy()[known], True
        found = nearest_known(mask)
        if found is not None:
            grid = np.where(mask, grid, grid[found[0], found[1]])
        for axis, n in ((0, ny), (1, nx)):
            total = None
            for k, weight in zip(range(-radius, radius + 1), weights):
                at = np.arange(n) + k
                at = np.clip(np.where(at < 0, -1 - at, np.where(at >= n, 2 * n - 1 - at, at)), 0, n - 1)
                term = np.take(grid, at, axis) * weight
                total = term if total is None else total + term
            grid = total
        rows, columns = np.divmod(np.arange(nx * ny), nx)
        smoothed = pa.nulls(nx * ny, pa.float64()) if found is None else pa.array(grid.ravel())
        made = {"cx": pa.array(columns), "cy": pa.array(rows), value: smoothed}
        first = pa.array(np.zeros(nx * ny, dtype=np.int64))
        return pa.table([(made[c].cast(table.schema.field(c).type) if c in made else table[c].take(first)) for c in table.column_names], names=table.column_names)

    return cells.groupBy(*tile).applyInArrow(smooth, schema)


def density_gate(points: DataFrame, minimum: int, tile: Sequence[str] = ("tx",), where: Column | None = None) -> DataFrame:
    """Keep points of tiles with at least `minimum` (matching) points."""
    counted = points if where is None else points.filter(where)
    dense = counted.groupBy(*tile).count().filter(F.col("count") >= minimum).drop("count")
    return points.join(dense, list(tile), "left_semi")


# -- Focal operators on sparse cells ------------------------------------------

def focal(cells: DataFrame, value: str, nx: int, ny: int, stats: dict[str, tuple[str, int]],
          tile: Sequence[str] = ("tx",)) -> DataFrame:
    """Square-window max / min of present cells, absent cells counting as 0.

    `stats` maps an output name to ("max" | "min", radius). Values are spread sideways
    with a partial aggregate, then combined down each column; the cell's own value rides
    along, so no join back is needed. A min is 0 unless the clipped window is full.
    """
    reach = max(r for _, r in stats.values())
    dx = F.col("_dx")
    spread = cells.select("*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_dx"))
    spread = spread.withColumn("_x", F.col("cx") + dx).filter(F.col("_x").between(0, nx - 1))
    aggs = [F.max(F.when(dx == 0, F.struct(*[c for c in cells.columns if c not in (*tile, "cx", "cy")]))).alias("_own")]
    for name, (kind, r) in stats.items():
        near = F.when(F.abs(dx) <= r, F.col(value))
        aggs.append((F.max(near) if kind == "max" else F.min(near)).alias(f"_{name}"))
        aggs.append(F.count(near).alias(f"_n_{name}"))
    rows = spread.groupBy(*tile, "_x", "cy").agg(*aggs)
    out = rows
    for name, (kind, r) in stats.items():
        w = Window.partitionBy(*tile, "_x").orderBy("cy").rangeBetween(-r, r)
        if kind == "max":
            out = out.withColumn(name, F.max(f"_{name}").over(w))
        else:
            window_cells = ((F.least(F.col("_x") + r, F.lit(nx - 1)) - F.greatest(F.col("_x") - r, F.lit(0)) + 1)
                            * (F.least(F.col("cy") + r, F.lit(ny - 1)) - F.greatest(F.col("cy") - r, F.lit(0)) + 1))
            full = F.sum(f"_n_{name}").over(w) == window_cells
            out = out.withColumn(name, F.when(full, F.min(f"_{name}").over(w)).otherwise(F.lit(0)))
    return (out.filter(F.col("_own").isNotNull())
            .select(*tile, F.col("_x").alias("cx"), "cy", "_own.*", *stats))


# -- Sampling -----------------------------------------------------------------

def _with_quad(probes: DataFrame, fx: ColumnLike, fy: ColumnLike, size: int) -> DataFrame:
    """Add the tile, strip and row of the upper left one of the four pixels around a fractional tile position, its place in the strip and the weights.

    Steps are separate projections, so each expression is evaluated once per row.
    """
    edge, zero = F.lit(size - 2).cast("bigint"), F.lit(0).cast("bigint")
    df = probes.withColumns({"_fx": col(fx), "_fy": col(fy)})
    df = df.withColumns({"_tx": whole(F.col("_fx")), "_ty": whole(F.col("_fy"))})
    df = df.withColumns({"_ax": (F.col("_fx") - F.col("_tx")) * size - 0.5, "_ay": (F.col("_fy") - F.col("_ty")) * size - 0.5})
    df = df.withColumns({"_x0": clamp(whole(F.col("_ax")), zero, edge), "_row": clamp(whole(F.col("_ay")), zero, edge)})
    return df.select(*probes.columns, "_tx", "_ty", F.expr(f"_x0 div {STRIP}").alias("_strip"), "_row", (F.col("_x0") % STRIP).cast("int").alias("_at"),
                     clamp(F.col("_ax") - F.col("_x0"), 0.0, 1.0).alias("_wx"), clamp(F.col("_ay") - F.col("_row"), 0.0, 1.0).alias("_wy"))


#: Pixels of a raster row that are one strip. A strip also carries the pixel right of it and the row below, so every square of four lies in one strip.
STRIP = 8


def _strips(pixels: DataFrame, value: str) -> DataFrame:
    """(tile, `_strip`, `_row`, `_up`, `_low`): values of a row's strip and of the strip below it; absent pixels are NULL.

    A partial aggregate makes strips of pixels before they are shuffled; the row below comes
    from a window over one column of strips.
    """
    keys = ["_tx", "_ty", "_strip"]
    own = F.floor(F.col("px") / STRIP).cast("bigint")
    both = F.when(F.col("px") % STRIP == 0, F.array(own, own - 1)).otherwise(F.array(own))
    spread = pixels.select(F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.col("py").alias("_row"), "px", F.col(value).alias("_v"), F.explode(both).alias("_strip"))
    at = F.col("px") - F.col("_strip") * STRIP
    rows = spread.groupBy(*keys, "_row").agg(*[F.max(F.when(at == i, F.col("_v"))).alias(f"_v{i}") for i in range(STRIP + 1)])
    rows = rows.select(*keys, "_row", F.array(*[f"_v{i}" for i in range(STRIP + 1)]).alias("_up"))
    down = Window.partitionBy(*keys).orderBy("_row")
    joint = rows.withColumns({"_low": F.when(F.lead("_row").over(down) == F.col("_row") + 1, F.lead("_up").over(down)),
                              "_open": F.coalesce(F.lag("_row").over(down) != F.col("_row") - 1, F.lit(True))})
    # Squares whose upper row is absent have the row below only.
    none = F.lit(None).cast(rows.schema["_up"].dataType)
    pair = lambda row, up, low: F.struct(row.alias("_row"), up.alias("_up"), low.alias("_low"))
    here, above = pair(F.col("_row"), F.col("_up"), F.col("_low")), pair(F.col("_row") - 1, none, F.col("_up"))
    return joint.select(*keys, F.explode(F.when(F.col("_open"), F.array(here, above)).otherwise(F.array(here))).alias("_p")).select(*keys, "_p.*")


def sample_bilinear(probes: DataFrame, pixels: DataFrame, fx: ColumnLike, fy: ColumnLike, size: int = 256,
                    value="value", out="elev", keep: Sequence[str] | None = None) -> DataFrame:
    """Bilinear value at fractional tile coordinates; 0 where the tile is missing.

    `<out>_covered` tells whether any pixel was found. A probe meets one strip of pixels that
    holds all four around it, so it stays one row and is shuffled once; pixels are one per place.
    """
    keep = list(keep or probes.columns)
    keys = ["_tx", "_ty", "_strip", "_row"]
    points = _with_quad(probes, fx, fy, size).select(*keep, *keys, "_at", "_wx", "_wy")
    met = points.join(by_keys(_strips(pixels, value)), keys, "left")
    places = [("_up", 0), ("_up", 1), ("_low", 0), ("_low", 1)]
    met = met.select(*keep, "_wx", "_wy", *[F.get(side, F.col("_at") + dx).cast("double").alias(f"{side}{dx}") for side, dx in places])
    corner = {place: F.coalesce(F.col("{}{}".format(*place)), F.lit(0.0)) for place in places}
    # Differences keep a level field exactly level.
    along = lambda side: corner[side, 0] + (corner[side, 1] - corner[side, 0]) * F.col("_wx")
    mixed = along("_up") + (along("_low") - along("_up")) * F.col("_wy")
    covered = F.coalesce(*["{}{}".format(*place) for place in places]).isNotNull()
    return met.select(*keep, mixed.alias(out), covered.alias(f"{out}_covered"))


def _repeated(df: DataFrame) -> DataFrame:
    """Each row `_times` times."""
    return df.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).drop("_times")


def sample_nearest(probes: DataFrame, pixels: DataFrame, fx: ColumnLike, fy: ColumnLike, size: int,
                   values: Sequence[str]) -> DataFrame:
    """Values of the pixel holding the position; NULL where the tile is missing."""
    pixel = lambda f: clamp(whole((f - F.floor(f)) * size), F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))
    keyed = probes.withColumns({"_tx": whole(col(fx)), "_ty": whole(col(fy)), "_px": pixel(col(fx)), "_py": pixel(col(fy))})
    grid = pixels.select(*[F.col(k).alias(f"_{k}") for k in ("tx", "ty", "px", "py")], *values)
    return (keyed.join(by_keys(grid), ["_tx", "_ty", "_px", "_py"], "left")
            .select(*probes.columns, *values))


def sample_preferred(probes: DataFrame, fine: DataFrame, coarse: DataFrame, fx: ColumnLike, fy: ColumnLike,
                     levels: int, size: int = 256, value="value", out="elev") -> DataFrame:
    """Fine tile where it covers the probe, coarse elsewhere, 0 where neither does.

    `fx`, `fy` are fractions at the coarse zoom; the fine zoom is `levels` deeper.
    """
    k = float(1 << levels)
    at = probes.withColumns({"_pfx": col(fx), "_pfy": col(fy)})
    near = sample_bilinear(at, fine, F.col("_pfx") * k, F.col("_pfy") * k, size, value, "_fine")
    both = sample_bilinear(near, coarse, "_pfx", "_pfy", size, value, "_coarse")
    return both.select(*probes.columns,
                       F.when(F.col("_fine_covered"), F.col("_fine")).otherwise(F.col("_coarse")).alias(out),
                       (F.col("_fine_covered") | F.col("_coarse_covered")).alias(f"{out}_covered"))


def with_lattice_corners(probes: DataFrame, lon: str, lat: str, zoom: int, grid: int = 64) -> DataFrame:
    """Explode each probe to its three lattice corners and their weights.

    Every lattice square is split along fx + fy = 1; the far triangle uses the opposite corner.
    """
    lon_, lat_ = F.col(lon), F.col(lat)
    df = probes.withColumns({"_tx": F.floor(geo.tile_frac_x(lon_, zoom)), "_ty": F.floor(geo.tile_frac_y(lat_, zoom))})
    df = df.withColumns({"_west": geo.tile_lon(F.col("_tx"), zoom), "_east": geo.tile_lon(F.col("_tx") + 1, zoom),
                         "_north": geo.tile_lat(F.col("_ty"), zoom), "_south": geo.tile_lat(F.col("_ty") + 1, zoom)})
    west, east, north, south = (F.col(c) for c in ("_west", "_east", "_north", "_south"))
    df = df.withColumns({"_gx": (lon_ - west) / (east - west) * grid, "_gy": (lat_ - north) / (south - north) * grid})
    last = F.lit(grid - 1).cast("bigint")
    df = df.withColumns({"_ix": clamp(whole(F.col("_gx")), F.lit(0).cast("bigint"), last),
                         "_iy": clamp(whole(F.col("_gy")), F.lit(0).cast("bigint"), last)})
    df = df.withColumns({"_rx": clamp(F.col("_gx") - F.col("_ix"), 0.0, 1.0), "_ry": clamp(F.col("_gy") - F.col("_iy"), 0.0, 1.0)})
    rx, ry = F.col("_rx"), F.col("_ry")
    pick = lambda dx, dy, w: F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), w.alias("w"))
    near = F.array(pick(0, 0, 1 - rx - ry), pick(1, 0, rx), pick(0, 1, ry))
    far = F.array(pick(1, 1, rx + ry - 1), pick(0, 1, 1 - rx), pick(1, 0, 1 - ry))
    df = df.withColumn("_l", F.explode(F.when(rx + ry <= 1, near).otherwise(far)))
    df = df.withColumns({"_gx": F.col("_ix") + F.col("_l.dx"), "_gy": F.col("_iy") + F.col("_l.dy")})
    inner = geo.tile_frac_y(north + (south - north) * (F.col("_gy") / grid), zoom)
    # Longitude is linear in the tile; corners on its border keep the exact border fraction.
    return df.select(*probes.columns, (F.col("_l.dx") * 2 + F.col("_l.dy")).alias("_corner"), F.col("_l.w").alias("_w"),
                     (F.col("_tx") + F.col("_gx") / grid).alias("_cfx"),
                     F.when(F.col("_gy") % grid == 0, F.col("_ty") + F.col("_gy") / grid).otherwise(inner).alias("_cfy"))


def sample_surface(probes: DataFrame, coarse: DataFrame, lon: str, lat: str, zoom: int, fine: DataFrame | None = None,
                   fine_zoom: int = 16, size: int = 256, grid: int = 64, value="value", out="surface") -> DataFrame:
    """Height of the rendered surface: the fine tile where covered, else the coarse triangle lattice."""
    corners = with_lattice_corners(probes, lon, lat, zoom, grid)
    if fine is None:
        sampled = sample_bilinear(corners, coarse, "_cfx", "_cfy", size, value, "_e")
    else:
        sampled = sample_preferred(corners, fine, coarse, "_cfx", "_cfy", fine_zoom - zoom, size, value, "_e")
    lattice = sampled.groupBy(*probes.columns).agg(F.sum(F.col("_e") * F.col("_w")).alias(out), (F.count(F.lit(1)) / 3).cast("bigint").alias("_times"))
    lattice = _repeated(lattice.withColumn(out, F.col(out) / F.col("_times")))
    if fine is None:
        return lattice
    direct = sample_bilinear(lattice, fine, geo.tile_frac_x(lon, fine_zoom), geo.tile_frac_y(lat, fine_zoom),
                             size, value, "_fine")
    return direct.select(*probes.columns, F.when(F.col("_fine_covered"), F.col("_fine")).otherwise(F.col(out)).alias(out))


def surface_normal(probes: DataFrame, sample, x: str, z: str, step: float = 5.0) -> DataFrame:
    """Unit normal by central differences; `sample` adds `surface` to probes at columns `_sx`, `_sz`."""
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx * step).alias("dx"), F.lit(dz * step).alias("dz"))
                        for k, dx, dz in (("xp", 1, 0), ("xn", -1, 0), ("zp", 0, 1), ("zn", 0, -1))])
    spread = (probes.select("*", F.explode(offsets).alias("_o"))
              .withColumns({"_k": F.col("_o.k"), "_sx": F.col(x) + F.col("_o.dx"), "_sz": F.col(z) + F.col("_o.dz")}).drop("_o"))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col("surface")))
    nx, nz = F.col("_nx"), F.col("_nz")
    length = F.sqrt(nx * nx + nz * nz + 1)
    slopes = (sample(spread).groupBy(*probes.columns)
              .agg((-(at("xp") - at("xn")) / (2 * step)).alias("_nx"), (-(at("zp") - at("zn")) / (2 * step)).alias("_nz"),
                   (F.count(F.lit(1)) / 4).cast("bigint").alias("_times")))
    return (_repeated(slopes)
            .select(*probes.columns, (nx / length).alias("nx"), (1 / length).alias("ny"), (nz / length).alias("nz")))


def lattice_vertices(tiles: DataFrame, pixels: DataFrame, zoom: int, grid: int = 64, size: int = 256,
                     value="value") -> DataFrame:
    """Vertices of a tile's elevation lattice with slope differences for normals.

    Positions stay in degrees; `dh_*` are the height differences and `d_lon` / `d_lat`
    the spans between the neighbouring vertices (one-sided at the tile edge).
    """
    verts = every_cell(tiles, grid + 1, grid + 1, ("tx", "ty"), "ix", "iy").withColumns({c: F.col(c).cast("int") for c in ("ix", "iy")})
    west, east = geo.tile_lon(F.col("tx"), zoom), geo.tile_lon(F.col("tx") + 1, zoom)
    north, south = geo.tile_lat(F.col("ty"), zoom), geo.tile_lat(F.col("ty") + 1, zoom)
    verts = verts.withColumns({"lon": west + (east - west) * (F.col("ix") / grid),
                               "lat": north + (south - north) * (F.col("iy") / grid)})
    # Border vertices belong to the neighbouring tile; their fractions are exact.
    fy = (F.when(F.col("iy") == 0, F.col("ty") + 0.0).when(F.col("iy") == grid, F.col("ty") + 1.0)
          .otherwise(geo.tile_frac_y("lat", zoom)))
    sampled = sample_bilinear(verts, pixels, F.col("tx") + F.col("ix") / grid, fy, size, value, "h")
    rows = Window.partitionBy("tx", "ty", "iy").orderBy("ix")
    cols = Window.partitionBy("tx", "ty", "ix").orderBy("iy")
    ends = lambda c, w: (F.coalesce(F.lead(c, 1).over(w), F.col(c)) - F.coalesce(F.lag(c, 1).over(w), F.col(c)))
    return sampled.withColumns({"dh_x": ends("h", rows), "d_lon": ends("lon", rows),
                                "dh_y": ends("h", cols), "d_lat": ends("lat", cols)})


# -- Imagery ------------------------------------------------------------------

def box_downsample(pixels: DataFrame, factor: int, values: Sequence[str], tile: Sequence[str] = ("tx", "ty"), parts: int | None = None) -> DataFrame:
    """Mean over factor x factor blocks. With `parts`, the rows of blocks are gathered in so many tasks, each holding its own blocks only."""
    blocks = pixels.select(*tile, whole(F.col("px") / factor).alias("px"), whole(F.col("py") / factor).alias("py"), *values)
    if parts:
        blocks = blocks.repartition(parts, *tile, "py")
    return blocks.groupBy(*tile, "px", "py").agg(*[F.avg(v).alias(v) for v in values])


def contrast_stretch(pixels: DataFrame, values: Sequence[str], cut_low: int = 1, cut_high: int = 3,
                     tile: Sequence[str] = ("tx", "ty")) -> DataFrame:
    """Per-tile, per-band stretch to 0..255 after cutting a percentage at each end.

    Bands are reduced to 256-bin histograms first; the limits are looked up per tile.
    """
    stacked = pixels.select(*tile, F.explode(F.array(*[
        F.struct(F.lit(v).alias("band"), F.col(v).cast("bigint").alias("level")) for v in values])).alias("_b"))
    hist = stacked.groupBy(*tile, "_b.band", "_b.level").count()
    w = Window.partitionBy(*tile, "band")
    up = F.sum("count").over(w.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum("count").over(w.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("count").over(w)
    cut = lambda percent: F.floor(total * percent / 100)
    ranked = hist.withColumns({"_low": up > cut(cut_low), "_high": down > cut(cut_high)})
    limits = (ranked.groupBy(*tile).agg(*[e for v in values for e in (
        F.min(F.when((F.col("band") == v) & F.col("_low"), F.col("level"))).alias(f"_lo_{v}"),
        F.max(F.when((F.col("band") == v) & F.col("_high"), F.col("level"))).alias(f"_hi_{v}"))]))

    def stretch(v: str) -> Column:
        lo, hi = F.col(f"_lo_{v}"), F.col(f"_hi_{v}")
        scale = F.lit(255.0) / (hi - lo)
        return F.when(hi <= lo, F.col(v)).otherwise(
            clamp((F.col(v) * scale - lo * scale).cast("bigint"), F.lit(0).cast("bigint"), F.lit(255).cast("bigint")))

    return (by_keys(pixels).join(limits, list(tile)).withColumns({v: stretch(v) for v in values})
            .select(*pixels.columns))
