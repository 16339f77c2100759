"""Readers of JSON documents. Each parser takes a DataFrame of (path, value) text rows.

Tile layers take their tile from columns tx and ty where there are such (`tiles.read_tiles`), else from the path.
A document that does not have the expected shape is rejected whole: parsers return the
rows of good documents, and `rejected` the paths of bad ones with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tiles import with_tile

# Declared shapes (never inferred).
TREES = "struct<trees: array<array<double>>>"
ROOFS = "struct<roofs: array<struct<at: array<bigint>, shape: double, eave_dm: bigint, rise_dm: bigint, ridge_cdeg: bigint>>>"
PAINT = ("struct<ribbons: array<struct<kind: string, width_dm: double, path: array<array<bigint>>>>, "
         "polygons: array<struct<kind: string, ring: array<array<bigint>>>>, "
         "decals: array<struct<kind: string, at: array<bigint>, bearing_cdeg: double, len_dm: double, width_dm: double>>>")
MANIFEST = "map<string, struct<zoom: int, tiles: array<string>>>"
MANIFEST_LINE = "struct<layer: string, zoom: int, tiles: array<string>, parts: array<string>>"
ELEMENTS = ("struct<elements: array<struct<type: string, id: bigint, lon: double, lat: double, tags: map<string, string>, "
            "geometry: array<struct<lon: double, lat: double>>, "
            "members: array<struct<role: string, geometry: array<struct<lon: double, lat: double>>>>>>>")
PINS = "struct<pins: array<struct<name: string, kind: string, tier: double, lat: double, lon: double>>>"
PLACES = ("struct<features: array<struct<geometry: struct<coordinates: array<double>>, properties: struct<housenumber: string, street: string, "
          "name: string, city: string, district: string, locality: string, county: string, state: string>>>>")
TRACE = ("struct<scenario: string, renderDtSec: double, sampleEveryNFrames: int, totalFrames: int, "
         "samples: array<struct<f: bigint, px: double, py: double, pz: double, yaw: double, pitch: double, roll: double, speed: double>>>")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their path."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _parsed(documents: DataFrame, shape: str) -> DataFrame:
    return with_tile(documents).withColumn("d", F.from_json("value", shape))


def _in_tile(ok: Column) -> Column:
    """A document of a tile layer also needs a tile."""
    return ok & F.col("tx").isNotNull() & F.col("ty").isNotNull()


def _tree_ok() -> Column:
    # A non-numeric entry parses to NULL, so it fails the check like a wrong length does.
    return F.coalesce(F.forall("d.trees", lambda t: (F.size(t) == 4) & F.forall(t, lambda v: v.isNotNull())), F.lit(False))


def tree_rows(documents: DataFrame) -> DataFrame:
    """Trees of documents whose every entry is four numbers."""
    return (_parsed(documents, TREES).filter(_in_tile(_tree_ok())).select("tx", "ty", F.explode("d.trees").alias("t"))
            .select("tx", "ty", *[F.col("t")[i].cast("bigint").alias(n) for i, n in enumerate(("lon_e7", "lat_e7", "height_dm", "crown_dm"))]))


def rejected_trees(documents: DataFrame) -> DataFrame:
    return _parsed(documents, TREES).filter(~_in_tile(_tree_ok())).select("path", "tx", "ty")


def _roof_ok() -> Column:
    ok = F.forall("d.roofs", lambda r: r["shape"].isin(0, 1, 2) & (F.size(r["at"]) == 2) & F.forall(r["at"], lambda v: v.isNotNull())
                  & r["eave_dm"].isNotNull() & r["rise_dm"].isNotNull() & r["ridge_cdeg"].isNotNull())
    return F.coalesce(ok, F.lit(False))


def roof_rows(documents: DataFrame) -> DataFrame:
    """Roof records of documents with only valid records."""
    return (_parsed(documents, ROOFS).filter(_in_tile(_roof_ok())).select("tx", "ty", F.explode("d.roofs").alias("r"))
            .select("tx", "ty", F.col("r.at")[0].alias("lon_e7"), F.col("r.at")[1].alias("lat_e7"), F.col("r.shape").cast("int").alias("shape"),
                    "r.eave_dm", "r.rise_dm", "r.ridge_cdeg"))


def _paint_ok() -> Column:
    top = F.from_json("value", "map<string, string>")
    ok = top.isNotNull()
    for name in ("ribbons", "polygons", "decals"):
        ok = ok & F.coalesce(F.element_at(top, F.lit(name)).startswith("["), F.lit(True))
    return ok


def paint_parts(documents: DataFrame) -> dict[str, DataFrame]:
    """Ribbons, polygons and decals; a missing list is empty, a list of another type rejects the document."""
    parsed = with_tile(documents).filter(_in_tile(_paint_ok())).withColumn("d", F.from_json("value", PAINT))
    return {name: parsed.select("tx", "ty", F.explode(f"d.{name}").alias("_p")).select("tx", "ty", "_p.*")
            for name in ("ribbons", "polygons", "decals")}


def coverage_rows(documents: DataFrame) -> DataFrame:
    """Layer, tx, ty of a manifest: one document with all layers, or lines of one parent tile each (`sinks.manifest_lines`).

    Fine terrain counts only at zoom 16 (or when no zoom is given).
    """
    one = F.from_json("value", MANIFEST_LINE)
    line = F.array(F.struct(one["layer"].alias("layer"), one["zoom"].alias("zoom"), one["tiles"].alias("tiles")))
    whole = F.transform(F.map_entries(F.from_json("value", MANIFEST)), lambda e: F.struct(e["key"].alias("layer"), e["value"]["zoom"].alias("zoom"), e["value"]["tiles"].alias("tiles")))
    layers = documents.select(F.explode(F.when(one["layer"].isNotNull(), line).otherwise(whole)).alias("l")).select("l.*")
    layers = layers.filter((F.col("layer") != "terrain") | F.coalesce(F.col("zoom") == 16, F.lit(True)))
    key = F.split(F.regexp_extract("key", r"(\d+/\d+)$", 1), "/")
    return (layers.select("layer", F.explode("tiles").alias("key"))
            .select("layer", key[0].cast("bigint").alias("tx"), key[1].cast("bigint").alias("ty")))


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the lines of a written manifest, for `coverage_rows` and `rejected`; files are split among tasks."""
    return spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")


def element_rows(documents: DataFrame) -> DataFrame:
    """Map elements; a node's position becomes its one-vertex geometry."""
    e = documents.select(F.explode(F.from_json("value", ELEMENTS)["elements"]).alias("e")).select("e.*")
    point = F.array(F.struct("lon", "lat"))
    return e.select("type", "id", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
                    F.when(F.col("type") == "node", point).otherwise(F.col("geometry")).alias("geometry"), "members")


def building_rings(elements: DataFrame) -> DataFrame:
    """Rings of ways and of outer relation members with at least three vertices."""
    ways = elements.filter(F.col("type") == "way").select("id", F.col("geometry").alias("ring"))
    outer = (elements.filter(F.col("type") == "relation").select("id", F.explode("members").alias("m"))
             .filter(F.col("m.role") == "outer").select("id", F.col("m.geometry").alias("ring")))
    return ways.unionByName(outer).filter(F.size("ring") >= 3)


def pin_rows(documents: DataFrame) -> DataFrame:
    """Pins with a name and a position; kind defaults to landmark, tier to 3 within 1..3."""
    p = documents.select(F.explode(F.from_json("value", PINS)["pins"]).alias("p")).select("p.*")
    return (p.filter(F.col("name").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
            .withColumns({"kind": F.coalesce("kind", F.lit("landmark")),
                          "tier": F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce(F.col("tier").cast("int"), F.lit(3))))}))


def place_rows(documents: DataFrame) -> DataFrame:
    """Geocoder features with two coordinates, in their own order."""
    f = documents.select("path", F.posexplode(F.from_json("value", PLACES)["features"]).alias("rank", "f"))
    xy = F.col("f.geometry.coordinates")
    return f.filter(F.size(xy) == 2).select("path", "rank", xy[0].alias("lon"), xy[1].alias("lat"), "f.properties.*")


def trace_rows(documents: DataFrame) -> DataFrame:
    """One row per sample with the trace's header."""
    t = documents.select(F.from_json("value", TRACE).alias("t")).select("t.*")
    return (t.select("scenario", "renderDtSec", "sampleEveryNFrames", "totalFrames", F.posexplode("samples").alias("sample", "s"))
            .select("scenario", "renderDtSec", "sampleEveryNFrames", "totalFrames", "sample", "s.*"))


#: Kind of document -> (declared shape, what a good one must hold).
_RULES = {
    "trees": (TREES, _tree_ok), "roofs": (ROOFS, _roof_ok), "paint": (PAINT, _paint_ok),
    "manifest": (MANIFEST, lambda: F.forall(F.map_values("d"), lambda l: l["tiles"].isNotNull())),
    "manifest_lines": (MANIFEST_LINE, lambda: F.col("d.layer").isNotNull() & (F.col("d.tiles").isNotNull() | F.col("d.parts").isNotNull())),
    "elements": (ELEMENTS, lambda: F.col("d.elements").isNotNull()), "pins": (PINS, lambda: F.col("d.pins").isNotNull()),
    "places": (PLACES, lambda: F.col("d.features").isNotNull()), "trace": (TRACE, lambda: F.col("d.samples").isNotNull()),
}


#: Kinds whose documents belong to a tile.
_TILED = ("trees", "roofs", "paint")


def rejected(documents: DataFrame, kind: str) -> DataFrame:
    """(path, reason) of the documents that the reader of this kind leaves out."""
    shape, ok = _RULES[kind]
    placed = with_tile(documents) if kind in _TILED else documents
    here = _in_tile(F.lit(True)) if kind in _TILED else F.lit(True)
    bad = placed.withColumn("d", F.from_json("value", shape)).withColumn("_ok", F.coalesce(ok(), F.lit(False))).filter(~(F.col("_ok") & here))
    is_object = F.from_json("value", "map<string, string>").isNotNull()
    return bad.select("path", F.when(~is_object, "not a JSON object").when(F.col("_ok"), "no tile in the path").otherwise("unexpected shape").alias("reason"))
