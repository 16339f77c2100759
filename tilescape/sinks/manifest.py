"""Coverage manifest from the files that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tilescape.operators.coverage import LAYERS, OPTIONAL_LAYERS
from tilescape.session import cut


def coverage_of_paths(paths: DataFrame, path="path") -> DataFrame:
    """Layer, zoom and tile of asset paths (`layer/zoom/x/y.ext`, or key=value folders)."""
    plain = r"([a-z]+)/(\d+)/(\d+)/(\d+)\.\w+$"
    keyed = r"layer=([a-z]+)/zoom=(\d+)/tx=(\d+)/ty=(\d+)/"
    pick = lambda i: F.coalesce(F.nullif(F.regexp_extract(path, plain, i), F.lit("")), F.nullif(F.regexp_extract(path, keyed, i), F.lit("")))
    return (paths.select(pick(1).alias("layer"), pick(2).cast("int").alias("zoom"), pick(3).cast("bigint").alias("tx"), pick(4).cast("bigint").alias("ty"))
            .filter(F.col("layer").isNotNull()).distinct())


def scan_assets(spark: SparkSession, root: str) -> DataFrame:
    """Asset paths under a root; only names are read, never the content."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))


def manifest_entries(coverage: DataFrame) -> DataFrame:
    """One row per layer: zoom and the sorted `x/y` keys, as JSON text of that layer.

    The required layers always appear; optional ones only when they have tiles. Keys are
    collected per layer because a manifest is a list of names by definition.
    """
    spark = coverage.sparkSession
    fixed = spark.createDataFrame([(k, z) for k, z in LAYERS.items()], "layer string, zoom int")
    known = coverage.join(fixed, ["layer", "zoom"], "left_semi")
    keys = known.groupBy("layer").agg(F.sort_array(F.collect_set(F.concat_ws("/", "tx", "ty"))).alias("tiles"))
    rows = fixed.join(keys, "layer", "left").filter(F.col("tiles").isNotNull() | ~F.col("layer").isin(*OPTIONAL_LAYERS))
    return rows.select("layer", F.to_json(F.struct("zoom", F.coalesce("tiles", F.array().cast("array<string>")).alias("tiles"))).alias("json"))


def manifest_json(coverage: DataFrame) -> DataFrame:
    """The manifest as one JSON row."""
    parts = manifest_entries(coverage).agg(F.sort_array(F.collect_list(F.concat(F.lit('"'), "layer", F.lit('":'), "json"))).alias("p"))
    return parts.select(F.concat(F.lit("{"), F.concat_ws(",", "p"), F.lit("}")).alias("json"))


def write_manifest(coverage: DataFrame, path: str) -> None:
    manifest_json(coverage).coalesce(1).write.mode("overwrite").text(path)


#: Zoom levels between a line and the parent tile it is written for: at most 4,096 names a line.
FOLD = 6


def known_coverage(coverage: DataFrame) -> DataFrame:
    """Rows of `coverage` (layer, zoom, tx, ty) whose layer has that zoom, each once."""
    fixed = coverage.sparkSession.createDataFrame([(k, z) for k, z in LAYERS.items()], "layer string, zoom int")
    return coverage.select("layer", F.col("zoom").cast("int").alias("zoom"), "tx", "ty").join(fixed, ["layer", "zoom"], "left_semi").distinct()


def manifest_lines(coverage: DataFrame) -> DataFrame:
    """(layer, zoom, level, px, py, n, json): the manifest as one line per parent tile, folded upwards.

    The lowest lines list the `x/y` keys of the tiles below a parent FOLD levels up (`tiles`); lines
    above list the parents below them (`parts`, as `level/x/y`) and how many tiles those hold,
    up to level 0. No group holds more than one parent's children. A required layer without
    tiles has one empty line at level 0, an optional one has none.
    """
    spark = coverage.sparkSession
    up = F.greatest(F.lit(0), F.col("level") - FOLD)
    parents = ["layer", "zoom", "_up", "px", "py"]

    def fold(rows: DataFrame, name: Column, count: Column) -> DataFrame:
        above = lambda c: F.expr(f"shiftright({c}, level - _up)")
        return (rows.withColumn("_up", up).select("layer", "zoom", "_up", above("x").alias("px"), above("y").alias("py"), name.alias("name"), count.alias("n"))
                .groupBy(*parents).agg(F.sort_array(F.collect_list("name")).alias("names"), F.sum("n").alias("n")).withColumnRenamed("_up", "level"))

    def line(rows: DataFrame, what: str) -> DataFrame:
        head = F.struct("layer", "zoom", "level", F.concat_ws("/", "px", "py").alias("parent"), "n", F.col("names").alias(what))
        return rows.select("layer", "zoom", "level", "px", "py", "n", F.to_json(head).alias("json"))

    tiles = known_coverage(coverage).select("layer", "zoom", F.col("zoom").alias("level"), F.col("tx").alias("x"), F.col("ty").alias("y"))
    rows = cut(fold(tiles, F.concat_ws("/", "x", "y"), F.lit(1).cast("bigint")))
    out = line(rows, "tiles")
    for _ in range(-(-max(LAYERS.values()) // FOLD) - 1):
        lower = rows.filter("level > 0").select("layer", "zoom", "level", F.col("px").alias("x"), F.col("py").alias("y"), "n")
        rows = fold(lower, F.concat_ws("/", "level", "x", "y"), F.col("n"))
        out = out.unionByName(line(rows, "parts"))
    required = [(k, z) for k, z in LAYERS.items() if k not in OPTIONAL_LAYERS]
    empty = (spark.createDataFrame(required, "layer string, zoom int").join(tiles.select("layer").distinct(), "layer", "left_anti")
             .select("layer", "zoom", F.lit(0).alias("level"), *[F.lit(0).cast("bigint").alias(c) for c in ("px", "py", "n")], F.array().cast("array<string>").alias("names")))
    return out.unionByName(line(empty, "parts"))


def write_manifest_lines(coverage: DataFrame, path: str) -> None:
    """Text files of manifest lines, one folder per layer."""
    manifest_lines(coverage).select("layer", "json").write.mode("overwrite").partitionBy("layer").text(path)


def manifest_key_range(coverage: DataFrame) -> DataFrame:
    """(layer, first_key, last_key, n): ends of a layer's sorted keys, without gathering them."""
    key = F.concat_ws("/", "tx", "ty")
    return known_coverage(coverage).groupBy("layer").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n"))
