"""The scalar functions as SQL functions of a session.

They are SQL expressions that the optimizer inlines, so a query over registered views can
use the same results as the DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = (
    "mercator_x(lon DOUBLE) RETURNS DOUBLE RETURN radians(lon) * 6378137.0D",
    "mercator_y(lat DOUBLE) RETURNS DOUBLE RETURN ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0D",
    "mercator_lon(x DOUBLE) RETURNS DOUBLE RETURN degrees(x / 6378137.0D)",
    "mercator_lat(y DOUBLE) RETURNS DOUBLE RETURN degrees(2 * atan(exp(y / 6378137.0D)) - pi() / 2)",
    "tile_x(lon DOUBLE, zoom INT) RETURNS BIGINT RETURN greatest(0L, least(shiftleft(1L, zoom) - 1, CAST(floor((lon + 180) / 360 * shiftleft(1L, zoom)) AS BIGINT)))",
    "tile_y(lat DOUBLE, zoom INT) RETURNS BIGINT RETURN greatest(0L, least(shiftleft(1L, zoom) - 1, "
    "CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * shiftleft(1L, zoom)) AS BIGINT)))",
    "tile_lon(x DOUBLE, zoom INT) RETURNS DOUBLE RETURN x / shiftleft(1L, zoom) * 360 - 180",
    "tile_lat(y DOUBLE, zoom INT) RETURNS DOUBLE RETURN degrees(atan(sinh(pi() * (1 - 2 * y / shiftleft(1L, zoom)))))",
    "tile_parent(v BIGINT, levels INT) RETURNS BIGINT RETURN shiftright(v, levels)",
    "to_e7(degrees DOUBLE) RETURNS BIGINT RETURN CAST(bround(degrees * 1e7D, 0) AS BIGINT)",
    "to_dm(metres DOUBLE) RETURNS BIGINT RETURN CAST(bround(metres * 10, 0) AS BIGINT)",
    "to_cdeg(degrees DOUBLE) RETURNS BIGINT RETURN pmod(CAST(bround(degrees * 100, 0) AS BIGINT), 36000L)",
    "from_e7(v BIGINT) RETURNS DOUBLE RETURN v / 1e7D",
    "from_dm(v BIGINT) RETURNS DOUBLE RETURN v / 10.0D",
    "terrarium_decode(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN r * 256 + g + b / 256 - 32768",
    "sane_height(h DOUBLE, area DOUBLE) RETURNS DOUBLE RETURN CASE WHEN h > 400 OR (h > 150 AND area < 100) THEN 5.0D "
    "WHEN h > 50 AND area > 25000 THEN least(h, 20.0D) ELSE h END",
    "eave_trusted(eave DOUBLE, height DOUBLE) RETURNS BOOLEAN RETURN eave >= 2 AND eave >= 0.4D * height",
    "wash_multiplier(v DOUBLE) RETURNS DOUBLE RETURN 0.6D + v / 255 * 0.8D",
)


def register(spark: SparkSession) -> list[str]:
    """Create every function as a temporary function; returns their names."""
    for text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    return [t.split("(", 1)[0] for t in FUNCTIONS]
