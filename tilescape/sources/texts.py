"""Texts of map elements and of tile documents, for operators that work on text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tilescape.functions import geo

# Tags that hold free text.
TEXT_TAGS = ("name", "description", "note", "inscription", "fixme")
#: Ids are unique per type only: the number of the type is in the lowest two bits of extract_id.
ELEMENT_TYPES = ("node", "way", "relation")


def element_texts(elements: DataFrame, tags: Sequence[str] = TEXT_TAGS, zoom: int = 14) -> DataFrame:
    """(extract_id, area, type, id, text) of each of `elements` (type, id, tags, geometry, members) that has text tags.

    The text joins the element's text tags by line feeds, in the order of `tags`. The area is
    the `zoom/x/y` tile of its first vertex (a relation's: of its first member), null where
    it has none. Elements whose text tags are all missing or empty are left out; an unknown
    type has a null extract_id.
    """
    values = F.filter(F.array(*[F.element_at("tags", F.lit(t)) for t in tags]), lambda v: v.isNotNull() & (v != ""))
    first = F.coalesce(F.get("geometry", F.lit(0)), F.get(F.get("members", F.lit(0))["geometry"], F.lit(0)))
    kind = F.array_position(F.array(*[F.lit(t) for t in ELEMENT_TYPES]), F.col("type"))
    found = elements.select("type", "id", values.alias("_v"), first.alias("_p"), kind.alias("_k")).filter(F.size("_v") > 0)
    tile = F.concat_ws("/", F.lit(zoom), geo.tile_x("_p.lon", zoom), geo.tile_y("_p.lat", zoom))
    return found.select(F.when(F.col("_k") > 0, F.shiftleft("id", 2) + F.col("_k") - 1).alias("extract_id"),
                        F.when(F.col("_p.lon").isNotNull() & F.col("_p.lat").isNotNull(), tile).alias("area"), "type", "id", F.array_join("_v", "\n").alias("text"))


def tile_fetches(documents: DataFrame, host: str = "tiles.example.org") -> DataFrame:
    """(fetch_id, url, body): one fetched document per row of `documents` (path, value).

    The url is the host and the document's path without its scheme; the id is a hash of both
    path and content, so a document read again has the same one.
    """
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9+.-]+:/*", "/")
    return documents.select(F.xxhash64("path", "value").alias("fetch_id"), F.concat(F.lit(f"https://{host}"), path).alias("url"), F.col("value").alias("body"))
