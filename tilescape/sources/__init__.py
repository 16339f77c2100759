"""Readers: point tables, map elements, tile documents, coverage, pins, places, traces."""

from .documents import (building_rings, coverage_rows, element_rows, paint_parts, pin_rows, place_rows, read_manifest_lines, read_text,  # noqa: F401
                        rejected, rejected_trees, roof_rows, trace_rows, tree_rows)
from .extracts import read_elements  # noqa: F401
from .points import clip_points, nodes_for_boxes, read_points  # noqa: F401
from .tiles import in_box, misplaced, read_plain_tiles, read_tiles, with_tile  # noqa: F401
from .texts import TEXT_TAGS, element_texts, tile_fetches  # noqa: F401
