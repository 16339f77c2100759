"""Registered queries over the derived inputs."""

from .registry import ORACLE, QUERIES  # noqa: F401
from . import (bake_queries, document_queries, line_queries, raster_queries, scalar_queries, solid_queries, track_queries,  # noqa: F401
               voxel_queries)
