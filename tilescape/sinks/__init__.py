"""Writers: tile documents, terrain rows, coverage manifest."""

from .documents import paint_documents, roof_documents, tree_documents, write_documents  # noqa: F401
from .manifest import (coverage_of_paths, known_coverage, manifest_entries, manifest_json, manifest_key_range, manifest_lines,  # noqa: F401
                       scan_assets, write_manifest, write_manifest_lines)
from .terrain import terrain_rows, write_terrain  # noqa: F401
