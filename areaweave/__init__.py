"""Map features and area boundaries in, clean comparable layers out, on Spark."""

from areaweave.operators.audit import (
    category_counts,
    export_manifest,
    fold_warnings,
    pending_requests,
    run_records,
)
from areaweave.operators.boundary import (
    BoundaryResolutionError,
    Resolution,
    resolve_boundaries,
    target_srid,
)
from areaweave.operators.clean import Cleaned, clean_layers
from areaweave.operators.layers import Extraction, extract_features, extract_layers, layer_counts
from areaweave.operators.report import (
    compare_lgas,
    layer_extent,
    layer_report,
    preview_feed,
    redact_tokens,
)
from areaweave.operators.rules import LayerExtractionError, assign_layers, rules_frame
from areaweave.operators.spatial import spatial_join
from areaweave.plans.pipeline import Run, export_layers, extract_lgas
from areaweave.settings import DEFAULT_RULES
from areaweave.sinks.files import read_runs, write_by_category, write_geojson, write_runs
from areaweave.sources.elements import (
    assemble_points,
    assemble_relations,
    assemble_ways,
    read_elements,
    way_paths,
    write_elements,
)
from areaweave.sources.geojson import read_boundary_files, read_layers

__all__ = [
    "BoundaryResolutionError",
    "Cleaned",
    "DEFAULT_RULES",
    "Extraction",
    "LayerExtractionError",
    "Resolution",
    "Run",
    "assemble_points",
    "assemble_relations",
    "assemble_ways",
    "assign_layers",
    "category_counts",
    "clean_layers",
    "compare_lgas",
    "export_layers",
    "export_manifest",
    "extract_features",
    "extract_layers",
    "extract_lgas",
    "fold_warnings",
    "layer_counts",
    "layer_extent",
    "layer_report",
    "pending_requests",
    "preview_feed",
    "read_boundary_files",
    "read_elements",
    "read_layers",
    "read_runs",
    "redact_tokens",
    "resolve_boundaries",
    "rules_frame",
    "run_records",
    "spatial_join",
    "target_srid",
    "way_paths",
    "write_by_category",
    "write_elements",
    "write_geojson",
    "write_runs",
]
