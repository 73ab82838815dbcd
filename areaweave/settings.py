"""Fixed values of the extraction contract, and the few tuning parameters."""

from __future__ import annotations

# --- Fixed values: results are only comparable if these stay as they are -----

# layer -> {tag key: True (any value) | one value | list of values}
DEFAULT_RULES: dict[str, dict] = {
    "roads": {"highway": True},
    "buildings": {"building": True},
    "waterways": {"waterway": True, "natural": "water"},
    "landuse": {"landuse": True},
    "health_facilities": {"amenity": ["hospital", "clinic", "pharmacy"]},
    "schools": {"amenity": "school"},
}

# Layers whose outlines become centroid points.
POINT_LAYERS = ("health_facilities", "schools")

# Bottom-to-top order of the preview.
DRAW_ORDER = ("landuse", "waterways", "roads", "buildings", "health_facilities", "schools")

# Fields a preview shows per layer.
TOOLTIP_FIELDS = {
    "buildings": ["osmid", "name"],
    "health_facilities": ["osmid", "name"],
    "schools": ["osmid", "name"],
    "roads": ["osmid"],
    "waterways": ["osmid", "name"],
    "landuse": ["osmid"],
}

GEOMETRY_CATEGORY = {
    "Point": "point",
    "MultiPoint": "point",
    "LineString": "line",
    "MultiLineString": "line",
    "Polygon": "polygon",
    "MultiPolygon": "polygon",
}

COUNTRY = "Nigeria"
COUNTRY_BBOX = (2.5, 4.0, 15.0, 14.0)  # lon min, lat min, lon max, lat max
MIN_AREA_KM2 = 2
MAX_AREA_KM2 = 10_000
WGS84 = 4326
FALLBACK_SRID = 32631
TOKEN_PATTERN = r"pk\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"

# Phrase that marks a layer without a feature in the warnings.
EMPTY_LAYER = "returned no features"

# --- Tuning parameters -------------------------------------------------------

# Longitude/latitude are compared as integers in 1e-7 degree.
FIXED_POINT = 10_000_000
# Steps in a metre for the same purpose, and the steps across which products stay exact.
METRIC_POINT = 1_000
EXACT_EXTENT = 3_000_000_000

# Side of the finest grid cell of the spatial join, in degrees.
CELL_DEGREES = 0.125

# A side is broadcast only if its measured size stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024

# Replicas of the boundary index when it is too large to broadcast.
SALTS = 16
