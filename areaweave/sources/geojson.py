"""GeoJSON files as tables: boundary files and exported layers."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.functions.projection import to_wgs84
from areaweave.operators.dissolve import dissolved
from areaweave.operators.scale import compute_once
from areaweave.settings import WGS84

# Nesting depth of "coordinates" differs per type, so they are read as text first.
_DEPTH = {
    "Point": 1,
    "MultiPoint": 2,
    "LineString": 2,
    "MultiLineString": 3,
    "Polygon": 3,
    "MultiPolygon": 4,
}

_GEOMETRY_JSON = "struct<type:string,coordinates:string>"
_FEATURE_JSON = f"struct<type:string,properties:map<string,string>,geometry:{_GEOMETRY_JSON}>"
_FILE_SCHEMA = (
    "type STRING, crs struct<properties:struct<name:string>>, "
    f"features array<{_FEATURE_JSON}>, geometry {_GEOMETRY_JSON}, "
    "properties map<string,string>, coordinates STRING"
)


def decode(geometry: str, srid: str) -> str:
    """GeoJSON struct<type, coordinates-as-text> to the geometry column (SQL text)."""

    def path(pairs: str) -> str:
        return f"transform({pairs}, v_ -> {g.vertex('get(v_, 0)', 'get(v_, 1)')})"

    to_parts = {
        "Point": f"CASE WHEN size(c_) > 1 THEN array(array({path('array(c_)')})) END",
        "MultiPoint": f"transform(c_, xy_ -> array({path('array(xy_)')}))",
        "LineString": f"CASE WHEN size(c_) > 0 THEN array(array({path('c_')})) END",
        "MultiLineString": f"transform(c_, path_ -> array({path('path_')}))",
        "Polygon": f"CASE WHEN size(c_) > 0 THEN array(transform(c_, path_ -> {path('path_')})) END",
        "MultiPolygon": f"transform(c_, part_ -> transform(part_, path_ -> {path('path_')}))",
    }

    def branch(gtype: str, depth: int) -> str:
        kind = "array<" * depth + "double" + ">" * depth
        parsed = f"from_json({geometry}.coordinates, '{kind}')"
        return f"WHEN '{gtype}' THEN {g.let('c_', parsed, to_parts[gtype])}"

    branches = " ".join(branch(t, d) for t, d in _DEPTH.items())
    parts = f"coalesce(CASE {geometry}.type {branches} END, array())"
    return f"CASE WHEN {geometry}.type IS NOT NULL THEN {g.geometry(f'{geometry}.type', parts, srid)} END"


def encode(geom: str) -> str:
    """The geometry column as GeoJSON geometry text (SQL text)."""

    def path(ring: str) -> str:
        return f"transform({ring}, v_ -> array(v_.x, v_.y))"

    head = f"get({geom}.parts, 0)"
    coordinates = {
        "Point": f"get({path(g.vertices(geom))}, 0)",
        "MultiPoint": path(g.vertices(geom)),
        "LineString": path(f"get({head}, 0)"),
        "MultiLineString": f"transform({g.rings(geom)}, path_ -> {path('path_')})",
        "Polygon": f"transform({head}, path_ -> {path('path_')})",
        "MultiPolygon": f"transform({geom}.parts, part_ -> transform(part_, path_ -> {path('path_')}))",
    }
    branches = " ".join(
        f"WHEN '{t}' THEN to_json(named_struct('type', '{t}', 'coordinates', {c}))"
        for t, c in coordinates.items()
    )
    return f"CASE {geom}.gtype {branches} END"


def srid_of(name: Column) -> Column:
    """EPSG number in a "crs" member; no member means longitude/latitude."""
    code = F.nullif(F.regexp_extract(name, r"EPSG:+(\d+)", 1), F.lit(""))
    return F.coalesce(code.cast("int"), F.lit(WGS84))


def path_key(path: Column) -> Column:
    """One spelling for a path as given and as Spark reports it: decoded, absolute, without "file:".

    Paths with another scheme keep it; relative ones are taken from the working directory.
    """
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(F.coalesce(decoded, path), "^file:/+", "/")
    relative = ~plain.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
    return F.when(relative, F.concat(F.lit(f"{os.getcwd()}/"), F.regexp_replace(plain, r"^(\./)+", ""))).otherwise(plain)


def read_boundary_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per boundary file: manual_path, display_name, geom and extent (WGS84), problem.

    A file holds a FeatureCollection, a Feature or a bare geometry.  Its first feature is
    the boundary; the ``extent``, whose centroid chooses the zone, is its outline, or the centroid of the
    union of all features' outlines where there are several.  A file without features, or with null geometries only, has a
    problem instead.
    """
    raw = (
        spark.read.schema(_FILE_SCHEMA)
        .json(paths if isinstance(paths, str) else list(paths), multiLine=True)
        .select("*", path_key(F.col("_metadata.file_path")).alias("manual_path"))
    )
    bare = F.struct(F.col("type").alias("type"), F.col("coordinates").alias("coordinates"))
    single = F.struct(
        F.lit("Feature").alias("type"),
        F.col("properties").alias("properties"),
        F.coalesce(F.col("geometry"), F.when(F.col("coordinates").isNotNull(), bare)).alias("geometry"),
    )
    features = F.coalesce(F.col("features"), F.array(single))
    shapes = F.transform(features, lambda f: f["geometry"])
    some = F.coalesce(F.exists(shapes, lambda s: s["type"].isNotNull()), F.lit(False))
    picked = raw.select(
        "manual_path",
        F.element_at(F.get(features, F.lit(0))["properties"], "display_name").alias("display_name"),
        shapes.alias("shapes"),
        srid_of(F.col("crs.properties.name")).alias("srid"),
        F.when(~some, F.lit("no_geometry")).alias("problem"),
    )
    decoded = compute_once(picked, shapes=f"transform(shapes, s_ -> {decode('s_', 'srid')})")
    parts = f"flatten(transform(filter(shapes, s_ -> {g.is_area('s_')}), s_ -> s_.parts))"
    joined = compute_once(decoded, shape="get(shapes, 0)", every=g.geometry("'MultiPolygon'", parts, "srid"))
    placed = compute_once(joined, geom=to_wgs84("shape"), extent=to_wgs84("every"))
    several = placed.where(F.size("extent.parts") > 1).select("manual_path", F.col("extent").alias("geom"))
    middle = dissolved(several, "manual_path").select("manual_path", F.expr(g.point("x", "y")).alias("_middle"))
    placed = placed.join(middle, "manual_path", "left").withColumn("extent", F.coalesce("_middle", "extent"))
    return placed.select("manual_path", "display_name", "geom", "extent", "problem")


def read_manual(spark: SparkSession, paths: Iterable[str]) -> DataFrame | None:
    """``read_boundary_files`` of those paths that exist, in one scan; None if there are none."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        place = hadoop.Path(path)
        return bool(place.getFileSystem(conf).globStatus(place))

    found = [path for path in paths if exists(path)]
    return read_boundary_files(spark, found) if found else None


def read_layers(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Exported layers back as rows; lga_id and layer come from the folder names.

    With the ``manifest`` (see read_manifest) only layers that the last run of their area
    exported: a folder left by an earlier run does not count.
    """
    lines = spark.read.schema(
        "type STRING, properties struct<osmid:bigint,name:string,element_type:string,srid:int>, "
        f"geometry {_GEOMETRY_JSON}, lga_id STRING, layer STRING"
    ).json(path)
    if manifest is not None:
        exported = manifest.where("status = 'exported'").select("lga_id", "layer").distinct()
        lines = lines.join(exported, ["lga_id", "layer"], "left_semi")
    return lines.select(
        "lga_id",
        "layer",
        "properties.element_type",
        "properties.osmid",
        "properties.name",
        F.expr(decode("geometry", "properties.srid")).alias("geom"),
    )
