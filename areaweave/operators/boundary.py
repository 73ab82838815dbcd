"""Requests -> accepted boundaries and rejects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.functions import text
from areaweave.functions.projection import to_utm, to_wgs84, utm_srid
from areaweave.operators.scale import compute_once, through_table
from areaweave.sources.geojson import path_key
from areaweave.settings import (
    COUNTRY_BBOX,
    FALLBACK_SRID,
    MAX_AREA_KM2,
    MIN_AREA_KM2,
)


class BoundaryResolutionError(Exception):
    """A requested area has no boundary that can be trusted."""


@dataclass(frozen=True)
class Resolution:
    """``accepted`` boundaries and ``rejected`` requests, one row per area."""

    accepted: DataFrame
    rejected: DataFrame


def target_srid(geom: str) -> str:
    """UTM zone of a WGS84 boundary's centroid, or the fallback without one."""
    zone = g.let("at_", g.centroid(geom), utm_srid("at_.x", "at_.y"))
    return f"coalesce({zone}, {FALLBACK_SRID})"


def normalise_requests(requests: DataFrame) -> DataFrame:
    """Trimmed names, blank state as null, one row per area.

    Needs lga_name and state_name; manual_path is optional.  Repeats of an area
    are folded, as one run answers them all; one with a manual file goes first.
    """
    manual = F.col("manual_path") if "manual_path" in requests.columns else F.lit(None).cast("string")
    clean = requests.select(
        text.blank_to_null(F.col("lga_name")).alias("lga_name"),
        text.blank_to_null(F.col("state_name")).alias("state_name"),
        text.blank_to_null(manual).alias("manual_path"),
    ).withColumn("lga_id", text.lga_id(F.coalesce("lga_name", F.lit("")), F.col("state_name")))
    row = F.struct("lga_name", "state_name", "manual_path")
    one = F.min_by(row, F.struct(F.col("manual_path").isNull(), row))
    return clean.groupBy("lga_id").agg(one.alias("r")).select("lga_id", "r.*")


def request_key() -> Column:
    return F.lower(text.lookup_key(F.col("lga_name"), F.col("state_name")))


def gazetteer_by_key(gazetteer: DataFrame) -> DataFrame:
    """Every place under its key with and without the state."""
    full = text.lookup_key(text.trimmed(F.col("lga_name")), text.trimmed(F.col("state_name")))
    short = text.lookup_key(text.trimmed(F.col("lga_name")), F.lit(None).cast("string"))
    keys = F.array_distinct(F.array(F.lower(full), F.lower(short)))
    return gazetteer.select(
        F.explode(keys).alias("key"),
        "position",
        F.struct("lga_name", "state_name", "display_name", "geom").alias("place"),
    )


def look_up(requests: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Requests with their place (first by position), match count and ambiguity.

    Places nobody asked for are dropped before anything wide is shuffled, and the
    pick is an aggregate that combines on the map side, so a name shared by very
    many places does not gather in one task.
    """
    asked = requests.withColumn("key", request_key())
    wanted = gazetteer_by_key(gazetteer).join(asked.select("key").distinct(), "key", "left_semi")
    picked = wanted.groupBy("key").agg(
        F.min_by("place", "position").alias("place"),
        F.min("position").alias("position"),
        F.count(F.lit(1)).alias("matches"),
    )
    return asked.join(picked, "key", "left").withColumn("ambiguous", F.coalesce(F.col("matches") > 1, F.lit(False)))


def hard_checks(places: DataFrame) -> DataFrame:
    """Adds centroid, target_srid, area_km2, reason_code and message.

    First failure wins, in the order empty, outside, small, large; the ends of
    all ranges pass.
    """
    lon0, lat0, lon1, lat1 = COUNTRY_BBOX
    inside = f"centroid.x BETWEEN {lon0} AND {lon1} AND centroid.y BETWEEN {lat0} AND {lat1}"
    code = (
        f"CASE WHEN NOT {g.usable('geom')} THEN 'empty' WHEN NOT ({inside}) THEN 'outside' "
        f"WHEN area_km2 < {MIN_AREA_KM2} THEN 'small' WHEN area_km2 > {MAX_AREA_KM2} THEN 'large' END"
    )
    texts = {
        "empty": "'Boundary from \\'%s\\' is empty or invalid.', boundary_source",
        "outside": "'Boundary from \\'%s\\' is centred at (%.2f, %.2f), outside Nigeria: probably another place "
        "of that name. Consider a manual boundary file.', boundary_source, centroid.x, centroid.y",
        "small": "'Boundary from \\'%s\\' is implausibly small (%.2f km^2): probably a point or a single "
        "feature. Consider a manual boundary file.', boundary_source, area_km2",
        "large": "'Boundary from \\'%s\\' is implausibly large (%.0f km^2): probably a state or the whole "
        "country. Consider a manual boundary file.', boundary_source, area_km2",
    }
    cases = " ".join(f"WHEN '{c}' THEN format_string({t})" for c, t in texts.items())
    shaped = compute_once(places, geom=to_wgs84("geom"))
    centred = compute_once(shaped, centroid=g.centroid("geom"))
    zone = utm_srid("centroid.x", "centroid.y")
    if "extent" in places.columns:  # a file of several outlines: all of them choose the zone
        zone = f"coalesce({g.let('at_', g.centroid('extent'), utm_srid('at_.x', 'at_.y'))}, {zone})"
    zoned = compute_once(centred, target_srid=f"coalesce({zone}, {FALLBACK_SRID})")
    square_metres = g.let("flat_", to_utm("geom", "target_srid"), g.area("flat_"))
    measured = compute_once(zoned, area_km2=f"{square_metres} / 1000000D")
    return compute_once(compute_once(measured, reason_code=code), message=f"CASE reason_code {cases} END")


def resolve_boundaries(
    requests: DataFrame,
    gazetteer: DataFrame,
    manual: DataFrame | None = None,
    strict: bool = False,
) -> Resolution:
    """Find and check the boundary of every requested area.

    ``requests``: lga_name, state_name[, manual_path]; ``gazetteer``: lga_name,
    state_name, display_name, geom, position; ``manual``: see read_boundary_files,
    it wins over the gazetteer.  One bad area is a rejected row and the others go
    on; ``strict`` raises on the first one instead.
    """
    asked = normalise_requests(requests)
    found = look_up(asked, gazetteer)
    if manual is not None:
        extent = F.col("extent") if "extent" in manual.columns else F.lit(None).cast(g.GEOMETRY)
        files = manual.select(
            path_key(F.col("manual_path")).alias("_path"), F.struct("display_name", "geom", extent.alias("extent"), "problem").alias("file")
        )
        found = found.withColumn("_path", path_key(F.col("manual_path"))).join(files, "_path", "left")
    else:
        nothing = F.struct(
            F.lit(None).cast("string").alias("display_name"),
            F.lit(None).cast(g.GEOMETRY).alias("geom"),
            F.lit(None).cast(g.GEOMETRY).alias("extent"),
            F.lit(None).cast("string").alias("problem"),
        )
        found = found.withColumn("file", F.when(F.lit(False), nothing))
    by_file = F.col("manual_path").isNotNull()
    placed = found.select(
        "lga_id",
        "lga_name",
        "state_name",
        "ambiguous",
        F.when(by_file, F.col("file.geom")).otherwise(F.col("place.geom")).alias("geom"),
        F.when(by_file, F.col("file.extent")).alias("extent"),
        F.when(by_file, F.col("file.display_name")).otherwise(F.col("place.display_name")).alias("display_name"),
        F.when(by_file, F.concat(F.lit("manual:"), "manual_path"))
        .otherwise(F.concat(F.lit("osm_geocode:"), text.lookup_key(F.col("lga_name"), F.col("state_name"))))
        .alias("boundary_source"),
        F.when(F.col("lga_name").isNull(), "blank_name")
        .when(by_file & F.col("file").isNull(), "no_file")
        .when(by_file, F.col("file.problem"))
        .when(F.col("place").isNull(), "no_match")
        .alias("lookup_code"),
    )
    # Read for the accepted and for the rejected, so it passes through a table.
    judged = compute_once(hard_checks(placed), reason_code=F.coalesce("lookup_code", "reason_code"))
    judged = through_table(judged)
    lookup_message = F.when(F.col("lookup_code") == "blank_name", F.lit("Enter the name of an area.")).when(
        F.col("lookup_code").isNotNull(),
        F.format_string(
            "No boundary from '%s' (%s). Consider a manual boundary file.", "boundary_source", "lookup_code"
        ),
    )
    accepted = judged.where(F.col("reason_code").isNull()).select(
        "lga_id",
        "lga_name",
        "state_name",
        "geom",
        "target_srid",
        F.floor(F.col("area_km2") * 1_000_000 + F.lit(0.5)).alias("area_m2"),
        "ambiguous",
        "boundary_source",
        text.name_notes(F.col("display_name"), F.col("lga_name"), F.col("state_name")).alias("validation_warnings"),
    )
    rejected = judged.where(F.col("reason_code").isNotNull()).select(
        "lga_id",
        "lga_name",
        "state_name",
        "reason_code",
        F.coalesce(lookup_message, F.col("message")).alias("message"),
    )
    if strict:
        first = rejected.agg(F.min_by("message", F.struct("lga_name", "state_name", "lga_id"))).head()[0]
        if first is not None:
            raise BoundaryResolutionError(first)
    return Resolution(accepted, rejected)
